"""One query per operator: the operator over a whole table with production parameters.

Queries take (spark, sf_dir). Where SQL can express the result, ``SQL`` holds it.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duesflow.llm import collide, exact, knn, licences, lm, matrices, mixing, neardup, packing, spelling, toxicity, trie, warc
from duesflow.llm.util import crc_part, shared_folder, stored_table


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_matrices(spark: SparkSession, root: str) -> DataFrame:
    """Packed rows of the shards written from all documents, read back from the files."""
    shards = stored_table(matrices.write_matrices(table(spark, root, "documents"), tokenizer_path(), shared_folder(spark)))
    rows = matrices.read_matrices(shards.repartition(max(1, min(shards.count(), 10_000)), "shard"))
    return rows.select("sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "resets", F.crc32("ids").alias("ids_crc32"))


def op2_maxent_scores(spark: SparkSession, root: str) -> DataFrame:
    scored = lm.score_texts(table(spark, root, "documents"), crc_part("doc_id", 7, 2))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_source_mix(spark: SparkSession, root: str) -> DataFrame:
    rows, sources, pieces = mixing.mix_sources(table(spark, root, "documents"))
    taken = pieces.groupBy("uid").agg(F.sum("length").alias("taken"))
    known = sources.select(F.col("source").alias("_source"), "source_size", "target")
    return (rows.join(taken, "uid", "left").join(known, F.col("source").eqNullSafe(F.col("_source")))
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def op4_open_window_packing(spark: SparkSession, root: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, root, "documents"), tokenizer_path())
    return packed.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).alias("length"), F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op5_warc_members(spark: SparkSession, root: str) -> DataFrame:
    records = warc.archive_pages(table(spark, root, "pages"), shared_folder(spark))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_voronoi_topk(spark: SparkSession, root: str) -> DataFrame:
    return knn.top_inner_products(table(spark, root, "embeddings"))


def op7_exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    return exact.exact_groups(table(spark, root, "documents"))


def op8_weighted_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return neardup.near_groups(table(spark, root, "documents"))


def op9_licence_spans(spark: SparkSession, root: str) -> DataFrame:
    return licences.scan_licences(table(spark, root, "documents"))


def op10_toxic_sentences(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    model = toxicity.fit(docs, table(spark, root, "labels"), lambda c: F.crc32(c.cast("string")) % 3 != 1)
    return toxicity.score(docs, model).select(
        "doc_id", crc_part("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
        F.col("sentence"), F.col("sentence_score"))


def op11_spelling_variants(spark: SparkSession, root: str) -> DataFrame:
    """Words of all documents with their near words counted, their usual form and its root."""
    return spelling.variant_groups(spelling.count_words(table(spark, root, "documents")))


def op12_collision_search(spark: SparkSession, root: str) -> DataFrame:
    return collide.nearest_by_collisions(table(spark, root, "embeddings"))


def rebuilt_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, role, text) and (conv_id, length): each conversation c with its first turns replaced.

    h = crc32(c as text) % 4; the first h turns of conversation c - c % 20 (all, if fewer;
    none, if there is none) come before what c has after its own first h. A remainder has the sign of c.
    """
    placed = stored_table(trie.number_turns(turns))
    h = F.crc32(F.col("conv_id").cast("string")) % 4
    sizes = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select(
        "conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = stored_table(sizes.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_own", F.lit(0)))))
    heads = placed.where((F.col("conv_id") % 20 == 0) & (F.col("pos") < 3)).withColumnRenamed("conv_id", "base")
    first = convs.join(heads, "base").where(F.col("pos") < F.col("h")).select("conv_id", "pos", "role", "text")
    rest = placed.join(convs.select("conv_id", "h", "head"), "conv_id").where(F.col("pos") >= F.col("h")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "role", "text")
    length = F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return first.unionByName(rest), convs.select("conv_id", length.alias("length"))


def op13_prefix_trie(spark: SparkSession, root: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie.prefix_trie(*rebuilt_conversations(table(spark, root, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_token_matrices, op2_maxent_scores, op3_source_mix, op4_open_window_packing, op5_warc_members,
        op6_voronoi_topk, op7_exact_dedup, op8_weighted_near_dedup, op9_licence_spans, op10_toxic_sentences,
        op11_spelling_variants, op12_collision_search, op13_prefix_trie)}

def _crc32_sql(text: str) -> str:
    """crc32 of the UTF-8 bytes of an ASCII or Latin-1 text in SQL, bit by bit."""
    digit = "strpos('0123456789ABCDEF', substr(hex(encode({0})), {1}, 1)) - 1"
    byte = f"({digit.format(text, '2 * i - 1')}) * 16 + {digit.format(text, '2 * i')}"
    data = f"[CAST({byte} AS BIGINT) FOR i IN range(1, octet_length(encode({text})) + 1)]"
    bits = ("list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), "
            "lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))")
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda a, b: {bits}), 4294967295)"


SQL: dict[str, str] = {
    "op3_source_mix": r"""
        WITH RECURSIVE sized AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                 md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
          FROM documents),
        totals AS (
          SELECT source, sum(size) AS source_size,
                 [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight
          FROM sized GROUP BY source),
        level(turn, x) AS (
          SELECT 0, CAST(0 AS DOUBLE)
          UNION ALL
          SELECT turn + 1,
                 (SELECT (1.5 * sum(source_size) - coalesce(sum(2 * source_size) FILTER (2 * source_size < x * weight), 0))
                         / sum(weight) FILTER (NOT 2 * source_size < x * weight) FROM totals)
          FROM level WHERE turn < (SELECT count(*) + 1 FROM totals)),
        targets AS (
          SELECT source, source_size, least(2 * source_size, (SELECT max(x) FROM level) * weight) AS target FROM totals),
        lines AS (
          SELECT sized.doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS quota,
                 coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY k, sized.doc_id
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
          FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
               CAST(least(greatest(quota - start, 0), size) + least(greatest(quota - source_size - start, 0), size) AS BIGINT) AS taken
        FROM lines""",
    "op6_voronoi_topk": """
        WITH whole AS (
          SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT q.vec_id AS query_id, d.vec_id,
                 CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM whole q JOIN whole d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op5_warc_members": """
        WITH bodies AS (
          SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        sized AS (
          SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM bodies),
        firsts AS (SELECT digest, min(page_id) AS first FROM sized WHERE n >= 100 GROUP BY digest)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sized.digest AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
        FROM sized LEFT JOIN firsts ON sized.digest = firsts.digest""",
    "op7_exact_dedup": r"""
        WITH plain AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM plain""",
    "op11_spelling_variants": rf"""
        WITH RECURSIVE runs AS (
          SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
                                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
          FROM documents),
        counted AS (
          SELECT run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS name
          FROM runs GROUP BY doc_id, run HAVING length(run) >= 7),
        hashed AS (SELECT run, n, {_crc32_sql("name")} AS h FROM counted),
        slipped AS (
          SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
                         ELSE run END AS word
          FROM hashed),
        words AS (
          SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        cuts AS (
          SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
          FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
        links AS (
          SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, a.rest FROM cuts a JOIN words w ON w.word = a.rest
          UNION SELECT a.rest, a.word FROM cuts a JOIN words w ON w.word = a.rest),
        ranked AS (
          SELECT l.word, l.other, o.n AS other_n, count(*) OVER (PARTITION BY l.word) AS n_near,
                 row_number() OVER (PARTITION BY l.word ORDER BY o.n DESC, l.other) AS place
          FROM links l JOIN words o ON o.word = l.other),
        formed AS (
          SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form,
                 CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
          FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1),
        chains(word, root, step) AS (
          SELECT word, word, 0 FROM formed
          UNION ALL SELECT c.word, f.form, step + 1 FROM chains c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
        roots AS (SELECT word, arg_max(root, step) AS root FROM chains GROUP BY word)
        SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN roots r ON r.word = f.word""",
    "op13_prefix_trie": rf"""
        WITH numbered AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
          FROM conversations WHERE conv_id IS NOT NULL),
        lists AS (
          SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS turns,
                 {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h
          FROM numbered GROUP BY conv_id),
        rebuilt AS (
          SELECT c.conv_id, coalesce(b.turns[1:c.h], []) || c.turns[c.h + 1:] AS turns
          FROM lists c LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 20),
        members AS (
          SELECT conv_id, len(turns) AS length, d AS depth, turns[1:d] AS path
          FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
        nodes AS (
          SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256,
                 (count(*) - 1) * coalesce(len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')), 0) AS saved
          FROM members GROUP BY path, depth),
        linked AS (
          SELECT n.*, p.conv_id AS parent_conv_id, p.path AS parent_path
          FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1] AND p.depth = n.depth - 1),
        kids AS (SELECT parent_path AS path, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY parent_path),
        below AS (
          SELECT path[1:d] AS path, sum(saved) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
          FROM (SELECT l.path, saved, n_children, unnest(range(l.depth + 1)) AS d FROM linked l LEFT JOIN kids k ON k.path = l.path)
          GROUP BY 1)
        SELECT l.conv_id, CAST(l.depth AS BIGINT) AS depth, l.parent_conv_id, l.n_convs, coalesce(n_children, 0) AS n_children,
               b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, l.ends_sha256
        FROM linked l JOIN below b ON b.path = l.path LEFT JOIN kids k ON k.path = l.path""",
}
