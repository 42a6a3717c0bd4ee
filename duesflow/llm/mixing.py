"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The documents of a source are laid on a line in shuffled order; the line is cut into
blocks of equal length and may be walked up to twice. Slot ``i`` of the schedule has the
point ``i * golden ratio mod 1``; the point falls into one source's share of the target
weights, and the k-th slot of a source takes the source's k-th block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duesflow.llm.util import NOT_SPACE, SPACE, free_names, stored_table, text_or_empty
from duesflow.operators.numbering import id_bucket, number_rows

UNIT = 1 << 31
GOLDEN = 1327217885  # UNIT divided by the golden ratio; odd, so a period visits every point once
CELL = 1 << 19
CHUNK = 1 << 12


def word_count(name: str = "text") -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(NOT_SPACE)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources numbered from 1 by code point, NULL last."""
    last = F.col("source").isNull()
    cuts = [F.struct(last, F.coalesce(F.substring("source", 1, n), F.lit(""))) for n in (4, 12)]
    return number_rows(sources, "place", [last, F.col("source")], cuts)


def _running(df: DataFrame, value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of smaller ``place``, in two levels."""
    run = id_bucket(F.col("place"), 4096)
    keyed = df.withColumn("_run", run)
    sums = keyed.groupBy("_run").agg(F.sum(value).alias("_sum"))
    start = F.coalesce(F.sum("_sum").over(W.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("_run", start.alias("_start"))
    inside = F.sum(value).over(W.partitionBy("_run").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    return (keyed.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(starts, "_run")
            .withColumn(name, F.col("_start") + F.col("_inside")).drop("_run", "_start", "_inside"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5,
                   repeats: int = 2) -> DataFrame:
    """Per source of ``sizes`` (source, size): place, weight, source_size, target, quota.

    Sources in code point order (NULL last) weigh ``weights`` in turn and share ``share``
    times all sizes. A target stops at ``repeats`` times its source's size; what exceeds it
    is shared by weight among the others, until none is above. ``quota`` is the target in
    whole words. Runs one small aggregation per round of sharing.
    """
    totals = _ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = stored_table(totals.withColumn("weight", turn))
    ceiling = F.col("source_size") * F.lit(repeats)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = ceiling < F.lit(level) * F.col("weight")
        row = sources.agg(F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, ceiling)).alias("taken"),
                          F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if row["n"] == full or not row["open"]:
            break
        full, level = row["n"], (share * total - (row["taken"] or 0)) / row["open"]
    target = F.least(ceiling.cast("double"), F.lit(level) * F.col("weight"))
    return sources.withColumn("target", target).withColumn("quota", F.round("target").cast("long"))


def source_lines(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``docs`` (uid, doc_id, source, size) with ``start``: the words of its source before it, in shuffled order.

    A source's line is cut by the first digits of the shuffle key, so that no task holds a source.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = docs.withColumn("key", key).withColumn("run", F.substring("key", 1, 3))
    before = (W.unboundedPreceding, -1)
    sums = keyed.groupBy("source", "run").agg(F.sum("size").alias("sum"))
    starts = sums.select(
        F.col("source").alias("_source"), F.col("run").alias("_run"),
        F.coalesce(F.sum("sum").over(W.partitionBy("source").orderBy("run").rowsBetween(*before)), F.lit(0)).alias("base"))
    inside = F.sum("size").over(W.partitionBy("source", "run").orderBy("key", "doc_id", "uid").rowsBetween(*before))
    return (keyed.withColumn("inside", F.coalesce(inside, F.lit(0)))
            .join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("run") == F.col("_run")))
            .withColumn("start", F.col("base") + F.col("inside"))
            .drop("key", "run", "_source", "_run", "base", "inside"))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """(slot, place, rank): which source's which block comes at each slot.

    A source has as many slots as its quota has blocks. Where the points give it more,
    the last are left out; where they give fewer, the missing ones follow at the end.
    """
    spark = sources.sparkSession
    blocks = F.ceil(F.col("quota") / F.lit(block)).cast("long")
    owned = stored_table(_running(sources.select("place", "quota", blocks.alias("blocks")), "quota", "before"))
    n, total, n_sources = owned.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    unit = lambda words: F.floor(words / F.lit(max(total, 1)) * F.lit(UNIT)).cast("long")
    shares = (owned.select("place", unit(F.col("before")).alias("low"), unit(F.col("before") + F.col("quota")).alias("high"))
              .where("high > low")
              .withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / CELL), F.floor((F.col("high") - 1) / CELL)))))
    points = (spark.range(n).withColumn("point", F.col("id") % UNIT * GOLDEN % UNIT)
              .withColumn("cell", F.floor(F.col("point") / CELL)))
    hits = (points.join(shares, "cell").where("point >= low AND point < high")
            .select(F.col("id").alias("slot"), "place", F.floor(F.col("id") / CHUNK).alias("chunk")))
    counts = hits.groupBy("place", "chunk").agg(F.count(F.lit(1)).alias("hits"))
    earlier = F.sum("hits").over(W.partitionBy("place").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("place", "chunk", F.coalesce(earlier, F.lit(0)).alias("base"))
    inside = F.row_number().over(W.partitionBy("place", "chunk").orderBy("slot")) - 1
    ranked = (hits.withColumn("inside", inside).join(starts, ["place", "chunk"])
              .select("slot", "place", (F.col("base") + F.col("inside")).alias("rank"))
              .join(owned.select("place", "blocks"), "place").where("rank < blocks").drop("blocks"))
    given = counts.groupBy("place").agg(F.sum("hits").alias("given"))
    short = (owned.join(given, "place", "left").withColumn("given", F.coalesce("given", F.lit(0)))
             .where("given < blocks")
             .select("place", "given", F.explode(F.sequence(F.col("given"), F.col("blocks") - 1)).alias("rank"))
             .select((F.lit(n) + (F.col("rank") - F.col("given")) * n_sources + F.col("place")).alias("slot"), "place", "rank"))
    return ranked.unionByName(short)


def mix_sources(docs: DataFrame, *, block: int = 512, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5,
                repeats: int = 2, seed: str = "mix", uid: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, pieces) of the mix of ``docs`` (doc_id, source, text; others ignored).

    ``rows``: one per row of ``docs`` with uid, doc_id, source, size; ``uid`` names a column
    of ``docs`` that already tells its rows apart. ``sources``: see ``source_targets``.
    ``pieces``: slot, uid, doc_id, walk (0 or 1), first, length: the words of a document
    that a slot takes. A source gives its quota of words exactly; a document is taken at
    most ``repeats`` times. NULL texts and texts without words have size 0 and are never
    taken; NULL is a source of its own; repeated rows are rows of their own. An empty table
    gives three empty frames. Runs jobs: sizes and sources are written to the shared folder.
    """
    row_id = F.col(f"`{uid}`") if uid else F.monotonically_increasing_id()
    rows = stored_table(docs.select(row_id.alias("uid"), "doc_id", F.col("source").cast("string").alias("source"),
                                    word_count().alias("size")))
    sources = stored_table(source_targets(rows, weights, share, repeats))
    lines = (source_lines(rows.where("size > 0"), seed).withColumnRenamed("source", "_s")
             .join(sources.select("source", "place", "source_size", "quota"), F.col("_s").eqNullSafe(F.col("source"))))
    low = F.col("start") + F.col("walk") * F.col("source_size")
    parts = (lines.withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
             .withColumn("low", low).withColumn("high", F.least(low + F.col("size"), F.col("quota")))
             .where("high > low")
             .withColumn("rank", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))))
             .withColumn("first", F.greatest(F.col("low"), F.col("rank") * block))
             .withColumn("length", F.least(F.col("high"), (F.col("rank") + 1) * block) - F.col("first"))
             .select("place", "rank", "uid", "doc_id", "walk", (F.col("first") - F.col("low")).alias("first"), "length"))
    pieces = parts.join(schedule(sources, block), ["place", "rank"]).select("slot", "uid", "doc_id", "walk", "first", "length")
    return rows, sources, pieces


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents with all columns of ``docs`` (which hold doc_id, source, text, n_chars).

    A row appears once per walk that takes words of it; where a walk takes only a head or
    a tail of its words, ``text`` holds these words, one space apart, and ``n_chars`` follows.
    Rows of which no word is taken, such as empty texts, are left out. The documents are
    written to the shared folder once, so that rows keep their identity in later steps.
    Extra columns may have any name.
    """
    columns = docs.columns
    row, first, length, row_taken = free_names(docs, "_mix_uid", "_mix_first", "_mix_length", "_mix_taken")
    marked = stored_table(docs.withColumn(row, F.monotonically_increasing_id()))
    _, _, pieces = mix_sources(marked, uid=row, **options)
    taken = (pieces.groupBy("uid", "walk").agg(F.min("first").alias(first), F.sum("length").alias(length))
             .select(first, length, F.col("uid").alias(row_taken)))
    words = F.split(F.regexp_replace(text_or_empty(), f"^{SPACE}", ""), SPACE)
    part = F.array_join(F.slice(words, F.col(first).cast("int") + 1, F.col(length).cast("int")), " ")
    text = F.when(F.col(length) == word_count(), F.col("text")).otherwise(part)
    out = marked.join(taken, F.col(row) == F.col(row_taken)).withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in columns])
