"""Exact duplicates: 128-bit content hashes, smallest id kept, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duesflow.llm.util import SPACE, free_names, stored_table, text_or_empty


def normal_text(name: str = "text") -> Column:
    """The text with each run of ASCII white space as one space; NULL counts as empty."""
    return F.regexp_replace(text_or_empty(name), SPACE, " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _keepers(rows: DataFrame) -> DataFrame:
    """Groups of at least two rows, with the row that stays and their number."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "uid"))
    return (rows.groupBy("digest").agg(first.alias("keep"), F.count(F.lit(1)).alias("n"))
            .where("n > 1").select("digest", "n", F.col("keep.doc_id").alias("keep_id"), F.col("keep.uid").alias("keep_uid")))


def _colliding(texts: DataFrame, copies: DataFrame) -> DataFrame:
    """Digests under which some text differs from the text of the row that stays.

    Texts are shuffled once, for the join that finds the members of groups; only members
    meet the text that stays. The hints keep one plan at every size: joins by shuffle, in
    which adaptive execution splits a hot group.
    """
    members = stored_table(texts.join(copies.hint("merge"), "digest")
                           .select("digest", "text", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays")))
    keeper = stored_table(members.where("stays").groupBy("digest").agg(F.min("text").alias("kept_text")))
    # Stored before it is made distinct: an aggregation by the join's key would keep a hot group in one task.
    return stored_table(members.join(keeper.hint("merge"), "digest").where(F.col("text") != F.col("kept_text"))
                        .select("digest")).distinct()


def exact_groups(docs: DataFrame, digest=content_hash) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows with equal ``normal_text`` form a group; the row with the smallest ``doc_id``
    stays (NULL ids last; of rows that repeat that id too, one). NULL and empty texts are
    equal. ``docs`` needs ``doc_id`` and ``text``; other columns are ignored and may have
    any name. An empty table gives no rows.

    Only hashes and ids are grouped. The texts are compared with that of the row that
    stays in a plain equi join, which adaptive execution splits for a hot group. Should
    hashes collide, the groups concerned are keyed by the SHA-256 as well and compared
    again. Runs jobs: the hashes are written to the shared folder once.
    """
    plain = docs.select("doc_id", normal_text().alias("text"))
    sha = F.sha2("text", 256)
    rows = stored_table(plain.select("doc_id", F.monotonically_increasing_id().alias("uid"),
                                     digest(F.col("text")).alias("digest"), sha.alias("text_sha256")))
    texts = plain.select("doc_id", "text", digest(F.col("text")).alias("digest"))
    copies = stored_table(_keepers(rows))
    bad = stored_table(_colliding(texts, copies))
    if not bad.isEmpty():
        marked = bad.withColumn("bad", F.lit(True))

        def apart(df: DataFrame, full: Column) -> DataFrame:
            return (df.join(marked, "digest", "left")
                    .withColumn("digest", F.when(F.col("bad"), F.concat("digest", F.unhex(full))).otherwise(F.col("digest")))
                    .drop("bad"))

        rows, texts = apart(rows, F.col("text_sha256")), apart(texts, sha)
        copies = stored_table(_keepers(rows))
        if not _colliding(texts, copies).isEmpty():
            raise ValueError("different texts share both hashes")
    return (rows.join(copies, "digest", "left")
            .select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                    F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(True)).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns.

    Extra columns may have any name.
    """
    columns = docs.columns
    digest, turn, kept_id, kept_sha = free_names(docs, "_sha", "_turn", "_kept_id", "_kept_sha")
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    others = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    # One row of those that repeat both id and text; the limit also holds before the shuffle.
    alone = (docs.withColumn(digest, F.sha2(normal_text(), 256))
             .withColumn(turn, F.row_number().over(W.partitionBy(digest, "doc_id").orderBy(others)))
             .where(F.col(turn) == 1))
    return alone.join(kept, (F.col(digest) == F.col(kept_sha)) & F.col("doc_id").eqNullSafe(F.col(kept_id)),
                      "left_semi").select(*[f"`{c}`" for c in columns])
