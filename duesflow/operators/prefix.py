"""Joins on ``text LIKE prefix || '%'`` as equi joins, one prefix length at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_LENGTHS = 64


def _lengths(prefixes: DataFrame, column: str) -> list[int]:
    """The distinct prefix lengths, ascending; more than ``MOST_LENGTHS`` are an error (runs a job)."""
    found = [r[0] for r in prefixes.where(F.col(column).isNotNull()).select(F.char_length(column)).distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(found) > MOST_LENGTHS:
        raise ValueError(f"prefixes have more than {MOST_LENGTHS} different lengths")
    return sorted(found)


def prefix_matches(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Every row with every row of ``prefixes`` whose ``prefix`` its ``text`` starts with.

    Each row asks once per prefix length that occurs, with the text cut to it, so both sides
    meet by equality and Spark picks the join; no pair is tried in vain. Letters count as
    they are; an empty prefix fits every text, NULL none. Column names of the two must differ.
    """
    lengths = _lengths(prefixes, prefix)
    if not lengths:
        return rows.limit(0).join(prefixes, F.lit(False))
    cuts = F.array(*[F.when(F.char_length(text) >= n, F.substring(text, 1, n) if n else F.lit("")) for n in lengths])
    asked = rows.select("*", F.explode(cuts).alias("_cut")).where(F.col("_cut").isNotNull())
    return asked.join(prefixes, F.col("_cut") == F.col(prefix)).drop("_cut")


def longest_prefix(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Every row once, with the columns of the longest prefix that fits, or NULLs.

    ``prefixes`` must hold each prefix once. Lengths are tried from the shortest, each by a
    left join, and a longer match replaces a shorter one; rows are never gathered by key.
    """
    out, names = rows, prefixes.columns
    for name in names:
        out = out.withColumn(name, F.lit(None).cast(prefixes.schema[name].dataType))
    for n in _lengths(prefixes, prefix):
        some = prefixes.where(F.char_length(prefix) == n).select(F.col(prefix).alias("_cut"), F.struct(*names).alias("_found"))
        out = out.withColumn("_cut", F.when(F.char_length(text) >= n, F.substring(text, 1, n) if n else F.lit(""))).join(some, "_cut", "left")
        out = out.select(*rows.columns, *[F.when(F.col("_found").isNotNull(), F.col(f"_found.{c}")).otherwise(F.col(c)).alias(c) for c in names])
    return out
