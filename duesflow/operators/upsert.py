"""Insert-if-absent, fill-in updates and duplicate handling."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _same(column: Column) -> Column:
    return column


def absent(
    incoming: DataFrame,
    existing: DataFrame,
    keys: Sequence[str] | Mapping[str, str],
    normal: Callable[[Column], Column] = _same,
) -> DataFrame:
    """Incoming rows whose key is not in ``existing``.

    ``keys`` maps incoming to existing column names (a list if they agree);
    ``normal`` is applied to both sides first, so the join stays an equi join.
    A NULL key equals nothing: such rows always count as absent.
    """
    pairs = dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}
    names = [f"_k{i}" for i in range(len(pairs))]
    left = incoming.select(
        "*", *[normal(F.col(c)).alias(n) for c, n in zip(pairs, names, strict=True)])
    right = existing.select(
        *[normal(F.col(c)).alias(n) for c, n in zip(pairs.values(), names, strict=True)])
    return left.join(right, names, "left_anti").drop(*names)


def present(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is in ``existing`` (left semi join)."""
    return incoming.join(existing.select(*keys), list(keys), "left_semi")


def keep_one(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """The first row per key in a stated order; of columns given by name, known values come before NULL.

    The filter on the row number is pushed below the shuffle as a group limit,
    so every task sends on one row per key however large the group is.
    """
    order = [F.asc_nulls_last(c) if isinstance(c, str) else c for c in order_by]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def drop_duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop all rows of a key that occurs more than once; rows with a NULL key stay.

    One aggregation with map-side combine: a hot key travels as one row per
    task, and every row with a NULL key is a group of its own.
    """
    has_null = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    alone = F.when(has_null, F.monotonically_increasing_id()).alias("_alone")
    others = [c for c in df.columns if c not in keys]
    rest = F.struct(*[F.col(c) for c in others]) if others else F.lit(True)
    return (
        df.select("*", alone)
        .groupBy(*keys, "_alone")
        .agg(F.count(F.lit(1)).alias("_n"), F.first(rest).alias("_rest"))
        .where("_n = 1")
        .select(*[F.col(c) if c in keys else F.col(f"_rest.{c}") for c in df.columns])
    )


def fill(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    prefer: str = "old",
) -> DataFrame:
    """Update ``columns`` of the target rows that have a match in ``updates``.

    ``prefer="old"`` fills NULLs only; ``prefer="new"`` takes the update unless
    it is NULL. ``updates`` must hold at most one row per key (see ``keep_one``).
    """
    if prefer not in ("old", "new"):
        raise ValueError(f"prefer must be old or new, not {prefer}")
    new = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = target.join(new, list(keys), "left")

    def value(c: str) -> Column:
        pair = (F.col(c), F.col(f"_new_{c}"))
        return F.coalesce(*(pair if prefer == "old" else reversed(pair))).alias(c)

    return joined.select(*[value(c) if c in columns else F.col(c) for c in target.columns])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every column is NULL or blank."""
    filled = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "" for c in df.columns]
    return df.where(F.greatest(*filled, F.lit(False)))
