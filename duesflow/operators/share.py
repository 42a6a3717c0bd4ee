"""Splitting amounts by weights and percentages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHT = "decimal(18,6)"


def split_by_weights(amount: Column, weights: Mapping[str, Column]) -> dict[str, Column]:
    """Parts of ``amount`` in proportion to the weights (six decimals).

    All parts are 0 where the weights do not add up to more than 0.
    """
    sized = {n: F.coalesce(w, F.lit(0)).cast(WEIGHT) for n, w in weights.items()}
    values = list(sized.values())
    total = values[0]
    for w in values[1:]:
        total = total + w
    return {
        n: F.when(total > 0, amount * (w / total)).otherwise(F.lit(0)).cast("decimal(38,6)")
        for n, w in sized.items()
    }


def with_group_total(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Add the sum of ``column`` over the group: aggregate, then join back.

    A window would gather the whole group in one task; here a hot group sends
    one partial sum per task and the small totals table joins back.
    """
    totals = df.groupBy(*keys).agg(F.sum(column).alias(name))
    return df.join(totals, list(keys), "left")


def percent_share(part: Column, whole: Column) -> Column:
    """``part`` as percentage of ``whole``, two decimals; NULL if the whole is 0."""
    return F.round(F.try_divide(part, whole) * 100, 2).cast("decimal(5,2)")
