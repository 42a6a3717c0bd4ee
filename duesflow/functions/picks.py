"""Repeatable picks: integer arithmetic on a row id instead of random numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_PRIME = 2147483647


def draw(row_id: Column, seed: int) -> Column:
    """A number in [0, 2147483646], fixed by row id and seed."""
    start = F.pmod(row_id.cast("bigint"), F.lit(_PRIME).cast("bigint"))
    mixed = F.pmod(start * F.lit(48271 + seed).cast("bigint") + F.lit(seed * 7919 + 1).cast("bigint"),
                   F.lit(_PRIME).cast("bigint"))
    return F.pmod(mixed * F.lit(69621).cast("bigint"), F.lit(_PRIME).cast("bigint"))


def draw_below(row_id: Column, seed: int, bound: int) -> Column:
    return F.pmod(draw(row_id, seed), F.lit(bound).cast("bigint")).cast("int")


def pick(row_id: Column, seed: int, values: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), draw_below(row_id, seed, len(values)))
