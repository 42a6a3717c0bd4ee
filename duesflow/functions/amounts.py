"""Money columns: localized text to decimal, decimal to text, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
RATE = "decimal(5,2)"

_PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"


def _to_money(text: Column, type_: str = MONEY) -> Column:
    return F.when(text.rlike(_PLAIN_NUMBER), text.try_cast(type_))


def parse_amount(text: Column, style: str = "reference") -> Column:
    """Localized amount text to decimal(18,2), NULL where it is no number.

    ``reference``: dots are thousands marks, the comma is the decimal mark,
    whatever the text looks like, so ``22,648.59`` reads as 22.65.
    ``smart``: the last mark is the decimal mark if one or two digits follow
    it; all other marks are thousands marks.
    """
    if style == "reference":
        return _to_money(F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    if style != "smart":
        raise ValueError(f"unknown amount style: {style}")
    trimmed = F.trim(text)
    fraction = F.regexp_extract(trimmed, r"[.,](\d{1,2})$", 1)
    whole = F.regexp_replace(F.regexp_replace(trimmed, r"[.,]\d{1,2}$", ""), "[.,]", "")
    return _to_money(
        F.when(fraction == "", whole).otherwise(F.concat_ws(".", whole, fraction))
    )


def parse_currency(text: Column) -> Column:
    """``$1234.56`` to decimal(18,2)."""
    return _to_money(F.replace(text, F.lit("$"), F.lit("")))


def parse_comma_decimal(text: Column, type_: str) -> Column:
    """``12,5`` to the given decimal type."""
    return _to_money(F.replace(F.trim(text), F.lit(","), F.lit(".")), type_)


def text_n2(amount: Column) -> Column:
    """Two decimals with thousands marks, rounded half up: ``1,234.50``."""
    return F.format_number(F.round(amount, 2), 2)


def percent_of(amount: Column, percent: Column) -> Column:
    """``amount * percent / 100`` kept exact, not rounded."""
    return amount * percent.cast(RATE) * F.lit("0.01").cast("decimal(3,2)")


def or_zero(amount: Column, type_: str = MONEY) -> Column:
    return F.coalesce(amount, F.lit(0)).cast(type_)
