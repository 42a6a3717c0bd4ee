"""Text columns: cleaning, keys, padding and splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def key(text: Column) -> Column:
    """Comparison form: outer blanks and letter case do not count."""
    return F.upper(F.trim(text))


def strip_blanks(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit(" "), F.lit(""))


def before_dash(text: Column) -> Column:
    """Trimmed text before the first dash; the whole text if there is none."""
    return F.trim(F.split_part(text, F.lit("-"), F.lit(1)))


def after_dash(text: Column) -> Column:
    """Trimmed text after the first dash; the whole text if there is none."""
    return F.trim(F.substr(text, F.instr(text, "-") + 1))


def zero_padded(value: Column, width: int) -> Column:
    """The last ``width`` characters, filled with zeros from the left."""
    return F.right(F.concat(F.lit("0" * width), value.cast("string")), F.lit(width))


def fixed_width(text: Column, width: int) -> Column:
    """Fill with blanks to a fixed width, as a CHAR column shows it."""
    return F.rpad(text, width, " ")
