"""XML text built from columns: attributes and elements whose value is NULL are left out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape(value: Column) -> Column:
    out = value.cast("string")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def _attributes(attributes: Mapping[str, Column]) -> list[Column]:
    return [F.concat(F.lit(f' {name}="'), escape(value), F.lit('"'))
            for name, value in attributes.items()]


def text_element(tag: str, value: Column) -> Column:
    """``<tag>value</tag>``, NULL for a NULL value."""
    return F.concat(F.lit(f"<{tag}>"), escape(value), F.lit(f"</{tag}>"))


def open_tag(tag: str, attributes: Mapping[str, Column] | None = None) -> Column:
    return F.concat_ws("", F.lit(f"<{tag}"), *_attributes(attributes or {}), F.lit(">"))


def empty_element(tag: str, attributes: Mapping[str, Column]) -> Column:
    return F.concat_ws("", F.lit(f"<{tag}"), *_attributes(attributes), F.lit("/>"))


def element(tag: str, content: list[Column], attributes: Mapping[str, Column] | None = None) -> Column:
    """An element around already escaped content; NULL content is left out."""
    return F.concat_ws("", open_tag(tag, attributes), *content, F.lit(f"</{tag}>"))
