from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from duesflow.functions import amounts, dates, picks, text, xml


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


AMOUNTS = [
    ("22,648.59", "22.65", "22648.59"), ("120,000.00", "120.00", "120000.00"), ("34,677.00", "34.68", "34677.00"),
    ("33.706,04", "33706.04", "33706.04"), ("127,080,00", None, "127080.00"), ("0,00", "0.00", "0.00"),
    (None, None, None), ("", None, None), ("1e5", None, None), ("abc", None, None), ("1.234", "1234.00", "1234.00"),
]


@pytest.mark.parametrize(("style", "at"), [("reference", 1), ("smart", 2)])
def test_parse_amount(spark, style, at):
    got = values(spark, amounts.parse_amount(F.col("t"), style), [(a[0],) for a in AMOUNTS], "t string")
    assert got == [None if a[at] is None else Decimal(a[at]) for a in AMOUNTS]


def test_parse_amount_rejects_unknown_style():
    with pytest.raises(ValueError):
        amounts.parse_amount(F.lit("1"), "other")


def test_text_n2_rounds_half_up(spark):
    got = values(spark, amounts.text_n2(F.col("d")), [(Decimal("0.125"),), (Decimal("1234.5"),)], "d decimal(18,3)")
    assert got == ["0.13", "1,234.50"]


def test_week_of_year_counts_from_sunday(spark):
    days = [dt.date(2023, 1, 1) + dt.timedelta(n) for n in range(1461)]
    got = values(spark, dates.week_of_year(F.col("d")), [(d,) for d in days], "d date")

    def week(d: dt.date) -> int:
        first = dt.date(d.year, 1, 1)
        return (d.timetuple().tm_yday - 1 + (first.weekday() + 1) % 7) // 7 + 1

    assert got == [week(d) for d in days]
    assert week(dt.date(2025, 5, 1)) == 18


def test_nth_business_day_matches_a_walk(spark):
    cases = [(y, m, n) for y in (2024, 2025) for m in range(1, 13) for n in range(-1, 25)]

    def walk(y, m, n):
        if n <= 0:
            return dt.date(y, m, 1)
        days = [d for i in range(31) if (d := dt.date(y, m, 1) + dt.timedelta(i)).month == m and d.weekday() < 5]
        return days[n - 1] if n <= len(days) else None

    got = values(spark, dates.nth_business_day(F.col("y"), F.col("m"), F.col("n")), cases, "y int, m int, n int")
    assert got == [walk(*c) for c in cases]


def test_periods_and_due_dates(spark):
    row = spark.range(1).select(
        dates.billed_period(F.lit("2025-01-20").cast("date")).alias("p"),
        dates.due_date(F.lit("2025-05-01").cast("date"), dates.FIRST_DUE_DAY).alias("a"),
        dates.due_date(F.lit("2025-05-01").cast("date"), dates.SECOND_DUE_DAY).alias("b"),
        dates.parse_dmy(F.lit("31/02/2025")).alias("bad"), dates.parse_dmy(F.lit("07/11/2025")).alias("good"),
        dates.month_number(F.lit("Mayo "), F.lit(9)).alias("m"), dates.month_number(F.lit("x"), F.lit(9)).alias("d"),
    ).first()
    assert row.p == dt.date(2024, 12, 1)
    assert (row.a, row.b) == (dt.date(2025, 5, 10), dt.date(2025, 5, 15))
    assert row.bad is None and row.good == dt.date(2025, 11, 7)
    assert (row.m, row.d) == (5, 9)


def test_text_functions(spark):
    row = spark.range(1).select(
        text.before_dash(F.lit("BANK - fees")).alias("b"), text.after_dash(F.lit("BANK - fees")).alias("a"),
        text.before_dash(F.lit("AYSA ")).alias("b0"), text.after_dash(F.lit("AYSA ")).alias("a0"),
        text.zero_padded(F.lit(12345), 3).alias("z"), text.zero_padded(F.lit(5), 3).alias("z5"),
        text.fixed_width(F.lit("PB"), 4).alias("w"), text.strip_blanks(F.lit(" a b @c ")).alias("s"),
        text.blank_to_null(F.lit("  ")).alias("n"), (text.key(F.lit(" Aysa ")) == text.key(F.lit("AYSA"))).alias("k"),
    ).first()
    assert (row.b, row.a, row.b0, row.a0) == ("BANK", "fees", "AYSA", "AYSA")
    assert (row.z, row.z5, row.w, row.s, row.n, row.k) == ("345", "005", "PB  ", "ab@c", None, True)


def test_xml_escapes_and_leaves_out_nulls(spark):
    row = spark.range(1).select(
        xml.element("a", [xml.text_element("b", F.lit('x<&>"')), xml.text_element("c", F.lit(None).cast("string"))],
                    {"id": F.lit(5), "no": F.lit(None).cast("int")}).alias("x"),
        xml.empty_element("p", {"d": F.lit(None).cast("int")}).alias("e")).first()
    assert row.x == '<a id="5"><b>x&lt;&amp;&gt;&quot;</b></a>'
    assert row.e == "<p/>"


def test_picks_repeat_and_cover(spark):
    rows = spark.range(1000).select(picks.pick(F.col("id"), 3, ["a", "b", "c"]).alias("v"),
                                    picks.pick(F.col("id"), 3, ["a", "b", "c"]).alias("w")).collect()
    assert all(r.v == r.w for r in rows)
    counts = {v: sum(r.v == v for r in rows) for v in "abc"}
    assert all(200 < n < 470 for n in counts.values())
