"""The books of the monthly job: what arrived, what was billed, and from which month on bills must be restated.

A delivery is noted per table and month before its rows are added, and as complete after;
a billing run is noted before it writes, and as complete after. All of it is a few rows
per delivery. The low-water mark, the earliest month that a delivery not billed yet
touches, and the months of runs that broke off say what the next run has to restate.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duesflow.session import cut_lineage

# Tables of the books.
BOOKS = {
    "Entrega": "lote string, tabla string, anio int, mes int, filas bigint, ultimo bigint, leidas bigint, validas bigint",
    "EntregaHecha": "lote string",
    "EntregaCobrada": "lote string",
    "Corrida": "corrida string, primero date, ultimo date",
    "CorridaHecha": "corrida string",
}


def read_book(spark: SparkSession, facts: str, book: str) -> DataFrame:
    try:
        return spark.read.schema(BOOKS[book]).parquet(f"{facts}/{book}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], BOOKS[book])
        raise


def _note(rows: DataFrame, facts: str, book: str) -> None:
    rows.coalesce(1).write.mode("append").parquet(f"{facts}/{book}")


def _note_id(spark: SparkSession, facts: str, book: str, value: str) -> None:
    name = BOOKS[book].split()[0]
    _note(spark.range(1).select(F.lit(value).alias(name)), facts, book)


def new_batch() -> str:
    return uuid.uuid4().hex


def note_arrival(fresh: DataFrame, facts: str, table: str, day: str, batch: str, counts: Mapping[str, int],
                 number: str | None = None) -> None:
    """Note the months that the rows of a delivery touch, before they are added. Runs a small aggregation.

    ``counts`` holds the rows ``leidas`` (read) and ``validas`` (left after cleaning); a delivery
    without new rows is noted with its counts and no month.
    """
    spark = fresh.sparkSession
    last = F.max(number) if number else F.lit(None)
    months = fresh.groupBy(F.year(day).alias("anio"), F.month(day).alias("mes")).agg(
        F.count(F.lit(1)).alias("filas"), last.cast("bigint").alias("ultimo"))
    whole = spark.range(1).select(F.lit(batch).alias("lote"), F.lit(table).alias("tabla"), *[
        F.lit(counts[c]).cast("bigint").alias(c) for c in ("leidas", "validas")])
    rows = whole.join(months, F.lit(True), "left").withColumn("filas", F.coalesce("filas", F.lit(0)))
    _note(rows.select("lote", "tabla", "anio", "mes", "filas", "ultimo", "leidas", "validas"), facts, "Entrega")


def arrival_done(spark: SparkSession, facts: str, batch: str) -> None:
    _note_id(spark, facts, "EntregaHecha", batch)


def broken_arrivals(spark: SparkSession, facts: str, table: str) -> DataFrame:
    """(lote, anio, mes) of deliveries that were noted but never completed."""
    noted = read_book(spark, facts, "Entrega").where((F.col("tabla") == table) & F.col("mes").isNotNull())
    return noted.select("lote", "anio", "mes").join(read_book(spark, facts, "EntregaHecha"), "lote", "left_anti")


def import_counts(spark: SparkSession, facts: str) -> DataFrame:
    """(lote, tabla, leidas, validas, repetidas, nuevas) of every completed import: rows read, left
    after cleaning, dropped as known or repeated, and written."""
    done = read_book(spark, facts, "Entrega").join(read_book(spark, facts, "EntregaHecha").distinct(), "lote", "left_semi")
    return done.groupBy("lote", "tabla").agg(
        F.first("leidas").alias("leidas"), F.first("validas").alias("validas"),
        (F.first("validas") - F.sum("filas")).alias("repetidas"), F.sum("filas").alias("nuevas"))


def last_number(spark: SparkSession, facts: str, table: str) -> int | None:
    """The largest number given in any delivery of the table; None if none was noted."""
    return read_book(spark, facts, "Entrega").where(F.col("tabla") == table).agg(F.max("ultimo")).first()[0]


def _month(number: int) -> dt.date:
    return dt.date(number // 12, number % 12 + 1, 1)


class Restatement:
    """The months a run has to bill: those asked for, those that late arrivals touch, and those of broken runs.

    Bills that follow a restated month are restated too, up to the last one billed. A late
    payment or cost of month m changes the bill of m and, if it is a payment, the line of
    the month before, which every run refreshes.
    """

    def __init__(self, spark: SparkSession, facts: str, first: dt.date, last: dt.date):
        self.spark, self.facts, self.run = spark, facts, new_batch()
        noted = read_book(spark, facts, "Entrega").join(read_book(spark, facts, "EntregaCobrada").distinct(), "lote", "left_anti")
        # What arrives while this run works is left for the next.
        self._open = cut_lineage(noted.select("lote", (F.col("anio") * 12 + F.col("mes") - 1).alias("_mes")))
        low = self._open.agg(F.min("_mes")).first()[0]
        runs = read_book(spark, facts, "Corrida")
        earliest, latest = runs.agg(F.min("primero"), F.max("ultimo")).first()
        broken = runs.join(read_book(spark, facts, "CorridaHecha").distinct(), "corrida", "left_anti").agg(F.min("primero")).first()[0]
        starts = [first]
        if earliest is not None:
            starts += [max(_month(low), earliest)] if low is not None else []
            starts += [broken] if broken is not None else []
        self.first = min(starts)
        self.last = max(last, latest) if latest is not None and self.first <= latest else last

    def begin(self) -> None:
        row = self.spark.range(1).select(F.lit(self.run).alias("corrida"), F.lit(self.first).alias("primero"), F.lit(self.last).alias("ultimo"))
        _note(row, self.facts, "Corrida")

    def end(self) -> None:
        """All months are written: deliveries noted before the run began are billed."""
        _note(self._open.select("lote").distinct(), self.facts, "EntregaCobrada")
        _note_id(self.spark, self.facts, "CorridaHecha", self.run)
