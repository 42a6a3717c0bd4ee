"""Registered queries: a Spark plan, its result columns, and the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duesflow.workload.tables import Ledger

# Result columns are cast to these on both sides, so that the two engines'
# own decimal, integer and date types do not matter when results are compared.
SPARK_TYPES = {"int": "bigint", "money": "double", "text": "string", "date": "date", "bool": "boolean"}
SQL_TYPES = {"int": "BIGINT", "money": "DOUBLE", "text": "VARCHAR", "date": "DATE", "bool": "BOOLEAN"}


@dataclass(frozen=True)
class Query:
    name: str
    columns: dict[str, str]
    plan: Callable[[Ledger], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, root: str) -> DataFrame:
        out = []
        for name, kind in self.columns.items():
            column = F.col(name).cast(SPARK_TYPES[kind])
            out.append((column.cast("string") if kind == "date" else column).alias(name))
        return self.plan(Ledger(spark, root)).select(*out)

    @property
    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = []
        for name, kind in self.columns.items():
            column = f'CAST("{name}" AS {SQL_TYPES[kind]})'
            out.append(f'CAST({column} AS VARCHAR) AS "{name}"' if kind == "date" else f'{column} AS "{name}"')
        return f"SELECT {', '.join(out)} FROM ({self.sql}) AS result"


QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register a plan. ``columns`` lists ``name kind`` pairs, separated by commas."""
    kinds = dict(pair.split() for pair in columns.split(","))

    def add(plan: Callable[[Ledger], DataFrame]) -> Callable[[Ledger], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = Query(name, kinds, plan, sql)
        return plan

    return add


def load() -> dict[str, Query]:
    """All registered queries."""
    from duesflow.workload import billing, files, imports, masters, monthly, operators, protected, reports  # noqa: F401

    return QUERIES
