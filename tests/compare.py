"""Run registered queries against their SQL: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from duesflow.session import get_spark  # noqa: E402


def database(root: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for file in sorted(os.listdir(root)):
        if file.endswith(".parquet"):
            db.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{root}/{file}'")
    return db


def _plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, db, name: str, root: str) -> str:
    df = contract.queries()[name](spark, root)
    got = rows_of(df.columns, df.collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return f"rows only: {sum(got.values())}"
    result = db.execute(sql)
    columns = [c[0] for c in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"DIFF columns {sorted(df.columns)} / {sorted(columns)}"
    if got != want:
        left, right = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"DIFF {sum(got.values())}/{sum(want.values())} rows; only Spark {left}; only SQL {right}"
    return f"equal: {sum(got.values())} rows"


def main() -> int:
    root = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(contract.queries())
    spark = get_spark("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    db, failed = database(root), 0
    for name in names:
        start = time.time()
        try:
            outcome = compare(spark, db, name, root)
        except Exception as error:  # noqa: BLE001 - report and go on
            outcome = f"DIFF error {type(error).__name__}: {str(error)[:600]}"
        failed += outcome.startswith("DIFF")
        print(f"{name}: {outcome} ({time.time() - start:.1f}s)", flush=True)
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
