"""Writers: append, keyed overwrite, XML documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def _gathered(df: DataFrame, partition_by: Sequence[str], sort_by: Sequence[str] = ()) -> DataFrame:
    """Rows of a partition in one task, or some where it is large, and small partitions together: one file a
    partition and task instead of one from every task."""
    if not partition_by:
        return df
    rows = df.hint("rebalance", *partition_by)
    return rows.sortWithinPartitions(*partition_by, *sort_by) if sort_by else rows


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Add rows to a Parquet table (runs a job)."""
    _gathered(df, partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str], sort_by: Sequence[str] = ()) -> None:
    """Replace just the partitions that occur in ``df`` (runs a job), rows sorted within files by ``sort_by``.

    Writing the same month again gives the same table, so a repeated run adds
    nothing. ``df`` must not read from ``path``.
    """
    (
        _gathered(df, partition_by, sort_by).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def replace_table(df: DataFrame, path: str) -> None:
    """Write an updated table to a new folder (runs a job); callers switch to it."""
    df.write.mode("errorifexists").parquet(path)


def write_table(df: DataFrame, root: str, table: str, sort_by: Sequence[str] = (),
                partition_by: Sequence[str] = ()) -> None:
    """Replace a ledger table as a whole, rows sorted within files so that scans can skip row groups."""
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy(*partition_by).parquet(f"{root}/{table}")


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """Save as a catalog table bucketed and sorted by ``key``: joins of two such
    tables on that key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def write_xml(df: DataFrame, path: str, root_tag: str, row_tag: str) -> None:
    """One XML element per row below a root element per part file."""
    df.write.mode("overwrite").format("xml").options(rootTag=root_tag, rowTag=row_tag).save(path)


def write_document(lines: DataFrame, path: str, root_tag: str, order_by: Sequence[str],
                   line: str = "xml") -> None:
    """Write document lines in global order; the part files joined by name are
    one XML document below ``root_tag``.

    The sort is a range shuffle on ``order_by``, so one large element spreads
    over several part files.
    """
    body = lines.select(F.lit(1).alias("_part"), *order_by, F.col(line).alias("value"))
    one = lines.sparkSession.range(1)
    nulls = [F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in order_by]
    head = one.select(F.lit(0).alias("_part"), *nulls, F.lit(f"<{root_tag}>").alias("value"))
    tail = one.select(F.lit(2).alias("_part"), *nulls, F.lit(f"</{root_tag}>").alias("value"))
    (
        head.unionByName(body).unionByName(tail)
        .orderBy("_part", *order_by)
        .select("value")
        .write.mode("overwrite").text(path)
    )


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """``df`` with a row counter that is filled when an action has run over it."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation


def rows_counted(observation: Observation) -> int:
    """What ``counted`` has counted; call it after the action over its frame."""
    return observation.get["rows"]


def preview(df: DataFrame, order_by: Sequence, n: int = 10) -> DataFrame:
    """The first ``n`` rows in the given order (a top-k, no full sort)."""
    return df.orderBy(*order_by).limit(n)
