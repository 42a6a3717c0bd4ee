"""Row numbers that do not put a whole partition into one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duesflow.session import cut_lineage

# Rows a task of the numbering sorts, on average.
ROWS_PER_TASK = 250_000


def id_bucket(row_id: Column, width: int = 1 << 20) -> Column:
    """Consecutive ids share a bucket, so a bucket of unique ids has at most ``width`` rows."""
    return F.floor(row_id / F.lit(width)).cast("bigint")


def prefix_buckets(text: Column, step: int = 6, length: int = 18) -> list[Column]:
    """Ever longer prefixes of a text key, as nested cuts for ``number_rows``."""
    known = F.coalesce(text, F.lit(""))
    return [F.substring(known, 1, n) for n in range(step, length + 1, step)]


def _starts(sizes: DataFrame, parts: int, depth: int) -> DataFrame:
    """(_run, _start): rows before each run, for runs keyed by ``parts`` partition
    columns and ``depth`` nested cuts. One running sum per level, each over the
    cuts inside one parent."""
    parent = F.struct(*[F.col(f"_run.p{i}") for i in range(parts)],
                      *[F.col(f"_run.b{i}") for i in range(depth - 1)])
    nested = sizes.withColumn("_parent", parent) if parts or depth > 1 else sizes
    siblings = W.partitionBy("_parent") if parts or depth > 1 else W.partitionBy()
    earlier = siblings.orderBy(f"_run.b{depth - 1}").rowsBetween(W.unboundedPreceding, -1)
    local = nested.withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    if depth == 1:
        return local.select("_run", "_start")
    parents = nested.groupBy(F.col("_parent").alias("_run")).agg(F.sum("_size").alias("_size"))
    above = _starts(parents, parts, depth - 1).select(
        F.col("_run").alias("_parent"), F.col("_start").alias("_above"))
    return local.join(above, "_parent").select("_run", (F.col("_start") + F.col("_above")).alias("_start"))


def number_rows(
    df: DataFrame,
    name: str,
    order_by: Sequence[str | Column],
    bucket: Column | Sequence[Column],
    partition_by: Sequence[str] = (),
    store: bool = False,
) -> DataFrame:
    """``row_number`` over ``partition_by`` in the order ``order_by``.

    ``bucket`` cuts each partition into runs of the order: one cut, or nested
    cuts from coarse to fine. Taken together the cuts must not decrease along
    ``order_by``. Rows are numbered inside their run, and a run starts after
    the rows of the runs before it, taken from running sums over run sizes. A
    partition that holds a third of all rows is thus spread over as many tasks
    as it has runs. ``order_by`` must be unique for a repeatable result.

    ``df`` is evaluated twice, once for the sizes of the runs, which suits a scan. With
    ``store`` it is evaluated once (runs a job): the rows are written to the work folder, and
    sorted by as many tasks as their number asks for, so that a task does not grow with them.
    """
    cuts = [bucket] if isinstance(bucket, Column) else list(bucket)
    # A struct key compares NULL with NULL as equal, and both the window and the
    # join below cluster by it: the rows are shuffled once.
    run = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(partition_by)],
                   *[c.alias(f"b{i}") for i, c in enumerate(cuts)])
    local = F.row_number().over(W.partitionBy("_run").orderBy(*order_by))
    keyed = (cut_lineage(df) if store else df).withColumn("_run", run)
    sizes = keyed.groupBy("_run").agg(F.count(F.lit(1)).alias("_size"))
    starts = _starts(sizes, len(partition_by), len(cuts))
    if store:
        tasks = math.ceil(keyed.count() / ROWS_PER_TASK)
        keyed = keyed.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_run")
    return (
        keyed.withColumn("_local", local).join(starts, "_run")
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_run", "_local", "_start")
    )
