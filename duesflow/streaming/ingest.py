"""File drops into a Parquet table: each file is read once, each key kept once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from duesflow.operators.upsert import absent, keep_one

BATCH = "lote"


def _existing(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame | None:
    full = T.StructType([*schema, T.StructField(BATCH, T.LongType())])
    try:
        return spark.read.schema(full).parquet(target)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _add_batch(batch: DataFrame, batch_id: int, target: str, keys: Sequence[str], day: str) -> None:
    """Append the keys the table does not have yet, as partition ``lote=batch_id``.

    A batch that is run again after a failure replaces its own partition and is
    compared with earlier batches only, so it ends with the same rows. Only the
    keys of the table are read. Of rows of one key in a batch the first by ``day``
    stays, then by the other columns.
    """
    spark = batch.sparkSession
    fresh = keep_one(batch, keys, [day, *[c for c in batch.columns if c not in (day, *keys)]])
    known = _existing(spark, target, batch.schema)
    if known is not None:
        fresh = absent(fresh, known.where(F.col(BATCH) < batch_id), keys)
    fresh.write.mode("overwrite").parquet(f"{target}/{BATCH}={batch_id}")


def ingest_drops(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema: T.StructType,
    keys: Sequence[str],
    day: str,
    file_format: str = "csv",
    options: Mapping[str, str] | None = None,
    clean: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Take in all files of ``source`` that were not taken in before, then stop.

    ``clean`` turns raw rows into typed ones; ``keys`` identify a row, whatever its
    date column ``day`` says. ``target`` and ``checkpoint``
    must be shared folders. Returns the started query.
    """
    raw = spark.readStream.format(file_format).schema(schema).options(**(options or {})).load(source)
    rows = clean(raw) if clean else raw
    return (
        rows.writeStream.foreachBatch(
            lambda batch, batch_id: _add_batch(batch, batch_id, target, keys, day))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_ingested(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The table ``ingest_drops`` filled; empty if nothing came in."""
    known = _existing(spark, target, schema)
    return spark.createDataFrame([], schema) if known is None else known.drop(BATCH)
