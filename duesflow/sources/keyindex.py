"""The keys of a growing table, kept apart from its rows and cut into buckets by hash.

A drop is compared with the buckets its own keys fall into, so taking it in reads no row of
the table, and of its keys only those buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET, BATCH = "cubo", "lote"


class KeyIndex:
    """Keys in folders ``cubo=<bucket>/lote=<batch>`` below ``path``.

    ``fields`` are the key columns with their types. The number of buckets is fixed when the
    index is first written; give the same number later.
    """

    def __init__(self, spark: SparkSession, path: str, fields: Sequence[T.StructField], buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.keys = [f.name for f in fields]
        self.schema = T.StructType([*fields, T.StructField(BUCKET, T.IntegerType()), T.StructField(BATCH, T.StringType())])

    def read(self) -> DataFrame | None:
        """All keys, or None if the index was never written."""
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def known(self, rows: DataFrame) -> DataFrame | None:
        """The keys in the buckets that occur in ``rows`` (runs a job that returns at most one number per bucket)."""
        index = self.read()
        if index is None:
            return None
        met = [r[0] for r in rows.select(self._bucket().alias(BUCKET)).distinct().collect()]
        return index.where(F.col(BUCKET).isin(met))

    def absent(self, rows: DataFrame, before: str | None = None) -> DataFrame:
        """Rows whose key is not in the index, or only under batch ``before``; a NULL in the key equals nothing."""
        known = self.known(rows)
        if known is None:
            return rows
        if before is not None:
            known = known.where(F.col(BATCH) != before)
        keyed = rows.withColumn(BUCKET, self._bucket())
        return keyed.join(known.select(BUCKET, *self.keys), [BUCKET, *self.keys], "left_anti").select(*rows.columns)

    def add(self, rows: DataFrame, batch: str) -> None:
        """Keep the keys of ``rows`` as ``batch``, one file a bucket; the same batch again replaces itself. Runs a job."""
        keyed = rows.select(*self.keys, self._bucket().alias(BUCKET), F.lit(batch).alias(BATCH))
        (keyed.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(BUCKET, BATCH).parquet(self.path))
