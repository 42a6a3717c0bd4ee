"""JSON arrays of documents, each file read by as many tasks as it has blocks.

Spark's multi-line reader gives a whole file to one task. Here a file is cut at its closing
braces, wherever they stand. Whether a cut lies inside a quoted text and how deep it is nested
follows from what stands before it: both are running sums, taken inside the blocks first and
then over the sums of the blocks of a file.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duesflow.session import cut_lineage
from duesflow.sources.files import _load

BLOCK = ["archivo", "bloque"]
EARLIER = (W.unboundedPreceding, -1)
# Bytes of the files for each task that orders pieces: less than a block, so that few blocks meet in a task.
BYTES_PER_TASK = 1 << 22


def _count(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


def _running(value: Column, window) -> Column:
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def _tasks(spark: SparkSession, path: str) -> int:
    """Tasks for the pieces of the files, by their listed sizes (no content is read)."""
    size = _load(spark.read.format("binaryFile"), path).agg(F.sum("length")).first()[0] or 0
    return max(math.ceil(size / BYTES_PER_TASK), int(spark.conf.get("spark.sql.shuffle.partitions")))


def _pieces(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """(archivo, bloque, lugar, texto, dentro, cambia, si_fuera, si_dentro): the texts between closing braces.

    ``dentro`` (0 or 1): whether the piece begins inside a quoted text, if its block does not;
    ``cambia``: whether it holds an odd number of quotes; ``si_fuera``, ``si_dentro``: the depth
    after it and its brace, counted from the block's begin, for a block that begins outside or inside a quoted text.
    """
    read = _load(spark.read.format("text").option("lineSep", "}"), path).select(
        F.col("_metadata.file_path").alias("archivo"), F.col("_metadata.file_block_start").alias("bloque"),
        F.monotonically_increasing_id().alias("lugar"), F.col("value").alias("texto"))
    # A backslash stands inside quoted texts only, and never before a brace.
    plain = F.regexp_replace("texto", r"(?s)\\.", "")
    odd = _count(plain, '"') % 2

    def change(inside: int) -> Column:
        text = F.concat(F.lit('"'), plain) if inside else plain
        bare = F.regexp_replace(text, r'"[^"]*("|\z)', "")
        return _count(bare, "{[") - _count(bare, "]") - F.when(odd == inside, 1).otherwise(0)

    ordered = W.partitionBy(*BLOCK).orderBy("lugar")
    known = read.select("*", odd.alias("cambia"), change(0).alias("_d0"), change(1).alias("_d1")).repartition(
        tasks or _tasks(spark, path), *BLOCK)
    known = known.withColumn("dentro", _running(F.col("cambia"), ordered.rowsBetween(*EARLIER)) % 2)
    outside = F.col("dentro") == 0
    return known.select(
        *BLOCK, "lugar", "texto", "dentro", "cambia",
        F.sum(F.when(outside, F.col("_d0")).otherwise(F.col("_d1"))).over(ordered).alias("si_fuera"),
        F.sum(F.when(outside, F.col("_d1")).otherwise(F.col("_d0"))).over(ordered).alias("si_dentro"))


def _blocks(pieces: DataFrame) -> DataFrame:
    """Per block: the state it begins in, its last piece, and the depth at the end of its file."""
    sums = pieces.groupBy(*BLOCK).agg(
        (F.sum("cambia") % 2).alias("_c"), F.max("lugar").alias("_ultimo"),
        F.max_by("si_fuera", "lugar").alias("_f"), F.max_by("si_dentro", "lugar").alias("_d"))
    file, earlier = W.partitionBy("archivo"), W.partitionBy("archivo").orderBy("bloque").rowsBetween(*EARLIER)
    begun = sums.withColumn("_begin", _running(F.col("_c"), earlier) % 2)
    change = F.when(F.col("_begin") == 0, F.col("_f")).otherwise(F.col("_d"))
    return begun.withColumn("_change", change).select(
        *BLOCK, "_begin", _running(F.col("_change"), earlier).alias("_depth"), F.sum("_change").over(file).alias("_end"),
        F.when(F.max("bloque").over(file) == F.col("bloque"), F.col("_ultimo")).alias("_last"))


def array_documents(spark: SparkSession, path: str) -> DataFrame:
    """(archivo, orden, texto, causa): the objects of each file's array in order, from 0.

    ``causa`` is NULL for a whole object, ``cortada`` for the last one of a file whose array does not
    end, ``ilegible`` for other text after the last object. Text between objects stays before
    the later one, so that it does not parse. Elements are objects and files UTF-8, not compressed
    (a compressed file cannot be cut); a file that does not begin with ``[`` raises. Empty files
    and arrays have no rows. Reads the files once, into the work folder.
    """
    tasks = _tasks(spark, path)
    pieces = cut_lineage(_pieces(spark, path, tasks))
    state = pieces.repartition(tasks, *BLOCK).join(_blocks(pieces), BLOCK)
    outside = F.col("_begin") == 0
    depth = F.col("_depth") + F.when(outside, F.col("si_fuera")).otherwise(F.col("si_dentro"))
    closed = (F.col("_begin") + F.col("dentro") + F.col("cambia")) % 2 == 0
    # The text after the last brace counts one brace too many: a whole array ends at -1.
    state = state.select(
        *BLOCK, "lugar", "texto", (closed & (depth == 1)).cast("int").alias("fin"),
        ((F.col("_end") != -1) & F.col("_last").eqNullSafe(F.col("lugar"))).alias("cortada"))
    ended = state.groupBy(*BLOCK).agg(F.sum("fin").alias("_n"))
    before = ended.select(*BLOCK, _running(F.col("_n"), W.partitionBy("archivo").orderBy("bloque").rowsBetween(*EARLIER)).alias("_n"))
    inside = _running(F.col("fin"), W.partitionBy(*BLOCK).orderBy("lugar").rowsBetween(*EARLIER))
    numbered = state.withColumn("_in", inside).join(before, BLOCK)
    docs = numbered.groupBy("archivo", (F.col("_n") + F.col("_in")).alias("orden")).agg(
        F.sort_array(F.collect_list(F.struct("bloque", "lugar", "texto"))).alias("_texts"),
        F.max("fin").alias("fin"), F.max("cortada").alias("cortada"))
    text = F.array_join(F.col("_texts.texto"), "}")
    lead = F.when((F.col("orden") > 0) | text.rlike(r"^\uFEFF?\s*\["), F.regexp_replace(text, r"^[\s,\[\uFEFF]+", "")).otherwise(
        F.raise_error(F.concat(F.lit("no JSON array: "), "archivo")))
    whole = (F.col("fin") == 1) & ~F.col("cortada")
    rest = F.regexp_replace(lead, r"[\s,\]]+$", "")
    return docs.select(
        "archivo", "orden", F.when(whole, F.concat(lead, F.lit("}"))).otherwise(rest).alias("texto"),
        F.when(F.col("cortada"), "cortada").when(F.col("fin") == 0, "ilegible").alias("causa"),
    ).where((F.col("causa").isNull()) | (F.col("texto") != "") | (F.col("causa") == "cortada"))


def read_array(spark: SparkSession, path: str, schema: str | T.StructType, kind: str = "costs") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of files that hold one JSON array of objects each.

    ``rejects`` has the columns of ``files.REJECTS``; its ``linea`` is the object's text as it stands.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    bad = "_ilegible"
    parsed = cut_lineage(array_documents(spark, path).select("*", F.from_json(
        F.when(F.col("causa").isNull(), F.col("texto")), T.StructType([*wanted, T.StructField(bad, T.StringType())]),
        {"columnNameOfCorruptRecord": bad}).alias("_doc")))
    fits = F.col("causa").isNull() & F.col(f"_doc.{bad}").isNull()
    rows = parsed.where(fits).select(*[F.col("_doc").getField(n).alias(n) for n in wanted.names])
    rejects = parsed.where(~fits).select(
        F.lit(kind).alias("clase"), "archivo", F.coalesce("causa", F.lit("ilegible")).alias("causa"), F.col("texto").alias("linea"))
    return rows, rejects
