"""Readers of the monthly drops. Paths are arguments; schemas are never inferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duesflow import schemas
from duesflow.session import cut_lineage


class MissingInput(FileNotFoundError):
    """The given input path does not exist."""


def _load(reader, path: str) -> DataFrame:
    try:
        return reader.load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise MissingInput(f"input file not found: {path}") from error
        raise


def _text(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _ansi_marks() -> tuple[str, str]:
    """The characters in which ANSI (windows-1252) text differs from ISO-8859-1."""
    plain, ansi = [], []
    for code in range(0x80, 0xA0):
        byte = bytes([code])
        try:
            ansi.append(byte.decode("windows-1252"))
        except UnicodeDecodeError:
            continue
        plain.append(byte.decode("iso-8859-1"))
    return "".join(plain), "".join(ansi)


def ansi_text(df: DataFrame) -> DataFrame:
    """Text that was read as ISO-8859-1, as the ANSI text it is.

    The CSV reader knows no windows-1252; the two differ in a few marks only.
    """
    plain, ansi = _ansi_marks()
    return df.select(*[F.translate(F.col(c), plain, ansi).alias(c) for c in df.columns])


# Per kind of delimited file: its columns, separator and encoding.
DELIMITED = {
    "payments": (schemas.PAYMENT_FILE, ",", "ISO-8859-1"),
    "buildings": (schemas.BUILDING_FILE, ",", "UTF-8"),
    "people": (schemas.PERSON_FILE, ";", "ISO-8859-1"),
    "providers": (schemas.PROVIDER_FILE, ";", "UTF-8"),
    "unit_owners": (schemas.UNIT_OWNER_FILE, "|", "UTF-8"),
    "units": (schemas.UNIT_FILE, "\t", "UTF-8"),
}
REJECTS = "clase string, archivo string, causa string, linea string"


def _delimited(spark: SparkSession, path: str, schema: str, sep: str, encoding: str, line: str | None = None) -> DataFrame:
    columns = _text(schema)
    reader = spark.read.format("csv").options(sep=sep, header=True, encoding=encoding, enforceSchema=True, nullValue="", mode="PERMISSIVE")
    if line is not None:
        columns = T.StructType([*columns, T.StructField(line, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", line)
    return _load(reader.schema(columns), path)


def read_checked(spark: SparkSession, kind: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a delimited file: rows with as many fields as the kind has columns, and the others.

    ``rejects`` holds the kind, the file, the cause (``corta``: fields are missing, ``larga``: there are
    too many, ``ilegible``: else) and the line as it stands. Every line is in one of the two; the
    plain readers fill missing fields with NULL and drop surplus ones instead. Reads the
    file once, into the work folder.
    """
    schema, sep, encoding = DELIMITED[kind]
    names = _text(schema).names
    read = _delimited(spark, path, schema, sep, encoding, line="_linea").select("*", F.col("_metadata.file_path").alias("_archivo"))
    held = cut_lineage(read if encoding == "UTF-8" else ansi_text(read))
    fields = F.size(F.split("_linea", f"[{sep}]", -1))
    cause = F.when(fields < len(names), "corta").when(fields > len(names), "larga").otherwise("ilegible")
    bad = held.where(F.col("_linea").isNotNull()).select(
        F.lit(kind).alias("clase"), F.col("_archivo").alias("archivo"), cause.alias("causa"), F.col("_linea").alias("linea"))
    return held.where(F.col("_linea").isNull()).select(*names), bad


def read_payments(spark: SparkSession, path: str) -> DataFrame:
    return ansi_text(_delimited(spark, path, *DELIMITED["payments"]))


def read_buildings(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, *DELIMITED["buildings"])


def read_people(spark: SparkSession, path: str) -> DataFrame:
    return ansi_text(_delimited(spark, path, *DELIMITED["people"]))


def read_providers(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, *DELIMITED["providers"])


def read_unit_owners(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, *DELIMITED["unit_owners"])


def read_units(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, *DELIMITED["units"])


def read_costs(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """Monthly cost documents: one JSON array per file, or one document per line.

    An array file is read by one task each. Large deliveries should come as many files or as
    JSON Lines, which split, or be read by ``arrays.read_array``, which cuts arrays.
    """
    reader = spark.read.format("json").schema(schemas.COST_FILE).options(multiLine=not json_lines)
    return _load(reader, path)


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One ledger table from its Parquet folder."""
    reader = spark.read.format("parquet").schema(schemas.TABLES[table].schema)
    return _load(reader, f"{root}/{table}")
