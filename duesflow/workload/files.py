"""Registered queries over files that are written from the given tables and read back: JSON arrays, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duesflow.functions.amounts import MONEY
from duesflow.operators import upsert
from duesflow.operators.numbering import id_bucket, number_rows
from duesflow.session import cut_lineage, work_dir
from duesflow.sources import arrays, sinks
from duesflow.workload import sql
from duesflow.workload.registry import query
from duesflow.workload.tables import Ledger

# --- JSON arrays -------------------------------------------------------------

# Orders of one array: keys of a span, so that a larger table gives more files, not larger ones.
SPAN = 1 << 16


def _write_arrays(rows: DataFrame, key: str, text: Column, path: str) -> None:
    """One JSON array a span of keys; ``key`` is unique."""
    span = W.partitionBy("_span").orderBy(key)
    before = F.when(F.row_number().over(span) == 1, "[").otherwise(",")
    after = F.when(F.lead(key).over(span).isNull(), "]").otherwise("")
    lines = rows.select(F.floor(F.col(key) / SPAN).alias("_span"), key, text.alias("_text")).select(
        "_span", key, F.concat(before, F.col("_text"), after).alias("value"))
    lines.sortWithinPartitions("_span", key).select("_span", "value").write.partitionBy("_span").text(path)


@query("json_arrays", "id int, detalle text, total money, partes int, ciudad text, causa text, linea text", f"""
SELECT o_orderkey AS id, 'a}}"[' || o_orderpriority || '\\{{' AS detalle, {sql.money('o_totalprice')} AS total,
       o_orderkey % 5 AS partes, o_orderstatus || '],' AS ciudad, NULL AS causa, NULL AS linea FROM orders WHERE o_orderkey % 97 <> 0
UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, 'ilegible', '{{"id":tru' || o_orderkey || '}}' FROM orders WHERE o_orderkey % 97 = 0""")
def json_arrays(t: Ledger):
    """All orders as JSON arrays with braces and quotes inside texts, read back by blocks; objects
    that do not parse come as rejects. Writes the files when called."""
    home, key = work_dir(t.spark), F.col("o_orderkey")
    text = F.concat(F.lit('a}"['), "o_orderpriority", F.lit("\\{"))
    parts = F.sequence(F.lit(1), (key % 5).cast("int"))
    whole = F.to_json(F.struct(
        key.alias("id"), text.alias("detalle"),
        F.struct(F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
                 F.when(key % 5 > 0, parts).otherwise(F.array().cast("array<int>")).alias("partes")).alias("importe"),
        F.array(F.struct(F.concat("o_orderstatus", F.lit("],")).alias("ciudad"))).alias("lugares")))
    broken = F.concat(F.lit('{"id":tru'), key.cast("string"), F.lit("}"))
    _write_arrays(t.table("orders"), "o_orderkey", F.when(key % 97 == 0, broken).otherwise(whole), home)
    rows, rejects = arrays.read_array(
        t.spark, home, "id bigint, detalle string, importe struct<total:decimal(18,2),partes:array<int>>, lugares array<struct<ciudad:string>>")
    nothing = F.lit(None)
    return rows.select(
        "id", "detalle", F.col("importe.total").alias("total"), F.size("importe.partes").alias("partes"),
        F.col("lugares")[0]["ciudad"].alias("ciudad"), nothing.cast("string").alias("causa"), nothing.cast("string").alias("linea"),
    ).unionByName(rejects.select("causa", "linea"), allowMissingColumns=True)


# --- sinks ---------------------------------------------------------------------


@query("appended_months", "id int, anio int, mes int, importe money", f"""
SELECT o_orderkey AS id, year(o_orderdate) AS anio, month(o_orderdate) AS mes, {sql.money('o_totalprice')} AS importe FROM orders
UNION ALL
SELECT o_orderkey, year(o_orderdate), month(o_orderdate), {sql.money('o_totalprice')} FROM orders WHERE o_orderkey % 3 = 0""")
def appended_months(t: Ledger):
    """A third of the payments, then all of them, appended to a table by month. Writes when called."""
    home = work_dir(t.spark)
    rows = t.payments.select("id", F.year("fecha").alias("anio"), F.month("fecha").alias("mes"), "importe")
    for part in (rows.where("id % 3 = 0"), rows):
        sinks.append(part, home, ["anio", "mes"])
    return t.spark.read.parquet(home)


@query("replaced_months", "id int, anio int, mes int, importe money", f"""
WITH changed AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders WHERE o_orderkey % 1000 = 7 GROUP BY ALL)
SELECT o_orderkey AS id, year(o_orderdate) AS anio, month(o_orderdate) AS mes,
       CASE WHEN changed.y IS NULL THEN {sql.money('o_totalprice')} ELSE {sql.money('o_totalprice')} + 1 END AS importe
FROM orders LEFT JOIN changed ON y = year(o_orderdate) AND m = month(o_orderdate)
WHERE changed.y IS NULL OR o_orderkey % 2 = 1""")
def replaced_months(t: Ledger):
    """Months that some payments fall into are replaced by changed rows, twice with the same
    result; the others stay. Writes when called."""
    home, months = work_dir(t.spark), ["anio", "mes"]
    rows = t.payments.select("id", F.year("fecha").alias("anio"), F.month("fecha").alias("mes"), "importe")
    sinks.overwrite_partitions(rows, home, months, ["id"])
    changed = rows.where("id % 1000 = 7").select(*months).distinct()
    fresh = upsert.present(rows.where("id % 2 = 1"), changed, months).withColumn(
        "importe", (F.col("importe") + 1).cast(MONEY))
    for _ in range(2):
        sinks.overwrite_partitions(fresh, home, months, ["id"])
    return t.spark.read.parquet(home)


@query("replaced_table", "id int, nombre text, direccion text, version int", """
SELECT s_suppkey AS id, s_name AS nombre, CASE WHEN s_acctbal < 0 THEN 'Nueva' ELSE 'Vieja ' || s_suppkey END AS direccion, v AS version
FROM supplier, (SELECT unnest([1, 2]) AS v) WHERE v = 2 OR s_acctbal >= 0
UNION ALL SELECT s_suppkey, s_name, NULL, 1 FROM supplier WHERE s_acctbal < 0""")
def replaced_table(t: Ledger):
    """A table and its updated form, in a folder of its own: missing addresses filled, the old one kept. Writes when called."""
    home, supplier = work_dir(t.spark), t.table("supplier")
    old = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("nombre"), F.when(
        F.col("s_acctbal") >= 0, F.concat(F.lit("Vieja "), F.col("s_suppkey").cast("string"))).alias("direccion"))
    sinks.replace_table(old, f"{home}/1")
    news = supplier.select(F.col("s_suppkey").alias("id"), F.lit("Nueva").alias("direccion"))
    sinks.replace_table(upsert.fill(t.spark.read.parquet(f"{home}/1"), news, ["id"], ["direccion"]), f"{home}/2")
    return t.spark.read.parquet(f"{home}/1").withColumn("version", F.lit(1)).unionByName(
        t.spark.read.parquet(f"{home}/2").withColumn("version", F.lit(2)))


@query("xml_files", "clave int, nombre text, segmento text, saldo money, lugar int", f"""
SELECT c_custkey AS clave, c_name || ' & <' || c_nationkey || '> "ñ"' AS nombre,
       CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segmento, {sql.money('c_acctbal')} AS saldo, 0 AS lugar FROM customer
UNION ALL
SELECT c_custkey, NULL, NULL, NULL, row_number() OVER (ORDER BY c_nationkey, c_custkey) FROM customer""")
def xml_files(t: Ledger):
    """Customers as XML elements and as one document in the order of their nation, both read back. Writes when called."""
    home, customer = work_dir(t.spark), t.table("customer")
    rows = customer.select(
        F.col("c_custkey").alias("clave"),
        F.concat("c_name", F.lit(" & <"), F.col("c_nationkey").cast("string"), F.lit('> "ñ"')).alias("nombre"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segmento"),
        F.col("c_acctbal").cast("decimal(18,2)").alias("saldo"))
    sinks.write_xml(rows, f"{home}/rows", "Clientes", "Cliente")
    read = t.spark.read.format("xml").options(rowTag="Cliente").schema(
        "clave bigint, nombre string, segmento string, saldo decimal(18,2)").load(f"{home}/rows")
    lines = customer.select("c_nationkey", "c_custkey", F.concat(F.lit("<c>"), F.col("c_custkey").cast("string"), F.lit("</c>")).alias("xml"))
    sinks.write_document(lines, f"{home}/document", "Clientes", ["c_nationkey", "c_custkey"])
    return read.withColumn("lugar", F.lit(0)).unionByName(_document_lines(t, f"{home}/document"), allowMissingColumns=True)


def _document_lines(t: Ledger, path: str) -> DataFrame:
    """(clave, lugar): the elements of a written document, with their line in the files joined by name."""
    read = cut_lineage(t.spark.read.text(path).select(
        F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), "value"))
    order = ["_file", "_block", "_at"]
    numbered = number_rows(read, "lugar", order, [F.col("_file"), F.col("_block"), id_bucket(F.col("_at"))])
    # The line of the root element is the first.
    return numbered.where(F.col("value").startswith("<c>")).select(
        F.regexp_extract("value", r"<c>(\d+)</c>", 1).cast("bigint").alias("clave"), (F.col("lugar") - 1).alias("lugar"))
