"""Registered queries over the monthly job: tables on storage, billed run by run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duesflow import schemas
from duesflow.functions import dates
from duesflow.plans import delivery, runs
from duesflow.session import cut_lineage, work_dir
from duesflow.sources import files, sinks
from duesflow.workload import sql
from duesflow.workload.registry import query
from duesflow.workload.sql import period_key
from duesflow.workload.tables import Ledger, account, money

RUNS = 4


def _blocks(first: dt.date, last: dt.date) -> list[tuple[dt.date, dt.date]]:
    """The months cut into ``RUNS`` spans, as equal as whole months allow (fewer, if there are fewer months)."""
    low, n = first.year * 12 + first.month - 1, (last.year - first.year) * 12 + last.month - first.month + 1
    edges = sorted({low + n * i // RUNS for i in range(RUNS + 1)})
    return [(runs._month(a), runs._month(b - 1)) for a, b in zip(edges, edges[1:], strict=False)]


def _arrival(day: Column, late: Column, blocks) -> Column:
    """The number of the run a row arrives for: that of its month, or ``late`` runs after it."""
    block = F.lit(0)
    for number, (first, _) in enumerate(blocks):
        block = F.when(day >= F.lit(first), number).otherwise(block)
    return F.least(block + late, F.lit(len(blocks) - 1))


def _masters(t: Ledger, home: str) -> str:
    for table, df in (("Consorcio", t.buildings), ("UnidadFuncional", t.shared_units), ("CuentaBancaria", t.accounts)):
        sinks.replace_table(schemas.conform(df, table), f"{home}/masters/{table}")
    return f"{home}/masters"


def _arriving(t: Ledger, blocks) -> dict[str, DataFrame]:
    """Payments up to three runs late by their number, costs up to one."""
    parts = {"Pago": (t.payments, F.pmod(F.col("id"), F.lit(4)))}
    for table, df in (("GastoOrdinario", t.ordinary(billed=False)), ("GastoExtraordinario", t.extraordinary(billed=False))):
        parts[table] = (df, F.pmod(F.col("idGasto"), F.lit(3)) % 2)
    return {table: cut_lineage(schemas.conform(df, table).withColumn("_run", _arrival(F.col(delivery.FACT_DAY[table]), late, blocks)))
            for table, (df, late) in parts.items()}


def _file(t: Ledger, rows: DataFrame) -> DataFrame:
    """Rows of a payment file; every seventh number is blank, every ninth row is empty."""
    key = F.col("o_orderkey")
    columns = {"idPago": F.when(key % 7 == 0, F.lit("  ")).otherwise(key.cast("string")), "fecha": dates.text_dmy(F.col("o_orderdate")),
               "CVU_CBU": account(F.col("o_custkey")), "valor": F.concat(F.lit("$"), money(F.col("o_totalprice")).cast("string"))}
    return rows.select(*[F.when(key % 9 != 0, c).alias(n) for n, c in columns.items()])


def _line(kind: str, fields: list[Column], key: Column) -> Column:
    """Lines of a file of the kind: a field short where the key ends in 3, one long where it ends in 7."""
    sep, digit = files.DELIMITED[kind][1], F.pmod(key, F.lit(10))
    whole = F.concat_ws(sep, *fields)
    return F.when(digit == 3, F.concat_ws(sep, *fields[:-1])).when(digit == 7, F.concat(whole, F.lit(f"{sep}more"))).otherwise(whole)


# Per kind of file: table, key, its fields in Spark and in SQL (not blank, the last one not empty).
FILES = {
    "payments": ("orders", "o_orderkey", ["o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority"]),
    "buildings": ("nation", "n_nationkey", ["n_name", "n_nationkey", "'Calle'", "n_regionkey", "n_nationkey"]),
    "people": ("customer", "c_custkey", ["c_name", "'Núñez'", "c_custkey", "c_mktsegment", "c_nationkey", "c_custkey", "'1'"]),
    "providers": ("supplier", "s_suppkey", ["'SEGUROS'", "s_name", "s_suppkey", "s_nationkey"]),
    "unit_owners": ("customer", "c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "'A'"]),
    "units": ("customer", "c_custkey", ["c_name", "c_custkey", "c_nationkey", "c_mktsegment", "'12,5'", "'1'", "'SI'", "'NO'", "'2'", "'3'"]),
}


def _file_sql(kind: str) -> str:
    table, key, fields = FILES[kind]
    sep = files.DELIMITED[kind][1].replace("\t", "' || chr(9) || '")
    texts = [f"CAST({f} AS VARCHAR)" for f in fields]
    glue = f" || '{sep}' || "
    return f"""
SELECT '{kind}' AS clase, CASE {key} % 10 WHEN 3 THEN 'corta' WHEN 7 THEN 'larga' ELSE 'valida' END AS causa,
       CASE WHEN {key} % 10 NOT IN (3, 7) THEN {texts[0]} END AS primero, CASE WHEN {key} % 10 NOT IN (3, 7) THEN {texts[-1]} END AS ultimo,
       CASE {key} % 10 WHEN 3 THEN {glue.join(texts[:-1])} WHEN 7 THEN {glue.join(texts)} || '{sep}more' END AS linea FROM {table}"""


@query("read_files", "clase text, causa text, primero text, ultimo text, linea text", " UNION ALL ".join(_file_sql(k) for k in FILES))
def read_files(t: Ledger):
    """Files of six kinds written from the tables and read back; lines that do not fit come with their cause.

    Writes the files when called.
    """
    home, out = work_dir(t.spark), None
    for kind, (table, key, fields) in FILES.items():
        _, _, encoding = files.DELIMITED[kind]
        names = T.StructType.fromDDL(files.DELIMITED[kind][0]).names
        texts = [F.expr(f"CAST({f} AS STRING)") for f in fields]
        # A file with one column, whose name is the header line.
        lines = t.table(table).select(_line(kind, texts, F.col(key)).alias("header"))
        lines.write.options(header=True, quote="", sep="\x01", encoding=encoding).csv(f"{home}/{kind}")
        rows, rejects = files.read_checked(t.spark, kind, f"{home}/{kind}")
        nothing = F.lit(None).cast("string")
        part = rows.select(F.lit(kind).alias("clase"), F.lit("valida").alias("causa"), F.col(names[0]).alias("primero"),
                           F.col(names[-1]).alias("ultimo"), nothing.alias("linea")).unionByName(
            rejects.select("clase", "causa", nothing.alias("primero"), nothing.alias("ultimo"), "linea"))
        out = part if out is None else out.unionByName(part)
    return out


COUNT_COLUMNS = "entrega int, leidas int, validas int, repetidas int, nuevas int"
_VALID = "o_orderkey % 7 <> 0 AND o_orderkey % 9 <> 0"


@query("repeated_files", COUNT_COLUMNS, f"""WITH valid AS (SELECT o_orderkey AS k FROM orders WHERE {_VALID}),
counts AS (
  SELECT 0 AS entrega, (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0) AS leidas,
         count(*) FILTER (k % 3 <> 0) AS validas, count(*) FILTER (k % 3 <> 0) AS nuevas FROM valid
  UNION ALL
  SELECT 1, (SELECT count(*) + count(*) FILTER (o_orderkey % 5 = 0) FROM orders),
         count(*) + count(*) FILTER (k % 5 = 0), count(*) FILTER (k % 3 = 0) FROM valid)
SELECT entrega, leidas, validas, validas - nuevas AS repetidas, nuevas FROM counts""")
def repeated_files(t: Ledger):
    """Two payment files; the second holds the first again and some rows twice. Rows read, valid, dropped and
    added, counted while they are written. Only keys are compared, by buckets.

    Runs the deliveries when called.
    """
    facts = f"{work_dir(t.spark)}/facts"
    orders = t.table("orders")
    again = orders.unionByName(orders.where("o_orderkey % 5 = 0"))
    for rows in (orders.where("o_orderkey % 3 <> 0"), again):
        delivery._take_payments(t.spark, _file(t, rows), facts, 1, dt.date(2025, 6, 15))
    counts = runs.import_counts(t.spark, facts)
    # The first delivery has fewer rows than the second.
    return counts.withColumn("entrega", F.row_number().over(W.orderBy("leidas")) - 1)


RUN_COLUMNS = "tabla text, id int, otro int, a money, b money, c money, d money"


@query("monthly_runs", RUN_COLUMNS, f"""WITH RECURSIVE {sql.CARRIED},
due AS (SELECT *, CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE) AS p FROM paid)
SELECT 'Expensa' AS tabla, {period_key('b', 'p')} AS id, b AS otro, (cierre - got + o + e) / 100.0 AS a, got / 100.0 AS b,
       (o + e) / 100.0 AS c, cierre / 100.0 AS d FROM headers
UNION ALL
SELECT 'DetalleExpensa', {period_key('u', 'p')}, {period_key('b', 'p')}, total / 100.0, before / 100.0, got / 100.0, interest / 100.0
FROM refreshed
UNION ALL
SELECT 'PagoAplicado', id, {period_key('u', 'p')}, amt, NULL, NULL, NULL
FROM due WHERE p >= (SELECT min(p) FROM grid) AND p <= (SELECT max(p) FROM grid)""")
def monthly_runs(t: Ledger):
    """Four billing runs over a quarter of the months each; a payment comes none to three runs
    late, a cost none or one. The tables must equal those of one run over all months.

    Runs the deliveries and the billing when called.
    """
    home = work_dir(t.spark)
    masters, facts, blocks = _masters(t, home), f"{home}/facts", _blocks(*t.months)
    arriving = _arriving(t, blocks)
    for number, (first, last) in enumerate(blocks):
        for table, rows in arriving.items():
            delivery.add_facts(rows.where(F.col("_run") == number).drop("_run"), facts, table)
        delivery.bill(t.spark, masters, facts, f"{home}/accounts-{number}", first, last)

    def part(table: str, *columns: str) -> DataFrame:
        named = [*columns, *[None] * (6 - len(columns))]
        return delivery._read(t.spark, facts, table).select(F.lit(table).alias("tabla"), *[
            (F.col(c) if c else F.lit(None)).alias(n) for c, n in zip(named, ("id", "otro", "a", "b", "c", "d"), strict=True)])

    return (part("Expensa", "id", "consorcioId", "saldoAnterior", "ingresosEnTermino", "egresos", "saldoCierre")
            .unionByName(part("DetalleExpensa", "id", "expensaId", "totalaPagar", "saldoAnteriorAbonado", "pagosRecibidos", "interesMora"))
            .unionByName(part("PagoAplicado", "idPago", "idDetalleExpensa", "importeAplicado")))
