"""Registered import queries: raw file rows are built from the given tables as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duesflow import schemas
from duesflow.functions import amounts, dates, text
from duesflow.plans import fillers, imports
from duesflow.session import work_dir
from duesflow.streaming.ingest import ingest_drops, read_ingested
from duesflow.workload import sql
from duesflow.workload.registry import query
from duesflow.workload.sql import draw, draw_below, half_up, pick
from duesflow.workload.tables import Ledger, account, money

# --- localized amounts -----------------------------------------------------


def _localized(amount: Column, style: Column) -> Column:
    """Amount text in four styles: 1,234.56 / 1.234,56 / 1,234,56 / 1234,56."""
    us = F.format_number(amount, 2)
    return (
        F.when(style == 0, us)
        .when(style == 1, F.translate(us, ",.", ".,"))
        .when(style == 2, F.translate(us, ".", ","))
        .otherwise(F.translate(amount.cast("string"), ".", ","))
    )


def _localized_sql(column: str, style: str) -> str:
    c = sql.cents(column)
    whole, rest = f"({c} // 100)", f"lpad(CAST({c} % 100 AS VARCHAR), 2, '0')"
    us = f"format('{{:,}}', CAST({whole} AS BIGINT))"
    return (f"CASE {style} WHEN 0 THEN {us} || '.' || {rest} WHEN 1 THEN replace({us}, ',', '.') || ',' || {rest}"
            f" WHEN 2 THEN {us} || ',' || {rest} ELSE {whole} || ',' || {rest} END")


def _parse_sql(text_: str) -> str:
    plain = f"replace(replace({text_}, '.', ''), ',', '.')"
    return (f"CASE WHEN regexp_matches({plain}, '^[0-9]+(\\.[0-9]*)?$')"
            f" THEN CAST({plain} AS DECIMAL(18,2)) END")


@query("amount_parse", "o_orderkey int, texto text, referencia money, corregido money",
       f"""WITH texts AS (SELECT o_orderkey, {_localized_sql('o_totalprice', '(o_orderkey % 4)')} AS t, o_totalprice
                          FROM orders)
SELECT o_orderkey, t AS texto, {_parse_sql('t')} AS referencia, {sql.money('o_totalprice')} AS corregido FROM texts""")
def amount_parse(t: Ledger):
    texts = t.table("orders").select(
        "o_orderkey", _localized(money(F.col("o_totalprice")), F.col("o_orderkey") % 4).alias("texto"))
    return texts.select("*", amounts.parse_amount(F.col("texto")).alias("referencia"),
                        amounts.parse_amount(F.col("texto"), "smart").alias("corregido"))


# --- monthly costs -----------------------------------------------------------

_MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in dates.MONTH_NAMES) + "]"


def _cost_documents(t: Ledger):
    """One cost document per order: building name, month name, seven amount texts."""
    day = F.col("o_orderdate")
    price = money(F.col("o_totalprice"))
    month = F.get(F.array(*[F.lit(m) for m in dates.MONTH_NAMES]), F.month(day) - 1)
    docs = t.table("orders").join(t.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    texts = [
        F.when((F.col("o_orderstatus") == "P") & F.lit(c == imports.GENERAL_CATEGORY), F.lit("0,00")).otherwise(
            _localized(price, (F.col("o_orderkey") + i) % 4)).alias(c)
        for i, c in enumerate(schemas.COST_CATEGORIES)
    ]
    return docs.select(F.col("n_name").alias("Nombre del consorcio"), F.concat(month, F.lit(" ")).alias("Mes"), *texts)


_DOCUMENT_ROWS = " UNION ALL ".join(
    f"SELECT n_name, month(o_orderdate) AS m, '{c}' AS kind,"
    f" CASE WHEN o_orderstatus = 'P' AND {c == imports.GENERAL_CATEGORY} THEN '0,00'"
    f" ELSE {_localized_sql('o_totalprice', f'((o_orderkey + {i}) % 4)')} END AS t"
    f" FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey"
    for i, c in enumerate(schemas.COST_CATEGORIES))


@query("costs_unpivot", "nombreConsorcio text, mes int, tipoServicio text, importe money",
       f"""WITH texts AS ({_DOCUMENT_ROWS}), parsed AS (SELECT *, {_parse_sql('t')} AS amount FROM texts)
SELECT n_name AS "nombreConsorcio", m AS mes, kind AS "tipoServicio", amount AS importe FROM parsed WHERE amount > 0""")
def costs_unpivot(t: Ledger):
    return imports.parse_costs(_cost_documents(t), as_of="2025-06-15")


@query("cost_import", "idGasto int, consorcioId int, nroFactura text, fechaEmision date, importeTotal money, "
       "tipoServicio text", f"""WITH texts AS ({_DOCUMENT_ROWS}), parsed AS (SELECT *, {_parse_sql('t')} AS amount FROM texts),
fresh AS (
  SELECT n_nationkey AS b, m, kind, amount FROM parsed JOIN nation ON nation.n_name = parsed.n_name WHERE amount > 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY b, m, kind, amount) + 7 AS k FROM fresh)
SELECT k AS "idGasto", b AS "consorcioId",
       lpad(CAST(k AS VARCHAR), 10, '0') AS "nroFactura",
       make_date(2025, CAST(m AS INT), 1) AS "fechaEmision", amount AS "importeTotal", kind AS "tipoServicio"
FROM numbered""")
def cost_import(t: Ledger):
    """Numbers every cost of every document after the ledger's last number."""
    ledger = schemas.empty(t.spark, "GastoOrdinario")
    return imports.import_costs(_cost_documents(t), t.buildings, ledger, 2025, last_number=7, as_of="2025-06-15")


@query("invoice_number", "id int, numero int, nroFactura text", f"""WITH {sql.PAID},
numbered AS (SELECT *, row_number() OVER (ORDER BY d, id) AS k FROM paid)
SELECT id, k AS numero, lpad(CAST(k AS VARCHAR), 10, '0') AS "nroFactura" FROM numbered""")
def invoice_number(t: Ledger):
    from duesflow.operators.numbering import id_bucket, number_rows

    rows = t.paid.select(F.col("idPago").alias("id"), "consorcioId", F.col("fecha").cast("date").alias("dia"))
    numbered = number_rows(rows, "numero", ["dia", "id"], [F.col("dia"), id_bucket(F.col("id"))])
    return numbered.withColumn("nroFactura", imports.invoice_number(
        F.col("consorcioId"), F.col("dia"), F.col("numero")))


# --- providers -----------------------------------------------------------------


def _provider_rows(t: Ledger):
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair]), F.col("p_type"))
    company = F.when(F.col("p_size") > 40, F.lit("AYSA ")).when(
        F.col("p_size") > 20, F.concat("p_name", F.lit(" - "), "p_brand", F.lit("-x"))).otherwise(F.col("p_name"))
    extra = F.when(F.col("p_size") > 30, F.concat(F.lit(" cuenta "), F.col("p_size").cast("string"))).otherwise(F.lit(" "))
    return t.table("part").select(
        "p_partkey", kind.alias("tipoGasto"), company.alias("empresaDetalle"), extra.alias("detalleAdicional"),
        F.concat("p_brand", F.lit(" ")).alias("nombreConsorcio"))


_KINDS = {
    "STANDARD": "Gastos bancarios varios", "ECONOMY": "GASTOS DE ADMINISTRACION", "MEDIUM": "gastos de limpieza",
    "PROMO": "SEGUROS ", "SMALL": "Servicios Publicos", "LARGE": "otros gastos",
}
_CATEGORIES = {
    "STANDARD": "BANCARIOS", "ECONOMY": "ADMINISTRACION", "MEDIUM": "LIMPIEZA", "PROMO": "SEGUROS",
    "SMALL": "SERVICIOS PUBLICOS", "LARGE": "OTROS GASTOS",
}


@query("prefix_classify", "nombreConsorcio text, categoria text, empresa text, detalle text, servicio text",
       f"""SELECT p_brand AS "nombreConsorcio",
       CASE p_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _CATEGORIES.items())} END AS categoria,
       CASE WHEN p_size > 40 THEN 'AYSA' ELSE p_name END AS empresa,
       CASE WHEN p_size > 30 THEN 'cuenta ' || p_size WHEN p_size > 20 THEN p_brand || '-x' ELSE p_name END AS detalle,
       CASE WHEN p_size > 40 THEN 'SERVICIOS PUBLICOS' END AS servicio FROM part""")
def prefix_classify(t: Ledger):
    return imports.clean_providers(_provider_rows(t).drop("p_partkey"))


@query("prefix_enrich", "idGasto int, consorcioId int, nombreEmpresaoPersona text, detalle text, tipoServicio text, "
       "importeTotal money", f"""WITH {sql.COST},
offers AS (
  SELECT s_nationkey AS b, CASE WHEN s_acctbal < 3000 THEN 'LIMPIEZA' WHEN s_acctbal < 6000 THEN 'SERVICIOS PUBLICOS'
         ELSE 'SEGUROS' END AS kind, s_name AS firm FROM supplier),
best AS (SELECT b, kind, min(firm) AS firm FROM offers GROUP BY b, kind),
open_costs AS (
  SELECT *, CASE WHEN status = 'O' AND ln < 4 THEN 'LIMPIEZA' WHEN status = 'O' THEN 'SERVICIOS PUBLICOS-Agua'
         WHEN ln < 4 THEN 'SEGUROS' ELSE 'GASTOS GENERALES' END AS kind FROM cost WHERE NOT extra)
SELECT okey AS "idGasto", c.b AS "consorcioId", best.firm AS "nombreEmpresaoPersona",
       CASE WHEN best.firm IS NOT NULL THEN 'Abono' END AS detalle, c.kind AS "tipoServicio", amt AS "importeTotal"
FROM open_costs c LEFT JOIN best ON best.b = c.b AND c.kind <> 'GASTOS GENERALES' AND starts_with(c.kind, best.kind)""")
def prefix_enrich(t: Ledger):
    balance = F.col("s_acctbal")
    kind = F.when(balance < 3000, "GASTOS DE LIMPIEZA").when(balance < 6000, "SERVICIOS PUBLICOS").otherwise("SEGUROS")
    raw = t.table("supplier").join(t.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        kind.alias("tipoGasto"), F.concat("s_name", F.lit(" - Abono")).alias("empresaDetalle"),
        F.lit(None).cast("string").alias("detalleAdicional"), F.col("n_name").alias("nombreConsorcio"))
    open_, first = F.col("l_linestatus") == "O", F.col("l_linenumber") < 4
    label = F.when(open_ & first, "LIMPIEZA").when(open_, "SERVICIOS PUBLICOS-Agua").when(first, "SEGUROS").otherwise(
        "GASTOS GENERALES")
    costs = t.cost_rows.where(~F.col("extra")).select(
        F.col("l_orderkey").alias("idGasto"), "consorcioId", "importeTotal",
        F.lit(None).cast("string").alias("nombreEmpresaoPersona"), F.lit(None).cast("string").alias("detalle"),
        label.alias("tipoServicio"))
    return imports.import_providers(raw, t.buildings, costs)


# --- payments --------------------------------------------------------------------


def _payment_file(t: Ledger):
    """Payment file rows: blanks around accounts, some dates and numbers missing."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    partial = F.col("o_orderstatus") == "P"
    day = F.when(urgent & partial, F.lit("31/02/2024")).otherwise(dates.text_dmy(F.col("o_orderdate")))
    number = F.when((F.col("o_orderpriority") == "5-LOW") & partial, F.lit(None)).otherwise(
        F.concat(F.lit(" "), F.col("o_orderkey").cast("string")))
    return t.table("orders").select(
        number.alias("idPago"), day.alias("fecha"),
        F.concat(F.lit(" "), account(F.col("o_custkey")), F.lit(" ")).alias("CVU_CBU"),
        F.concat(F.lit("$"), money(F.col("o_totalprice")).cast("string")).alias("valor"))


PAYMENT_COLUMNS = "id int, idFormaPago int, cbuCuentaOrigen text, fecha date, importe money"


@query("clean_rows", PAYMENT_COLUMNS, f"""
SELECT o_orderkey AS id, 1 AS "idFormaPago", {sql.account('o_custkey')} AS "cbuCuentaOrigen",
       CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN DATE '2025-06-15'
            ELSE CAST(o_orderdate AS DATE) END AS fecha, {sql.money('o_totalprice')} AS importe
FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P')""")
def clean_rows(t: Ledger):
    return imports.clean_payments(_payment_file(t), 1, as_of="2025-06-15")


@query("payment_import", PAYMENT_COLUMNS, f"""
SELECT o_orderkey AS id, 1 AS "idFormaPago", {sql.account('o_custkey')} AS "cbuCuentaOrigen",
       CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN DATE '2025-06-15'
            ELSE CAST(o_orderdate AS DATE) END AS fecha, {sql.money('o_totalprice')} AS importe
FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P') AND NOT o_orderstatus = 'F'""")
def payment_import(t: Ledger):
    """The file twice over, into a ledger that already has the closed orders."""
    known = t.payments.join(t.table("orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("id")), "id", "left_semi")
    raw = _payment_file(t)
    return imports.import_payments(raw.unionByName(raw), known, 1, as_of="2025-06-15")


@query("first_method", "idFormaPago int", """
SELECT min(CAST(substr(o_orderpriority, 1, 1) AS INT)) AS "idFormaPago" FROM orders""")
def first_method(t: Ledger):
    methods = t.table("orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("idFormaPago"))
    return imports.default_method(methods)


@query("incremental_ingest", "id int, cbuCuentaOrigen text, fecha date, importe money", f"""
SELECT o_orderkey AS id, {sql.account('o_custkey')} AS "cbuCuentaOrigen", CAST(o_orderdate AS DATE) AS fecha,
       {sql.money('o_totalprice')} AS importe FROM orders""")
def incremental_ingest(t: Ledger):
    """All payments arrive in two overlapping file drops; each is kept once, as it came first,
    though the second drop gives those sent again another date or none.

    Runs the two writes and the two streams when called.
    """
    home = work_dir(t.spark)
    schema = T.StructType.fromDDL(schemas.PAYMENT_FILE)
    rows = t.table("orders").select(
        F.col("o_orderkey").cast("string").alias("idPago"), dates.text_dmy(F.col("o_orderdate")).alias("fecha"),
        account(F.col("o_custkey")).alias("CVU_CBU"),
        F.concat(F.lit("$"), money(F.col("o_totalprice")).cast("string")).alias("valor"), "o_orderdate")
    drops = (F.col("o_orderdate") < "1999-01-01", F.col("o_orderdate") >= "1997-01-01")
    again = F.when(F.col("idPago").cast("bigint") % 2 == 0, dates.text_dmy(F.date_add("o_orderdate", 40)))
    moved = rows.withColumn("fecha", F.when(drops[0], again).otherwise(F.col("fecha")))
    for sent, drop in zip((rows, moved), drops, strict=True):
        sent.where(drop).drop("o_orderdate").write.mode("append").option("header", True).csv(f"{home}/in")
        stream = ingest_drops(
            t.spark, f"{home}/in", f"{home}/out", f"{home}/state", schema, ["id"], "fecha",
            options={"header": "true"}, clean=lambda raw: imports.clean_payments(raw, 1))
        stream.awaitTermination()
    return read_ingested(t.spark, f"{home}/out", schemas.TABLES["Pago"].schema)


# --- people, buildings, units ------------------------------------------------------


@query("people_import", "idPersona int, nombre text, dni text, email text, CVU_CBU text, idTipoRol int", f"""
WITH raw AS (
  SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN {sql.account('c_custkey // 2')}
                 WHEN c_mktsegment = 'MACHINERY' THEN NULL
                 ELSE {sql.account('c_custkey + 1000000000')} END AS cvu FROM customer),
kept AS (SELECT * FROM raw WHERE cvu IS NULL OR cvu IN (SELECT cvu FROM raw GROUP BY cvu HAVING count(*) = 1)),
fresh AS (SELECT * FROM kept WHERE NOT (c_mktsegment = 'FURNITURE' AND c_acctbal > 0))
SELECT row_number() OVER (ORDER BY cvu NULLS FIRST, c_custkey) + 10 AS "idPersona", c_name AS nombre,
       CAST(c_custkey AS VARCHAR) AS dni, 'c' || c_custkey || '@example.com' AS email, cvu AS "CVU_CBU",
       CASE WHEN c_acctbal >= 0 THEN 1 ELSE 2 END AS "idTipoRol" FROM fresh""")
def people_import(t: Ledger):
    segment, key = F.col("c_mktsegment"), F.col("c_custkey")
    cvu = F.when(segment == "BUILDING", account(F.floor(key / 2))).when(
        segment != "MACHINERY", account(key + 1000000000))
    customer = t.table("customer")
    raw = customer.select(
        F.concat(F.lit(" "), "c_name").alias("nombre"), segment.alias("apellido"), key.cast("string").alias("dni"),
        F.concat(F.lit(" c"), key.cast("string"), F.lit(" @ example.com")).alias("email"),
        key.cast("string").alias("telefono"), cvu.alias("CVU_CBU"),
        F.when(F.col("c_acctbal") >= 0, "1").otherwise("0").alias("tipo"))
    known = customer.where((segment == "FURNITURE") & (F.col("c_acctbal") > 0)).select(
        key.cast("string").alias("dni"), cvu.alias("CVU_CBU"))
    return imports.import_people(raw, known, last_id=10)


@query("insert_if_absent", "c_custkey int, c_name text", """
SELECT c_custkey, c_name FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def insert_if_absent(t: Ledger):
    from duesflow.operators.upsert import absent

    pending = t.table("orders").where("o_orderstatus = 'P'")
    return absent(t.table("customer"), pending, {"c_custkey": "o_custkey"}).select("c_custkey", "c_name")


@query("upsert_fill", "id int, nombre text, direccion text, metrosCuadradosTotal money", f"""
WITH known AS (SELECT * FROM supplier WHERE s_acctbal < 6000), drop_ AS (SELECT * FROM supplier WHERE s_acctbal > 3000 OR s_acctbal < 0),
fresh AS (SELECT * FROM drop_ WHERE s_name NOT IN (SELECT s_name FROM known))
SELECT known.s_suppkey AS id, known.s_name AS nombre,
       coalesce(CASE WHEN drop_.s_acctbal > 0 THEN 'Nueva ' || drop_.s_suppkey END, 'Vieja') AS direccion,
       CASE WHEN drop_.s_suppkey IS NULL THEN 1 ELSE {sql.money('drop_.s_acctbal')} END AS "metrosCuadradosTotal"
FROM known LEFT JOIN drop_ ON drop_.s_name = known.s_name
UNION ALL
SELECT row_number() OVER (ORDER BY s_name) + 100000000, s_name,
       CASE WHEN s_acctbal > 0 THEN 'Nueva ' || s_suppkey END, {sql.money('s_acctbal')} FROM fresh""")
def upsert_fill(t: Ledger):
    supplier = t.table("supplier")
    known = supplier.where("s_acctbal < 6000").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("nombre"), F.lit(None).cast("string").alias("CVU_CBU"),
        F.lit("Vieja").alias("direccion"), F.lit(1).cast("decimal(10,2)").alias("metrosCuadradosTotal"))
    raw = supplier.where("s_acctbal > 3000 or s_acctbal < 0").select(
        F.col("s_name").alias("consorcio"), F.concat(F.lit(" "), "s_name", F.lit(" ")).alias("nombre"),
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit("Nueva "), F.col("s_suppkey").cast("string"))).alias("direccion"),
        F.lit("1").alias("cantUnidades"), money(F.col("s_acctbal")).cast("string").alias("superficie"))
    return imports.import_buildings(raw, known, last_id=100000000)


@query("unit_owner_import", "id int, CVU_CBU text, consorcioId int, piso text, departamento text, numero int", f"""
WITH fresh AS (
  SELECT * FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_mktsegment <> 'HOUSEHOLD'
  WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'))
SELECT row_number() OVER (ORDER BY n_nationkey NULLS FIRST, c_custkey) AS id, {sql.account('c_custkey')} AS "CVU_CBU",
       n_nationkey AS "consorcioId", 'PB  ' AS piso, substr(c_mktsegment, 1, 1) AS departamento, c_custkey AS numero
FROM fresh""")
def unit_owner_import(t: Ledger):
    """Households come with a building name the ledger does not know."""
    key = F.col("c_custkey")
    name = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("?")).otherwise(F.col("n_name"))
    raw = t.table("customer").join(t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(account(key), F.lit(" ")).alias("CVU_CBU"), F.concat(name, F.lit(" ")).alias("nombreConsorcio"),
        key.cast("string").alias("numero"), F.lit("PB").alias("piso"),
        F.substring("c_mktsegment", 1, 1).alias("departamento"))
    known = t.table("orders").where("o_orderpriority = '1-URGENT'").select(account(F.col("o_custkey")).alias("CVU_CBU"))
    return imports.import_unit_owners(raw, t.buildings, known)


@query("unit_import", "id int, consorcioId int, metrosCuadrados money, porcentajeExpensas money, tipo text", f"""
SELECT c_custkey AS id, c_nationkey AS "consorcioId",
       CASE WHEN c_acctbal > 0 THEN {sql.money('c_acctbal')} ELSE {sql.money('abs(c_acctbal)')} END AS "metrosCuadrados",
       CASE WHEN c_mktsegment <> 'BUILDING' THEN 1.25 END AS "porcentajeExpensas",
       CASE WHEN c_mktsegment <> 'BUILDING' THEN
         {pick('(c_nationkey * 100003 + c_custkey)', 1, imports.UNIT_KINDS)} END AS tipo
FROM customer WHERE c_acctbal > 0 OR c_mktsegment <> 'BUILDING'
UNION ALL SELECT c_custkey, c_nationkey, NULL, NULL, NULL FROM customer
WHERE NOT (c_acctbal > 0 OR c_mktsegment <> 'BUILDING')""")
def unit_import(t: Ledger):
    balance = F.col("c_acctbal").cast("decimal(10,2)")
    listed = t.table("customer").where("c_mktsegment <> 'BUILDING'").join(
        t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit(" "), "n_name").alias("nombreConsorcio"),
        F.col("c_custkey").cast("string").alias("nroUnidadFuncional"), F.lit("1,25").alias("coeficiente"),
        F.translate(F.abs(balance).cast("string"), ".", ",").alias("m2"))
    known = t.table("customer").select(
        F.col("c_custkey").alias("id"), account(F.col("c_custkey")).alias("CVU_CBU"),
        F.col("c_nationkey").cast("bigint").alias("consorcioId"), F.lit("A").alias("departamento"),
        F.lit("PB").alias("piso"), F.col("c_custkey").cast("int").alias("numero"),
        F.when(balance > 0, balance).alias("metrosCuadrados"),
        F.lit(None).cast("decimal(5,2)").alias("porcentajeExpensas"), F.lit(None).cast("string").alias("tipo"))
    return imports.import_units(listed, t.buildings, known)[1]


# --- fillers -----------------------------------------------------------------------


@query("general_costs", "idGasto int, nombreEmpresaoPersona text, detalle text", f"""
SELECT p_partkey AS "idGasto",
       CASE WHEN p_type <> 'STANDARD' THEN NULL WHEN p_size > 25 THEN p_name
            ELSE {pick('p_partkey', 1, fillers.GENERAL_COMPANIES)} END AS "nombreEmpresaoPersona",
       CASE WHEN p_type = 'STANDARD' THEN {pick('p_partkey', 2, fillers.GENERAL_DETAILS)} END AS detalle FROM part""")
def general_costs(t: Ledger):
    standard = F.col("p_type") == "STANDARD"
    rows = t.table("part").select(
        F.col("p_partkey").alias("idGasto"),
        F.when(standard & (F.col("p_size") > 25), F.col("p_name")).alias("nombreEmpresaoPersona"),
        F.lit(None).cast("string").alias("detalle"),
        F.when(standard, "Gastos generales").otherwise("LIMPIEZA").alias("tipoServicio"))
    return fillers.fill_general_costs(rows)


_SEEDED = (f"(5000000 + {draw_below('o_orderkey', 3, 50000000)})", f"({draw_below('o_orderkey', 5, 2)} = 1)",
           f"({draw_below('o_orderkey', 6, 5)} + 1)")


SEEDED_COLUMNS = ("idGasto int, consorcioId int, nombreEmpresaoPersona text, nroFactura text, fechaEmision date, "
                  "importeTotal money, detalle text, esPagoTotal bool, nroCuota int, totalCuota money")


@query("seeded_costs", SEEDED_COLUMNS, f"""
SELECT o_orderkey AS "idGasto", c_nationkey AS "consorcioId",
       {pick('o_orderkey', 1, fillers.WORK_COMPANIES)} AS "nombreEmpresaoPersona",
       lpad(CAST({draw('o_orderkey', 7)} AS VARCHAR), 10, '0') AS "nroFactura",
       DATE '2025-04-01' + CAST({draw_below('o_orderkey', 4, 91)} AS INT) AS "fechaEmision",
       {_SEEDED[0]} / 100.0 AS "importeTotal", {pick('o_orderkey', 2, fillers.WORK_DETAILS)} AS detalle,
       {_SEEDED[1]} AS "esPagoTotal", CASE WHEN NOT {_SEEDED[1]} THEN {_SEEDED[2]} END AS "nroCuota",
       CASE WHEN {_SEEDED[1]} THEN {_SEEDED[0]} ELSE {half_up(_SEEDED[0], _SEEDED[2])} END / 100.0 AS "totalCuota"
FROM orders JOIN customer ON o_custkey = c_custkey""")
def seeded_costs(t: Ledger):
    rows = t.paid.select(F.col("idPago").alias("idGasto"), "consorcioId")
    return fillers.extraordinary_costs(rows, "2025-04-01", 91)


@query("simulated_payments", "id int, idFormaPago int, cbuCuentaOrigen text, fecha date, importe money",
       f"""WITH {sql.LINES}
SELECT id, {draw_below('id', 4, 3)} + 1 AS "idFormaPago", {sql.account('u')} AS "cbuCuentaOrigen",
       CAST(m + INTERVAL 1 MONTH + INTERVAL 5 DAY AS DATE) + CAST({draw_below('id', 3, 6)} AS INT) AS fecha,
       {half_up(f"total * (70 + {draw_below('id', 2, 31)})", '100')} / 100.0 AS importe
FROM lines WHERE {draw_below('id', 1, 100)} < 80""")
def simulated_payments(t: Ledger):
    return fillers.simulate_payments(t.lines, t.units)


@query("attach_sequence", "unidadFuncionalId int, numero int, porcentajeExpensas money", f"""WITH {sql.UNITS},
taken AS (SELECT b, max(u % 100 + 1) AS top FROM units WHERE dep = 'H' GROUP BY b)
SELECT s.u AS "unidadFuncionalId", row_number() OVER (PARTITION BY s.b ORDER BY s.u) + coalesce(top, 0) AS numero,
       pct / 100.0 AS "porcentajeExpensas"
FROM shared s LEFT JOIN taken ON taken.b = s.b WHERE s.dep <> 'H'""")
def attach_sequence(t: Ledger):
    taken = t.units.where("departamento = 'H'").select(
        "id", F.col("id").alias("unidadFuncionalId"), (F.col("id") % 100 + 1).cast("int").alias("numero"))
    return fillers.attach_extras(t.units, taken)


@query("account_attach", "id int, CVU_CBU text", f"""
WITH ranked AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer)
SELECT c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN {sql.account('c_custkey')}
       ELSE lpad(CAST({draw('rn', 1)} AS VARCHAR), 11, '0') || lpad(CAST(rn AS VARCHAR), 11, '0') END AS "CVU_CBU"
FROM ranked""")
def account_attach(t: Ledger):
    owners = t.table("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("nombre"),
        F.when(F.col("c_acctbal") > 5000, account(F.col("c_custkey"))).alias("CVU_CBU"))
    return fillers.attach_accounts(owners)[1]


@query("generated_accounts", "CVU_CBU text, nombreTitular text, saldo money", f"""
WITH ranked AS (SELECT row_number() OVER (ORDER BY c_custkey) AS rn FROM customer)
SELECT lpad(CAST({draw('rn', 1)} AS VARCHAR), 11, '0') || lpad(CAST(rn AS VARCHAR), 11, '0') AS "CVU_CBU",
       {pick('rn', 2, fillers.FIRST_NAMES)} || ' ' || {pick('rn', 3, fillers.LAST_NAMES)} AS "nombreTitular",
       ({draw_below('rn', 4, 4900001)} + 100000) / 100.0 AS saldo FROM ranked""")
def generated_accounts(t: Ledger):
    owners = t.table("customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("CVU_CBU"))
    return fillers.attach_accounts(owners)[0]


@query("blank_keys", "c_custkey int, clave text, vacio text", """
SELECT c_custkey, upper(c_name) AS clave,
       CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS vacio FROM customer""")
def blank_keys(t: Ledger):
    padded = F.concat(F.lit("  "), F.lower("c_name"), F.lit(" "))
    blank = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("   ")).otherwise(F.col("c_mktsegment"))
    return t.table("customer").select("c_custkey", text.key(padded).alias("clave"),
                                      text.blank_to_null(blank).alias("vacio"))
