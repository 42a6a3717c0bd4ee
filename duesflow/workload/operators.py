"""Registered operator queries: functions, duplicates, quality, counts, protection."""

from __future__ import annotations

import secrets

from pyspark.sql import functions as F

from duesflow import schemas
from duesflow.functions import dates
from duesflow.operators import prefix, quality, share, upsert
from duesflow.operators.protect import key_hash, keyed_hash, protect_table, reveal_table
from duesflow.sources.sinks import preview
from duesflow.workload import sql
from duesflow.workload.registry import query
from duesflow.workload.tables import GIVEN, Ledger


def new_key() -> str:
    """A key for one run. Real tables are given theirs as an argument."""
    return secrets.token_hex(16)


@query("nth_business_day", "o_orderkey int, dia date", """
WITH days AS (
  SELECT CAST(d AS DATE) AS d, row_number() OVER (PARTITION BY date_trunc('month', d) ORDER BY d) AS n
  FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS d)
  WHERE dayofweek(d) NOT IN (0, 6))
SELECT o_orderkey, CASE WHEN o_orderkey % 25 = 0 THEN CAST(date_trunc('month', o_orderdate) AS DATE) ELSE d END AS dia
FROM orders LEFT JOIN days ON date_trunc('month', d) = date_trunc('month', o_orderdate) AND n = o_orderkey % 25""")
def nth_business_day(t: Ledger):
    day = F.col("o_orderdate")
    return t.table("orders").select("o_orderkey", dates.nth_business_day(
        F.year(day), F.month(day), (F.col("o_orderkey") % 25).cast("int")).alias("dia"))


@query("week_of_year", "event_id int, semana int, mes text, dia text", """
SELECT event_id, CAST(floor((dayofyear(ts) - 1 + dayofweek(date_trunc('year', ts))) / 7) AS INT) + 1 AS semana,
       monthname(ts) AS mes, strftime(ts, '%d/%m/%Y') AS dia FROM events""")
def week_of_year(t: Ledger):
    day = F.col("ts").cast("date")
    return t.table("events").select("event_id", dates.week_of_year(day).alias("semana"),
                                    F.date_format(day, "MMMM").alias("mes"), dates.text_dmy(day).alias("dia"))


@query("json_fields", "event_id int, k int", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_fields(t: Ledger):
    return t.table("events").select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.k")


@query("drop_dup_groups", "doc_id int, lang text, source text, n_chars int", """
SELECT doc_id, lang, source, n_chars FROM documents
WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) = 1) OR text IS NULL""")
def drop_dup_groups(t: Ledger):
    """Documents whose whole text occurs once. The digest stands in for the text,
    so that whole texts are read but not shuffled."""
    rows = t.table("documents").select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("huella"))
    return upsert.drop_duplicate_groups(rows, ["huella"])


@query("semi_join", "c_custkey int, c_name text", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def semi_join(t: Ledger):
    large = t.table("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return upsert.present(t.table("customer"), large, ["c_custkey"]).select("c_custkey", "c_name")


@query("keep_one_match", "l_suppkey int, l_orderkey int, l_linenumber int, l_shipdate date", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_shipdate FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS r FROM lineitem)
WHERE r = 1""")
def keep_one_match(t: Ledger):
    lines = t.table("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return upsert.keep_one(lines, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"])


@query("group_share", "o_orderkey int, parte money", f"""
WITH totals AS (SELECT o_custkey, CAST(sum({sql.cents('o_totalprice')}) AS BIGINT) AS t FROM orders GROUP BY o_custkey)
SELECT o_orderkey, {sql.half_up(f"{sql.cents('o_totalprice')} * 10000", 't')} / 100.0 AS parte
FROM orders JOIN totals USING (o_custkey)""")
def group_share(t: Ledger):
    orders = t.table("orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    return share.with_group_total(orders, ["o_custkey"], "p", "total").select(
        "o_orderkey", share.percent_share(F.col("p"), F.col("total")).alias("parte"))


@query("table_counts", "Tabla text, Registros int",
       " UNION ALL ".join(f"SELECT '{n}' AS \"Tabla\", count(*) AS \"Registros\" FROM {n}" for n in GIVEN))
def table_counts(t: Ledger):
    return quality.table_counts({n: t.table(n) for n in GIVEN})


@query("latest_rows", "o_orderkey int, o_custkey int, o_totalprice money, o_orderdate date", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10""")
def latest_rows(t: Ledger):
    rows = t.table("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return preview(rows, [F.desc("o_orderdate"), "o_orderkey"])


def _checked(t: Ledger):
    """Ledger tables with rule violations that the given data brings along:
    line items share invoice numbers, some customers' balances turn texts blank."""
    ordinary = t.ordinary().withColumn(
        "nroFactura", F.when(F.col("importeTotal") < 2000, F.lit("A1")).otherwise(F.col("nroFactura"))).withColumn(
        "tipoServicio", F.repeat("tipoServicio", F.when(F.col("importeTotal") > 90000, 9).otherwise(1)))
    units = t.units.withColumn("CVU_CBU", F.when(F.col("metrosCuadrados") > 100, F.col("CVU_CBU")).otherwise(
        F.concat(F.lit("x"), "CVU_CBU"))).withColumn("tipo", F.lit("local"))
    units = units.withColumn("consorcioId", F.when(F.col("id") % 13 != 0, F.col("consorcioId")))
    people = t.people.withColumns({
        "apellido": F.when(F.col("apellido") != "BUILDING", F.col("apellido")),
        "idTipoRol": F.when(F.col("idPersona") % 11 != 0, F.col("idTipoRol"))})
    buildings = t.buildings.withColumn("direccion", F.when(F.col("id") % 5 != 0, F.col("direccion")))
    return {"Consorcio": buildings, "Persona": people, "UnidadFuncional": units, "GastoOrdinario": ordinary}


def _count(table: str, rule: str, columns: str, source: str) -> str:
    return (f"SELECT '{table}' AS tabla, '{rule}' AS regla, '{columns}' AS columnas, "
            f"(SELECT count(*) FROM {source}) AS violaciones")


def _quality_sql() -> str:
    none = "customer WHERE c_custkey < 0"
    parts = []
    for table in ("Consorcio", "Persona", "UnidadFuncional", "GastoOrdinario"):
        spec = schemas.TABLES[table]
        missing = {"Persona.apellido": "customer WHERE c_mktsegment = 'BUILDING'", "Persona.idTipoRol": "customer WHERE c_custkey % 11 = 0",
                   "Consorcio.direccion": "nation WHERE n_nationkey % 5 = 0", "UnidadFuncional.consorcioId": "customer WHERE c_custkey % 13 = 0"}
        for c in spec.required:
            parts.append((table, "required", c, missing.get(f"{table}.{c}", none)))
        for c in spec.widths:
            found = {"UnidadFuncional.CVU_CBU": f"customer WHERE NOT {sql.cents('c_acctbal')} > 10000",
                     "GastoOrdinario.tipoServicio": "cost WHERE NOT extra AND amt > 90000"}
            parts.append((table, "width", c, found.get(f"{table}.{c}", none)))
        if table == "GastoOrdinario":
            parts.append((table, "format", "nroFactura", "cost WHERE NOT extra AND (amt < 2000 OR okey = 0)"))
        for keys in spec.unique:
            found = {"GastoOrdinario.idGasto": "(SELECT okey FROM cost WHERE NOT extra GROUP BY okey HAVING count(*) > 1)",
                     "GastoOrdinario.nroFactura": "(SELECT CASE WHEN amt < 2000 THEN 'A1' ELSE CAST(okey AS VARCHAR) END"
                     " AS f FROM cost WHERE NOT extra GROUP BY 1 HAVING count(*) > 1)"}
            parts.append((table, "unique", ",".join(keys), found.get(f"{table}.{','.join(keys)}", none)))
        for c, (parent, _) in spec.references.items():
            if parent in ("Consorcio", "Persona"):
                found = f"customer WHERE NOT {sql.cents('c_acctbal')} > 10000" if parent == "Persona" else none
                parts.append((table, "reference", c, found))
    return f"WITH {sql.COST} " + " UNION ALL ".join(_count(*p) for p in parts)


@query("quality_report", "tabla text, regla text, columnas text, violaciones int", _quality_sql())
def quality_report(t: Ledger):
    return quality.quality_report(_checked(t))


@query("repeated_keys", "l_orderkey int, l_linenumber int, veces int", """
SELECT l_orderkey, l_linenumber, count(*) AS veces FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def repeated_keys(t: Ledger):
    return quality.repeated_keys(t.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("orphans", "o_orderkey int, o_custkey int", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def orphans(t: Ledger):
    parents = t.table("customer").where("c_mktsegment <> 'BUILDING'")
    return quality.orphans(t.table("orders"), "o_custkey", parents, "c_custkey").select("o_orderkey", "o_custkey")


# --- protection -------------------------------------------------------------------


@query("protect_roundtrip", "idPersona int, nombre text, apellido text, dni text, email text, CVU_CBU text, "
       "telefono text, idTipoRol int", f"""
SELECT c_custkey AS "idPersona", c_name AS nombre, c_mktsegment AS apellido,
       lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS dni, 'c' || c_custkey || '@example.com' AS email,
       {sql.account('c_custkey')} AS "CVU_CBU", lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS telefono,
       c_custkey % 2 + 1 AS "idTipoRol" FROM customer""")
def protect_roundtrip(t: Ledger):
    key = new_key()
    return reveal_table(protect_table(t.people, "Persona", key), "Persona", key)


_HASH_JOIN = f"""WITH {sql.PAID}
SELECT id AS "idPago", u AS "idUnidadFuncional", b AS "consorcioId" FROM paid"""


def _joined_by_hash(t: Ledger, digest):
    payments = t.payments.select(F.col("id").alias("idPago"), digest(F.col("cbuCuentaOrigen")).alias("h"))
    units = t.units.select(F.col("id").alias("idUnidadFuncional"), "consorcioId", digest(F.col("CVU_CBU")).alias("h"))
    return payments.join(units, "h").drop("h")


@query("hash_join", "idPago int, idUnidadFuncional int, consorcioId int", _HASH_JOIN)
def hash_join(t: Ledger):
    return _joined_by_hash(t, key_hash)


@query("hash_join_keyed", "idPago int, idUnidadFuncional int, consorcioId int", _HASH_JOIN)
def hash_join_keyed(t: Ledger):
    """The join on keyed hashes, which cannot be guessed without the key."""
    return _joined_by_hash(t, keyed_hash(t.spark, secrets.token_bytes(32)))


# --- prefixes ---------------------------------------------------------------------

_PREFIXES = """prefixes AS (
  SELECT substr(p_name, 1, CAST(2 + p_partkey % 9 AS INT)) AS prefix, min(p_partkey) AS owner FROM part GROUP BY 1)"""


def _prefixes(t: Ledger):
    """Prefixes of two to ten letters that the names of the parts themselves give."""
    return t.table("part").groupBy(F.substring("p_name", F.lit(1), (F.col("p_partkey") % 9 + 2).cast("int")).alias("prefix")).agg(
        F.min("p_partkey").alias("owner"))


@query("prefix_matches", "p_partkey int, prefix text, owner int", f"""WITH {_PREFIXES}
SELECT p_partkey, prefix, owner FROM part JOIN prefixes ON starts_with(p_name, prefix)""")
def prefix_matches(t: Ledger):
    return prefix.prefix_matches(t.table("part").select("p_partkey", "p_name"), "p_name", _prefixes(t), "prefix")


@query("longest_prefix", "p_partkey int, prefix text, owner int", f"""WITH {_PREFIXES},
ranked AS (
  SELECT p_partkey, prefix, owner, row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) AS place
  FROM part LEFT JOIN prefixes ON starts_with(p_name, prefix) AND owner % 2 = 1)
SELECT p_partkey, prefix, owner FROM ranked WHERE place = 1""")
def longest_prefix(t: Ledger):
    """Every part with the longest of half the prefixes, or none."""
    return prefix.longest_prefix(t.table("part").select("p_partkey", "p_name"), "p_name", _prefixes(t).where("owner % 2 = 1"), "prefix")
