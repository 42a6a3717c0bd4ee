"""Registered report queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from duesflow.plans import billing, notices, reports
from duesflow.session import cut_lineage
from duesflow.workload import sql
from duesflow.workload.registry import query
from duesflow.workload.sql import half_up
from duesflow.workload.tables import Ledger

N2 = "format('{{:,.2f}}', CAST({0} AS DOUBLE))"

WEEKLY_COLUMNS = (
    "Nombre_Consorcio text, ID_Consorcio int, ID_Expensa int, Periodo text, Anio int, Mes int, Semana int, "
    "Egreso_Ordinario text, Egreso_Extraordinario text, Egreso_Semanal_Total text, "
    "Acumulado_Progresivo text, Promedio_Periodo text"
)
WEEKLY_SQL = f"""WITH {sql.COST},
weekly AS (
  SELECT b, year(d) AS y, month(d) AS m,
         CAST(floor((dayofyear(d) - 1 + dayofweek(date_trunc('year', d))) / 7) AS INT) + 1 AS w,
         coalesce(sum(CASE WHEN NOT extra THEN amt END), 0) AS o,
         coalesce(sum(CASE WHEN extra THEN amt END), 0) AS e, sum(amt) AS t
  FROM cost GROUP BY ALL)
SELECT n_name AS "Nombre_Consorcio", b AS "ID_Consorcio", CAST(b AS BIGINT) * 1000000 + y * 100 + m AS "ID_Expensa",
       printf('%04d-%02d', y, m) AS "Periodo", y AS "Anio", m AS "Mes", w AS "Semana",
       {N2.format('o')} AS "Egreso_Ordinario", {N2.format('e')} AS "Egreso_Extraordinario",
       {N2.format('t')} AS "Egreso_Semanal_Total",
       {N2.format('sum(t) OVER (PARTITION BY b, y, m ORDER BY w)')} AS "Acumulado_Progresivo",
       {N2.format(half_up('CAST(sum(t) OVER (PARTITION BY b, y, m) * 100 AS BIGINT)',
                          'count(*) OVER (PARTITION BY b, y, m)') + ' / 100.0')} AS "Promedio_Periodo"
FROM weekly JOIN nation ON n_nationkey = b"""


# The end of a range that leaves nothing out, so that results do not depend on the day of the run.
EVER = dt.date(9998, 12, 31)
# Parameters of the queries on one bill and on a range: a building, its name from the data, and months of all sizes of the tables.
ONE_BUILDING, ONE_NAME = 7, "NATION_7"
ONE_YEAR, ONE_MONTH = 2000, 5


@query("weekly_cost_flow", WEEKLY_COLUMNS, WEEKLY_SQL)
def weekly_cost_flow(t: Ledger):
    return reports.weekly_cost_flow(t.costs(), t.bills, t.buildings)


@query("weekly_cost_flow_one_bill", WEEKLY_COLUMNS, f"""{WEEKLY_SQL}
WHERE n_name = '{ONE_NAME}' AND y = {ONE_YEAR} AND m = {ONE_MONTH}""")
def weekly_cost_flow_one_bill(t: Ledger):
    """The report for one building and month, as its readers ask for it (names in any case, with blanks around)."""
    return reports.weekly_cost_flow(t.costs(), t.bills, t.buildings, f" {ONE_NAME.lower()} ", ONE_YEAR, ONE_MONTH)


_MONTHS = [f"coalesce(sum(CASE WHEN month(d) = {i} THEN amt END), 0)" for i in range(1, 13)]
CROSSTAB_COLUMNS = "consorcioId int, anio int, departamento text, " + ", ".join(
    f"{m} money" for m in (*reports.MONTH_COLUMNS, "Total"))
CROSSTAB_SQL = f"""WITH {sql.PAID}
SELECT b AS "consorcioId", year(d) AS anio, dep AS departamento,
       {', '.join(f'{e} AS "{m}"' for e, m in zip(_MONTHS, reports.MONTH_COLUMNS, strict=True))},
       sum(amt) AS "Total"
FROM paid GROUP BY b, year(d), dep"""


@query("month_dept_crosstab", CROSSTAB_COLUMNS, CROSSTAB_SQL)
def month_dept_crosstab(t: Ledger):
    return reports.month_department_crosstab(t.paid, t.units)


@query("month_dept_crosstab_reference", CROSSTAB_COLUMNS, f"""WITH {sql.PAID},
sizes AS (SELECT c_nationkey AS b, substr(c_mktsegment, 1, 1) AS dep, count(*) AS n FROM customer GROUP BY ALL),
sums AS (
  SELECT b, year(d) AS anio, dep,
         {', '.join(f'{e} AS "{m}"' for e, m in zip(_MONTHS, reports.MONTH_COLUMNS, strict=True))},
         sum(amt) AS "Total"
  FROM paid GROUP BY b, year(d), dep)
SELECT sums.b AS "consorcioId", anio, sums.dep AS departamento,
       {', '.join(f'"{m}" * n AS "{m}"' for m in (*reports.MONTH_COLUMNS, 'Total'))}
FROM sums JOIN sizes ON sums.b = sizes.b AND sums.dep = sizes.dep""")
def month_dept_crosstab_reference(t: Ledger):
    return reports.month_department_crosstab(t.paid, t.units, per_unit_rows=True)


# Shares are rounded to six decimals per payment, sums shown with two.
_PART = half_up("CAST(got AS HUGEINT) * {0} * 10000", "total")
ORIGIN_COLUMNS = "Periodo text, Ordinario money, Extraordinario money, Mora money, Total money"
ORIGIN_SQL = f"""WITH {sql.LINES},
parts AS (
  SELECT m, {', '.join(f"CASE WHEN total > 0 THEN {_PART.format(f'coalesce({w}, 0)')} ELSE 0 END AS {w}"
                       for w in ('wo', 'we', 'wm'))}
  FROM lines),
sums AS (SELECT m, sum(wo) AS o, sum(we) AS e, sum(wm) AS i FROM parts GROUP BY m)
SELECT strftime(m, '%Y-%m') AS "Periodo",
       {', '.join(f'CAST({half_up(c, "10000")} AS BIGINT) / 100.0 AS "{n}"' for c, n in (
           ('o', 'Ordinario'), ('e', 'Extraordinario'), ('i', 'Mora'), ('(o + e + i)', 'Total')))}
FROM sums"""


def _two_decimals(df):
    return df.select("Periodo", *[F.round(c, 2).alias(c) for c in df.columns if c != "Periodo"])


@query("collections_by_origin", ORIGIN_COLUMNS, ORIGIN_SQL)
def collections_by_origin(t: Ledger):
    return _two_decimals(reports.collections_by_origin(t.weighted_paid, end=EVER))


@query("collections_by_origin_range", ORIGIN_COLUMNS, ORIGIN_SQL.replace("FROM lines)", f"""FROM lines
  WHERE b = {ONE_BUILDING} AND d >= DATE '{ONE_YEAR}-02-10' AND d <= DATE '{ONE_YEAR}-11-20')"""))
def collections_by_origin_range(t: Ledger):
    """One building, a range of days with both ends in it."""
    return _two_decimals(reports.collections_by_origin(
        t.weighted_paid, ONE_BUILDING, dt.date(ONE_YEAR, 2, 10), dt.date(ONE_YEAR, 11, 20)))


TOP_MONTH_COLUMNS = "Tipo text, Anio int, Mes int, NombreMes text, Monto money"
TOP_MONTH_SQL = f"""WITH {sql.COST}, {sql.PAID},
spent AS (SELECT year(d) AS y, month(d) AS m, sum(amt) AS t FROM cost GROUP BY ALL),
earned AS (SELECT year(d) AS y, month(d) AS m, sum(amt) AS t FROM paid WHERE amt > 0 GROUP BY ALL),
top AS (
  (SELECT 'Gasto' AS k, * FROM spent ORDER BY t DESC, y, m LIMIT 5)
  UNION ALL (SELECT 'Ingreso' AS k, * FROM earned ORDER BY t DESC, y, m LIMIT 5))
SELECT k AS "Tipo", y AS "Anio", m AS "Mes", monthname(make_date(CAST(y AS INT), CAST(m AS INT), 1)) AS "NombreMes",
       t AS "Monto" FROM top"""


@query("topn_months", TOP_MONTH_COLUMNS, TOP_MONTH_SQL)
def topn_months(t: Ledger):
    return reports.top_months(t.costs(), t.bills, t.lines, n=5)


def debtor_sql(clamp: bool) -> str:
    owed = "greatest(total - got, 0)" if clamp else "total - got"
    return f"""{sql.LINES},
owing AS (
  SELECT b, u, CAST(sum({owed}) AS BIGINT) AS debt FROM lines GROUP BY b, u HAVING sum({owed}) > 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY b ORDER BY debt DESC, u) AS r FROM owing)"""


DEBTOR_COLUMNS = (
    "consorcioId int, puesto int, dni text, nombre text, apellido text, email text, telefono text, morosidad money"
)


def debtor_rows_sql(clamp: bool) -> str:
    return f"""WITH {debtor_sql(clamp)}
SELECT b AS "consorcioId", r AS puesto, lpad(CAST(u AS VARCHAR), 8, '0') AS dni, c_name AS nombre,
       c_mktsegment AS apellido, 'c' || u || '@example.com' AS email,
       lpad(CAST(u AS VARCHAR), 10, '0') AS telefono, debt / 100.0 AS morosidad
FROM ranked JOIN customer ON c_custkey = u WHERE r <= 3"""


@query("top_debtors", DEBTOR_COLUMNS, debtor_rows_sql(clamp=True))
def top_debtors(t: Ledger):
    return reports.top_debtors(reports.debtors(t.lines, t.units, t.people, end=EVER), n=3, per_building=True)


@query("top_debtors_overall", DEBTOR_COLUMNS, f"""WITH {debtor_sql(True)}
SELECT b AS "consorcioId", row_number() OVER (ORDER BY debt DESC, u) AS puesto,
       lpad(CAST(u AS VARCHAR), 8, '0') AS dni, c_name AS nombre, c_mktsegment AS apellido,
       'c' || u || '@example.com' AS email, lpad(CAST(u AS VARCHAR), 10, '0') AS telefono,
       debt / 100.0 AS morosidad
FROM owing JOIN customer ON c_custkey = u ORDER BY debt DESC, u LIMIT 3""")
def top_debtors_overall(t: Ledger):
    return reports.top_debtors(reports.debtors(t.lines, t.units, t.people, end=EVER), n=3)


def _xml(tag: str, value: str) -> str:
    return f"'<{tag}>' || {value} || '</{tag}>'"


@query("top_debtors_xml", "consorcioId int, XML_Reporte5 text", f"""WITH {debtor_sql(True)},
entries AS (
  SELECT b, r, '<propietario dni="' || lpad(CAST(u AS VARCHAR), 8, '0') || '">' ||
         {_xml('nombre', 'c_name')} || {_xml('apellido', 'c_mktsegment')} ||
         {_xml('email', "'c' || u || '@example.com'")} ||
         {_xml('telefono', "lpad(CAST(u AS VARCHAR), 10, '0')")} ||
         {_xml('morosidad', "(debt // 100) || '.' || lpad(CAST(debt % 100 AS VARCHAR), 2, '0')")} ||
         '</propietario>' AS x
  FROM ranked JOIN customer ON c_custkey = u WHERE r <= 3)
SELECT b AS "consorcioId",
       '<mayoresMorosos>' || string_agg(x, '' ORDER BY r) || '</mayoresMorosos>' AS "XML_Reporte5"
FROM entries GROUP BY b""")
def top_debtors_xml(t: Ledger):
    return reports.debtors_xml(top_debtors(t))


GAP_COLUMNS = "idUF int, idConsorcio int, fechaPago date, orden int, diasDesdeAnterior int"
GAPS = f"""{sql.LINES},
gaps AS (
  SELECT u, b, d, row_number() OVER (PARTITION BY u, d ORDER BY id) AS n,
         date_diff('day', lag(d) OVER (PARTITION BY u ORDER BY d, id), d) AS days
  FROM lines WHERE coalesce(wo, 0) > 0)"""
GAP_SQL = f"""WITH {GAPS}
SELECT u AS "idUF", b AS "idConsorcio", d AS "fechaPago", n AS orden, days AS "diasDesdeAnterior" FROM gaps"""


@query("payment_gaps", GAP_COLUMNS, GAP_SQL)
def payment_gaps(t: Ledger):
    return reports.payment_gaps(t.weighted_paid, end=EVER)


@query("payment_gaps_range", GAP_COLUMNS, GAP_SQL.replace("WHERE coalesce(wo, 0) > 0", f"""WHERE coalesce(wo, 0) > 0 AND b = {ONE_BUILDING}
    AND d >= DATE '{ONE_YEAR - 1}-06-15' AND d <= DATE '{ONE_YEAR}-06-14'"""))
def payment_gaps_range(t: Ledger):
    """One building, a year of days: the first payment in the range has none before it."""
    return reports.payment_gaps(t.weighted_paid, ONE_BUILDING, start=dt.date(ONE_YEAR - 1, 6, 15), end=dt.date(ONE_YEAR, 6, 14))


@query("payment_gaps_xml", "idUF int, fechaPago date, orden int, parte int, xml text", f"""WITH {GAPS},
ends AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY d DESC, n DESC) AS back FROM gaps)
SELECT u AS "idUF", d AS "fechaPago", n AS orden, 1 AS parte,
       '<pago fecha="' || d || '"' || coalesce(' diasDesdeAnterior="' || days || '"', '') || '/>' AS xml
FROM ends
UNION ALL SELECT u, d, n, 0, '<unidadFuncional id="' || u || '">' FROM ends WHERE days IS NULL
UNION ALL SELECT u, d, n, 2, '</unidadFuncional>' FROM ends WHERE back = 1""")
def payment_gaps_xml(t: Ledger):
    return reports.payment_gaps_xml(reports.payment_gaps(t.weighted_paid, end=EVER, mark_last=True))


@query("event_gaps", "idUF int, fechaPago date, orden int, diasDesdeAnterior int", """
SELECT user_id AS "idUF", CAST(ts AS DATE) AS "fechaPago",
       row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS orden,
       date_diff('day', lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY ts, event_id), CAST(ts AS DATE))
         AS "diasDesdeAnterior"
FROM events""")
def event_gaps(t: Ledger):
    rows = t.table("events").select(
        F.col("user_id").alias("idUnidadFuncional"), F.lit(0).alias("consorcioId"),
        F.col("ts").cast("timestamp").alias("fecha"), F.lit(1).alias("prorrateoOrdinario"))
    return reports.payment_gaps(rows, end=EVER)


def run_batch(t: Ledger, **options) -> billing.BillingRun:
    """The whole batch; the headers are stored when this is called."""
    return billing.billing_batch(
        t.buildings, t.accounts, t.shared_units, t.payments, t.ordinary(billed=False),
        t.extraordinary(billed=False), *t.months, keep=cut_lineage, **options)


DOCUMENT_COLUMNS = (
    "Seccion text, IdConsorcio int, NombreConsorcio text, Anio int, Mes int, Campo1 text, Campo2 text, "
    "Campo3 text, Campo4 text, Monto money"
)


def _part(title: str, key: str, fields: list[str], amount: str, source: str) -> str:
    named = [*fields, *["NULL"] * (4 - len(fields))]
    return (f"SELECT '{title}' AS \"Seccion\", {key} AS b, year(p) AS y, month(p) AS m, "
            + ", ".join(f"CAST({f} AS VARCHAR) AS c{i}" for i, f in enumerate(named, 1))
            + f", {amount} AS amount FROM {source}")


_SUMS = [("SaldoAnterior", "cierre - got + o + e"), ("IngresosEnTermino", "got"), ("IngresosAdeudados", "late"),
         ("IngresosAdelantados", "ahead"), ("Egresos", "o + e"), ("SaldoCierre", "cierre")]
DOCUMENT_SQL = f"""WITH RECURSIVE {sql.CARRIED},
cost_months AS (
  SELECT *, CAST(date_trunc('month', d) AS DATE) AS p, lpad(CAST(okey AS VARCHAR), 10, '0') AS invoice,
         'L' || ln AS item FROM cost),
doc AS (
  {_part('1-Encabezado', 'b', ["'Region ' || n_regionkey", sql.account('b')], 'NULL',
         'headers JOIN nation ON n_nationkey = b')}
  UNION ALL {_part('2-FormaPago', 'b', ["'Transferencia bancaria a la cuenta del consorcio'",
                                       'CAST(p + INTERVAL 9 DAY AS DATE)', 'CAST(p + INTERVAL 14 DAY AS DATE)'],
                   'NULL', 'headers')}
  UNION ALL {_part('3-Deudores', 'b', ["c_name || ' ' || c_mktsegment",
                                      "rpad('P' || (u % 10), 4, ' ') || '-' || substr(c_mktsegment, 1, 1)", 'u'],
                   '(total - got) / 100.0', '(SELECT * FROM refreshed WHERE total > got) JOIN customer ON c_custkey = u')}
  UNION ALL {_part('4-GastosOrdinarios', 'b', ["CASE WHEN status = 'O' THEN 'LIMPIEZA' ELSE 'SEGUROS' END", 'firm',
                                              'invoice', 'item'], 'amt', 'cost_months WHERE NOT extra')}
  UNION ALL {_part('5-GastosExtraordinarios', 'b', ['item', 'firm', 'invoice',
                                                   "CASE WHEN status <> 'O' THEN 'Cuota ' || ln END"],
                   'amt', 'cost_months WHERE extra')}
  {' '.join('UNION ALL ' + _part('6-EstadoFinanciero', 'b', [f"'{label}'"], f'({e}) / 100.0', 'headers')
            for label, e in _SUMS)})
SELECT "Seccion", b AS "IdConsorcio", n_name AS "NombreConsorcio", y AS "Anio", m AS "Mes", c1 AS "Campo1",
       c2 AS "Campo2", c3 AS "Campo3", c4 AS "Campo4", amount AS "Monto"
FROM doc JOIN nation ON n_nationkey = b"""


@query("expense_document", DOCUMENT_COLUMNS, DOCUMENT_SQL)
def expense_document(t: Ledger):
    run = run_batch(t)
    return reports.expense_document(
        t.buildings, run.bills, run.lines, t.units, t.people, t.ordinary(), t.extraordinary())


_MONEY_TEXT = "('$' || (({0}) // 100) || '.' || lpad(CAST(({0}) % 100 AS VARCHAR), 2, '0'))"


def _li(label: str, value: str) -> str:
    return f"'<li>{label}: ' || {value} || '</li>'"


_BODY = " || ".join([
    "'<h1>Estimado/a ' || c_mktsegment || ' ' || c_name || '</h1><ul>'",
    _li("Consorcio", "n_name"), _li("Unidad", "dep"), _li("Periodo", "month(m) || '/' || year(m)"),
    _li("Saldo anterior abonado", "'$0.00'"), _li("Total a pagar", _MONEY_TEXT.format("total")),
    _li("Interes por mora", f"coalesce({_MONEY_TEXT.format('wm')}, '$0.00')"),
    _li("Primer vencimiento", "strftime(m + INTERVAL 9 DAY, '%d/%m/%Y')"),
    _li("Segundo vencimiento (2% de recargo, luego 5%)", "strftime(m + INTERVAL 14 DAY, '%d/%m/%Y')"),
    "'</ul>'",
])


@query("notification_payload", "idDetalleExpensa int, email text, payload text", f"""WITH {sql.LINES}
SELECT id AS "idDetalleExpensa", 'c' || u || '@example.com' AS email,
       '{{"personalizations":[{{"to":[{{"email":"c' || u || '@example.com"}}],"subject":"Expensa Mensual"}}],' ||
       '"from":{{"email":"avisos@example.com","name":"Sistema de Expensas"}},' ||
       '"content":[{{"type":"text/html","value":"' || {_BODY} || '"}}]}}' AS payload
FROM lines JOIN customer ON c_custkey = u JOIN nation ON n_nationkey = b""")
def notification_payload(t: Ledger):
    rows = notices.notice_rows(t.lines, t.bills, t.buildings, t.units, t.people)
    return notices.notice_payloads(rows, "avisos@example.com", "Sistema de Expensas")
