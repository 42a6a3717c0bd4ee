"""The monthly run: take in a delivery of files, then bill the months due.

Master tables (buildings, people, units, accounts, extras, seeds) are small and
written anew per delivery, from ``old`` to ``new``; callers switch to the new
folder when the run has ended. Fact tables (payments, costs, bills, lines,
applications) stay in one folder, partitioned by month; a run appends to them
or replaces whole months. Running a delivery or a billing again leaves the
same tables, also after one broke off (``runs`` keeps the books). Months that
a late payment or cost touches are billed again by the next run, so that runs
in any order of arrival end with the tables of one run over all months. Both
functions run jobs.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duesflow import schemas
from duesflow.functions import dates
from duesflow.plans import billing, fillers, imports, runs
from duesflow.session import cut_lineage
from duesflow.sources import files, sinks
from duesflow.sources.keyindex import KeyIndex

MONTH = ("anio", "mes")
# The column that puts a fact row into its month.
FACT_DAY = {
    "Pago": "fecha",
    "GastoOrdinario": "fechaEmision",
    "GastoExtraordinario": "fechaEmision",
    "DetalleExpensa": "primerVencimiento",
}


def _read(spark: SparkSession, root: str | None, table: str, required: bool = False) -> DataFrame:
    """A table, empty if it was never written; a ``required`` one that is absent is an error."""
    if root is None:
        return schemas.empty(spark, table)
    try:
        return spark.read.schema(schemas.TABLES[table].schema).parquet(f"{root}/{table}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND" and not required:
            return schemas.empty(spark, table)
        raise


def _by_month(df: DataFrame, day: str) -> DataFrame:
    return df.withColumns({"anio": F.year(day), "mes": F.month(day)})


def _months(df: DataFrame, first: dt.date, last: dt.date, low: int = 0, high: int = 0) -> DataFrame:
    """The partitions from month ``low`` before or after ``first`` up to ``high`` from ``last``; others are not listed as input."""
    if "anio" not in df.columns:
        return df
    number = F.col("anio") * 12 + F.col("mes") - 1
    return df.where(number.between(first.year * 12 + first.month - 1 + low, last.year * 12 + last.month - 1 + high))


def _last(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]


class _Masters:
    """Reads from the old folder, writes to the new one, reads back what is written."""

    def __init__(self, spark: SparkSession, old: str | None, new: str):
        self.spark, self.old, self.new = spark, old, new

    def before(self, table: str) -> DataFrame:
        return _read(self.spark, self.old, table, required=True)

    def write(self, table: str, df: DataFrame) -> DataFrame:
        sinks.replace_table(schemas.conform(df, table), f"{self.new}/{table}")
        return _read(self.spark, self.new, table)

    @cached_property
    def accounts(self) -> DataFrame:
        return self.before("CuentaBancaria")


def take_in(
    spark: SparkSession,
    drop: Mapping[str, str],
    old: str | None,
    new: str,
    facts: str,
    as_of: dt.date,
    extraordinary: int = 0,
) -> None:
    """Import a delivery. ``drop`` names the file of each kind: payments,
    buildings, people, unit_owners, units, costs, providers; kinds may be left
    out. Lines with too few or too many fields go to the table ``Rechazo`` with file and cause.
    ``extraordinary`` costs are generated if the ledger has none."""
    m = _Masters(spark, old, new)

    def raw(kind: str) -> DataFrame | None:
        if kind not in drop:
            return None
        if kind not in files.DELIMITED:
            return files.read_costs(spark, drop[kind])
        rows, rejects = files.read_checked(spark, kind, drop[kind])
        sinks.append(rejects, f"{facts}/Rechazo")
        return rows

    roles, methods = m.before("TipoRol"), m.before("FormaDePago")
    m.write("TipoRol", roles.unionByName(fillers.seed_roles(roles)))
    methods = m.write("FormaDePago", methods.unionByName(fillers.seed_methods(methods)))

    buildings, units, people = m.before("Consorcio"), m.before("UnidadFuncional"), m.before("Persona")
    if (rows := raw("buildings")) is not None:
        buildings = cut_lineage(imports.import_buildings(rows, buildings, _last(buildings, "id")))
    if (rows := raw("people")) is not None:
        people = people.unionByName(imports.import_people(rows, people, _last(people, "idPersona")))
    m.write("Persona", people)
    if (rows := raw("unit_owners")) is not None:
        units = cut_lineage(units.unionByName(
            imports.import_unit_owners(rows, buildings, units, _last(units, "id"))))
    if (rows := raw("units")) is not None:
        buildings, units = imports.import_units(rows, buildings, units, _last(buildings, "id"))
        buildings = cut_lineage(buildings)
    generated, buildings = fillers.attach_accounts(buildings)
    used = generated.join(buildings.select("CVU_CBU"), "CVU_CBU", "left_semi")
    known = m.accounts
    m.write("CuentaBancaria", known.unionByName(used.join(known.select("CVU_CBU"), "CVU_CBU", "left_anti")))
    buildings, units = m.write("Consorcio", buildings), m.write("UnidadFuncional", units)
    for extras in ("Cochera", "Baulera"):
        there = m.before(extras)
        m.write(extras, there.unionByName(fillers.attach_extras(units, there)))

    if (rows := raw("payments")) is not None:
        method = imports.default_method(methods).first().idFormaPago
        _take_payments(spark, rows, facts, method, as_of)
    if (rows := raw("costs")) is not None:
        _take_costs(spark, rows, raw("providers"), buildings, facts, as_of)
    if extraordinary and _read(spark, facts, "GastoExtraordinario").isEmpty():
        generated = cut_lineage(fillers.generate_extraordinary(buildings, extraordinary))
        add_facts(generated, facts, "GastoExtraordinario")


def add_facts(fresh: DataFrame, facts: str, table: str, counts: Mapping[str, int] | None = None, keys: KeyIndex | None = None,
              number: str | None = None) -> None:
    """Add new rows to a fact table: note the arrival, write the rows, then their keys, then note that all is done.

    ``fresh`` is read several times: store it first if it is not a table. ``counts`` are rows
    read and valid; without them both are the rows given.
    """
    if counts is None:
        counts = dict.fromkeys(("leidas", "validas"), fresh.count())
    batch = runs.new_batch()
    runs.note_arrival(fresh, facts, table, FACT_DAY[table], batch, counts, number)
    sinks.append(_by_month(fresh, FACT_DAY[table]), f"{facts}/{table}", MONTH)
    if keys is not None:
        keys.add(fresh, batch)
    runs.arrival_done(fresh.sparkSession, facts, batch)


def _payment_keys(spark: SparkSession, facts: str) -> KeyIndex:
    """The numbers of all payments taken in, made good where a delivery broke off before it noted them."""
    table = schemas.TABLES["Pago"].schema
    keys = KeyIndex(spark, f"{facts}/PagoClave", [table["id"]])
    if keys.read() is None:
        there = _read(spark, facts, "Pago")
        if not there.isEmpty():
            keys.add(there, "before")
        return keys
    broken = cut_lineage(runs.broken_arrivals(spark, facts, "Pago"))
    for batch in [r.lote for r in broken.select("lote").distinct().collect()]:
        # A delivery touches few months; only these partitions are read.
        months = [r.anio * 12 + r.mes - 1 for r in broken.where(F.col("lote") == batch).collect()]
        there = _read(spark, facts, "Pago")
        if "anio" in there.columns:
            keys.add(keys.absent(there.where((F.col("anio") * 12 + F.col("mes") - 1).isin(months)), before=batch), batch)
        runs.arrival_done(spark, facts, batch)
    return keys


def _take_payments(spark: SparkSession, rows: DataFrame, facts: str, method: int, as_of: dt.date) -> None:
    keys = _payment_keys(spark, facts)
    read, seen = sinks.counted(rows, "payments_read")
    cleaned, valid = sinks.counted(imports.clean_payments(read, method, as_of), "payments_valid")
    distinct = cut_lineage(imports.one_per_number(cleaned))
    counts = {"leidas": sinks.rows_counted(seen), "validas": sinks.rows_counted(valid)}
    add_facts(cut_lineage(keys.absent(distinct)), facts, "Pago", counts, keys)


def _take_costs(spark: SparkSession, rows: DataFrame, offers: DataFrame | None, buildings: DataFrame, facts: str, as_of: dt.date) -> None:
    """Costs of a file belong to the year of the import: only that year's partitions are compared with."""
    ordinary = _read(spark, facts, "GastoOrdinario")
    last = runs.last_number(spark, facts, "GastoOrdinario")
    last = _last(ordinary, "idGasto") if last is None else last
    if "anio" in ordinary.columns:
        ordinary = ordinary.where(F.col("anio") == as_of.year)
    read, seen = sinks.counted(rows, "costs_read")
    parsed = cut_lineage(imports.parse_costs(read, as_of))
    fresh = cut_lineage(imports.number_costs(parsed, buildings, ordinary, as_of.year, last))
    if offers is not None:
        fresh = imports.import_providers(offers, buildings, fresh)
    fresh = cut_lineage(fillers.fill_general_costs(fresh))
    add_facts(fresh, facts, "GastoOrdinario", {"leidas": sinks.rows_counted(seen), "validas": parsed.count()}, number="idGasto")


def bill(spark: SparkSession, masters: str, facts: str, accounts: str, first: dt.date, last: dt.date) -> None:
    """Bill the months from ``first`` to ``last`` and replace their partitions.

    Months billed earlier that payments or costs arrived for since, or that a run left
    unfinished, are billed again first, with all that follow them; see ``runs.Restatement``.
    The bill of the month before, if there is one, gives the opening balances, and its lines
    the debts to carry: payments that came in since are applied to them first, and that
    month's lines and applications are replaced. Without one, the accounts open. The account
    table with the closing balances goes to the new folder ``accounts``.
    """
    buildings, units, opening = (_read(spark, masters, t, required=True) for t in ("Consorcio", "UnidadFuncional", "CuentaBancaria"))
    span = runs.Restatement(spark, facts, first, last)
    first, last = span.first, span.last
    span.begin()
    start, end = F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date")

    def days(name, low, high):
        """Days from month ``low`` up to month ``high``, counted from ``start`` and ``end``, as a range that reaches the scan."""
        return (F.col(name) >= F.add_months(start, low)) & (F.col(name) < F.add_months(end, high))

    # Late payments of the month before are advances; the month after pays the last bill.
    payments = _months(_read(spark, facts, "Pago"), first, last, -1, 1).where(days("fecha", -1, 2))
    in_months = {}
    for table in ("GastoOrdinario", "GastoExtraordinario"):
        # Costs stamped by an earlier run of these months are billed again.
        in_months[table] = _months(_read(spark, facts, table), first, last).where(days(FACT_DAY[table], 0, 1)).withColumns(
            {"_antes": F.col("idExpensa"), "idExpensa": F.lit(None).cast("bigint")})
    month_before = F.add_months(start, -1)
    # Through the work folder: the run replaces files of the tables it reads here.
    billed = cut_lineage(_months(_read(spark, facts, "Expensa"), first, first, -1, -1).where(
        (F.col("fechaPeriodoAnio") == F.year(month_before)) & (F.col("fechaPeriodoMes") == F.month(month_before))))
    opening = billing.settle_accounts(opening, buildings, billed.withColumn("periodo", month_before))
    old_lines = _months(_read(spark, facts, "DetalleExpensa"), first, first, -1, -1).where(
        (F.col("primerVencimiento") >= month_before) & (F.col("primerVencimiento") < start))
    if not billed.isEmpty():
        late = cut_lineage(billing.apply_payments(payments, units, old_lines, billed))
        old_lines = cut_lineage(billing.refresh_lines(old_lines, late, payments))
        sinks.overwrite_partitions(_by_month(old_lines, "primerVencimiento"), f"{facts}/DetalleExpensa", MONTH, ["idUnidadFuncional"])
        sinks.overwrite_partitions(_by_month(late.withColumn("_periodo", month_before), "_periodo").drop("_periodo"),
                                   f"{facts}/PagoAplicado", MONTH)
    before = old_lines.select(
        "idUnidadFuncional", dates.period(F.col("primerVencimiento")).alias("periodo"),
        (F.col("totalaPagar") - F.col("pagosRecibidos")).alias("deuda"), F.col("pagosRecibidos").alias("pagado"))
    run = billing.billing_batch(
        buildings, opening, units, payments, in_months["GastoOrdinario"], in_months["GastoExtraordinario"],
        first, last, previous=before, keep=cut_lineage)
    bills = run.bills.withColumns({"anio": F.col("fechaPeriodoAnio"), "mes": F.col("fechaPeriodoMes")})
    sinks.overwrite_partitions(bills, f"{facts}/Expensa", MONTH)
    # Lines are the most rows of a run: written once, to their table, and read back from there.
    sinks.overwrite_partitions(_by_month(run.lines, "primerVencimiento"), f"{facts}/DetalleExpensa", MONTH, ["idUnidadFuncional"])
    lines = _months(_read(spark, facts, "DetalleExpensa"), first, last).where(days("primerVencimiento", 0, 1))
    # A payment of one month is applied to the line of the month before.
    paid = payments.select(F.col("id").alias("idPago"), dates.billed_period(F.col("fecha")).alias("_periodo"))
    applied = billing.apply_payments(payments, units, lines, run.bills).join(paid, "idPago")
    sinks.overwrite_partitions(_by_month(applied, "_periodo").drop("_periodo"), f"{facts}/PagoAplicado", MONTH)
    for table, costs in (("GastoOrdinario", run.ordinary), ("GastoExtraordinario", run.extraordinary)):
        dated = _by_month(costs, "fechaEmision")
        # Months whose costs all have the bill that they had before stay as they are.
        number = F.col("anio") * 12 + F.col("mes") - 1
        changed = dated.where(~F.col("idExpensa").eqNullSafe(F.col("_antes"))).select(number.alias("n")).distinct().collect()
        if changed:
            # Written through the work folder: a job must not replace what it reads.
            due = costs.where(number.isin([r.n for r in changed])).drop("_antes")
            sinks.overwrite_partitions(cut_lineage(_by_month(due, "fechaEmision")), f"{facts}/{table}", MONTH)
    sinks.replace_table(run.accounts, f"{accounts}/CuentaBancaria")
    span.end()
