"""Monthly bills: headers, unit lines, payment application, late interest.

All buildings and months are billed in one plan. State that moves from month to
month is a running sum per building (account balance) and a fold over the
months of each unit (carried debt, which depends on the sign of the debt before
and so is no window sum).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duesflow.functions import dates
from duesflow.functions.amounts import MONEY, RATE, or_zero, percent_of
from duesflow.operators.upsert import absent
from duesflow.schemas import conform

# Interest on a carried debt in ten-thousandths, and the late tiers by first payment date.
CARRY_INTEREST = 500
AFTER_FIRST_DUE = "0.02"
AFTER_SECOND_DUE = "0.05"
# Bills whose carried debts are gathered before they are put to those of the bills before.
STRETCH = 9


def _rate(text: str) -> Column:
    return F.lit(text).cast("decimal(3,2)")


def period_key(owner_id: Column, period: Column) -> Column:
    """One id per owner and month: the same run always gives the same ids."""
    month = F.year(period) * 100 + F.month(period)
    return owner_id.cast("bigint") * F.lit(1000000).cast("bigint") + month


bill_id = period_key
line_id = period_key


def period_grid(buildings: DataFrame, first: Column, last: Column) -> DataFrame:
    """(consorcioId, periodo): one row per building and month, both ends included."""
    months = F.sequence(dates.period(first), dates.period(last), F.expr("interval 1 month"))
    return buildings.select(F.col("id").alias("consorcioId"), F.explode(months).alias("periodo"))


def combine_costs(ordinary: DataFrame, extraordinary: DataFrame) -> DataFrame:
    """Both cost tables as one, each amount in the column of its kind."""
    zero = F.lit(0).cast(MONEY)

    def part(df: DataFrame, ord_: Column, ext: Column) -> DataFrame:
        # Months as partitions stay known, so that a report on one month lists no other.
        months = [c for c in ("anio", "mes") if c in ordinary.columns and c in extraordinary.columns]
        return df.select("idExpensa", "consorcioId", "fechaEmision",
                         ord_.alias("ordinario"), ext.alias("extraordinario"), *months)

    amount = F.col("importeTotal")
    return part(ordinary, amount, zero).unionByName(part(extraordinary, zero, amount))


def monthly_costs(costs: DataFrame) -> DataFrame:
    """Costs not billed yet, per building and month of issue."""
    return (
        costs.where(F.col("idExpensa").isNull())
        .groupBy("consorcioId", dates.period(F.col("fechaEmision")).alias("periodo"))
        .agg(F.sum("ordinario").cast(MONEY).alias("ordinario"),
             F.sum("extraordinario").cast(MONEY).alias("extraordinario"))
    )


def account_months(payments: DataFrame) -> DataFrame:
    """Payments per paying account and month.

    ``vencido`` is the part paid on or after the first due day, ``tardio`` the
    part paid after the second. Combined on the map side, so an account with
    very many payments sends few rows.
    """
    day = F.dayofmonth("fecha")
    amount = F.col("importe")
    return payments.groupBy(
        F.col("cbuCuentaOrigen").alias("CVU_CBU"), dates.period(F.col("fecha")).alias("mes")
    ).agg(
        F.sum(amount).cast(MONEY).alias("pagado"),
        F.sum(F.when(day >= dates.FIRST_DUE_DAY, amount)).cast(MONEY).alias("vencido"),
        F.sum(F.when(day > dates.SECOND_DUE_DAY, amount)).cast(MONEY).alias("tardio"),
        F.min("fecha").alias("primera"),
    )


def monthly_income(paid: DataFrame, units: DataFrame) -> DataFrame:
    """Income per building and month: all of it, the overdue part, and the part
    paid in advance (late in the month before)."""
    per_month = (
        paid.join(units.select("CVU_CBU", "consorcioId"), "CVU_CBU")
        .groupBy("consorcioId", F.col("mes").alias("periodo"))
        .agg(F.sum("pagado").cast(MONEY).alias("pagado"),
             F.sum("vencido").cast(MONEY).alias("vencido"),
             F.sum("tardio").cast(MONEY).alias("tardio"))
    )
    # The late payments of one month are the advances of the next.
    nothing = F.lit(None).cast(MONEY)
    moved = F.array(
        F.struct("periodo", "pagado", "vencido", nothing.alias("adelantado")),
        F.struct(F.add_months("periodo", 1).alias("periodo"), nothing.alias("pagado"),
                 nothing.alias("vencido"), F.col("tardio").alias("adelantado")),
    )
    return (
        per_month.select("consorcioId", F.inline(moved))
        .groupBy("consorcioId", "periodo")
        .agg(*[F.sum(c).cast(MONEY).alias(c) for c in ("pagado", "vencido", "adelantado")])
    )


def bill_headers(grid: DataFrame, opening: DataFrame, income: DataFrame,
                 costs: DataFrame) -> DataFrame:
    """Bill headers with the account balance carried from month to month.

    ``opening`` holds (consorcioId, saldo) before the first month; a building
    without an account opens at 0. The window runs over months, after all
    sums, so a building has one row per month in it.
    """
    keys = ["consorcioId", "periodo"]
    flow = (
        grid.join(income, keys, "left").join(costs, keys, "left")
        .join(opening.select("consorcioId", "saldo"), "consorcioId", "left")
        .select(
            *keys, or_zero(F.col("saldo")).alias("apertura"),
            or_zero(F.col("pagado")).alias("ingresosEnTermino"),
            or_zero(F.col("vencido")).alias("ingresosAdeudados"),
            or_zero(F.col("adelantado")).alias("ingresosAdelantados"),
            or_zero(F.col("ordinario")).alias("ordinario"),
            or_zero(F.col("extraordinario")).alias("extraordinario"),
        )
        .withColumn("egresos", (F.col("ordinario") + F.col("extraordinario")).cast(MONEY))
    )
    net = F.col("ingresosEnTermino") - F.col("egresos")
    so_far = W.partitionBy("consorcioId").orderBy("periodo").rowsBetween(W.unboundedPreceding, 0)
    return flow.withColumn(
        "saldoCierre", (F.col("apertura") + F.sum(net).over(so_far)).cast(MONEY)
    ).select(
        bill_id(F.col("consorcioId"), F.col("periodo")).alias("id"), "consorcioId", "periodo",
        (F.col("saldoCierre") - net).cast(MONEY).alias("saldoAnterior"),
        "ingresosEnTermino", "ingresosAdeudados", "ingresosAdelantados", "egresos", "saldoCierre",
        F.year("periodo").alias("fechaPeriodoAnio"), F.month("periodo").alias("fechaPeriodoMes"),
        "ordinario", "extraordinario",
    )


def unit_shares(headers: DataFrame, units: DataFrame) -> DataFrame:
    """Each unit's share of each bill's costs by its percentage (no carried debt)."""
    pct = F.col("porcentajeExpensas")
    return headers.select("consorcioId", "id", "periodo", "ordinario", "extraordinario").join(
        units.select("consorcioId", F.col("id").alias("idUnidadFuncional"), "porcentajeExpensas"),
        "consorcioId",
    ).select(
        F.col("id").alias("expensaId"), "periodo", "idUnidadFuncional",
        or_zero(percent_of(F.col("ordinario"), pct)).alias("prorrateoOrdinario"),
        or_zero(percent_of(F.col("extraordinario"), pct)).alias("prorrateoExtraordinario"),
    )


def _cents(amount: Column) -> Column:
    return (F.coalesce(amount, F.lit(0)).cast(MONEY) * 100).cast("bigint")


def _money(cents: Column) -> Column:
    return (cents * _rate("0.01")).cast(MONEY)


def _rounded(exact: Column) -> Column:
    """Millionths as cents, rounded half up as a stored amount is."""
    half = F.when(exact < 0, F.lit(-5000)).otherwise(F.lit(5000))
    return F.call_function("div", exact + half, F.lit(10000))


def _total_cents(costs: Column, percent: Column, carried: Column) -> Column:
    """What a unit owes on a bill: its share, the debt carried into it, and interest on that debt."""
    return _rounded(costs * percent + carried * 10000 + F.greatest(carried, F.lit(0).cast("bigint")) * CARRY_INTEREST)


def _carried_cents(stretches: Column, paid: Column, percent: Column, start: Column) -> Column:
    """The debt carried into each bill of one unit, in cents, by a walk over its bills.

    The state is what is carried into the next bill. Whole cents keep the walk
    exact and cheap: amount times percentage is a whole number of millionths,
    and a total is rounded half up to cents as a stored amount is. An overflow
    raises. The state is copied at every bill, so the debts are gathered per stretch
    of bills, and put to those before at its end.
    """
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<bigint>")

    def step(state: Column, bill: Column) -> Column:
        total = _total_cents(bill.centavos, percent, state.arrastre)
        open_ = total - F.coalesce(F.try_element_at(paid, bill.periodo), zero)
        return F.struct(F.when(bill.seguira, open_).otherwise(zero).alias("arrastre"),
                        F.array_append(state.arrastres, state.arrastre).alias("arrastres"))

    def walk(state: Column, stretch: Column) -> Column:
        return F.aggregate(stretch, F.struct(state.arrastre.alias("arrastre"), none.alias("arrastres")), step,
                           lambda end: F.struct(end.arrastre.alias("arrastre"), F.concat(state.arrastres, end.arrastres).alias("arrastres")))

    begin = F.struct(start.alias("arrastre"), none.alias("arrastres"))
    return F.aggregate(stretches, begin, walk, lambda state: state.arrastres)


def _with_bills(rows: DataFrame, bills: DataFrame, units: DataFrame) -> DataFrame:
    """Join the array of bills to the units of the building.

    Both sides meet by building and salt, so that the units of one very large
    building spread over all shuffle partitions. Bills are copied only to the
    salts that a building's units fall into, which are never more than its units;
    Spark broadcasts the bills instead where their measured size allows. Units are dealt
    to a stated number of tasks also then: a task's work is units times months, which the
    size of the units, by which adaptive execution would merge tasks, does not show.
    """
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = lambda unit: F.pmod(F.hash(unit), F.lit(salts)).alias("_salt")
    salted = rows.select("*", salt("idUnidadFuncional")).repartition(salts, "consorcioId", "_salt")
    met = units.select("consorcioId", salt("id")).distinct()
    return salted.join(bills.join(met, "consorcioId"), ["consorcioId", "_salt"]).drop("_salt")


def carried_lines(headers: DataFrame, units: DataFrame, paid: DataFrame,
                  previous: DataFrame | None = None) -> DataFrame:
    """All lines of all bills with debts carried from month to month.

    A building's bills travel as one array per building and a unit's payments
    as one map per unit (at most one entry per month), so only one row per unit
    is shuffled; the lines come into being after the last join. Only a debt of
    the calendar month before is carried. ``previous`` may hold
    (idUnidadFuncional, periodo, deuda, pagado) of the bill before the first
    month.
    """
    in_order = W.partitionBy("consorcioId").orderBy("periodo")
    follows = lambda before, after: F.add_months(before, 1) == after
    bills = (
        headers.withColumns({"anterior": F.lag("periodo").over(in_order), "siguiente": F.lead("periodo").over(in_order)})
        .groupBy("consorcioId")
        .agg(F.sort_array(F.collect_list(F.struct(
            "periodo", F.col("id").alias("expensaId"), _cents(F.col("ordinario")).alias("ordinario"),
            _cents(F.col("extraordinario")).alias("extraordinario"), "anterior",
            F.coalesce(follows(F.col("periodo"), F.col("siguiente")), F.lit(False)).alias("seguira"),
            _cents(F.col("ordinario") + F.col("extraordinario")).alias("centavos"),
        ))).alias("facturas"))
        .withColumn("tramos", F.transform(F.sequence(F.lit(1), F.size("facturas"), F.lit(STRETCH)), lambda at: F.transform(
            F.slice("facturas", at, STRETCH), lambda b: F.struct(b.periodo.alias("periodo"), b.centavos.alias("centavos"), b.seguira.alias("seguira")))))
    )
    month = F.add_months("mes", -1)
    settled = paid.groupBy(F.col("CVU_CBU").alias("_cuenta")).agg(
        F.map_from_entries(F.collect_list(F.struct(month, F.struct(
            "pagado", F.col("primera").cast("timestamp").alias("primera"))))).alias("pagos"),
        F.map_from_entries(F.collect_list(F.struct(month, _cents(F.col("pagado"))))).alias("pagosCentavos"),
    )
    # Units without an account have keys of their own, so that they do not meet in one task.
    own = F.coalesce(F.col("CVU_CBU"), F.concat(F.lit("unit "), F.col("id").cast("string")))
    rows = (
        units.select(F.col("id").alias("idUnidadFuncional"), "consorcioId", own.alias("_cuenta"),
                     _cents(F.col("porcentajeExpensas").cast(RATE)).alias("porcentaje"))
        .join(settled, "_cuenta", "left")
    )
    opening, paid_before = F.lit(0).cast("bigint"), F.lit(None).cast(MONEY)
    if previous is not None:
        # Before the units are dealt: the walk must not run in the tasks that a join leaves behind.
        rows = rows.join(previous.select(
            "idUnidadFuncional", F.col("periodo").alias("_ultimo"), F.col("deuda").alias("_deuda"),
            F.col("pagado").cast(MONEY).alias("_pagado")), "idUnidadFuncional", "left")
    rows = _with_bills(rows, bills, units)
    if previous is not None:
        first = F.col("facturas")[0]["periodo"]
        opening = _cents(F.when(F.add_months("_ultimo", 1) == first, F.col("_deuda")))
        paid_before = F.col("_pagado")
    carried = _carried_cents(F.col("tramos"), F.col("pagosCentavos"), F.col("porcentaje"), opening)
    lines = rows.withColumn("_inicio", paid_before).withColumn("arrastres", carried).select(
        "idUnidadFuncional", "consorcioId", "porcentaje", "pagos", "_inicio",
        F.inline(F.arrays_zip("facturas", "arrastres")))
    # Lines are many: their amounts are whole numbers up to the last step, as in the walk.
    bill, debt, percent = F.col("facturas"), F.col("arrastres"), F.col("porcentaje")
    settled_now = F.try_element_at("pagos", bill["periodo"])
    settled_before = F.coalesce(F.try_element_at("pagos", bill["anterior"])["pagado"], F.lit(0).cast(MONEY))
    return lines.select(
        "idUnidadFuncional", "consorcioId", bill["periodo"].alias("periodo"), bill["expensaId"].alias("expensaId"),
        _money(_rounded(bill["ordinario"] * percent)).alias("ordinario"),
        _money(_rounded(bill["extraordinario"] * percent)).alias("extraordinario"),
        _money(debt).alias("arrastre"), _money(_rounded(F.greatest(debt, F.lit(0).cast("bigint")) * CARRY_INTEREST)).alias("interes"),
        _money(_total_cents(bill["centavos"], percent, debt)).alias("total"),
        or_zero(settled_now["pagado"]).alias("pagado"), settled_now["primera"].alias("primera"),
        F.when(bill["anterior"].isNotNull(), settled_before).otherwise(F.col("_inicio")).alias("pagadoAntes"),
    )


def late_interest(first_payment: Column, first_due: Column, second_due: Column,
                  base: Column) -> Column:
    """Nothing up to the first due date, 2 % up to the second, 5 % after it."""
    return (
        F.when(first_payment > second_due, base * _rate(AFTER_SECOND_DUE))
        .when(first_payment > first_due, base * _rate(AFTER_FIRST_DUE))
        .otherwise(F.lit(0))
        .cast(MONEY)
    )


def _as_lines(carried: DataFrame, refreshed: bool) -> DataFrame:
    first = dates.due_date(F.col("periodo"), dates.FIRST_DUE_DAY)
    second = dates.due_date(F.col("periodo"), dates.SECOND_DUE_DAY)
    if refreshed:
        paid_before = F.coalesce("pagadoAntes", "arrastre")
        late = late_interest(F.col("primera"), first, second, F.col("total") - paid_before)
        interest = F.when(F.col("primera").isNull(), F.col("interes")).otherwise(late)
        received = F.col("pagado")
    else:
        paid_before, interest, received = F.col("arrastre"), F.col("interes"), F.lit(0).cast(MONEY)
    return conform(carried.select(
        line_id(F.col("idUnidadFuncional"), F.col("periodo")).alias("id"), "expensaId",
        "idUnidadFuncional", F.col("ordinario").alias("prorrateoOrdinario"),
        F.col("extraordinario").alias("prorrateoExtraordinario"), interest.alias("interesMora"),
        F.col("total").alias("totalaPagar"), paid_before.alias("saldoAnteriorAbonado"),
        received.alias("pagosRecibidos"), first.alias("primerVencimiento"),
        second.alias("segundoVencimiento"),
    ), "DetalleExpensa")


def apply_payments(payments: DataFrame, units: DataFrame, lines: DataFrame, bills: DataFrame,
                   applied: DataFrame | None = None) -> DataFrame:
    """New PagoAplicado rows: each payment goes in full to the paying unit's line
    of the month before, unless the payment was applied earlier."""
    if applied is not None:
        payments = absent(payments, applied, {"id": "idPago"})
    periods = bills.select(
        F.col("id").alias("expensaId"),
        dates.period_of(F.col("fechaPeriodoAnio"), F.col("fechaPeriodoMes")).alias("periodo"))
    open_lines = lines.select(F.col("id").alias("idDetalleExpensa"), "expensaId",
                              "idUnidadFuncional").join(periods, "expensaId")
    by_unit = payments.select(
        F.col("id").alias("idPago"), F.col("cbuCuentaOrigen").alias("CVU_CBU"),
        dates.billed_period(F.col("fecha")).alias("periodo"), F.col("importe").alias("importeAplicado"),
    ).join(units.select("CVU_CBU", F.col("id").alias("idUnidadFuncional")), "CVU_CBU")
    return conform(by_unit.join(open_lines, ["idUnidadFuncional", "periodo"]), "PagoAplicado")


def line_payments(applied: DataFrame, payments: DataFrame) -> DataFrame:
    """Per line: the sum applied and the date of the first payment."""
    return (
        applied.join(payments.select(F.col("id").alias("idPago"), "fecha"), "idPago")
        .groupBy("idDetalleExpensa")
        .agg(F.sum("importeAplicado").cast(MONEY).alias("pagado"), F.min("fecha").alias("primera"))
    )


def previous_paid(lines: DataFrame, paid: str = "pagosRecibidos", name: str = "pagadoAntes") -> DataFrame:
    """Add what was received for the unit's bill before (NULL for its first bill)."""
    by_unit = W.partitionBy("idUnidadFuncional").orderBy("primerVencimiento", "id")
    return lines.withColumn(name, F.lag(paid).over(by_unit))


def refresh_lines(lines: DataFrame, applied: DataFrame, payments: DataFrame) -> DataFrame:
    """Lines with received sums, the sum received for the bill before, and the
    late interest by first payment date. Lines nobody paid keep their interest."""
    settled = lines.join(
        line_payments(applied, payments).withColumnRenamed("idDetalleExpensa", "id"), "id", "left"
    ).withColumn("pagosRecibidos", F.coalesce("pagado", "pagosRecibidos").cast(MONEY))
    chained = previous_paid(settled).withColumn(
        "saldoAnteriorAbonado", F.coalesce("pagadoAntes", "saldoAnteriorAbonado"))
    late = late_interest(F.col("primera"), F.col("primerVencimiento"), F.col("segundoVencimiento"),
                         F.col("totalaPagar") - F.col("saldoAnteriorAbonado"))
    return conform(chained.withColumn(
        "interesMora",
        F.coalesce(F.when(F.col("primera").isNotNull(), late).otherwise(F.col("interesMora")),
                   F.lit(0)).cast(MONEY)), "DetalleExpensa")


def stamp_costs(costs: DataFrame, bills: DataFrame) -> DataFrame:
    """Give costs without a bill the bill of their building and month, if there is one."""
    known = bills.select(
        F.col("id").alias("_bill"), "consorcioId",
        dates.period_of(F.col("fechaPeriodoAnio"), F.col("fechaPeriodoMes")).alias("_periodo"))
    return (
        costs.withColumn("_periodo", dates.period(F.col("fechaEmision")))
        .join(known, ["consorcioId", "_periodo"], "left")
        .withColumn("idExpensa", F.coalesce("idExpensa", "_bill"))
        .select(*costs.columns)
    )


def settle_accounts(accounts: DataFrame, buildings: DataFrame, headers: DataFrame) -> DataFrame:
    """Account balances after the last bill of each building."""
    closing = headers.groupBy("consorcioId").agg(
        F.max_by("saldoCierre", "periodo").alias("_saldo"))
    owners = buildings.select(F.col("id").alias("consorcioId"), "CVU_CBU").join(closing, "consorcioId")
    return accounts.join(owners.select("CVU_CBU", "_saldo"), "CVU_CBU", "left").select(
        "CVU_CBU", "nombreTitular", F.coalesce("_saldo", "saldo").alias("saldo"))


@dataclass(frozen=True)
class BillingRun:
    """What one batch leaves behind; all of it lazy."""

    bills: DataFrame
    lines: DataFrame
    applied: DataFrame
    ordinary: DataFrame
    extraordinary: DataFrame
    accounts: DataFrame


def billing_batch(
    buildings: DataFrame,
    accounts: DataFrame,
    units: DataFrame,
    payments: DataFrame,
    ordinary: DataFrame,
    extraordinary: DataFrame,
    first: dt.date | str,
    last: dt.date | str,
    previous: DataFrame | None = None,
    refreshed: bool = True,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> BillingRun:
    """Bill every building for every month from ``first`` to ``last``.

    Each bill is followed by payment application and refresh, as a month-by-month
    run would do. ``refreshed=False`` gives the lines as they stand right after
    billing. ``keep`` may store the headers (one row per building and month), for
    example ``session.cut_lineage``, so that the parts share them instead of
    summing the costs once each. Storing runs a job. Write the parts with a keyed
    overwrite: the ids depend on building, unit and month only, so a second run of
    the same months changes nothing.
    """
    start, end = (F.lit(str(d)).cast("date") for d in (first, last))
    paid = account_months(payments)
    opening = buildings.select(F.col("id").alias("consorcioId"), "CVU_CBU").join(
        accounts.select("CVU_CBU", "saldo"), "CVU_CBU")
    headers = bill_headers(
        period_grid(buildings, start, end), opening, monthly_income(paid, units),
        monthly_costs(combine_costs(ordinary, extraordinary)))
    if keep is not None:
        headers = keep(headers)
    bills = conform(headers, "Expensa")
    lines = _as_lines(carried_lines(headers, units, paid, previous), refreshed)
    return BillingRun(
        bills=bills,
        lines=lines,
        applied=apply_payments(payments, units, lines, bills),
        ordinary=stamp_costs(ordinary, bills),
        extraordinary=stamp_costs(extraordinary, bills),
        accounts=settle_accounts(accounts, buildings, headers),
    )
