"""The recurring reports. Each runs for all buildings and months at once;
arguments only narrow it down. Result columns carry the names report readers
know."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duesflow.functions import dates, text, xml
from duesflow.functions.amounts import MONEY, text_n2
from duesflow.operators.share import split_by_weights

# Month columns of the cross-tab, January first.
MONTH_COLUMNS = ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")

DEBT_THRESHOLD = "0.01"


class UnknownBuilding(LookupError):
    """No building has the given name."""


class UnknownBill(LookupError):
    """The building has no bill for the given month."""


def _where(df: DataFrame, *conditions: Column) -> DataFrame:
    return reduce(DataFrame.where, conditions, df)


def _equals(column: str, value) -> list[Column]:
    return [] if value is None else [F.col(column) == F.lit(value)]


def in_period(df: DataFrame, day: str, year: int | None, month: int | None) -> DataFrame:
    """Rows of the year, or of the month of it, by ``day``; tables partitioned by ``anio`` and ``mes`` list no other folder.

    Costs and lines of a bill are dated in the bill's month, so a report on one bill reads that month.
    """
    if year is None:
        return df
    parts = set(df.columns)
    if month is None:
        wanted = dates.in_year(F.col(day), year)
    else:
        start = dt.date(year, month, 1)
        wanted = [F.col(day) >= F.lit(start), F.col(day) < F.add_months(F.lit(start), 1)]
        wanted += _equals("mes", month) if "mes" in parts else []
    wanted += _equals("anio", year) if "anio" in parts else []
    return _where(df, *wanted)


def resolve_bill(buildings: DataFrame, bills: DataFrame, name: str | None = None,
                 year: int | None = None, month: int | None = None) -> DataFrame:
    """(consorcioId, nombre, expensaId, anioPeriodo, mesPeriodo) of the bills asked for."""
    named = _where(buildings, *[text.key(F.col("nombre")) == text.key(F.lit(v))
                                for v in [name] if v is not None])
    wanted = _where(bills, *_equals("fechaPeriodoAnio", year), *_equals("fechaPeriodoMes", month))
    return wanted.select(
        "consorcioId", F.col("id").alias("expensaId"), F.col("fechaPeriodoAnio").alias("anioPeriodo"),
        F.col("fechaPeriodoMes").alias("mesPeriodo"),
    ).join(named.select(F.col("id").alias("consorcioId"), "nombre"), "consorcioId")


def require_bill(buildings: DataFrame, bills: DataFrame, name: str, year: int, month: int) -> None:
    """Raise if the building, or its bill of that month, is unknown (runs small jobs)."""
    if buildings.where(text.key(F.col("nombre")) == text.key(F.lit(name))).isEmpty():
        raise UnknownBuilding(f'building "{name}" not found')
    if resolve_bill(buildings, bills, name, year, month).isEmpty():
        raise UnknownBill(f'bill of building "{name}" for {month}/{year} not found')


def weekly_cost_flow(
    costs: DataFrame,
    bills: DataFrame,
    buildings: DataFrame,
    name: str | None = None,
    year: int | None = None,
    month: int | None = None,
    formatted: bool = True,
) -> DataFrame:
    """Weekly ordinary, extraordinary and total cost of each bill, with the
    running total and the mean of the weeks of the bill's month.

    ``costs`` comes from ``billing.combine_costs``. Costs dated outside the
    bill's month do not count. The windows run over at most six weeks each.
    """
    day = F.col("fechaEmision")
    weekly = (
        in_period(costs, "fechaEmision", year, month).where(F.col("idExpensa").isNotNull())
        .groupBy(F.col("idExpensa").alias("expensaId"), F.year(day).alias("Anio"),
                 F.month(day).alias("Mes"), dates.week_of_year(day).alias("Semana"))
        .agg(F.sum("ordinario").cast(MONEY).alias("ord"), F.sum("extraordinario").cast(MONEY).alias("ext"))
        .withColumn("total", (F.col("ord") + F.col("ext")).cast(MONEY))
    )
    billed = resolve_bill(buildings, bills, name, year, month)
    in_month = (F.col("Anio") == F.col("anioPeriodo")) & (F.col("Mes") == F.col("mesPeriodo"))
    month_weeks = W.partitionBy("expensaId")
    so_far = month_weeks.orderBy("Anio", "Semana").rowsBetween(W.unboundedPreceding, 0)
    show = text_n2 if formatted else lambda c: F.round(c, 2).cast(MONEY)
    return weekly.join(billed, "expensaId").where(in_month).select(
        F.col("nombre").alias("Nombre_Consorcio"), F.col("consorcioId").alias("ID_Consorcio"),
        F.col("expensaId").alias("ID_Expensa"),
        F.date_format(dates.period_of(F.col("Anio"), F.col("Mes")), "yyyy-MM").alias("Periodo"),
        "Anio", "Mes", "Semana",
        show(F.col("ord")).alias("Egreso_Ordinario"),
        show(F.col("ext")).alias("Egreso_Extraordinario"),
        show(F.col("total")).alias("Egreso_Semanal_Total"),
        show(F.sum("total").over(so_far)).alias("Acumulado_Progresivo"),
        show(F.avg("total").over(month_weeks)).alias("Promedio_Periodo"),
    ).orderBy("ID_Consorcio", "Anio", "Semana", "Mes")


def collections(applied: DataFrame, payments: DataFrame, lines: DataFrame,
                units: DataFrame) -> DataFrame:
    """Applied payments with their date, line weights, unit and building.

    The base of the collection reports; unused columns are pruned from it.
    """
    return (
        applied.join(payments.select(F.col("id").alias("idPago"), "fecha"), "idPago")
        .join(lines.select(
            F.col("id").alias("idDetalleExpensa"), "expensaId", "idUnidadFuncional",
            "prorrateoOrdinario", "prorrateoExtraordinario", "interesMora"), "idDetalleExpensa")
        .join(units.select(F.col("id").alias("idUnidadFuncional"), "consorcioId", "departamento"),
              "idUnidadFuncional")
    )


def month_department_crosstab(
    paid: DataFrame,
    units: DataFrame,
    building: int | None = None,
    year: int | None = None,
    include_unpaid: bool = False,
    per_unit_rows: bool = False,
) -> DataFrame:
    """Collections per building, year and department, one column per month.

    ``include_unpaid`` adds departments without payments (needs ``year``).
    ``per_unit_rows`` repeats a department's sums once per unit of the
    department before adding them up, as the first version of this report did.
    """
    if include_unpaid and year is None:
        raise ValueError("include_unpaid needs a year")
    wanted = _where(paid, *_equals("consorcioId", building), *dates.in_year(F.col("fecha"), year))
    month = F.month("fecha")
    # Conditional sums: one shuffle, combined on the map side, instead of the
    # two aggregations of a pivot.
    table = wanted.groupBy("consorcioId", F.year("fecha").alias("anio"), "departamento").agg(*[
        F.sum(F.when(month == i, F.col("importeAplicado"))).alias(name)
        for i, name in enumerate(MONTH_COLUMNS, 1)
    ])
    if include_unpaid:
        departments = _where(units, *_equals("consorcioId", building)).select(
            "consorcioId", "departamento").distinct()
        table = departments.join(table, ["consorcioId", "departamento"], "left").withColumn(
            "anio", F.coalesce("anio", F.lit(year)))
    factor = F.lit(1)
    if per_unit_rows:
        sizes = units.groupBy("consorcioId", "departamento").agg(F.count(F.lit(1)).alias("_units"))
        table = table.join(sizes, ["consorcioId", "departamento"])
        factor = F.col("_units")
    months = [(F.coalesce(F.col(m), F.lit(0)) * factor).cast(MONEY).alias(m) for m in MONTH_COLUMNS]
    return (
        table.select("consorcioId", "anio", "departamento", *months)
        .withColumn("Total", reduce(lambda a, b: a + b, [F.col(m) for m in MONTH_COLUMNS]).cast(MONEY))
        .orderBy("consorcioId", "anio", "departamento")
    )


def collections_by_origin(paid: DataFrame, building: int | None = None, start=None,
                          end: dt.date | str | None = None, as_of=None) -> DataFrame:
    """Collections per month, each payment split over ordinary cost,
    extraordinary cost and interest in proportion to its line."""
    day = F.col("fecha")
    upper = dates.between(day, end=end) if end else [day < F.date_add(dates.as_of_date(as_of), 1)]
    wanted = _where(paid, *_equals("consorcioId", building), *dates.between(day, start), *upper)
    parts = split_by_weights(F.col("importeAplicado").cast(MONEY), {
        "Ordinario": F.col("prorrateoOrdinario"),
        "Extraordinario": F.col("prorrateoExtraordinario"),
        "Mora": F.col("interesMora"),
    })
    return (
        wanted.select(dates.period(day).alias("_mes"), *[c.alias(n) for n, c in parts.items()])
        .groupBy("_mes").agg(*[F.sum(n).alias(n) for n in parts])
        .orderBy("_mes")
        .select(F.date_format("_mes", "yyyy-MM").alias("Periodo"), *parts,
                (F.col("Ordinario") + F.col("Extraordinario") + F.col("Mora")).alias("Total"))
    )


def top_months(costs: DataFrame, bills: DataFrame, lines: DataFrame, n: int = 5,
               year: int | None = None, building: int | None = None) -> DataFrame:
    """The ``n`` months with the highest cost and the ``n`` with the highest income.

    Ties go to the earlier month.
    """
    known = _where(bills, *_equals("consorcioId", building)).select(
        F.col("id").alias("expensaId"), "fechaPeriodoAnio", "fechaPeriodoMes")
    day = F.col("fechaEmision")
    # Sum per bill and month first: what meets the bills is small. Dates and amounts may be decrypted: conditions on
    # them stand in the sums, because Spark would copy the decryption into a filter below and decrypt a value twice.
    spent = (
        _where(costs, F.col("idExpensa").isNotNull(), *dates.in_year(day, year))
        .groupBy(F.col("idExpensa").alias("expensaId"), F.year(day).alias("Anio"), F.month(day).alias("Mes"))
        .agg(F.sum(F.col("ordinario") + F.col("extraordinario")).alias("Monto"), F.count(day).alias("_dias"))
        .where("_dias > 0")
        .join(known, "expensaId", "left_semi")
        .groupBy("Anio", "Mes").agg(F.sum("Monto").cast(MONEY).alias("Monto"))
    )
    due, received = F.col("primerVencimiento"), F.col("pagosRecibidos")
    earned = (
        _where(lines, *dates.in_year(due, year))
        .groupBy("expensaId").agg(F.sum(F.when(due.isNotNull() & (received > 0), received)).alias("Monto"))
        .where(F.col("Monto").isNotNull())
        .join(known, "expensaId")
        .groupBy(F.col("fechaPeriodoAnio").alias("Anio"), F.col("fechaPeriodoMes").alias("Mes"))
        .agg(F.sum("Monto").cast(MONEY).alias("Monto"))
    )

    def top(df: DataFrame, kind: str) -> DataFrame:
        return df.orderBy(F.desc("Monto"), "Anio", "Mes").limit(n).select(
            F.lit(kind).alias("Tipo"), "Anio", "Mes",
            F.date_format(dates.period_of(F.col("Anio"), F.col("Mes")), "MMMM").alias("NombreMes"), "Monto")

    return top(spent, "Gasto").unionByName(top(earned, "Ingreso")).orderBy(
        F.desc("Tipo"), F.desc("Monto"), "Anio", "Mes")


def debts(lines: DataFrame, clamp: bool = True) -> Column:
    """What is open on a line; ``clamp`` counts overpaid lines as 0."""
    open_ = F.col("totalaPagar") - F.coalesce("pagosRecibidos", F.lit(0).cast(MONEY))
    return F.greatest(open_, F.lit(0).cast(MONEY)) if clamp else open_


def debtors(lines: DataFrame, units: DataFrame, people: DataFrame, building: int | None = None,
            start=None, end=None, as_of=None, clamp: bool = True, role: int | None = None,
            link: str = "CVU_CBU") -> DataFrame:
    """Open debt per building and person over lines due in the range.

    ``link`` is the account column both sides share (or its hash). Debts are
    summed per unit before units meet people.
    """
    due = F.col("primerVencimiento")
    upper = dates.between(due, end=end) if end else [due <= dates.as_of_date(as_of)]
    per_unit = (
        _where(lines, *dates.between(due, start), *upper)
        .groupBy("idUnidadFuncional").agg(F.sum(debts(lines, clamp)).alias("deuda"))
    )
    owned = _where(units, *_equals("consorcioId", building)).select(
        F.col("id").alias("idUnidadFuncional"), "consorcioId", link)
    persons = _where(people, *_equals("idTipoRol", role)).select(
        link, "dni", "nombre", "apellido", "email", "telefono")
    return (
        per_unit.join(owned, "idUnidadFuncional").join(persons, link)
        .groupBy("consorcioId", "dni", "nombre", "apellido", "email", "telefono")
        .agg(F.sum("deuda").cast(MONEY).alias("morosidad"))
        .where(F.col("morosidad") > F.lit(DEBT_THRESHOLD).cast(MONEY))
    )


def top_debtors(owing: DataFrame, n: int = 3, per_building: bool = False) -> DataFrame:
    """The largest debtors of ``debtors``, over all rows or per building; ties go
    to the lower dni. Either way only ``n`` rows per task (and building) are shuffled."""
    order = [F.desc("morosidad"), F.col("dni"), F.col("consorcioId")]
    if not per_building:
        top = owing.orderBy(*order).limit(n)
        return top.withColumn("puesto", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))
    rank = F.row_number().over(W.partitionBy("consorcioId").orderBy(*order))
    return owing.withColumn("puesto", rank).where(F.col("puesto") <= n)


def debtors_xml(top: DataFrame) -> DataFrame:
    """One XML document of the top debtors per building. The input is a top list,
    so a document has at most ``n`` entries."""
    person = xml.element(
        "propietario",
        [xml.text_element(c, F.col(c)) for c in ("nombre", "apellido", "email", "telefono", "morosidad")],
        {"dni": F.col("dni")},
    )
    people = F.sort_array(F.collect_list(F.struct("puesto", person.alias("xml"))))
    return top.groupBy("consorcioId").agg(people.alias("p")).select(
        "consorcioId",
        xml.element("mayoresMorosos", [F.array_join(F.col("p.xml"), "")]).alias("XML_Reporte5"))


def payment_gaps(paid: DataFrame, building: int | None = None, unit: int | None = None, start=None,
                 end=None, as_of=None, mark_last: bool = False) -> DataFrame:
    """Every payment on a line with an ordinary share, with the days since the
    unit's payment before (NULL for the first). ``mark_last`` adds ``ultimo``,
    true on the unit's last payment.

    Payments are first counted per unit and day; the window then holds one row
    per day, and the payments of one day come back as rows 0 days apart. A unit
    with a third of all payments thus fills no task.
    """
    day = F.col("fecha")
    upper = dates.between(day, end=end) if end else [day < F.date_add(dates.as_of_date(as_of), 1)]
    daily = (
        _where(paid, F.col("prorrateoOrdinario") > 0, *_equals("consorcioId", building),
               *_equals("idUnidadFuncional", unit), *dates.between(day, start), *upper)
        .groupBy("consorcioId", "idUnidadFuncional", day.cast("date").alias("fechaPago"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    in_order = W.partitionBy("idUnidadFuncional").orderBy("fechaPago")
    last = [((F.col("orden") == F.col("_n")) & F.col("_final")).alias("ultimo")] if mark_last else []
    return (
        daily.withColumn("_gap", F.datediff("fechaPago", F.lag("fechaPago").over(in_order)))
        .withColumn("_final", F.lead("fechaPago").over(in_order).isNull())
        .select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("orden"))
        .select(F.col("idUnidadFuncional").alias("idUF"), F.col("consorcioId").alias("idConsorcio"),
                "fechaPago", F.col("orden").cast("int").alias("orden"),
                F.when(F.col("orden") == 1, F.col("_gap")).otherwise(F.lit(0)).alias("diasDesdeAnterior"), *last)
    )


def payment_gaps_xml(gaps: DataFrame) -> DataFrame:
    """Document lines (idUF, fechaPago, orden, parte, xml) of ``payment_gaps``
    with ``mark_last``: an opening line before a unit's first payment, a line
    per payment, a closing line after its last. In the order of the first four
    columns they are the body of the document; no unit is gathered in one row,
    and ``sinks.write_document`` sorts and writes them."""
    first = F.col("diasDesdeAnterior").isNull()
    lines = F.array(
        F.struct(F.lit(0).alias("parte"), first.alias("_da"),
                 xml.open_tag("unidadFuncional", {"id": F.col("idUF")}).alias("xml")),
        F.struct(F.lit(1).alias("parte"), F.lit(True).alias("_da"),
                 xml.empty_element("pago", {"fecha": F.col("fechaPago"),
                                            "diasDesdeAnterior": F.col("diasDesdeAnterior")}).alias("xml")),
        F.struct(F.lit(2).alias("parte"), F.col("ultimo").alias("_da"),
                 F.lit("</unidadFuncional>").alias("xml")),
    )
    return gaps.select("idUF", "fechaPago", "orden", F.inline(lines)).where("_da").drop("_da")


def _section(df: DataFrame, title: str, fields: list[Column], amount: Column) -> DataFrame:
    filled = [*fields, *[F.lit(None)] * (4 - len(fields))]
    return df.select(
        F.lit(title).alias("Seccion"), F.col("consorcioId").alias("IdConsorcio"),
        F.col("nombre").alias("NombreConsorcio"), F.col("anioPeriodo").alias("Anio"),
        F.col("mesPeriodo").alias("Mes"),
        *[c.cast("string").alias(f"Campo{i}") for i, c in enumerate(filled, 1)],
        amount.cast(MONEY).alias("Monto"))


def expense_document(
    buildings: DataFrame, bills: DataFrame, lines: DataFrame, units: DataFrame, people: DataFrame,
    ordinary: DataFrame, extraordinary: DataFrame, name: str | None = None, year: int | None = None,
    month: int | None = None,
) -> DataFrame:
    """The six sections of each bill's expense document: header, how to pay,
    debtors, ordinary costs, extraordinary costs, financial status."""
    billed = resolve_bill(buildings, bills, name, year, month)
    lines = in_period(lines, "primerVencimiento", year, month)
    ordinary, extraordinary = (in_period(df, "fechaEmision", year, month) for df in (ordinary, extraordinary))
    period = dates.period_of(F.col("anioPeriodo"), F.col("mesPeriodo"))
    about = billed.join(
        buildings.select(F.col("id").alias("consorcioId"), "direccion", "CVU_CBU", "metrosCuadradosTotal"),
        "consorcioId")
    header = _section(about, "1-Encabezado",
                      [F.col("direccion"), F.col("CVU_CBU"), F.col("metrosCuadradosTotal")], F.lit(None))
    terms = _section(
        billed, "2-FormaPago",
        [F.lit("Transferencia bancaria a la cuenta del consorcio"),
         dates.due_date(period, dates.FIRST_DUE_DAY), dates.due_date(period, dates.SECOND_DUE_DAY)],
        F.lit(None))
    owing = (
        lines.select("expensaId", "idUnidadFuncional", debts(lines).alias("deuda")).where("deuda > 0")
        .join(units.select(F.col("id").alias("idUnidadFuncional"), "CVU_CBU", "piso", "departamento",
                           "numero"), "idUnidadFuncional")
        .join(people.select("CVU_CBU", F.col("nombre").alias("_nombre"), "apellido"), "CVU_CBU")
        .join(billed, "expensaId")
    )
    door = F.concat(text.fixed_width(F.col("piso"), 4), F.lit("-"), F.col("departamento"))
    debtors_ = _section(owing, "3-Deudores",
                        [F.concat_ws(" ", "_nombre", "apellido"), door, F.col("numero")], F.col("deuda"))
    bill = billed.withColumnRenamed("expensaId", "idExpensa").drop("consorcioId")
    ordinary_ = _section(
        ordinary.join(bill, "idExpensa"), "4-GastosOrdinarios",
        [F.col(c) for c in ("tipoServicio", "nombreEmpresaoPersona", "nroFactura", "detalle")],
        F.col("importeTotal"))
    instalment = F.when(~F.col("esPagoTotal"), F.concat(F.lit("Cuota "), F.col("nroCuota").cast("string")))
    extra = _section(
        extraordinary.join(bill, "idExpensa"), "5-GastosExtraordinarios",
        [F.col("detalle"), F.col("nombreEmpresaoPersona"), F.col("nroFactura"), instalment],
        F.col("importeTotal"))
    amounts = {"SaldoAnterior": "saldoAnterior", "IngresosEnTermino": "ingresosEnTermino",
               "IngresosAdeudados": "ingresosAdeudados", "IngresosAdelantados": "ingresosAdelantados",
               "Egresos": "egresos", "SaldoCierre": "saldoCierre"}
    status_rows = bills.select(F.col("id").alias("expensaId"), F.inline(F.array(*[
        F.struct(F.lit(label).alias("concepto"), F.col(c).alias("importe")) for label, c in amounts.items()])))
    status = _section(status_rows.join(billed, "expensaId"), "6-EstadoFinanciero",
                      [F.col("concepto")], F.col("importe"))
    return reduce(DataFrame.unionByName, [header, terms, debtors_, ordinary_, extra, status])
