"""One delivery from files to reports, checked against known sums and a plain walk."""

from __future__ import annotations

import datetime as dt
import os
from decimal import ROUND_HALF_UP, Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from duesflow import schemas
from duesflow.plans import billing, delivery, fillers, imports, notices, protected, reports
from duesflow.operators.protect import protect_table
from duesflow.session import cut_lineage
from duesflow.sources import files, sinks
from tests import fixtures

AS_OF, FIRST, LAST = "2025-08-15", "2025-04-01", "2025-07-01"
CENT = Decimal("0.01")


def rounded(value: Decimal) -> Decimal:
    return value.quantize(CENT, ROUND_HALF_UP)


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    paths = fixtures.write_all(str(tmp_path_factory.mktemp("drop")))
    readers = {"buildings": files.read_buildings, "unit_owners": files.read_unit_owners, "people": files.read_people,
               "units": files.read_units, "providers": files.read_providers, "costs": files.read_costs,
               "payments": files.read_payments}
    return SimpleNamespace(**{k: readers[k](spark, p) for k, p in paths.items()})


@pytest.fixture(scope="module")
def ledger(spark, raw):
    def empty(name):
        return schemas.empty(spark, name)

    buildings = cut_lineage(imports.import_buildings(raw.buildings, empty("Consorcio")))
    people = cut_lineage(imports.import_people(raw.people, empty("Persona")))
    owners = cut_lineage(imports.import_unit_owners(raw.unit_owners, buildings, empty("UnidadFuncional")))
    accounts, buildings = fillers.attach_accounts(buildings)
    accounts, buildings = cut_lineage(accounts), cut_lineage(buildings)
    buildings, units = imports.import_units(raw.units, buildings, owners, last_building=5)
    buildings, units = cut_lineage(buildings), cut_lineage(units)
    payments = cut_lineage(imports.import_payments(raw.payments, empty("Pago"), 1, AS_OF))
    ordinary = imports.import_costs(raw.costs, buildings, empty("GastoOrdinario"), 2025, last_number=1, as_of=AS_OF, invoices="reference")
    ordinary = imports.import_providers(raw.providers, buildings, cut_lineage(ordinary))
    ordinary = cut_lineage(fillers.fill_general_costs(ordinary))
    extraordinary = cut_lineage(fillers.generate_extraordinary(buildings, 20))
    run = billing.billing_batch(buildings, accounts, units, payments, ordinary, extraordinary, FIRST, LAST,
                                keep=cut_lineage)
    return SimpleNamespace(
        buildings=buildings, people=people, units=units, accounts=accounts, payments=payments,
        ordinary=ordinary, extraordinary=extraordinary, run=run, bills=cut_lineage(run.bills),
        lines=cut_lineage(run.lines), applied=cut_lineage(run.applied))


def test_missing_file_names_the_path(spark, tmp_path):
    with pytest.raises(files.MissingInput, match="nowhere.csv"):
        files.read_payments(spark, str(tmp_path / "nowhere.csv"))


def test_imports(ledger):
    assert [(r.id, r.nombre, r.metrosCuadradosTotal) for r in ledger.buildings.orderBy("id").collect()] == [
        *[(i, row[1], Decimal(row[4])) for i, row in enumerate(fixtures.BUILDINGS, 1)], (6, "Nuevo", None)]
    assert ledger.buildings.where("id = 6").first().direccion == imports.UNKNOWN_ADDRESS
    assert ledger.units.count() == 135 and ledger.units.select("CVU_CBU").distinct().count() == 135
    unit = ledger.units.where("consorcioId = 1 and numero = 1").first()
    assert (unit.piso, unit.departamento, unit.porcentajeExpensas, unit.metrosCuadrados) == (
        "PB  ", "A", Decimal("3.33"), Decimal("42.50"))
    assert unit.tipo in imports.UNIT_KINDS
    people = ledger.people
    assert people.count() == 136 and people.where("nombre = 'Twin'").isEmpty()
    ana = people.where("dni = '10001001'").first()
    assert (ana.nombre, ana.apellido, ana.email, ana.idTipoRol) == ("Ana1", "Río1", "ana1.1@example.com", 1)
    assert [r.apellido for r in people.where("CVU_CBU is null").collect()] == ["O’Hara"]
    assert sorted(r.idPersona for r in people.collect()) == list(range(1, 137))
    assert ledger.payments.count() == 540
    first = ledger.payments.where("id = 10014").first()
    assert (first.importe, first.fecha.date()) == (Decimal("4001.50"), dt.date(2025, 4, 6))


def test_repeated_import_adds_nothing(raw, ledger):
    assert imports.import_payments(raw.payments, ledger.payments, 1, AS_OF).isEmpty()
    assert imports.import_people(raw.people, ledger.people).where("CVU_CBU is not null").isEmpty()
    assert imports.import_unit_owners(raw.unit_owners, ledger.buildings, ledger.units).isEmpty()
    assert imports.import_buildings(raw.buildings, ledger.buildings).count() == 6
    assert imports.import_costs(raw.costs, ledger.buildings, ledger.ordinary, 2025, as_of=AS_OF, invoices="reference").isEmpty()


def test_cost_sums_and_invoices(ledger):
    got = {(r.nombre, r.mes): (r.n, r.s) for r in ledger.ordinary.join(
        ledger.buildings.withColumnRenamed("id", "consorcioId"), "consorcioId").groupBy(
        "nombre", F.month("fechaEmision").alias("mes")).agg(
        F.count("*").alias("n"), F.sum("importeTotal").alias("s")).collect()}
    want = {(b, m): (n, Decimal(s)) for b, row in fixtures.SURVIVING.items()
            for m, (n, s) in zip((4, 5, 6), row, strict=True)}
    assert got == want and sum(n for n, _ in got.values()) == 86
    may = ledger.ordinary.where("consorcioId = 1 and month(fechaEmision) = 5").orderBy("nroFactura").collect()
    assert [r.nroFactura for r in may] == [f"00125050{n:02d}" for n in range(9, 16)]
    assert [(r.tipoServicio, r.nombreEmpresaoPersona, r.detalle) for r in may if r.tipoServicio != "GASTOS GENERALES"] == [
        ("ADMINISTRACION", "Ana Gil", "Honorarios"), ("BANCARIOS", "BANCO UNO", "Gastos bancario"),
        ("LIMPIEZA", "Serv. Limpieza", "Limpia Azcuenaga"), ("SEGUROS", "SEGUROS DOS", "Integral de consorcio"),
        ("SERVICIOS PUBLICOS", "AYSA", "Cuenta 9"), ("SERVICIOS PUBLICOS", "AYSA", "Cuenta 9")]
    general = next(r for r in may if r.tipoServicio == "GASTOS GENERALES")
    assert general.nombreEmpresaoPersona in fillers.GENERAL_COMPANIES and general.detalle in fillers.GENERAL_DETAILS
    bank = ledger.ordinary.where("consorcioId = 3 and tipoServicio = 'BANCARIOS'").first()
    assert bank.nombreEmpresaoPersona is None


def month_add(day: dt.date, n: int) -> dt.date:
    index = day.year * 12 + day.month - 1 + n
    return dt.date(index // 12, index % 12 + 1, 1)


def walk(ledger):
    """Bills and lines month by month, as a clerk would do them."""
    units = ledger.units.collect()
    saldo = {r.CVU_CBU: r.saldo for r in ledger.accounts.collect()}
    payments = [(p, p.fecha.date()) for p in ledger.payments.collect()]
    costs = [(c.consorcioId, c.fechaEmision, c.importeTotal, k) for k, df in enumerate(
        (ledger.ordinary, ledger.extraordinary)) for c in df.collect()]
    home = {u.CVU_CBU: u.consorcioId for u in units}
    bills, lines = {}, {}
    for b in ledger.buildings.collect():
        balance = saldo.get(b.CVU_CBU, Decimal(0))
        for i in range(4):
            p = month_add(dt.date(2025, 4, 1), i)
            mine = [(x, d) for x, d in payments if home.get(x.cbuCuentaOrigen) == b.id]
            income = [(x.importe, d) for x, d in mine if d.replace(day=1) == p]
            ahead = [x.importe for x, d in mine if d.replace(day=1) == month_add(p, -1) and d.day > 15]
            spent = [sum((a for c, d, a, k in costs if c == b.id and d.replace(day=1) == p and k == kind), Decimal(0))
                     for kind in (0, 1)]
            got = sum((a for a, _ in income), Decimal(0))
            closing = balance + got - sum(spent)
            bills[b.id, p] = (balance, got, sum((a for a, d in income if d.day >= 10), Decimal(0)),
                              sum(ahead, Decimal(0)), sum(spent), closing)
            balance = closing
            for u in (u for u in units if u.consorcioId == b.id):
                before = lines.get((u.id, month_add(p, -1)))
                debt = before["total"] - before["paid"] if before else Decimal(0)
                rate = debt * Decimal("0.05") if debt > 0 else Decimal(0)
                shares = [s * (u.porcentajeExpensas or 0) / 100 for s in spent]
                settled = [(x.importe, d) for x, d in mine if x.cbuCuentaOrigen == u.CVU_CBU
                           and month_add(d.replace(day=1), -1) == p]
                total = rounded(sum(shares) + debt + rate)
                earlier = before["paid"] if before else rounded(debt)
                interest = rounded(rate)
                if settled:
                    first = min(d for _, d in settled)
                    tier = "0.05" if first > p.replace(day=15) else "0.02" if first > p.replace(day=10) else "0"
                    interest = rounded((total - earlier) * Decimal(tier))
                lines[u.id, p] = {
                    "shares": tuple(rounded(s) for s in shares), "total": total, "interest": interest,
                    "paid": sum((a for a, _ in settled), Decimal(0)), "earlier": earlier}
    return bills, lines


def test_billing_equals_the_walk(ledger):
    bills, lines = walk(ledger)
    got = {(r.consorcioId, dt.date(r.fechaPeriodoAnio, r.fechaPeriodoMes, 1)): (
        r.saldoAnterior, r.ingresosEnTermino, r.ingresosAdeudados, r.ingresosAdelantados, r.egresos, r.saldoCierre)
        for r in ledger.bills.collect()}
    assert got == bills
    got_lines = {(r.idUnidadFuncional, r.primerVencimiento.replace(day=1)): {
        "shares": (r.prorrateoOrdinario, r.prorrateoExtraordinario), "total": r.totalaPagar,
        "interest": r.interesMora, "paid": r.pagosRecibidos, "earlier": r.saldoAnteriorAbonado}
        for r in ledger.lines.collect()}
    assert got_lines == lines
    final = {r.CVU_CBU: r.saldo for r in ledger.run.accounts.collect()}
    accounts = {r.id: r.CVU_CBU for r in ledger.buildings.collect()}
    assert all(final[accounts[b]] == bills[b, dt.date(2025, 7, 1)][-1] for b in range(1, 6))


def test_step_by_step_equals_the_batch(ledger):
    """Inserted lines, then applied payments, then refresh."""
    inserted = billing.billing_batch(  # without ``keep``: bills meet units by building and salt
        ledger.buildings, ledger.accounts, ledger.units, ledger.payments, ledger.ordinary, ledger.extraordinary,
        FIRST, LAST, refreshed=False)
    lines = cut_lineage(inserted.lines)
    assert lines.where("pagosRecibidos <> 0").isEmpty()
    applied = billing.apply_payments(ledger.payments, ledger.units, lines, ledger.bills)
    refreshed = billing.refresh_lines(lines, applied, ledger.payments)
    assert refreshed.exceptAll(ledger.lines).isEmpty() and refreshed.count() == ledger.lines.count()
    assert billing.apply_payments(ledger.payments, ledger.units, lines, ledger.bills, ledger.applied).isEmpty()


def test_going_on_from_earlier_bills_equals_the_batch(ledger):
    def run(first, last, accounts, previous=None):
        return billing.billing_batch(ledger.buildings, accounts, ledger.units, ledger.payments, ledger.ordinary,
                                     ledger.extraordinary, first, last, previous)

    start = run("2025-04-01", "2025-05-01", ledger.accounts)
    open_ = start.lines.where("month(primerVencimiento) = 5").select(
        "idUnidadFuncional", F.trunc("primerVencimiento", "MM").alias("periodo"),
        (F.col("totalaPagar") - F.col("pagosRecibidos")).alias("deuda"), F.col("pagosRecibidos").alias("pagado"))
    rest = run("2025-06-01", "2025-07-01", cut_lineage(start.accounts), cut_lineage(open_))
    lines = cut_lineage(rest.lines)
    assert lines.exceptAll(ledger.lines).isEmpty() and lines.count() == 270
    # Building 6 has no account, so its balance is not carried between runs.
    bills = cut_lineage(rest.bills.where("consorcioId <= 5"))
    assert bills.exceptAll(ledger.bills).isEmpty() and bills.count() == 10


def test_extras_get_numbers_once(ledger, spark):
    first = cut_lineage(fillers.attach_extras(ledger.units, schemas.empty(spark, "Cochera")))
    assert first.count() == 135
    assert sorted(r.numero for r in first.join(ledger.units.where("consorcioId = 2").select(
        F.col("id").alias("unidadFuncionalId")), "unidadFuncionalId").collect()) == list(range(1, 21))
    assert first.first().porcentajeExpensas > 0
    assert fillers.attach_extras(ledger.units, first).isEmpty()


def test_seeds_and_accounts(spark, ledger):
    roles = fillers.seed_roles(schemas.empty(spark, "TipoRol"))
    assert sorted((r.idTipoRol, r.nombre) for r in roles.collect()) == [(1, "Inquilino"), (2, "Propietario")]
    assert fillers.seed_roles(roles).isEmpty()
    methods = fillers.seed_methods(schemas.empty(spark, "FormaDePago"))
    assert methods.count() == 3 and imports.default_method(methods).first().idFormaPago == 1
    assert ledger.accounts.where("saldo < 1000 or saldo > 50000 or length(CVU_CBU) <> 22").isEmpty()
    attached = ledger.buildings.where("id <= 5").join(ledger.accounts, "CVU_CBU")
    assert attached.count() == 5
    extra = ledger.extraordinary.collect()
    assert len(extra) == 20 and all(50000 <= r.importeTotal < 550000 for r in extra)
    assert all(r.totalCuota == (r.importeTotal if r.esPagoTotal else rounded(r.importeTotal / r.nroCuota)) for r in extra)


def test_reports_over_the_ledger(ledger):
    run, t = ledger.run, ledger
    costs = billing.combine_costs(run.ordinary, run.extraordinary)
    reports.require_bill(t.buildings, t.bills, "azcuenaga ", 2025, 5)
    with pytest.raises(reports.UnknownBuilding):
        reports.require_bill(t.buildings, t.bills, "Nobody", 2025, 5)
    with pytest.raises(reports.UnknownBill):
        reports.require_bill(t.buildings, t.bills, "Azcuenaga", 2024, 5)
    weekly = reports.weekly_cost_flow(costs, t.bills, t.buildings, "Azcuenaga", 2025, 5).collect()
    assert weekly[0].Semana == 18 and weekly[0].Egreso_Ordinario == "1,054,273.37" and weekly[0].Periodo == "2025-05"
    egresos = t.bills.where("consorcioId = 1 and fechaPeriodoMes = 5").first().egresos
    assert weekly[-1].Acumulado_Progresivo == f"{egresos:,.2f}"

    paid = reports.collections(t.applied, t.payments, t.lines, t.units)
    table = reports.month_department_crosstab(paid, t.units, 1, 2025).collect()
    assert [r.departamento for r in table] == list("ABCDE")
    assert sum(r.Total for r in table) == paid.where("consorcioId = 1").agg(F.sum("importeAplicado")).first()[0]
    repeated = reports.month_department_crosstab(paid, t.units, 1, 2025, per_unit_rows=True).collect()
    assert [r.Total for r in repeated] == [r.Total * 6 for r in table]
    none = reports.month_department_crosstab(paid, t.units, 1, 2024, include_unpaid=True).collect()
    assert [(r.departamento, r.Total, r.anio) for r in none] == [(d, 0, 2024) for d in "ABCDE"]
    with pytest.raises(ValueError):
        reports.month_department_crosstab(paid, t.units, include_unpaid=True)

    origin = reports.collections_by_origin(paid, 1, "2025-05-01", "2025-06-30").collect()
    assert [r.Periodo for r in origin] == ["2025-05", "2025-06"]
    sums = {f"{r.y}-{r.m:02d}": r.s for r in paid.where("consorcioId = 1").groupBy(
        F.year("fecha").alias("y"), F.month("fecha").alias("m")).agg(F.sum("importeAplicado").alias("s")).collect()}
    assert all(abs(r.Total - sums[r.Periodo]) < Decimal("0.01") for r in origin)

    top = reports.top_months(costs, t.bills, t.lines, n=2, year=2025, building=1).collect()
    assert [r.Tipo for r in top] == ["Ingreso", "Ingreso", "Gasto", "Gasto"] and top[0].Monto >= top[1].Monto
    owing = reports.debtors(t.lines, t.units, t.people, 1, "2025-05-01", as_of=AS_OF)
    three = cut_lineage(reports.top_debtors(owing))
    assert three.count() == 3 and reports.top_debtors(owing, per_building=True).count() == 3
    text = reports.debtors_xml(three).first().XML_Reporte5
    assert text.startswith('<mayoresMorosos><propietario dni="') and text.count("</propietario>") == 3


def test_payment_gaps_document(ledger, spark, tmp_path):
    t = ledger
    paid = reports.collections(t.applied, t.payments, t.lines, t.units)
    gaps = reports.payment_gaps(paid, unit=3, as_of=AS_OF)
    got = [(r.fechaPago, r.diasDesdeAnterior) for r in gaps.orderBy("fechaPago").collect()]
    days = sorted(r.fecha.date() for r in paid.where("idUnidadFuncional = 3 and prorrateoOrdinario > 0").collect())
    assert got == [(d, None if i == 0 else (d - days[i - 1]).days) for i, d in enumerate(days)]
    sinks.write_document(
        reports.payment_gaps_xml(reports.payment_gaps(paid, as_of=AS_OF, mark_last=True)), str(tmp_path / "doc"),
        "pagosOrdinarios", ["idUF", "fechaPago", "orden", "parte"])
    parts = sorted(f for f in os.listdir(tmp_path / "doc") if f.startswith("part"))
    lines = "".join(open(tmp_path / "doc" / f).read() for f in parts).splitlines()
    assert lines[0] == "<pagosOrdinarios>" and lines[-1] == "</pagosOrdinarios>"
    assert lines[1] == '<unidadFuncional id="1">' and lines[2].startswith('<pago fecha="2025-05-06"/>')
    import xml.etree.ElementTree as tree

    root = tree.fromstring("\n".join(lines))
    assert len(root) == paid.where("prorrateoOrdinario > 0").select("idUnidadFuncional").distinct().count()


def test_gaps_repeat_zero_on_one_day(spark):
    rows = spark.createDataFrame([(1, 1, d, 1) for d in ("2025-01-05", "2025-01-05", "2025-01-09")],
                                 "idUnidadFuncional int, consorcioId int, fecha string, prorrateoOrdinario int")
    rows = rows.withColumn("fecha", F.col("fecha").cast("timestamp"))
    got = reports.payment_gaps(rows, end="2025-12-31").orderBy("fechaPago", "orden").collect()
    assert [r.diasDesdeAnterior for r in got] == [None, 0, 4]


def test_expense_document(ledger):
    t = ledger
    doc = reports.expense_document(t.buildings, t.bills, t.lines, t.units, t.people, t.run.ordinary,
                                   t.run.extraordinary, "Azcuenaga", 2025, 5)
    rows = doc.collect()
    part = {s: [r for r in rows if r.Seccion == s] for s in {r.Seccion for r in rows}}
    assert part["1-Encabezado"][0].Campo1 == "Belgrano 3344" and part["1-Encabezado"][0].Campo3 == "1281.00"
    assert (part["2-FormaPago"][0].Campo2, part["2-FormaPago"][0].Campo3) == ("2025-05-10", "2025-05-15")
    assert len(part["3-Deudores"]) == 30 and "PB  -A" in {r.Campo2 for r in part["3-Deudores"]}
    assert sum(r.Monto for r in part["4-GastosOrdinarios"]) == Decimal("1054273.37")
    status = {r.Campo1: r.Monto for r in part["6-EstadoFinanciero"]}
    assert status["SaldoCierre"] == status["SaldoAnterior"] + status["IngresosEnTermino"] - status["Egresos"]
    extra = sum((r.Monto for r in part.get("5-GastosExtraordinarios", [])), Decimal(0))
    assert status["Egresos"] == Decimal("1054273.37") + extra


def test_protected_reports_equal_plain(ledger):
    t, key = ledger, "s" * 16
    hidden = {n: protect_table(df, n, key) for n, df in {
        "GastoOrdinario": t.run.ordinary, "GastoExtraordinario": t.run.extraordinary, "PagoAplicado": t.applied,
        "Pago": t.payments, "DetalleExpensa": t.lines, "UnidadFuncional": t.units, "Persona": t.people}.items()}
    chain = [hidden[n] for n in ("PagoAplicado", "Pago", "DetalleExpensa", "UnidadFuncional")]
    paid = reports.collections(t.applied, t.payments, t.lines, t.units)
    costs = billing.combine_costs(t.run.ordinary, t.run.extraordinary)
    pairs = [
        (protected.weekly_cost_flow(hidden["GastoOrdinario"], hidden["GastoExtraordinario"], t.bills, t.buildings, key),
         reports.weekly_cost_flow(costs, t.bills, t.buildings)),
        (protected.month_department_crosstab(*chain, key), reports.month_department_crosstab(paid, t.units)),
        (protected.collections_by_origin(*chain, key, as_of=AS_OF), reports.collections_by_origin(paid, as_of=AS_OF)),
        (protected.top_months(hidden["GastoOrdinario"], hidden["GastoExtraordinario"], t.bills, hidden["DetalleExpensa"], key),
         reports.top_months(costs, t.bills, t.lines)),
        (protected.debtors(hidden["DetalleExpensa"], hidden["UnidadFuncional"], hidden["Persona"], key, as_of=AS_OF),
         reports.debtors(t.lines, t.units, t.people, as_of=AS_OF, clamp=False)),
        (protected.payment_gaps(*chain, key, as_of=AS_OF), reports.payment_gaps(paid, as_of=AS_OF)),
    ]
    for got, want in pairs:
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_notices(ledger):
    import json

    t = ledger
    rows = notices.notice_rows(t.lines, t.bills, t.buildings, t.units, t.people, bill=1202505)
    sent = notices.notice_payloads(rows, "from@example.com", "Office").collect()
    assert len(sent) == 30
    body = json.loads(sent[0].payload)
    assert body["personalizations"][0]["to"][0]["email"] == sent[0].email
    assert "10/05/2025" in body["content"][0]["value"] and body["from"]["name"] == "Office"


def test_invoice_numbers_never_repeat_silently(spark):
    rows = spark.createDataFrame([(7, "2025-03-01", 999), (7, "2025-03-01", 1000)], "b long, p string, k long").withColumn(
        "p", F.col("p").cast("date"))

    def numbers(df, style):
        return [r[0] for r in df.select(imports.invoice_number(F.col("b"), F.col("p"), F.col("k"), style)).collect()]

    assert numbers(rows, "running") == ["0000000999", "0000001000"]
    assert numbers(rows.where("k < 1000"), "reference") == ["0072503999"]
    with pytest.raises(Exception, match="more than 3 digits"):
        numbers(rows, "reference")


def test_masters_must_exist(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        delivery.bill(spark, str(tmp_path / "none"), str(tmp_path / "facts"), str(tmp_path / "out"),
                      dt.date(2025, 4, 1), dt.date(2025, 4, 1))
