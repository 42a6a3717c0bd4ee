"""What the reports on one bill read, prefix joins on odd texts, and lines that do not fit."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from duesflow import schemas
from duesflow.functions.amounts import MONEY
from duesflow.operators import prefix, protect
from duesflow.plans import billing, delivery, reports
from duesflow.sources import files, sinks


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_bill_reads_one_month(spark, tmp_path):
    facts = str(tmp_path)
    costs = [(i, 1_000_000 + 202500 + m, 1, "f", f"{i:010d}", dt.date(2025, m, 7), 10 * m, "d", "SEGUROS")
             for i, m in enumerate((1, 2, 2, 3, 12))]
    ddl = schemas.TABLES["GastoOrdinario"].ddl.replace("decimal(18,2)", "int")
    rows = schemas.conform(spark.createDataFrame(costs, ddl), "GastoOrdinario")
    extra = schemas.conform(rows, "GastoExtraordinario")
    sinks.append(delivery._by_month(rows, "fechaEmision"), f"{facts}/GastoOrdinario", delivery.MONTH)
    sinks.append(delivery._by_month(extra, "fechaEmision"), f"{facts}/GastoExtraordinario", delivery.MONTH)
    ordinary, extraordinary = (delivery._read(spark, facts, t) for t in ("GastoOrdinario", "GastoExtraordinario"))
    buildings = spark.createDataFrame([(1, "One", "s", "B1", None)], "id long, nombre string, direccion string, CVU_CBU string, metrosCuadradosTotal int")
    bills = spark.createDataFrame([(1_202_500 + m, 1, 2025, m) for m in (1, 2, 3, 12)],
                                  "id long, consorcioId long, fechaPeriodoAnio int, fechaPeriodoMes int")
    bills = schemas.conform(bills.withColumn("id", F.col("id") + 0), "Expensa")
    report = reports.weekly_cost_flow(billing.combine_costs(ordinary, extraordinary), bills, buildings, "one", 2025, 2)
    filters = [line for line in plan_of(report).splitlines() if "PartitionFilters" in line and "Gasto" in line]
    assert len(filters) == 2 and report.count() == 1 and all("anio" in f.split("PartitionFilters")[1] and "mes" in f.split("PartitionFilters")[1] for f in filters)
    lines = schemas.empty(spark, "DetalleExpensa")
    document = reports.expense_document(buildings, bills, lines, schemas.empty(spark, "UnidadFuncional"), schemas.empty(spark, "Persona"),
                                        ordinary, extraordinary, "one", 2025, 2)
    assert {(r.Seccion, r.n) for r in document.groupBy("Seccion").agg(F.count("*").alias("n")).collect()} >= {
        ("4-GastosOrdinarios", 2), ("5-GastosExtraordinarios", 2)}
    filters = [line for line in plan_of(document).splitlines() if "PartitionFilters" in line and "Gasto" in line]
    assert filters and all("mes" in f.split("PartitionFilters")[1] for f in filters)


def test_billing_lists_its_months_only(spark, tmp_path):
    facts = str(tmp_path)
    rows = spark.createDataFrame([(i, 1, "U", dt.datetime(2024 + i // 12, i % 12 + 1, 3), 5) for i in range(30)],
                                 "id long, idFormaPago int, cbuCuentaOrigen string, fecha timestamp, importe int")
    delivery.add_facts(schemas.conform(rows, "Pago"), facts, "Pago")
    some = delivery._months(delivery._read(spark, facts, "Pago"), dt.date(2024, 12, 1), dt.date(2025, 2, 1), -1, 1)
    assert sorted(r.id for r in some.collect()) == [10, 11, 12, 13, 14] and len(some.inputFiles()) == 30
    assert "PartitionFilters: [isnotnull" in plan_of(some) or "PartitionFilters: [((" in plan_of(some)


def test_prefixes_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, "ab%"), (3, ""), (4, None), (5, "ñandú"), (6, "a_c")], "i int, t string")
    marks = spark.createDataFrame([("ab", 1), ("ab%", 2), ("", 3), (None, 4), ("ñan", 5), ("a_", 6), ("abcd", 7), ("zz", 8)], "p string, k int")
    got = sorted((r.i, r.k) for r in prefix.prefix_matches(rows, "t", marks, "p").collect())
    texts, kinds = {r.i: r.t for r in rows.collect()}, {r.k: r.p for r in marks.collect()}
    want = sorted((i, k) for i, t in texts.items() for k, p in kinds.items() if t is not None and p is not None and t.startswith(p))
    assert got == want
    best = {r.i: r.k for r in prefix.longest_prefix(rows, "t", marks, "p").collect()}
    assert best == {1: 1, 2: 2, 3: 3, 4: None, 5: 5, 6: 6}
    assert "NestedLoop" not in plan_of(prefix.prefix_matches(rows, "t", marks, "p"))
    none = marks.where("false")
    assert prefix.prefix_matches(rows, "t", none, "p").isEmpty() and prefix.longest_prefix(rows, "t", none, "p").count() == 6


def test_lines_that_do_not_fit(spark, tmp_path):
    path = tmp_path / "pagos.csv"
    path.write_bytes("id,fecha,cvu,valor\n1,01/01/2025,U1,$1\n2,01/01/2025\n3,01/01/2025,U1,$1,x,y\n,,,\n\"5\",01/01/2025,\"U,1\",ñ\n".encode("iso-8859-1"))
    rows, bad = files.read_checked(spark, "payments", str(path))
    assert sorted((r.idPago or "", r.CVU_CBU or "", r.valor or "") for r in rows.collect()) == [("", "", ""), ("1", "U1", "$1"), ("5", "U,1", "ñ")]
    assert sorted((r.causa, r.linea, r.archivo.endswith("pagos.csv")) for r in bad.collect()) == [
        ("corta", "2,01/01/2025", True), ("larga", "3,01/01/2025,U1,$1,x,y", True)]


def test_units_are_dealt_also_under_broadcast_bills(spark):
    rows = spark.range(20).select(F.col("id").alias("idUnidadFuncional"), F.lit(1).cast("long").alias("consorcioId"))
    units = rows.withColumnRenamed("idUnidadFuncional", "id")
    bills = spark.createDataFrame([(1, [5])], "consorcioId long, facturas array<long>")
    joined = billing._with_bills(rows.coalesce(1), bills, units)
    assert "REPARTITION_BY_NUM" in plan_of(joined)
    assert sorted(r.idUnidadFuncional for r in joined.collect()) == list(range(20))
    assert joined.columns == ["consorcioId", "idUnidadFuncional", "facturas"]


def test_units_are_dealt_also_after_a_join_with_debts(spark):
    """The walk over the months must not run in the tasks that a join by unit leaves behind."""
    march = dt.date(2025, 3, 1)
    units = spark.range(40).select("id", F.lit(1).cast("long").alias("consorcioId"), F.col("id").cast("string").alias("CVU_CBU"),
                                   F.lit(50).cast("decimal(5,2)").alias("porcentajeExpensas"))
    headers = spark.createDataFrame([(1, 1_202_503, march, 100, 0)], "consorcioId long, id long, periodo date, ordinario int, extraordinario int").withColumns(
        {c: F.col(c).cast(MONEY) for c in ("ordinario", "extraordinario")})
    paid = billing.account_months(schemas.empty(spark, "Pago"))
    previous = units.select(F.col("id").alias("idUnidadFuncional"), F.lit(dt.date(2025, 2, 1)).alias("periodo"),
                            F.col("id").cast(MONEY).alias("deuda"), F.lit(3).cast(MONEY).alias("pagado"))
    lines = billing.carried_lines(headers, units, paid, previous)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RepartitionByExpression")
    assert "aggregate(" in above and "LeftOuter" not in above and "LeftOuter" in below
    got = {r.idUnidadFuncional: (r.arrastre, r.total, r.pagadoAntes) for r in lines.collect()}
    assert got == {i: (i, 50 + i * Decimal("1.05"), 3) for i in range(40)}


def test_debts_are_carried_across_stretches_of_bills(spark):
    """Twenty-nine months with two gaps against a plain walk; the state of the walk holds the debts of one stretch only."""
    months = [dt.date(2020 + n // 12, n % 12 + 1, 1) for n in range(31) if n not in (8, 20)]
    costs = {m: (100_000 + 7_919 * i, -301 * i) for i, m in enumerate(months)}
    percents = {1: "33.33", 2: "0.07", 3: None}
    money = lambda c: F.col(c).cast(MONEY)
    units = spark.createDataFrame([(i, 1, f"U{i}", p) for i, p in percents.items()], "id long, consorcioId long, CVU_CBU string, p string").select(
        "id", "consorcioId", "CVU_CBU", F.col("p").cast("decimal(5,2)").alias("porcentajeExpensas"))
    headers = spark.createDataFrame([(1, m.year * 100 + m.month, m, f"{o / 100}", f"{e / 100}") for m, (o, e) in costs.items()],
                                    "consorcioId long, id long, periodo date, ordinario string, extraordinario string").withColumns(
        {c: money(c) for c in ("ordinario", "extraordinario")})
    given = {(u, m): 11_111 * (i % 5) for u in (1, 2) for i, m in enumerate(months) if i % 3}
    paid = spark.createDataFrame([(f"U{u}", (m + dt.timedelta(days=31)).replace(day=1), f"{c / 100}") for (u, m), c in given.items()],
                                 "CVU_CBU string, mes date, pagado string").select("CVU_CBU", "mes", money("pagado").alias("pagado"), F.col("mes").alias("primera"))
    want = {}
    for u, p in percents.items():
        left, last, percent = 0, None, int(Decimal(p or 0) * 100)
        for m in months:
            carried = left if last and (last + dt.timedelta(days=31)).replace(day=1) == m else 0
            exact = sum(costs[m]) * percent + carried * 10_000 + max(carried, 0) * 500
            total = (abs(exact) + 5_000) // 10_000 * (1 if exact >= 0 else -1)
            want[u, m] = (carried, total)
            left, last = total - given.get((u, m), 0), m
    lines = billing.carried_lines(headers, units, paid)
    got = {(r.idUnidadFuncional, r.periodo): (int(r.arrastre * 100), int(r.total * 100)) for r in lines.collect()}
    assert got == want and len(want) == 87
    assert "tramos" in lines._jdf.queryExecution().optimizedPlan().toString()


def test_top_months_decrypts_no_value_in_a_filter(spark):
    from duesflow.plans import protected

    day = dt.date(2025, 3, 5)
    cost = [(1, 12025_03, 2, "f", "1", day, 10, "d", True, 1, 10), (2, 12025_03, 2, "f", "2", None, 99, "d", True, 1, 99),
            (3, None, 2, "f", "3", day, 99, "d", True, 1, 99)]
    extra = schemas.conform(spark.createDataFrame(cost, schemas.TABLES["GastoExtraordinario"].ddl.replace("decimal(18,2)", "int")), "GastoExtraordinario")
    lines = schemas.conform(spark.createDataFrame(
        [(1, 12025_03, 7, day), (2, 12025_03, 0, day), (3, 12025_03, None, day), (4, 12025_03, 5, None), (5, 12025_03, -1, day)],
        "id long, expensaId long, pagosRecibidos int, primerVencimiento date"), "DetalleExpensa")
    bills = spark.createDataFrame([(12025_03, 2, 2025, 3), (12025_04, 2, 2025, 4)], "id long, consorcioId long, fechaPeriodoAnio int, fechaPeriodoMes int")
    key = "0123456789abcdef"
    hide = lambda df, table: protect.protect_table(df, table, key)
    top = protected.top_months(hide(schemas.empty(spark, "GastoOrdinario"), "GastoOrdinario"), hide(extra, "GastoExtraordinario"),
                               bills, hide(lines, "DetalleExpensa"), key)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "aesdecrypt" in plan.lower() and not [x for x in plan.splitlines() if "Filter" in x and "aes" in x.lower()]
    assert [(r.Tipo, r.Anio, r.Mes, int(r.Monto)) for r in top.collect()] == [("Ingreso", 2025, 3, 7), ("Gasto", 2025, 3, 10)]


def test_plans_show_tables_below_long_folders(spark, tmp_path):
    path = str(tmp_path / ("folder" * 20) / "GastoOrdinario")
    sinks.append(spark.range(12).select("id", (F.col("id") % 3).cast("int").alias("mes")), path, ["mes"])
    scans = [line for line in plan_of(spark.read.parquet(path).where("mes = 1")).splitlines() if "PartitionFilters" in line]
    assert len(scans) == 1 and "GastoOrdinario" in scans[0] and "mes" in scans[0].split("PartitionFilters")[1]
