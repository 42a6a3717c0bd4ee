"""The monthly run over Parquet folders: files in, tables out, twice the same."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from duesflow import schemas
from duesflow.operators.quality import quality_report, table_counts
from duesflow.plans import delivery
from tests import fixtures

MASTERS = ("TipoRol", "FormaDePago", "Persona", "Consorcio", "UnidadFuncional", "CuentaBancaria", "Cochera", "Baulera")
FACTS = ("Pago", "GastoOrdinario", "GastoExtraordinario", "Expensa", "DetalleExpensa", "PagoAplicado")
AS_OF = dt.date(2025, 8, 15)


def tables(spark, masters, facts):
    return {t: delivery._read(spark, r, t) for r, names in ((masters, MASTERS), (facts, FACTS)) for t in names}


def test_delivery_and_billing(spark, tmp_path):
    drop = fixtures.write_all(str(tmp_path))
    v1, v2, facts = (str(tmp_path / n) for n in ("v1", "v2", "facts"))
    delivery.take_in(spark, drop, None, v1, facts, AS_OF, extraordinary=20)
    delivery.bill(spark, v1, facts, str(tmp_path / "a1"), dt.date(2025, 4, 1), dt.date(2025, 5, 1))
    got = {r.Tabla: r.Registros for r in table_counts(tables(spark, v1, facts)).collect()}
    assert got == {
        "TipoRol": 2, "FormaDePago": 3, "Persona": 136, "Consorcio": 6, "UnidadFuncional": 135, "CuentaBancaria": 6,
        "Cochera": 135, "Baulera": 135, "Pago": 540, "GastoOrdinario": 86, "GastoExtraordinario": 20, "Expensa": 12,
        "DetalleExpensa": 270, "PagoAplicado": 270}

    delivery.take_in(spark, {k: v for k, v in drop.items() if k != "people"}, v1, v2, facts, AS_OF, extraordinary=20)
    lines = {r.id: r for r in tables(spark, v1, facts)["DetalleExpensa"].collect()}
    delivery.bill(spark, v1, facts, str(tmp_path / "a2"), dt.date(2025, 4, 1), dt.date(2025, 5, 1))
    again = tables(spark, v2, facts)
    assert {r.Tabla: r.Registros for r in table_counts(again).collect()} == got
    assert {r.id: r for r in again["DetalleExpensa"].collect()} == lines

    delivery.bill(spark, str(tmp_path / "v1"), facts, str(tmp_path / "a3"), dt.date(2025, 6, 1), dt.date(2025, 7, 1))
    after = tables(spark, v2, facts)
    june = after["DetalleExpensa"].where("month(primerVencimiento) = 6 and idUnidadFuncional = 1").first()
    assert june.saldoAnteriorAbonado == lines[1202505].pagosRecibidos
    assert after["GastoOrdinario"].where(F.col("idExpensa").isNull()).isEmpty()
    report = quality_report(after).where("violaciones > 0").collect()
    assert {(r.tabla, r.regla, r.columnas) for r in report} == {("Consorcio", "reference", "CVU_CBU")} or not report
    assert set(schemas.TABLES) == set(got)


def test_single_months_equal_one_run(spark, tmp_path):
    """Two months billed one by one, payments arriving in between, against one run over both."""
    drop = fixtures.write_all(str(tmp_path))
    april, may = dt.date(2025, 4, 1), dt.date(2025, 5, 1)
    masters = [str(tmp_path / n) for n in ("m1", "m2", "m3")]
    whole, single = str(tmp_path / "whole"), str(tmp_path / "single")
    delivery.take_in(spark, drop, None, masters[0], whole, AS_OF, extraordinary=20)
    delivery.bill(spark, masters[0], whole, str(tmp_path / "a0"), april, may)
    delivery.take_in(spark, {k: v for k, v in drop.items() if k != "payments"}, None, masters[1], single, AS_OF, extraordinary=20)
    delivery.bill(spark, masters[1], single, str(tmp_path / "a1"), april, april)
    delivery.take_in(spark, {"payments": drop["payments"]}, masters[1], masters[2], single, AS_OF)
    delivery.bill(spark, masters[2], single, str(tmp_path / "a3"), may, may)
    for table, columns in (
        ("Expensa", ("id", "saldoAnterior", "ingresosEnTermino", "egresos", "saldoCierre")),
        ("DetalleExpensa", ("id", "totalaPagar", "pagosRecibidos", "interesMora", "saldoAnteriorAbonado")),
        ("PagoAplicado", ("idPago", "idDetalleExpensa", "importeAplicado")),
    ):
        one, many = (sorted(delivery._read(spark, f, table).select(*columns).collect()) for f in (whole, single))
        assert one == many, table
