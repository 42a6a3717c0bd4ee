"""Bill notices: one row per bill line with a mail payload. Nothing is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duesflow.functions.amounts import or_zero
from duesflow.functions.dates import text_dmy

SUBJECT = "Expensa Mensual"


def _item(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"<li>{label}: "), value, F.lit("</li>"))


def _money(column: str) -> Column:
    return F.concat(F.lit("$"), or_zero(F.col(column)).cast("string"))


def notice_rows(lines: DataFrame, bills: DataFrame, buildings: DataFrame, units: DataFrame,
                people: DataFrame, bill: int | None = None) -> DataFrame:
    """One row per line: whom to tell what."""
    if bill is not None:
        lines = lines.where(F.col("expensaId") == bill)
    return (
        lines.select(F.col("id").alias("idDetalleExpensa"), "expensaId", "idUnidadFuncional",
                     "primerVencimiento", "segundoVencimiento", "totalaPagar", "interesMora",
                     "saldoAnteriorAbonado", "pagosRecibidos")
        .join(bills.select(F.col("id").alias("expensaId"), "consorcioId",
                           F.col("fechaPeriodoMes").alias("mes"), F.col("fechaPeriodoAnio").alias("anio")),
              "expensaId")
        .join(buildings.select(F.col("id").alias("consorcioId"), F.col("nombre").alias("consorcio")),
              "consorcioId")
        .join(units.select(F.col("id").alias("idUnidadFuncional"), "CVU_CBU", "departamento"),
              "idUnidadFuncional")
        .join(people.select("CVU_CBU", "email", "nombre", "apellido"), "CVU_CBU")
    )


def html_body() -> Column:
    """The message text over the columns of ``notice_rows``."""
    return F.concat(
        F.lit("<h1>Estimado/a "), F.col("apellido"), F.lit(" "), F.col("nombre"), F.lit("</h1><ul>"),
        _item("Consorcio", F.col("consorcio")),
        _item("Unidad", F.col("departamento")),
        _item("Periodo", F.concat(F.col("mes").cast("string"), F.lit("/"), F.col("anio").cast("string"))),
        _item("Saldo anterior abonado", _money("saldoAnteriorAbonado")),
        _item("Total a pagar", _money("totalaPagar")),
        _item("Interes por mora", _money("interesMora")),
        _item("Primer vencimiento", text_dmy(F.col("primerVencimiento"))),
        _item("Segundo vencimiento (2% de recargo, luego 5%)", text_dmy(F.col("segundoVencimiento"))),
        F.lit("</ul>"),
    )


def notice_payloads(rows: DataFrame, sender_email: str, sender_name: str) -> DataFrame:
    """(idDetalleExpensa, email, payload): the JSON request body per line."""
    to = F.struct(F.col("email").alias("email"))
    payload = F.to_json(F.struct(
        F.array(F.struct(F.array(to).alias("to"), F.lit(SUBJECT).alias("subject"))).alias("personalizations"),
        F.struct(F.lit(sender_email).alias("email"), F.lit(sender_name).alias("name")).alias("from"),
        F.array(F.struct(F.lit("text/html").alias("type"), html_body().alias("value"))).alias("content"),
    ))
    return rows.select("idDetalleExpensa", "email", payload.alias("payload"))
