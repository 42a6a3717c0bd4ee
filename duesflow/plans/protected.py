"""The reports over protected tables: decrypt what a report reads, then run it.

Tables arrive as ``operators.protect.protect_table`` leaves them; tables with
no protected column a report needs may come as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duesflow.operators.protect import ENCRYPTED, HASH_SUFFIX, is_protected, reveal, reveal_table
from duesflow.plans import billing, reports
from duesflow.schemas import TABLES


def _some(df: DataFrame, table: str, columns: list[str], key: str) -> DataFrame:
    """The given columns, decrypted where they are protected."""
    picked = df.select(*columns)
    if not is_protected(df):
        return picked
    types = {f.name: f.dataType.simpleString() for f in TABLES[table].schema}
    return reveal(picked, {c: types[c] for c in columns if c in ENCRYPTED.get(table, ())}, key)


def _costs(ordinary: DataFrame, extraordinary: DataFrame, key: str) -> DataFrame:
    columns = ["idExpensa", "consorcioId", "fechaEmision", "importeTotal"]
    return billing.combine_costs(_some(ordinary, "GastoOrdinario", columns, key),
                                 _some(extraordinary, "GastoExtraordinario", columns, key))


def collections(applied: DataFrame, payments: DataFrame, lines: DataFrame, units: DataFrame,
                key: str) -> DataFrame:
    """``reports.collections`` over protected tables; joins use clear ids only."""
    return reports.collections(
        reveal_table(applied, "PagoAplicado", key),
        payments.select("id", "fecha"),
        _some(lines, "DetalleExpensa",
              ["id", "expensaId", "idUnidadFuncional", "prorrateoOrdinario",
               "prorrateoExtraordinario", "interesMora"], key),
        units.select("id", "consorcioId", "departamento"),
    )


def weekly_cost_flow(ordinary: DataFrame, extraordinary: DataFrame, bills: DataFrame,
                     buildings: DataFrame, key: str, **options) -> DataFrame:
    return reports.weekly_cost_flow(_costs(ordinary, extraordinary, key), bills, buildings, **options)


def month_department_crosstab(applied, payments, lines, units, key: str, **options) -> DataFrame:
    paid = collections(applied, payments, lines, units, key)
    return reports.month_department_crosstab(paid, units, **options)


def collections_by_origin(applied, payments, lines, units, key: str, **options) -> DataFrame:
    return reports.collections_by_origin(collections(applied, payments, lines, units, key), **options)


def top_months(ordinary, extraordinary, bills, lines, key: str, **options) -> DataFrame:
    plain = _some(lines, "DetalleExpensa",
                  ["id", "expensaId", "pagosRecibidos", "primerVencimiento"], key)
    return reports.top_months(_costs(ordinary, extraordinary, key), bills, plain, **options)


def debtors(lines, units, people, key: str, clamp: bool = False, **options) -> DataFrame:
    """Debtors joined on the hash of the account, which needs no decryption.

    As over plain tables, but overpaid lines reduce a debt unless ``clamp``.
    """
    link = "CVU_CBU" + HASH_SUFFIX
    plain_lines = _some(lines, "DetalleExpensa",
                        ["id", "idUnidadFuncional", "totalaPagar", "pagosRecibidos",
                         "primerVencimiento"], key)
    plain_people = reveal(
        people.select(F.col(link), "idTipoRol", "dni", "nombre", "apellido", "email", "telefono"),
        {c: "string" for c in ("dni", "nombre", "apellido", "email", "telefono")}, key)
    return reports.debtors(plain_lines, units, plain_people, clamp=clamp, link=link, **options)


def payment_gaps(applied, payments, lines, units, key: str, **options) -> DataFrame:
    return reports.payment_gaps(collections(applied, payments, lines, units, key), **options)
