"""Registered reports over protected tables; they must equal the plain ones."""

from __future__ import annotations

from pyspark.sql import DataFrame

from duesflow.operators.protect import protect_table
from duesflow.plans import protected, reports
from duesflow.workload import reports as plain
from duesflow.workload.operators import new_key
from duesflow.workload.registry import query
from duesflow.workload.tables import Ledger


class _Protected:
    """The ledger's tables under a key of their own."""

    def __init__(self, t: Ledger):
        self.t, self.key = t, new_key()

    def _hide(self, df: DataFrame, table: str) -> DataFrame:
        return protect_table(df, table, self.key)

    @property
    def ordinary(self) -> DataFrame:
        return self._hide(self.t.ordinary(), "GastoOrdinario")

    @property
    def extraordinary(self) -> DataFrame:
        return self._hide(self.t.extraordinary(), "GastoExtraordinario")

    @property
    def applied(self) -> DataFrame:
        return self._hide(self.t.applied, "PagoAplicado")

    @property
    def payments(self) -> DataFrame:
        return self._hide(self.t.payments, "Pago")

    @property
    def lines(self) -> DataFrame:
        return self._hide(self.t.lines, "DetalleExpensa")

    @property
    def units(self) -> DataFrame:
        return self._hide(self.t.units, "UnidadFuncional")

    @property
    def people(self) -> DataFrame:
        return self._hide(self.t.people, "Persona")


@query("weekly_cost_flow_protected", plain.WEEKLY_COLUMNS, plain.WEEKLY_SQL)
def weekly_cost_flow(t: Ledger):
    p = _Protected(t)
    return protected.weekly_cost_flow(p.ordinary, p.extraordinary, t.bills, t.buildings, p.key)


@query("crosstab_protected", plain.CROSSTAB_COLUMNS, plain.CROSSTAB_SQL)
def crosstab(t: Ledger):
    p = _Protected(t)
    return protected.month_department_crosstab(p.applied, p.payments, p.lines, p.units, p.key)


@query("origin_protected", plain.ORIGIN_COLUMNS, plain.ORIGIN_SQL)
def origin(t: Ledger):
    p = _Protected(t)
    return plain._two_decimals(
        protected.collections_by_origin(p.applied, p.payments, p.lines, p.units, p.key, end=plain.EVER))


@query("topn_protected", plain.TOP_MONTH_COLUMNS, plain.TOP_MONTH_SQL)
def topn(t: Ledger):
    p = _Protected(t)
    return protected.top_months(p.ordinary, p.extraordinary, t.bills, p.lines, p.key, n=5)


@query("debtors_protected", plain.DEBTOR_COLUMNS, plain.debtor_rows_sql(clamp=False))
def debtors(t: Ledger):
    p = _Protected(t)
    owing = protected.debtors(p.lines, p.units, p.people, p.key, end=plain.EVER)
    return reports.top_debtors(owing, n=3, per_building=True)


@query("gaps_protected", plain.GAP_COLUMNS, plain.GAP_SQL)
def gaps(t: Ledger):
    p = _Protected(t)
    return protected.payment_gaps(p.applied, p.payments, p.lines, p.units, p.key, end=plain.EVER)
