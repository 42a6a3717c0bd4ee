"""The given tables in the shape of ledger tables.

nation = building, customer = unit and person, orders = payment and bill line,
lineitem = cost (through its supplier's nation) and line weights, supplier =
provider. Column names are those of ``duesflow.schemas``.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duesflow.functions import dates, text
from duesflow.functions.amounts import MONEY
from duesflow.operators import share
from duesflow.plans.billing import bill_id, line_id

# Columns of the given tables (a stated schema saves a job per read).
GIVEN = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
EXTRAORDINARY_FLAG = "R"


def account(owner: Column) -> Column:
    return text.zero_padded(owner, 22)


def money(amount: Column) -> Column:
    return amount.cast(MONEY)


class Ledger:
    """Ledger tables over one folder of the given tables; everything is lazy."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(GIVEN[name]).parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def months(self) -> tuple[dt.date, dt.date]:
        """First and last month with a payment or a cost. Runs two small jobs."""
        spans = [self.table(name).agg(F.min(day), F.max(day)).first()
                 for name, day in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"))]
        days = [day.date().replace(day=1) for span in spans for day in span if day is not None]
        return (min(days), max(days)) if days else (dt.date(1970, 1, 1), dt.date(1970, 1, 1))

    @cached_property
    def buildings(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("nombre"),
            account(F.col("n_nationkey")).alias("CVU_CBU"),
            F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")).alias("direccion"),
            F.lit(None).cast("decimal(10,2)").alias("metrosCuadradosTotal"))

    @cached_property
    def accounts(self) -> DataFrame:
        """One account per building; the providers' balances make its opening balance."""
        balance = self.table("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
            F.sum(money(F.col("s_acctbal"))).cast(MONEY).alias("saldo"))
        return self.table("nation").join(balance, "n_nationkey").select(
            account(F.col("n_nationkey")).alias("CVU_CBU"), F.col("n_name").alias("nombreTitular"), "saldo")

    @cached_property
    def units(self) -> DataFrame:
        """Units without percentages (see ``shared_units``)."""
        return self.table("customer").select(
            F.col("c_custkey").alias("id"), account(F.col("c_custkey")).alias("CVU_CBU"),
            F.col("c_nationkey").cast("bigint").alias("consorcioId"),
            F.substring("c_mktsegment", 1, 1).alias("departamento"),
            F.concat(F.lit("P"), (F.col("c_custkey") % 10).cast("string")).alias("piso"),
            F.col("c_custkey").cast("int").alias("numero"),
            F.greatest(F.col("c_acctbal").cast("decimal(10,2)"), F.lit(0).cast("decimal(10,2)"))
            .alias("metrosCuadrados"))

    @cached_property
    def shared_units(self) -> DataFrame:
        """Units with their percentage of the building's area."""
        sized = share.with_group_total(self.units, ["consorcioId"], "metrosCuadrados", "_area")
        return sized.withColumn(
            "porcentajeExpensas", share.percent_share(F.col("metrosCuadrados"), F.col("_area"))).drop("_area")

    @cached_property
    def people(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("idPersona"), F.col("c_name").alias("nombre"), F.col("c_mktsegment").alias("apellido"),
            text.zero_padded(key, 8).alias("dni"),
            F.concat(F.lit("c"), key.cast("string"), F.lit("@example.com")).alias("email"),
            account(key).alias("CVU_CBU"), text.zero_padded(key, 10).alias("telefono"),
            (key % 2 + 1).cast("int").alias("idTipoRol"))

    @cached_property
    def payments(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.lit(1).alias("idFormaPago"),
            account(F.col("o_custkey")).alias("cbuCuentaOrigen"),
            F.col("o_orderdate").cast("timestamp").alias("fecha"),
            money(F.col("o_totalprice")).alias("importe"))

    @cached_property
    def cost_rows(self) -> DataFrame:
        """Every cost with its building, provider and kind; not billed yet."""
        lines = self.table("lineitem").select(
            "l_suppkey", "l_orderkey", "l_linenumber", "l_linestatus",
            (F.col("l_returnflag") == EXTRAORDINARY_FLAG).alias("extra"),
            F.col("l_shipdate").cast("date").alias("fechaEmision"),
            money(F.col("l_extendedprice")).alias("importeTotal"))
        providers = self.table("supplier").select(
            F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("consorcioId"),
            F.col("s_name").alias("nombreEmpresaoPersona"))
        bill = bill_id(F.col("consorcioId"), dates.period(F.col("fechaEmision")))
        return lines.join(providers, "l_suppkey").withColumn("_bill", bill)

    def costs(self, billed: bool = True) -> DataFrame:
        """All costs in the shape of ``billing.combine_costs``, from one scan."""
        zero = F.lit(0).cast(MONEY)
        return self.cost_rows.select(
            (F.col("_bill") if billed else F.lit(None).cast("bigint")).alias("idExpensa"), "consorcioId",
            "fechaEmision",
            F.when(F.col("extra"), zero).otherwise(F.col("importeTotal")).alias("ordinario"),
            F.when(F.col("extra"), F.col("importeTotal")).otherwise(zero).alias("extraordinario"))

    def _invoice(self) -> Column:
        return text.zero_padded(F.col("l_orderkey"), 10)

    def ordinary(self, billed: bool = True) -> DataFrame:
        return self.cost_rows.where(~F.col("extra")).select(
            F.col("l_orderkey").alias("idGasto"),
            (F.col("_bill") if billed else F.lit(None).cast("bigint")).alias("idExpensa"), "consorcioId",
            "nombreEmpresaoPersona", self._invoice().alias("nroFactura"), "fechaEmision", "importeTotal",
            F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("detalle"),
            F.when(F.col("l_linestatus") == "O", "LIMPIEZA").otherwise("SEGUROS").alias("tipoServicio"))

    def extraordinary(self, billed: bool = True) -> DataFrame:
        whole = F.col("l_linestatus") == "O"
        return self.cost_rows.where("extra").select(
            F.col("l_orderkey").alias("idGasto"),
            (F.col("_bill") if billed else F.lit(None).cast("bigint")).alias("idExpensa"), "consorcioId",
            "nombreEmpresaoPersona", self._invoice().alias("nroFactura"), "fechaEmision", "importeTotal",
            F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("detalle"),
            whole.alias("esPagoTotal"), F.when(~whole, F.col("l_linenumber")).alias("nroCuota"),
            F.col("importeTotal").alias("totalCuota"))

    @cached_property
    def bills(self) -> DataFrame:
        """Bill headers without amounts: one per building and month."""
        first, last = self.months
        months = F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 month"))
        grid = self.buildings.select(F.col("id").alias("consorcioId"), F.explode(months).alias("periodo"))
        return grid.select(
            bill_id(F.col("consorcioId"), F.col("periodo")).alias("id"), "consorcioId",
            F.year("periodo").alias("fechaPeriodoAnio"), F.month("periodo").alias("fechaPeriodoMes"))

    @cached_property
    def order_weights(self) -> DataFrame:
        """Per order: ordinary, extraordinary and interest part of its lines."""
        price, tax = money(F.col("l_extendedprice")), F.col("l_tax").cast("decimal(4,2)")
        rows = self.table("lineitem").select(
            F.col("l_orderkey").alias("id"), (F.col("l_returnflag") == EXTRAORDINARY_FLAG).alias("extra"),
            price.alias("importe"), tax.alias("tasa"))
        extra, amount = F.col("extra"), F.col("importe")
        return rows.groupBy("id").agg(
            F.sum(F.when(~extra, amount)).cast(MONEY).alias("prorrateoOrdinario"),
            F.sum(F.when(extra, amount)).cast(MONEY).alias("prorrateoExtraordinario"),
            F.sum((amount * F.col("tasa")).cast(MONEY)).cast(MONEY).alias("interesMora"))

    @cached_property
    def lines(self) -> DataFrame:
        """Bill lines: one per order, charged with its weights, paid with its price."""
        order = self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("idUnidadFuncional"),
            F.col("o_orderdate").cast("date").alias("_dia"), money(F.col("o_totalprice")).alias("pagosRecibidos"))
        homes = self.table("customer").select(
            F.col("c_custkey").alias("idUnidadFuncional"), F.col("c_nationkey").cast("bigint").alias("_casa"))
        month = dates.period(F.col("_dia"))
        total = sum((F.coalesce(F.col(c), F.lit(0).cast(MONEY)) for c in (
            "prorrateoOrdinario", "prorrateoExtraordinario", "interesMora")), F.lit(0).cast(MONEY))
        return order.join(self.order_weights, "id", "left").join(homes, "idUnidadFuncional").select(
            "id", bill_id(F.col("_casa"), month).alias("expensaId"), "idUnidadFuncional",
            "prorrateoOrdinario", "prorrateoExtraordinario", "interesMora",
            total.cast(MONEY).alias("totalaPagar"), F.lit(0).cast(MONEY).alias("saldoAnteriorAbonado"),
            "pagosRecibidos", dates.due_date(month, dates.FIRST_DUE_DAY).alias("primerVencimiento"),
            dates.due_date(month, dates.SECOND_DUE_DAY).alias("segundoVencimiento"))

    @cached_property
    def unit_month_lines(self) -> DataFrame:
        """``lines`` added up to one line per unit and bill."""
        sums = ("prorrateoOrdinario", "prorrateoExtraordinario", "interesMora", "totalaPagar",
                "saldoAnteriorAbonado", "pagosRecibidos")
        return (
            self.lines.groupBy("idUnidadFuncional", "expensaId", "primerVencimiento", "segundoVencimiento")
            .agg(*[F.sum(c).cast(MONEY).alias(c) for c in sums])
            .withColumn("id", line_id(F.col("idUnidadFuncional"), dates.period(F.col("primerVencimiento")))))

    @cached_property
    def unit_month_applied(self) -> DataFrame:
        """Each payment on the ``unit_month_lines`` row of its own month."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("idPago"),
            line_id(F.col("o_custkey"), dates.period(F.col("o_orderdate"))).alias("idDetalleExpensa"),
            money(F.col("o_totalprice")).alias("importeAplicado"))

    @cached_property
    def applied(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("idPago"), F.col("o_orderkey").alias("idDetalleExpensa"),
            money(F.col("o_totalprice")).alias("importeAplicado"))

    @cached_property
    def paid(self) -> DataFrame:
        """Applied payments in the shape of ``reports.collections``, without line
        weights: an order is payment, application and line at once, so no join
        of orders with itself is needed."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("idPago"), F.col("o_custkey").alias("idUnidadFuncional"),
            F.col("o_orderdate").cast("timestamp").alias("fecha"),
            money(F.col("o_totalprice")).alias("importeAplicado"),
        ).join(self.units.select(F.col("id").alias("idUnidadFuncional"), "consorcioId", "departamento"),
               "idUnidadFuncional")

    @cached_property
    def weighted_paid(self) -> DataFrame:
        """``paid`` with the line weights of each payment."""
        return self.paid.join(self.order_weights.withColumnRenamed("id", "idPago"), "idPago", "left")
