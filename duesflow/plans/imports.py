"""Monthly imports: raw file rows in, new or updated ledger rows out.

Importing the same file again adds nothing: rows whose natural key is in the
ledger are dropped by an anti join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duesflow.functions import amounts, dates, picks, text
from duesflow.operators import upsert
from duesflow.operators.numbering import id_bucket, number_rows, prefix_buckets
from duesflow.schemas import COST_CATEGORIES, conform

# Roles by the tenant flag of the people file.
TENANT_ROLE, OWNER_ROLE = 1, 2

# Provider categories by prefix of the provider file's text.
CATEGORY_PREFIXES = (
    ("GASTOS BANCARIOS", "BANCARIOS"),
    ("GASTOS DE ADMINISTRACION", "ADMINISTRACION"),
    ("GASTOS DE LIMPIEZA", "LIMPIEZA"),
    ("SEGUROS", "SEGUROS"),
    ("SERVICIOS PUBLICOS", "SERVICIOS PUBLICOS"),
)
UTILITY_CATEGORY = "SERVICIOS PUBLICOS"
UTILITY_COMPANIES = ("AYSA", "EDENOR")
GENERAL_CATEGORY = "GASTOS GENERALES"
UNKNOWN_ADDRESS = "Dirección desconocida"
UNIT_KINDS = ("local", "departamento", "duplex")


def default_method(methods: DataFrame) -> DataFrame:
    """The payment method with the lowest id, as a one-row table."""
    return methods.agg(F.min("idFormaPago").alias("idFormaPago"))


def clean_payments(raw: DataFrame, method: int | Column, as_of=None) -> DataFrame:
    """Raw payment rows as Pago rows: rows without a number are dropped, a
    missing date becomes the day of the import."""
    paid_on = F.coalesce(dates.parse_dmy(F.col("fecha")), dates.as_of_date(as_of))
    rows = upsert.drop_empty_rows(raw).select(
        F.trim("idPago").try_cast("bigint").alias("id"),
        (F.lit(method) if isinstance(method, int) else method).cast("int").alias("idFormaPago"),
        F.trim("CVU_CBU").alias("cbuCuentaOrigen"),
        paid_on.cast("timestamp").alias("fecha"),
        amounts.parse_currency(F.col("valor")).alias("importe"),
    )
    return conform(rows.where(F.col("id").isNotNull()), "Pago")


def one_per_number(cleaned: DataFrame) -> DataFrame:
    """One row per payment number: the earliest, then the smallest account and amount."""
    return upsert.keep_one(cleaned, ["id"], ["fecha", "cbuCuentaOrigen", "importe"])


def import_payments(raw: DataFrame, payments: DataFrame, method: int | Column, as_of=None) -> DataFrame:
    """New Pago rows; the file's payment number is the key."""
    return upsert.absent(one_per_number(clean_payments(raw, method, as_of)), payments, ["id"])


def parse_costs(raw: DataFrame, as_of=None, style: str = "reference") -> DataFrame:
    """Cost documents as (nombreConsorcio, mes, tipoServicio, importe) with
    positive amounts only; an unknown month counts as the month of the import."""
    this_month = F.month(dates.as_of_date(as_of))
    # Parsed before the columns become rows: the filter on the amount then reads
    # a value instead of parsing each text once more.
    parsed = raw.select(
        F.col("`Nombre del consorcio`").alias("nombreConsorcio"),
        dates.month_number(F.col("Mes"), this_month).alias("mes"),
        *[amounts.parse_amount(F.col(f"`{c}`"), style).alias(c) for c in COST_CATEGORIES],
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("tipoServicio"), F.col(f"`{c}`").alias("importe"))
                      for c in COST_CATEGORIES])
    return parsed.select("nombreConsorcio", "mes", F.inline(pairs)).where(F.col("importe") > 0)


def invoice_number(building: Column, period: Column, counter: Column, style: str = "running") -> Column:
    """Ten digits. ``running`` is the counter itself; ``reference`` is building (3), year and
    month (4) and counter (3). A part that does not fit raises, so that no number repeats."""
    if style not in ("running", "reference"):
        raise ValueError(f"style must be running or reference, not {style}")

    def digits(value: Column, width: int) -> Column:
        fits = (value >= 0) & (value < 10**width)
        too_long = F.raise_error(F.concat(value.cast("string"), F.lit(f" has more than {width} digits")))
        return F.when(value.isNull() | fits, text.zero_padded(value, width)).otherwise(too_long.cast("string"))

    if style == "running":
        return digits(counter, 10)
    return F.concat(digits(building, 3), F.date_format(period, "yyMM"), digits(counter, 3))


def import_costs(raw: DataFrame, buildings: DataFrame, ordinary: DataFrame, year: int,
                 last_number: int = 0, as_of=None, style: str = "reference",
                 invoices: str = "running") -> DataFrame:
    """New GastoOrdinario rows, numbered after ``last_number`` by building,
    month and category. Costs of a building, month and category that the ledger
    already has are not added again. Runs a job (see ``number_rows``)."""
    return number_costs(parse_costs(raw, as_of, style), buildings, ordinary, year, last_number, invoices)


def number_costs(parsed: DataFrame, buildings: DataFrame, ordinary: DataFrame, year: int, last_number: int = 0,
                 invoices: str = "running") -> DataFrame:
    """``import_costs`` over rows of ``parse_costs``. ``ordinary`` may be cut to the costs of ``year``."""
    costs = parsed.join(
        buildings.select(F.col("id").alias("consorcioId"), F.trim("nombre").alias("nombreConsorcio")),
        "nombreConsorcio",
    ).select(
        "consorcioId", dates.period_of(F.lit(year), F.col("mes")).alias("fechaEmision"),
        "tipoServicio", F.col("importe").alias("importeTotal"))
    # A provider match renames the utility categories, so compare by prefix.
    prefix = F.when(F.col("tipoServicio").startswith(UTILITY_CATEGORY), F.lit(UTILITY_CATEGORY)).otherwise(
        F.col("tipoServicio")).alias("_tipo")
    keys = ["consorcioId", "fechaEmision", "_tipo", "importeTotal"]
    fresh = upsert.absent(costs.select("*", prefix), ordinary.select("*", prefix), keys).drop("_tipo")
    numbered = number_rows(
        fresh, "idGasto", ["consorcioId", "fechaEmision", "tipoServicio", "importeTotal"],
        [id_bucket(F.col("consorcioId"), 4096), F.col("consorcioId"), F.struct("fechaEmision", "tipoServicio", F.floor(F.col("importeTotal") / 100))],
        store=True)
    counter = F.col("idGasto") + F.lit(last_number)
    return conform(numbered.withColumns({
        "idGasto": counter,
        "nroFactura": invoice_number(F.col("consorcioId"), F.col("fechaEmision"), counter, invoices),
    }), "GastoOrdinario")


def import_people(raw: DataFrame, people: DataFrame, last_id: int = 0) -> DataFrame:
    """New Persona rows. Accounts that occur more than once are dropped
    altogether; rows without an account stay."""
    kept = upsert.drop_duplicate_groups(upsert.drop_empty_rows(raw).withColumn(
        "CVU_CBU", F.trim("CVU_CBU")), ["CVU_CBU"])
    cleaned = kept.select(
        F.trim("nombre").alias("nombre"), F.trim("apellido").alias("apellido"),
        F.trim("dni").try_cast("bigint").cast("string").alias("dni"),
        text.strip_blanks(F.col("email")).alias("email"), "CVU_CBU",
        F.trim("telefono").try_cast("bigint").cast("string").alias("telefono"),
        F.when(F.trim("tipo") == "1", TENANT_ROLE).when(F.trim("tipo") == "0", OWNER_ROLE).alias("idTipoRol"),
    )
    fresh = upsert.absent(cleaned, people, ["dni", "CVU_CBU"])
    # Rows without an account are cut by dni instead: there may be many of them.
    number = F.col("dni").cast("bigint")
    numbered = number_rows(
        fresh, "idPersona", ["CVU_CBU", number, "apellido", "nombre"],
        [*prefix_buckets(F.col("CVU_CBU")), F.when(F.col("CVU_CBU").isNull(), F.floor(number / 10000))], store=True)
    return conform(numbered.withColumn("idPersona", F.col("idPersona") + last_id), "Persona")


def _new_buildings(rows: DataFrame, last_id: int) -> DataFrame:
    numbered = number_rows(rows, "id", ["_orden", "nombre"], prefix_buckets(F.col("_orden")))
    return conform(numbered.withColumn("id", F.col("id") + last_id), "Consorcio")


def import_buildings(raw: DataFrame, buildings: DataFrame, last_id: int = 0) -> DataFrame:
    """The Consorcio table with addresses and areas updated by name and unknown
    names added, numbered in the order of the file's first column."""
    named = raw.where(F.trim("nombre") != "").select(
        F.coalesce("consorcio", F.lit("")).alias("_orden"), F.trim("nombre").alias("nombre"), "direccion",
        F.trim("superficie").try_cast("decimal(10,2)").alias("metrosCuadradosTotal"),
    )
    rows = upsert.keep_one(named, ["nombre"], ["_orden", "direccion"]).withColumn("_clave", F.col("nombre"))
    updated = upsert.fill(buildings.withColumn("_clave", F.trim("nombre")), rows, ["_clave"],
                          ["direccion", "metrosCuadradosTotal"], prefer="new").drop("_clave")
    return updated.unionByName(_new_buildings(upsert.absent(rows, buildings, ["nombre"], F.trim), last_id))


def import_unit_owners(raw: DataFrame, buildings: DataFrame, units: DataFrame, last_id: int = 0) -> DataFrame:
    """New UnidadFuncional rows for accounts without a unit. An unknown building
    name leaves the building NULL."""
    rows = raw.select(
        F.trim("CVU_CBU").alias("CVU_CBU"), F.trim("nombreConsorcio").alias("nombreConsorcio"),
        F.trim("numero").try_cast("int").alias("numero"), text.fixed_width(F.col("piso"), 4).alias("piso"),
        F.trim("departamento").alias("departamento"))
    names = buildings.select(F.col("id").alias("consorcioId"), F.trim("nombre").alias("nombreConsorcio"))
    fresh = upsert.absent(rows, units, ["CVU_CBU"]).join(names, "nombreConsorcio", "left")
    order = ["consorcioId", "numero", "CVU_CBU"]
    # Rows of unknown buildings may be many: they are cut further, by number and account.
    unknown = [F.when(F.col("consorcioId").isNull(), c) for c in (F.col("numero"), *prefix_buckets(F.col("CVU_CBU")))]
    numbered = number_rows(fresh, "id", order, [F.col("consorcioId"), F.floor(F.col("numero") / 1024), *unknown],
                           store=True)
    return conform(numbered.withColumn("id", F.col("id") + last_id), "UnidadFuncional")


def import_units(raw: DataFrame, buildings: DataFrame, units: DataFrame, last_building: int = 0,
                 seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(buildings, units): unknown buildings added, and area, percentage and kind
    of each listed unit filled in where they are NULL."""
    listed = raw.where((F.trim("nombreConsorcio") != "") & (F.trim("nroUnidadFuncional") != "")).withColumn(
        "nombre", F.trim("nombreConsorcio"))
    unknown = upsert.absent(listed.select("nombre").distinct(), buildings, ["nombre"], F.trim)
    added = _new_buildings(unknown.withColumns({"_orden": F.col("nombre"), "direccion": F.lit(UNKNOWN_ADDRESS)}),
                           last_building)
    all_buildings = buildings.unionByName(added)
    values = listed.join(all_buildings.select(F.col("id").alias("consorcioId"), F.trim("nombre").alias("nombre")),
                         "nombre").select(
        "consorcioId", F.trim("nroUnidadFuncional").try_cast("int").alias("numero"),
        amounts.parse_comma_decimal(F.col("coeficiente"), "decimal(5,2)").alias("porcentajeExpensas"),
        amounts.parse_comma_decimal(F.col("m2"), "decimal(10,2)").alias("metrosCuadrados"))
    kind = picks.pick(F.col("consorcioId") * 100003 + F.col("numero"), seed, UNIT_KINDS)
    one = upsert.keep_one(values, ["consorcioId", "numero"], ["porcentajeExpensas", "metrosCuadrados"])
    filled = upsert.fill(units, one.withColumn("tipo", kind), ["consorcioId", "numero"],
                         ["metrosCuadrados", "porcentajeExpensas", "tipo"])
    return all_buildings, filled


def category(kind: Column) -> Column:
    """Provider category by prefix of the provider file's text; the text itself if none fits."""
    upper = text.key(kind)
    out = None
    for prefix, name in CATEGORY_PREFIXES:
        test = upper.startswith(prefix)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(upper)


def clean_providers(raw: DataFrame) -> DataFrame:
    """(nombreConsorcio, categoria, empresa, detalle, servicio) per provider row."""
    company = F.col("empresaDetalle")
    return raw.select(
        F.trim("nombreConsorcio").alias("nombreConsorcio"),
        category(F.col("tipoGasto")).alias("categoria"),
        text.before_dash(company).alias("empresa"),
        F.coalesce(text.blank_to_null(F.col("detalleAdicional")),
                   F.nullif(text.after_dash(company), F.lit(""))).alias("detalle"),
        F.when(text.key(company).isin(*UTILITY_COMPANIES), UTILITY_CATEGORY).alias("servicio"),
    )


def cost_category(kind: Column) -> Column:
    """The category a cost belongs to: the known category its text starts with."""
    upper = text.key(kind)
    out = upper
    for _, name in CATEGORY_PREFIXES:
        out = F.when(upper.startswith(name), name).otherwise(out)
    return out


def import_providers(raw: DataFrame, buildings: DataFrame, ordinary: DataFrame,
                     match_building: bool = True) -> DataFrame:
    """Ordinary costs with company, detail and category filled from the providers.

    Only costs without a detail that are no general costs take part. The prefix
    match becomes an equi join on the derived category. Of several providers
    the first by company and detail wins; ``match_building=False`` lets a
    provider of any building win.
    """
    providers = clean_providers(raw).join(
        buildings.select(F.col("id").alias("consorcioId"), F.trim("nombre").alias("nombreConsorcio")),
        "nombreConsorcio")
    keys = ["consorcioId", "_categoria"] if match_building else ["_categoria"]
    first = upsert.keep_one(providers.withColumnRenamed("categoria", "_categoria"), keys,
                            ["empresa", "detalle"]).select(*keys, "empresa", F.col("detalle").alias("_detalle"),
                                                           "servicio")
    open_ = text.blank_to_null(F.col("detalle")).isNull() & (F.col("tipoServicio") != GENERAL_CATEGORY)
    tagged = ordinary.withColumn("_categoria", F.when(open_, cost_category(F.col("tipoServicio"))))
    joined = tagged.join(first.withColumn("_hit", F.lit(True)), keys, "left")
    hit = F.col("_hit").isNotNull()
    return joined.withColumns({
        "nombreEmpresaoPersona": F.when(hit, F.col("empresa")).otherwise(F.col("nombreEmpresaoPersona")),
        "detalle": F.when(hit, F.col("_detalle")).otherwise(F.col("detalle")),
        "tipoServicio": F.coalesce(F.when(hit, F.col("servicio")), "tipoServicio"),
    }).select(*ordinary.columns)
