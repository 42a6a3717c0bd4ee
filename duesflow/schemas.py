"""Column types of the fourteen ledger tables and of the input files.

Each ledger table carries its data rules (required, unique, references,
text widths, sizes of amounts) so that ``operators.quality`` can check them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    ddl: str
    required: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    widths: dict[str, int] = field(default_factory=dict)
    # Amounts whose whole part may have eight digits at most.
    small: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


# Names and types of the ledger columns. Row ids are bigint here.
TABLES: dict[str, Table] = {
    "TipoRol": Table(
        "idTipoRol int, nombre string, descripcion string",
        required=("nombre",),
        unique=(("idTipoRol",), ("nombre",)),
        widths={"nombre": 50, "descripcion": 200},
    ),
    "CuentaBancaria": Table(
        "CVU_CBU string, nombreTitular string, saldo decimal(18,2)",
        required=("CVU_CBU",),
        unique=(("CVU_CBU",),),
        widths={"CVU_CBU": 22, "nombreTitular": 50},
        small=("saldo",),
    ),
    "FormaDePago": Table(
        "idFormaPago int, descripcion string, confirmacion string",
        required=("descripcion",),
        unique=(("idFormaPago",),),
        widths={"descripcion": 50, "confirmacion": 20},
    ),
    "Persona": Table(
        "idPersona bigint, nombre string, apellido string, dni string, email string, "
        "CVU_CBU string, telefono string, idTipoRol int",
        required=("nombre", "apellido", "dni", "idTipoRol"),
        unique=(("idPersona",), ("CVU_CBU",)),
        references={"idTipoRol": ("TipoRol", "idTipoRol")},
        widths={"nombre": 100, "apellido": 100, "dni": 8, "email": 150, "CVU_CBU": 22, "telefono": 15},
    ),
    "Consorcio": Table(
        "id bigint, nombre string, CVU_CBU string, direccion string, "
        "metrosCuadradosTotal decimal(10,2)",
        required=("nombre", "direccion"),
        unique=(("id",),),
        references={"CVU_CBU": ("CuentaBancaria", "CVU_CBU")},
        widths={"nombre": 100, "CVU_CBU": 22, "direccion": 200},
    ),
    "Pago": Table(
        "id bigint, idFormaPago int, cbuCuentaOrigen string, fecha timestamp, importe decimal(18,2)",
        required=("idFormaPago", "cbuCuentaOrigen", "fecha", "importe"),
        unique=(("id",),),
        references={"idFormaPago": ("FormaDePago", "idFormaPago")},
        widths={"cbuCuentaOrigen": 50},
    ),
    "UnidadFuncional": Table(
        "id bigint, CVU_CBU string, consorcioId bigint, departamento string, piso string, "
        "numero int, metrosCuadrados decimal(10,2), porcentajeExpensas decimal(5,2), tipo string",
        required=("CVU_CBU", "consorcioId"),
        unique=(("id",),),
        references={"CVU_CBU": ("Persona", "CVU_CBU"), "consorcioId": ("Consorcio", "id")},
        widths={"CVU_CBU": 22, "departamento": 1, "piso": 4, "tipo": 50},
    ),
    "Expensa": Table(
        "id bigint, consorcioId bigint, saldoAnterior decimal(18,2), ingresosEnTermino decimal(18,2), "
        "ingresosAdeudados decimal(18,2), ingresosAdelantados decimal(18,2), egresos decimal(18,2), "
        "saldoCierre decimal(18,2), fechaPeriodoAnio int, fechaPeriodoMes int",
        unique=(("id",), ("consorcioId", "fechaPeriodoAnio", "fechaPeriodoMes")),
        references={"consorcioId": ("Consorcio", "id")},
        small=("saldoAnterior", "ingresosEnTermino", "ingresosAdeudados", "ingresosAdelantados", "egresos",
               "saldoCierre"),
    ),
    "Cochera": Table(
        "id bigint, unidadFuncionalId bigint, numero int, porcentajeExpensas decimal(5,2)",
        required=("numero", "porcentajeExpensas"),
        unique=(("id",),),
        references={"unidadFuncionalId": ("UnidadFuncional", "id")},
    ),
    "Baulera": Table(
        "id bigint, unidadFuncionalId bigint, numero int, porcentajeExpensas decimal(5,2)",
        required=("numero", "porcentajeExpensas"),
        unique=(("id",),),
        references={"unidadFuncionalId": ("UnidadFuncional", "id")},
    ),
    "GastoOrdinario": Table(
        "idGasto bigint, idExpensa bigint, consorcioId bigint, nombreEmpresaoPersona string, "
        "nroFactura string, fechaEmision date, importeTotal decimal(18,2), detalle string, "
        "tipoServicio string",
        required=("nroFactura", "importeTotal"),
        unique=(("idGasto",), ("nroFactura",)),
        references={"idExpensa": ("Expensa", "id"), "consorcioId": ("Consorcio", "id")},
        widths={"nombreEmpresaoPersona": 200, "nroFactura": 10, "detalle": 500, "tipoServicio": 50},
    ),
    "GastoExtraordinario": Table(
        "idGasto bigint, idExpensa bigint, consorcioId bigint, nombreEmpresaoPersona string, "
        "nroFactura string, fechaEmision date, importeTotal decimal(18,2), detalle string, "
        "esPagoTotal boolean, nroCuota int, totalCuota decimal(18,2)",
        required=("importeTotal", "esPagoTotal", "totalCuota"),
        unique=(("idGasto",),),
        references={"idExpensa": ("Expensa", "id"), "consorcioId": ("Consorcio", "id")},
        widths={"nombreEmpresaoPersona": 200, "nroFactura": 50, "detalle": 500},
    ),
    "DetalleExpensa": Table(
        "id bigint, expensaId bigint, idUnidadFuncional bigint, prorrateoOrdinario decimal(18,2), "
        "prorrateoExtraordinario decimal(18,2), interesMora decimal(18,2), totalaPagar decimal(18,2), "
        "saldoAnteriorAbonado decimal(18,2), pagosRecibidos decimal(18,2), primerVencimiento date, "
        "segundoVencimiento date",
        unique=(("id",),),
        references={"expensaId": ("Expensa", "id"), "idUnidadFuncional": ("UnidadFuncional", "id")},
        small=("prorrateoOrdinario", "prorrateoExtraordinario", "interesMora", "totalaPagar",
               "saldoAnteriorAbonado", "pagosRecibidos"),
    ),
    "PagoAplicado": Table(
        "idPago bigint, idDetalleExpensa bigint, importeAplicado decimal(18,2)",
        required=("idPago", "idDetalleExpensa", "importeAplicado"),
        unique=(("idPago", "idDetalleExpensa"),),
        references={"idPago": ("Pago", "id"), "idDetalleExpensa": ("DetalleExpensa", "id")},
    ),
}

# Columns of the input files, all read as text.
PAYMENT_FILE = "idPago string, fecha string, CVU_CBU string, valor string"
BUILDING_FILE = "consorcio string, nombre string, direccion string, cantUnidades string, superficie string"
PERSON_FILE = (
    "nombre string, apellido string, dni string, email string, telefono string, "
    "CVU_CBU string, tipo string"
)
PROVIDER_FILE = (
    "tipoGasto string, empresaDetalle string, detalleAdicional string, nombreConsorcio string"
)
UNIT_OWNER_FILE = (
    "CVU_CBU string, nombreConsorcio string, numero string, piso string, departamento string"
)
UNIT_FILE = (
    "nombreConsorcio string, nroUnidadFuncional string, piso string, departamento string, "
    "coeficiente string, m2 string, bauleras string, cochera string, m2_baulera string, "
    "m2_cochera string"
)
# Keys of the monthly cost documents.
COST_CATEGORIES = (
    "BANCARIOS", "LIMPIEZA", "ADMINISTRACION", "SEGUROS", "GASTOS GENERALES",
    "SERVICIOS PUBLICOS-Agua", "SERVICIOS PUBLICOS-Luz",
)
COST_FILE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("Nombre del consorcio", "Mes", *COST_CATEGORIES)]
)


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table].schema)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Exactly the columns of a ledger table, in order and type; absent ones NULL."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[table].schema
        ]
    )
