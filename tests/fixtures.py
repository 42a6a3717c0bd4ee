"""Input files of one delivery, with invented people and accounts."""

from __future__ import annotations

import json
import os

BUILDINGS = (
    ("Consorcio 1", "Azcuenaga", "Belgrano 3344", 30, 1281),
    ("Consorcio 2", "Alzaga", "Callao 1122", 20, 914),
    ("Consorcio 3", "Alberdi", "Santa Fe 910", 20, 784),
    ("Consorcio 4", "Unzue", "Corrientes 5678", 25, 1316),
    ("Consorcio 5", "Pereyra Iraola", "Rivadavia 1234", 40, 1691),
)
# Bank fees, cleaning, administration and insurance per month.
SHARED_COSTS = {
    "abril": ("22,648.59", "120,000.00", "200,000.00", "33.706,04"),
    "mayo ": ("22,648.59", "120,000.00", "200,000.00", "34,677.00"),
    "junio": ("22,648.59", "127,080,00", "211,800,00", "37.730,00"),
}
# General costs, water and power per building and month.
OWN_COSTS = {
    ("Azcuenaga", "abril"): ("9.344,32", "482.925,88", "532.116,75"),
    ("Azcuenaga", "mayo "): ("9.613,50", "496.837,32", "547.445,22"),
    ("Azcuenaga", "junio"): ("0,00", "526.150,72", "579.744,49"),
    ("Alzaga", "abril"): ("14.256,21", "521.258,32", "658.741,25"),
    ("Alzaga", "mayo "): ("0,00", "485.985,36", "654.582,32"),
    ("Alzaga", "junio"): ("0,00", "478.859,45", "658.741,65"),
    ("Alberdi", "abril"): ("0,00", "352.256,25", "458.965,32"),
    ("Alberdi", "mayo "): ("12.365,23", "358.145,25", "458.745,32"),
    ("Alberdi", "junio"): ("0,00", "658.741,29", "587.985,16"),
    ("Unzue", "abril"): ("22.000,00", "455.748,65", "657.415,25"),
    ("Unzue", "mayo "): ("0,00", "658.147,12", "475.895,42"),
    ("Unzue", "junio"): ("0,00", "574.154,98", "658.325,21"),
    ("Pereyra Iraola", "abril"): ("0,00", "585.589,14", "458.365,32"),
    ("Pereyra Iraola", "mayo "): ("15.321,25", "587.758,14", "647.589,23"),
    ("Pereyra Iraola", "junio"): ("0,00", "458.752,31", "658.987,23"),
}
# Surviving cost rows and their sum, per building for April, May, June.
SURVIVING = {
    "Azcuenaga": ((7, "1058435.64"), (7, "1054273.37"), (4, "1143647.86")),
    "Alzaga": ((7, "1228304.47"), (6, "1140945.01"), (4, "1175353.75")),
    "Alberdi": ((6, "845270.26"), (7, "829633.13"), (4, "1284479.10")),
    "Unzue": ((7, "1169212.59"), (6, "1134419.87"), (4, "1270232.84")),
    "Pereyra Iraola": ((6, "1078003.15"), (7, "1251045.95"), (4, "1155492.19")),
}
FLOORS, DOORS = ("PB", "1", "2", "3", "4", "5", "6", "7"), "ABCDE"


def account(building: int, unit: int) -> str:
    return f"{7000000000 + building * 1000 + unit:010d}{'0' * 12}"


def _write(folder: str, name: str, text: str, encoding: str = "utf-8") -> str:
    path = os.path.join(folder, name)
    with open(path, "w", encoding=encoding, newline="") as out:
        out.write(text)
    return path


def write_all(folder: str) -> dict[str, str]:
    """All seven files; returns their paths by kind."""
    units = [(b, u) for b, row in enumerate(BUILDINGS, 1) for u in range(1, row[3] + 1)]
    paths = {}
    paths["buildings"] = _write(folder, "buildings.csv", "Consorcio,Nombre,Domicilio,Cant,m2\n" + "\n".join(
        ",".join(map(str, row)) for row in BUILDINGS))
    paths["unit_owners"] = _write(folder, "owners.csv", "CVU/CBU|consorcio|nro|piso|departamento\n" + "".join(
        f"{account(b, u)}|{BUILDINGS[b - 1][1]}|{u}|{FLOORS[(u - 1) // 5]}|{DOORS[(u - 1) % 5]}\n" for b, u in units))
    people = [f"Ana{u} ;Río{b};{10000000 + b * 1000 + u};ana {u}.{b}@example.com ;11{b:02d}{u:04d};{account(b, u)};{u % 2}\n"
              for b, u in units]
    people += ["Twin;A;1;t@example.com;1;9999999999999999999999;1\n", "Twin;B;2;t@example.com;2;9999999999999999999999;0\n",
               "No;O’Hara;3;n@example.com;3;;1\n", ";;;;;;\n"]
    paths["people"] = _write(folder, "people.csv", "Nombre;apellido;DNI;email;telefono;CVU/CBU;Inquilino\n" + "".join(people),
                             "windows-1252")
    paths["units"] = _write(folder, "units.txt", "\t".join(
        ("consorcio", "nro", "piso", "departamento", "coeficiente", "m2", "bauleras", "cochera", "m2b", "m2c")) + "\n" + "".join(
        "\t".join((BUILDINGS[b - 1][1], str(u), "x", "x", f"{100 / BUILDINGS[b - 1][3]:.2f}".replace(".", ","), "42,5",
                   "SI", "NO", "5", "0")) + "\n" for b, u in units)
        + "\t1\tx\tx\t1\t1\t\t\t\t\nNuevo\t1\tPB\tA\t100,0\t50\tSI\tSI\t1\t1\n")
    rows = []
    for _, name, *_rest in BUILDINGS:
        utility = [("SERVICIOS PUBLICOS", "AYSA ", f"Cuenta {len(name)}"), ("SERVICIOS PUBLICOS", "EDENOR", "cuenta 9")]
        known = [("GASTOS BANCARIOS", "BANCO UNO - Gastos bancario", ""), ("GASTOS DE ADMINISTRACION", "Ana Gil - Honorarios", ""),
                 ("SEGUROS", "SEGUROS DOS - Integral de consorcio", ""), ("GASTOS DE LIMPIEZA", "Serv. Limpieza", "Limpia " + name)]
        rows += [";".join((*r, name)) for r in (known if name != "Alberdi" else known[2:]) + utility]
    paths["providers"] = _write(folder, "providers.csv", "﻿;;;Nombre del consorcio\n" + "\n".join(rows) + "\n")
    costs = []
    for (name, month), own in OWN_COSTS.items():
        bank, clean, admin, insurance = SHARED_COSTS[month]
        costs.append({
            "_id": {"$oid": f"{name}-{month}"}, "Nombre del consorcio": name, "Mes": month, "BANCARIOS": bank,
            "LIMPIEZA": clean, "ADMINISTRACION": admin, "SEGUROS": insurance, "GASTOS GENERALES": own[0],
            "SERVICIOS PUBLICOS-Agua": own[1], "SERVICIOS PUBLICOS-Luz": own[2]})
    costs.append({"_id": {"$oid": "last"}})
    paths["costs"] = _write(folder, "costs.json", json.dumps(costs, indent=2))
    paths["payments"] = _write(folder, "payments.csv", "Id de pago,fecha,CVU/CBU,Valor\n" + "".join(
        f"{b * 10000 + u * 10 + m},{5 + u % 20:02d}/{m:02d}/2025,{account(b, u)},${1000 * m + u}.50\n"
        for b, u in units for m in (4, 5, 6, 7)) + ",,,\n")
    return paths
