"""Late payments and costs, broken runs and deliveries, and what an import reads."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duesflow import schemas
from duesflow.plans import delivery, runs
from duesflow.sources import sinks
from duesflow.sources.keyindex import KeyIndex

MONTHS = [dt.date(2025, m, 1) for m in (3, 4, 5)]


@pytest.fixture(scope="module")
def masters(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("masters"))
    rows = {
        "Consorcio": [(1, "One", "B1", "street", None), (2, "Two", "B2", "street", None)],
        "CuentaBancaria": [("B1", "One", 100), ("B2", "Two", 0)],
        "UnidadFuncional": [(i, f"U{i}", 1 + i % 2, "A", "1", i, 10, 20, None) for i in range(1, 7)],
    }
    for table, data in rows.items():
        df = spark.createDataFrame([tuple(str(v) if v is not None else None for v in r) for r in data],
                                   T.StructType([T.StructField(c, T.StringType()) for c in schemas.TABLES[table].schema.names]))
        sinks.replace_table(schemas.conform(df, table), f"{home}/{table}")
    return home


def facts_rows(spark):
    rng = random.Random(4)
    payments = [(100 + k, 1, f"U{1 + k % 6}", dt.datetime(2025, rng.choice([3, 4, 5]), rng.randrange(1, 28)), rng.randrange(500, 9000) / 100)
                for k in range(40)]
    costs = [(1 + k, None, 1 + k % 2, "firm", f"{k:010d}", dt.date(2025, 3 + k % 3, 5), 1000 + 7 * k, "x", "SEGUROS") for k in range(12)]

    def frame(table, data):
        ddl = schemas.TABLES[table].ddl.replace("decimal(18,2)", "double")
        return schemas.conform(spark.createDataFrame([tuple(float(v) if c.endswith("double") and v is not None else v
                                                            for v, c in zip(r, ddl.split(", "), strict=True)) for r in data], ddl), table)

    return frame("Pago", payments), frame("GastoOrdinario", costs)


def state(spark, facts):
    out = {}
    for table in ("Expensa", "DetalleExpensa", "PagoAplicado"):
        out[table] = sorted(tuple(r) for r in delivery._read(spark, facts, table).select(*schemas.TABLES[table].schema.names).collect())
    return out


def test_any_order_of_arrival_equals_one_run(spark, masters, tmp_path):
    payments, costs = facts_rows(spark)
    whole, late = str(tmp_path / "whole"), str(tmp_path / "late")
    for table, df in (("Pago", payments), ("GastoOrdinario", costs)):
        delivery.add_facts(df, whole, table)
    delivery.bill(spark, masters, whole, str(tmp_path / "w"), MONTHS[0], MONTHS[-1])
    # Each month's run sees a third of the rows, whatever their month.
    for k, month in enumerate(MONTHS):
        delivery.add_facts(payments.where(F.col("id") % 3 == (k + 1) % 3), late, "Pago")
        delivery.add_facts(costs.where(F.col("idGasto") % 3 == k), late, "GastoOrdinario")
        delivery.bill(spark, masters, late, str(tmp_path / f"l{k}"), month, month)
    assert state(spark, late) == state(spark, whole)
    accounts = [sorted(map(tuple, spark.read.parquet(str(tmp_path / n / "CuentaBancaria")).collect())) for n in ("w", "l2")]
    assert accounts[0] == accounts[1]
    spans = [(r.primero, r.ultimo) for r in runs.read_book(spark, late, "Corrida").collect()]
    assert set(spans) == {(MONTHS[0], m) for m in MONTHS}


def test_lines_are_written_once(spark, masters, tmp_path, monkeypatch):
    """Lines of the months billed go to their table, not through the work folder; payments are applied to the rows there."""
    payments, costs = facts_rows(spark)
    facts, kept, keep = str(tmp_path / "facts"), [], delivery.cut_lineage
    for table, df in (("Pago", payments), ("GastoOrdinario", costs)):
        delivery.add_facts(df, facts, table)
    monkeypatch.setattr(delivery, "cut_lineage", lambda df: kept.append(df.columns) or keep(df))
    delivery.bill(spark, masters, facts, str(tmp_path / "a"), MONTHS[0], MONTHS[1])
    assert kept and not [columns for columns in kept if "totalaPagar" in columns]
    lines, applied = (delivery._read(spark, facts, t) for t in ("DetalleExpensa", "PagoAplicado"))
    assert lines.count() == 12 and applied.join(lines, F.col("idDetalleExpensa") == F.col("id"), "left_anti").isEmpty()
    assert applied.count() == payments.where("month(fecha) in (4, 5)").count()


def test_costs_that_keep_their_bills_are_not_written_again(spark, masters, tmp_path):
    payments, costs = facts_rows(spark)
    facts = str(tmp_path / "facts")
    late = costs.where("idGasto = 5")
    delivery.add_facts(costs.where("idGasto <> 5"), facts, "GastoOrdinario")
    delivery.bill(spark, masters, facts, str(tmp_path / "a"), MONTHS[0], MONTHS[1])
    files = lambda: {m: sorted(f.name for f in (tmp_path / "facts/GastoOrdinario/anio=2025" / f"mes={m}").glob("*.parquet")) for m in (3, 4, 5)}
    before = files()
    delivery.add_facts(late, facts, "GastoOrdinario")
    delivery.add_facts(payments, facts, "Pago")
    delivery.bill(spark, masters, facts, str(tmp_path / "b"), MONTHS[1], MONTHS[1])
    after = files()
    assert [r.primero for r in runs.read_book(spark, facts, "Corrida").collect()] == [MONTHS[0]] * 2
    assert before[3] == after[3] and before[5] == after[5] and not set(before[4]) & set(after[4])
    got = {r.idGasto: r.idExpensa for r in delivery._read(spark, facts, "GastoOrdinario").collect()}
    want = {r.idGasto: r.consorcioId * 1_000_000 + 202_500 + r.fechaEmision.month if r.fechaEmision.month < 5 else None for r in costs.collect()}
    assert got == want


def test_broken_run_is_made_good(spark, masters, tmp_path, monkeypatch):
    payments, costs = facts_rows(spark)
    whole, facts = str(tmp_path / "whole"), str(tmp_path / "facts")
    for home in (whole, facts):
        for table, df in (("Pago", payments), ("GastoOrdinario", costs)):
            delivery.add_facts(df, home, table)
    delivery.bill(spark, masters, whole, str(tmp_path / "w"), MONTHS[0], MONTHS[1])
    delivery.bill(spark, masters, whole, str(tmp_path / "w2"), MONTHS[2], MONTHS[2])
    calls, write = [], sinks.overwrite_partitions

    def breaking(df, path, *rest):
        calls.append(path)
        if path.endswith("PagoAplicado"):
            raise RuntimeError("lost")
        write(df, path, *rest)

    monkeypatch.setattr(sinks, "overwrite_partitions", breaking)
    with pytest.raises(RuntimeError):
        delivery.bill(spark, masters, facts, str(tmp_path / "f"), MONTHS[0], MONTHS[1])
    monkeypatch.setattr(sinks, "overwrite_partitions", write)
    delivery.bill(spark, masters, facts, str(tmp_path / "f2"), MONTHS[2], MONTHS[2])
    assert state(spark, facts) == state(spark, whole)


def test_payments_are_compared_by_their_buckets(spark, tmp_path):
    facts = str(tmp_path / "facts")
    shape = schemas.PAYMENT_FILE

    def take(ids):
        rows = [(str(i), "05/04/2025", "U1", f"${i}.00") for i in ids]
        delivery._take_payments(spark, spark.createDataFrame(rows, shape), facts, 1, dt.date(2025, 6, 1))

    take([*range(1, 200), 7, 7])
    take([*range(150, 260), 150])
    paid = delivery._read(spark, facts, "Pago")
    assert sorted(r.id for r in paid.select("id").collect()) == list(range(1, 260))
    counts = sorted((r.leidas, r.validas, r.repetidas, r.nuevas) for r in runs.import_counts(spark, facts).collect())
    assert counts == [(111, 111, 51, 60), (201, 201, 2, 199)]
    keys = delivery._payment_keys(spark, facts)
    drop = spark.createDataFrame([(5,), (300,)], "id long")
    plan = keys.absent(drop)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cubo#" in plan and "facts/Pago/" not in plan and "facts/Pago]" not in plan
    assert [r.id for r in keys.absent(drop).collect()] == [300]
    assert len(keys.known(drop).select("cubo").distinct().collect()) <= 2


def test_broken_delivery_is_not_added_twice(spark, tmp_path, monkeypatch):
    facts = str(tmp_path / "facts")
    raw = spark.createDataFrame([(str(i), "05/04/2025", "U1", "$1.00") for i in range(20)], schemas.PAYMENT_FILE)
    take = lambda: delivery._take_payments(spark, raw, facts, 1, dt.date(2025, 6, 1))
    first = raw.where("idPago < 5")
    delivery._take_payments(spark, first, facts, 1, dt.date(2025, 6, 1))
    add = KeyIndex.add
    monkeypatch.setattr(KeyIndex, "add", lambda self, rows, batch: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        take()
    monkeypatch.setattr(KeyIndex, "add", add)
    take()
    assert sorted(r.id for r in delivery._read(spark, facts, "Pago").select("id").collect()) == list(range(20))


def test_index_batch_replaces_itself(spark, tmp_path):
    keys = KeyIndex(spark, str(tmp_path / "keys"), [T.StructField("k", T.StringType())], buckets=4)
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert keys.read() is None and keys.absent(rows).count() == 3
    keys.add(rows, "one")
    keys.add(rows, "one")
    assert keys.read().count() == 3
    assert [r.k for r in keys.absent(rows).collect()] == [None]
    assert keys.absent(rows, before="one").count() == 3
