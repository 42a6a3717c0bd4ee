from __future__ import annotations

import hashlib
import hmac
import os
from decimal import Decimal

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duesflow import schemas
from duesflow.functions import dates
from duesflow.operators import protect, quality, share, upsert
from duesflow.operators.numbering import id_bucket, number_rows, prefix_buckets
from duesflow.sources import sinks


def test_number_rows_equals_row_number_with_a_hot_partition(spark):
    rows = spark.range(20000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.when(F.col("id") < 9000, 1).otherwise(
            (F.col("id") % 7).cast("int"))).alias("p"))
    got = number_rows(rows, "n", ["id"], id_bucket(F.col("id"), 500), ["p"])
    want = rows.withColumn("n", F.row_number().over(W.partitionBy("p").orderBy("id")))
    assert got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == 20000


def test_number_rows_with_nested_cuts(spark):
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("k")).unionByName(
        spark.range(1).select(F.lit(None).cast("string").alias("k")))
    got = number_rows(rows, "n", ["k"], prefix_buckets(F.col("k"), 1, 3))
    want = rows.withColumn("n", F.row_number().over(W.orderBy("k")))
    assert got.exceptAll(want).isEmpty() and got.count() == 5001


def test_number_rows_never_gathers_a_partition(spark):
    rows = spark.range(4096).withColumn("p", F.lit(1))
    got = number_rows(rows, "n", ["id"], id_bucket(F.col("id"), 256), ["p"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("_local")[0]
    assert {r.n for r in got.collect()} == set(range(1, 4097))


def test_stored_numbering_evaluates_its_input_once(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("p")).write.parquet(path)
    rows = spark.read.parquet(path)
    watched, watch = sinks.counted(rows)
    got = number_rows(watched, "n", ["id"], id_bucket(F.col("id"), 500), ["p"], store=True)
    assert sinks.rows_counted(watch) == 5000
    assert path not in got._jdf.queryExecution().executedPlan().toString()
    want = rows.withColumn("n", F.row_number().over(W.partitionBy("p").orderBy("id")))
    assert got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == 5000
    none = number_rows(rows.where("id < 0"), "n", ["id"], id_bucket(F.col("id")), ["p"], store=True)
    assert none.isEmpty()


def test_stored_numbering_takes_more_tasks_for_more_rows(spark, monkeypatch):
    from duesflow.operators import numbering

    monkeypatch.setattr(numbering, "ROWS_PER_TASK", 10)
    rows = spark.range(2000).select("id", (F.col("id") % 3).alias("p"))
    got = number_rows(rows, "n", ["id"], id_bucket(F.col("id"), 5), ["p"], store=True)
    assert ", 200), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    want = rows.withColumn("n", F.row_number().over(W.partitionBy("p").orderBy("id")))
    assert got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == 2000


def test_absent_keeps_null_keys_and_normalises(spark):
    new = spark.createDataFrame([(" A ",), ("b",), (None,)], "k string")
    old = spark.createDataFrame([("a",), (None,)], "n string")
    assert [r.k for r in upsert.absent(new, old, {"k": "n"}, lambda c: F.upper(F.trim(c))).collect()] in (
        ["b", None], [None, "b"])


def test_drop_duplicate_groups_drops_every_member(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), (None, 4), (None, 5)], "k string, v int")
    assert sorted(r.v for r in upsert.drop_duplicate_groups(df, ["k"]).collect()) == [3, 4, 5]


def test_fill_prefers_old_or_new(spark):
    target = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    update = spark.createDataFrame([(1, "n"), (2, "m"), (3, None)], "k int, v string")
    old = dict(upsert.fill(target, update, ["k"], ["v"]).collect())
    new = dict(upsert.fill(target, update, ["k"], ["v"], prefer="new").collect())
    assert old == {1: "a", 2: "m", 3: "c"} and new == {1: "n", 2: "m", 3: "c"}
    with pytest.raises(ValueError):
        upsert.fill(target, update, ["k"], ["v"], prefer="both")


def test_keep_one_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    one = upsert.keep_one(df, ["k"], [F.desc("id")])
    assert sorted(r.id for r in one.collect()) == [997, 998, 999]
    assert "WindowGroupLimit" in one._jdf.queryExecution().executedPlan().toString()


def test_drop_empty_rows(spark):
    df = spark.createDataFrame([(None, "  "), (None, "x"), (1, None)], "a int, b string")
    assert upsert.drop_empty_rows(df).count() == 2


def test_split_parts_sum_to_the_amount(spark):
    df = spark.createDataFrame(
        [(Decimal("100.00"), Decimal("1"), Decimal("1"), Decimal("1")), (Decimal("5.00"), None, None, None)],
        "a decimal(18,2), x decimal(10,2), y decimal(10,2), z decimal(10,2)")
    parts = share.split_by_weights(F.col("a"), {c: F.col(c) for c in "xyz"})
    rows = df.select(*[p.alias(n) for n, p in parts.items()]).collect()
    assert abs(sum(rows[0]) - Decimal("100")) <= Decimal("0.000002")
    assert list(rows[1]) == [0, 0, 0]


def test_quality_rules(spark):
    rows = [(1, None, 1, "x", "0000000001", None, Decimal(1), "d", "t"),
            (2, 9, 7, "x" * 201, "0000000001", None, Decimal(1), "d", "t"),
            (3, None, 1, "x", "0000000000", None, None, "d", "t")]
    costs = spark.createDataFrame(rows, schemas.TABLES["GastoOrdinario"].schema)
    buildings = schemas.conform(spark.range(1, 2).withColumn("nombre", F.lit("A")), "Consorcio")
    report = {(r.tabla, r.regla, r.columnas): r.violaciones for r in quality.quality_report(
        {"GastoOrdinario": costs, "Consorcio": buildings}).collect()}
    assert report["GastoOrdinario", "unique", "nroFactura"] == 1
    assert report["GastoOrdinario", "reference", "consorcioId"] == 1
    assert report["GastoOrdinario", "required", "importeTotal"] == 1
    assert report["GastoOrdinario", "format", "nroFactura"] == 1
    assert report["GastoOrdinario", "width", "nombreEmpresaoPersona"] == 1
    assert report["Consorcio", "unique", "id"] == 0
    accounts = spark.createDataFrame([("1", "a", Decimal("100000000")), ("2", "b", Decimal("-99999999.99"))],
                                     schemas.TABLES["CuentaBancaria"].schema)
    sizes = {(r.regla, r.columnas): r.violaciones for r in quality.quality_report({"CuentaBancaria": accounts}).collect()}
    assert sizes["size", "saldo"] == 1 and sizes["required", "CVU_CBU"] == 0


def test_quality_report_reads_each_table_once(spark, tmp_path):
    """Every kind of rule broken, against the rules one by one; NULL keys count nowhere."""
    people = [(i, "a", "b", "1", None, str(i % 40) if i % 7 else None, None, 1 + i % 3) for i in range(300)]
    units = [(i % 90, str(i % 60) if i % 5 else None, 1, "d", "p", i, None, None, "t") for i in range(200)]
    bills = [(i, 1, *[Decimal(i)] * 6, 2025, i % 12 if i % 4 else None) for i in range(50)]
    tables = {}
    for name, rows in (("Persona", people), ("UnidadFuncional", units), ("Expensa", bills),
                       ("TipoRol", [(1, "x" * 60, None), (2, None, None)])):
        spark.createDataFrame(rows, schemas.TABLES[name].schema).write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    report = quality.quality_report(tables)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == len(tables)
    got = {(r.tabla, r.regla, r.columnas): r.violaciones for r in report.collect()}
    want = {}
    for name, df in tables.items():
        for rule, broken in quality.row_rules(name).items():
            want[name, *rule] = df.where(broken).count()
        for keys in schemas.TABLES[name].unique:
            want[name, "unique", ",".join(keys)] = quality.repeated_keys(df, keys).count()
        for column, (parent, other) in schemas.TABLES[name].references.items():
            if parent in tables:
                want[name, "reference", column] = quality.orphans(df, column, tables[parent], other).count()
    assert got == want
    assert got["Expensa", "unique", "consorcioId,fechaPeriodoAnio,fechaPeriodoMes"] == 9
    assert got["Persona", "reference", "idTipoRol"] == 100 and got["UnidadFuncional", "reference", "CVU_CBU"] > 0


def test_protect_hides_and_reveals(spark):
    people = spark.createDataFrame(
        [(1, "Ana", "Gil", "00000001", None, "77", "5", 1), (2, "Eva", "Paz", "00000002", "e@x", "77", "6", 2)],
        schemas.TABLES["Persona"].schema)
    key = "k" * 32
    hidden = protect.protect_table(people, "Persona", key)
    rows = hidden.orderBy("idPersona").collect()
    assert rows[0].CVU_CBU != rows[1].CVU_CBU and rows[0].CVU_CBU_hash == rows[1].CVU_CBU_hash
    assert len(rows[0].CVU_CBU_hash) == 64 and rows[0].email is None
    assert protect.reveal_table(hidden, "Persona", key).collect() == people.collect()
    wrong = protect.reveal_table(hidden, "Persona", "w" * 32).collect()
    assert all(r.dni is None for r in wrong)
    with pytest.raises(protect.AlreadyProtected):
        protect.protect_table(hidden, "Persona", key)
    salted = protect.protect(people, ["dni"], key, ["dni"], salt="s").first().dni_hash
    assert salted != rows[0].dni_hash


def test_keyed_hash_is_hmac(spark):
    values = ["", "00000001", "ñandú", "x" * 300, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    for key in (b"k", b"s" * 128, b"long" * 100):
        digest = protect.keyed_hash(spark, key)
        got = {r.i: r.h for r in rows.select("i", digest(F.col("v")).alias("h")).collect()}
        for i, v in enumerate(values):
            want = None if v is None else hmac.new(key, v.encode(), hashlib.sha512).digest()
            assert (None if got[i] is None else bytes(got[i])) == want
    with pytest.raises(ValueError):
        protect.protect(rows, ["v"], "k" * 16, ["v"], salt="s", hash_key=b"k")


def test_no_plan_shows_a_key(spark):
    key, hash_key = "Secret0123456789", b"AnotherSecret567"
    people = spark.range(3).select(F.col("id").cast("string").alias("dni"))
    hidden = protect.protect(people, ["dni"], key, ["dni"], hash_key=hash_key)
    back = protect.reveal(hidden, {"dni": "string"}, key)
    assert sorted(r.dni for r in back.collect()) == ["0", "1", "2"]
    pads = [bytes(b ^ x for b in hash_key) for x in (0x36, 0x5C)]
    for df in (hidden, back):
        run = df._jdf.queryExecution()
        plan = run.toString() + run.executedPlan().toString() + run.analyzed().toString()
        for secret in (key.encode(), hash_key, *pads):
            assert secret.hex().upper() not in plan.upper() and secret.decode("latin-1") not in plan


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2025, "a"), (2, 2026, "b")], "id int, anio int, v string")
    path = str(tmp_path / "t")
    sinks.overwrite_partitions(df, path, ["anio"])
    sinks.overwrite_partitions(spark.createDataFrame([(3, 2026, "c")], df.schema), path, ["anio"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 3]
    sinks.append(df, str(tmp_path / "a"))
    sinks.append(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4
    counted, seen = sinks.counted(df)
    counted.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 2
    assert [r.id for r in sinks.preview(df, [F.desc("id")], 1).collect()] == [2]
    sinks.write_xml(df, str(tmp_path / "x"), "rows", "row")
    body = "".join(open(tmp_path / "x" / f).read() for f in sorted(os.listdir(tmp_path / "x")) if f.startswith("part"))
    assert "<rows>" in body and "<v>a</v>" in body


def test_date_ranges_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "pago")
    schemas.conform(spark.range(10).withColumn("fecha", F.lit("2025-05-01").cast("timestamp")), "Pago").write.parquet(path)
    rows = spark.read.schema(schemas.TABLES["Pago"].schema).parquet(path)
    wanted = reduce_where(rows, dates.in_year(F.col("fecha"), 2025))
    plan = wanted.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(fecha" in plan and "LessThan(fecha" in plan
    assert "ReadSchema: struct<id:bigint,fecha:timestamp>" in plan
    assert wanted.count() == 10 and reduce_where(rows, dates.in_year(F.col("fecha"), 2024)).isEmpty()


def reduce_where(df, conditions):
    for condition in conditions:
        df = df.where(condition)
    return df


def test_a_hot_key_keeps_results_whole(spark):
    """A third of all rows under one key, against the plain window form."""
    rows = spark.range(30000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    total = share.with_group_total(rows, ["k"], "id", "t")
    want = rows.withColumn("t", F.sum("id").over(W.partitionBy("k")))
    assert total.select(want.columns).exceptAll(want).isEmpty() and total.count() == 30000
    assert upsert.drop_duplicate_groups(rows, ["k"]).count() == 20000
    assert upsert.keep_one(rows, ["k"], ["id"]).count() == 20001
