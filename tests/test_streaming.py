from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from duesflow import schemas
from duesflow.plans.imports import clean_payments
from duesflow.streaming import ingest

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("idPago", "fecha", "CVU_CBU", "valor")])


def drop(folder, name, ids):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as out:
        out.write("id,fecha,cvu,valor\n" + "".join(f"{i},{1 + i % 28:02d}/0{1 + i % 9}/2025,{i:022d},${i}.25\n" for i in ids))


def run(spark, home):
    query = ingest.ingest_drops(spark, f"{home}/in", f"{home}/out", f"{home}/state", SCHEMA, ["id"], "fecha",
                                options={"header": "true"}, clean=lambda raw: clean_payments(raw, 1))
    query.awaitTermination()
    return ingest.read_ingested(spark, f"{home}/out", schemas.TABLES["Pago"].schema)


def test_overlapping_drops_are_kept_once(spark, tmp_path):
    home = str(tmp_path)
    assert ingest.read_ingested(spark, f"{home}/out", schemas.TABLES["Pago"].schema).isEmpty()
    drop(f"{home}/in", "a.csv", range(1, 101))
    assert run(spark, home).count() == 100
    drop(f"{home}/in", "b.csv", range(50, 151))
    drop(f"{home}/in", "c.csv", range(140, 161))
    rows = run(spark, home)
    assert sorted(r.id for r in rows.collect()) == list(range(1, 161))
    assert rows.agg(F.sum("importe")).first()[0] == sum(range(1, 161)) + 160 * 25 / 100
    assert run(spark, home).count() == 160


def test_a_batch_run_twice_ends_with_the_same_rows(spark, tmp_path):
    target = str(tmp_path / "out")
    first = spark.createDataFrame([(1, "2025-01-01"), (2, "2025-01-02")], "id int, day string")
    second = spark.createDataFrame([(2, "2025-01-02"), (3, "2025-01-03")], "id int, day string")
    for batch_id, batch in ((0, first), (1, second), (1, second)):
        ingest._add_batch(batch, batch_id, target, ["id"], "day")
    rows = ingest.read_ingested(spark, target, first.schema)
    assert sorted(r.id for r in rows.collect()) == [1, 2, 3]
