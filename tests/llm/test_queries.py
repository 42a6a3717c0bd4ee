"""The registered queries against their SQL, and the pipeline as a whole, on the smallest tables."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from duesflow.llm import queries as llm
from tests.compare import compare, database

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = database(ROOT)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", list(llm.SQL))
def test_query_equals_sql(spark, db, name):
    outcome = compare(spark, db, name, ROOT)
    assert outcome.startswith("equal"), outcome


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES) == list(range(1, 14)) and set(llm.QUERIES) <= set(contract.queries())


def test_pipeline_stages_each_take_effect(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = llm.stored_table(stage(spark, docs, ROOT))
        assert docs.columns == columns
        counts.append(docs.count())
    toxic = spark.read.parquet(f"{ROOT}/labels.parquet").where("toxic = 1").count()
    assert counts[0] - counts[1] <= 2 * toxic + 2 and counts[1] > counts[2] >= counts[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, ROOT)
    assert last.where("start = 0").count() == docs.count()
    fills = [r.n for r in last.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert max(fills) <= 4096 and np.sum(4096 - np.array(fills)) <= 4096 + 32 * len(fills)


def test_packed_sequences_keep_their_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a few words"), (2, None), (1, "other words " * 5000)], "doc_id long, text string")
    rows = corpus_pipeline.packed(spark, docs, ROOT).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    frames, pack = [], llm.packing.pack_documents
    monkeypatch.setattr(llm.packing, "pack_documents", lambda *args, **named: frames.append(pack(*args, **named)) or frames[-1])
    got = llm.op4_open_window_packing(spark, ROOT)
    want = frames[0].select(got.columns)
    assert frames[0].where("ids IS NULL OR octet_length(ids) <> 4 * length").isEmpty()
    assert dict(got.dtypes) == dict(want.dtypes) and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
