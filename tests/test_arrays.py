"""JSON arrays cut at braces against Python's own JSON reader."""

from __future__ import annotations

import json
import random

import pytest

from duesflow.sources.arrays import read_array

SCHEMA = "id bigint, texto string, dentro struct<a:array<bigint>,b:struct<c:string>>"
MARKS = ['{', '}', '[', ']', '"', '\\', ',', ' ', '\n', 'ñ', '}"', '\\"', 'x' * 40]


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "97")
    spark.conf.set(names[1], "1")
    yield
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


def _documents(seed: int, n: int) -> list[dict]:
    draw = random.Random(seed)
    text = lambda: "".join(draw.choices(MARKS, k=draw.randrange(12)))
    return [{"id": i, "texto": text(), "dentro": {"a": [draw.randrange(9) for _ in range(draw.randrange(4))], "b": {"c": text()}}}
            for i in range(n)]


def _rows(df) -> list[dict]:
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: r["id"])


@pytest.mark.parametrize("indent", [None, 2])
def test_documents_equal_python(spark, tmp_path, small_blocks, indent):
    for seed in range(3):
        docs = [{**d, "id": d["id"] + seed * 100} for d in _documents(seed, 60)]
        (tmp_path / f"{seed}.json").write_text(json.dumps(docs, indent=indent, ensure_ascii=seed == 1), encoding="utf-8")
    (tmp_path / "empty.json").write_text("[ ]")
    (tmp_path / "nothing.json").write_text("")
    rows, rejects = read_array(spark, str(tmp_path), SCHEMA)
    want = [{**d, "id": d["id"] + seed * 100} for seed in range(3) for d in _documents(seed, 60)]
    assert _rows(rows) == want and rejects.count() == 0


@pytest.mark.parametrize("tail, kept, cause, line", [
    (',{"id":2,"texto":"x"', 1, "cortada", '{"id":2,"texto":"x"'),
    (',{"id":2,"te', 1, "cortada", '{"id":2,"te'),
    (',{"id":2,"texto":"a}', 1, "cortada", '{"id":2,"texto":"a'),
    (',{"id":tru}]', 1, "ilegible", '{"id":tru}'),
    (',7,{"id":2}]', 1, "ilegible", '7,{"id":2}'),
    (',7]', 1, "ilegible", "7"),
    (',{"id":2},]', 2, None, None),
])
def test_rejects(spark, tmp_path, small_blocks, tail, kept, cause, line):
    (tmp_path / "a.json").write_text('[{"id":1,"texto":"}{"}' + tail)
    rows, rejects = read_array(spark, str(tmp_path), SCHEMA)
    assert rows.count() == kept
    assert [(r.causa, r.linea) for r in rejects.collect()] == ([(cause, line)] if cause else [])


def test_no_array_raises(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":1}\n{"id":2}')
    with pytest.raises(Exception, match="no JSON array"):
        read_array(spark, str(tmp_path), SCHEMA)


def test_one_file_many_tasks(spark, tmp_path, small_blocks):
    from duesflow.sources.arrays import _pieces

    (tmp_path / "a.json").write_text(json.dumps(_documents(5, 100)))
    assert _pieces(spark, str(tmp_path)).select("bloque").distinct().count() > 50


def test_tasks_grow_with_the_files(spark, tmp_path, small_blocks, monkeypatch):
    from duesflow.sources import arrays

    (tmp_path / "a.json").write_text(json.dumps(_documents(7, 200)))
    size = (tmp_path / "a.json").stat().st_size
    monkeypatch.setattr(arrays, "BYTES_PER_TASK", 64)
    tasks = -(-size // 64)
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = arrays._pieces(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert f", {tasks}), REPARTITION_BY_NUM" in plan
    documents = arrays.array_documents(spark, str(tmp_path))
    assert f", {tasks}), REPARTITION_BY_NUM" in documents._jdf.queryExecution().executedPlan().toString()
    assert _rows(read_array(spark, str(tmp_path), SCHEMA)[0]) == _documents(7, 200)
