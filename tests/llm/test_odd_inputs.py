"""Long texts and words, escaped addresses, and columns that have the names of helper columns."""

from __future__ import annotations

import hashlib
import sys
import time

import pytest
from pyspark.sql import functions as F

from duesflow.llm import exact, mixing, neardup, tokens, warc
from duesflow.llm.packing import OpenWindows
from duesflow.llm.queries import tokenizer_path
from duesflow.llm.words import WordHasher

NAMES = ("_sha", "_turn", "_kept_id", "_kept_sha", "_near_row", "_near_kept", "_mix_uid", "_mix_first", "_mix_length", "_mix_taken")


@pytest.mark.parametrize("drop", [exact.drop_copies, neardup.drop_near_copies, mixing.mixed_documents])
def test_columns_of_any_name_stay(spark, drop):
    rows = [(i, f"some words of text number {i // 2} and what else belongs to it {i // 2}", "s", *(f"{n}{i}" for n in NAMES)) for i in range(8)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *NAMES])
    got = drop(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert kept and all(r[n] == f"{n}{r.doc_id}" for r in kept for n in NAMES)


def test_long_document_is_cut_in_time():
    n = 10_000_000
    windows, begin = OpenWindows(4096, 32, 16), time.time()
    ids = bytes(4 * n)
    closed = [piece for window in windows.add(1, 0, n, n, ids) for piece in window]
    closed += [piece for window in windows.rest() for piece in window]
    assert time.time() - begin < 10
    assert sum(p[2] for p in closed) == n and all(len(p[4]) == 4 * p[2] for p in closed)


def test_long_words_have_their_own_hashes():
    a, b = b"x" * 5000, b"x" * 4999 + b"y"
    swapped = b"a" + b"x" * 4095 + b"b" + b"x" * 903
    again = b"b" + b"x" * 4095 + b"a" + b"x" * 903
    hashes = WordHasher()([a, b, swapped, again, b"short"])[0]
    assert len(set(hashes.tolist())) == 5
    assert hashes[4] == WordHasher()([b"short"])[0][0]


@pytest.mark.parametrize("url", ["http://a.b/x%20y?q=%2F", "http://a.b/ä b%", "http://a.b/%25", "plain", "", "http://a.b/a%0D%0Ab\r\nX: 1"])
def test_addresses_come_back(url):
    payload = b"<html>"
    record = warc.format_record(1, url, payload, hashlib.sha256(payload).hexdigest(), "response", None)
    assert b"\r\nX: 1" not in record.partition(b"\r\n\r\n")[0]
    assert warc.parse_record(record)["url"] == url


def test_coders_are_forgotten():
    coder = tokens.worker_coder(tokenizer_path())
    assert tokens.worker_coder(tokenizer_path()) is coder
    tokens.forget_coders()
    assert not [n for n in vars(sys.modules["_kept_word_coders"]) if not n.startswith("__")]
    assert tokens.worker_coder(tokenizer_path()) is not coder


def test_exact_copies_do_not_group_by_text(spark):
    docs = spark.createDataFrame([(i, "same text" if i < 50 else f"text {i}") for i in range(80)], "doc_id long, text string")
    assert exact.drop_copies(docs).count() == 31
    assert exact.exact_groups(docs, digest=lambda c: F.lit(b"x")).where("kept").count() == 31
