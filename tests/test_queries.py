"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from duesflow.workload import registry
from tests.compare import compare, database

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = database(ROOT)
    yield connection
    connection.close()


LEDGER = list(registry.load())


def test_every_query_has_sql():
    assert set(LEDGER) <= set(contract.queries()) and set(LEDGER) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", LEDGER)
def test_query_equals_sql(spark, db, name):
    outcome = compare(spark, db, name, ROOT)
    assert outcome.startswith("equal"), outcome


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:3] == ["Nombre_Consorcio", "ID_Consorcio", "ID_Expensa"] and not df.isEmpty()
