"""The driver contract: entry(), and every query against its DuckDB oracle."""

import os

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck

# VIGIL_ORACLE_SF=/root/testdata/sf0.01 runs the oracle contract at the driver's scale
SF = os.environ.get("VIGIL_ORACLE_SF", "/root/testdata/sf0.001")

# the library's own queries; tests/llm covers the corpus operators
QUERIES = sorted(q for q in E.queries() if q.startswith("q_"))


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["normalized_message", "occurrences", "example"]
    assert df.count() >= 0


def test_every_query_has_oracle():
    assert set(QUERIES) == {q for q in E.oracle_sql() if q.startswith("q_")}
    assert len(QUERIES) >= 81


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)


SCALAR_TYPES = ("string", "bigint", "int", "double", "boolean", "timestamp", "date")


@pytest.mark.parametrize("name", QUERIES)
def test_outputs_are_scalar(spark, name):
    df = E.queries()[name](spark, SF)
    bad = [(f.name, f.dataType.simpleString()) for f in df.schema.fields
           if f.dataType.simpleString() not in SCALAR_TYPES]
    assert not bad, bad
