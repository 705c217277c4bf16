"""Every registered query against its DuckDB twin (sf0.001 by default).

Set CORPUSMILL_ORACLE_SF to another folder, e.g. /root/testdata/sf0.01.
"""

import os

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck

SF = os.environ.get("CORPUSMILL_ORACLE_SF", "/root/testdata/sf0.001")
QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_docstring():
    for name, fn in QUERIES.items():
        assert (fn.__doc__ or "").strip(), name


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "word", "cnt"] and df.count() >= 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, SF, name, QUERIES, ORACLE)
    assert ok, msg
