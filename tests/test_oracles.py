"""Every registered query at the smallest scale against its SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
import oracle  # noqa: E402

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    problem = oracle.compare(spark, con, name, sf, QUERIES, ORACLES)
    # Few rows at this scale, so an empty result on both sides is fine here.
    assert problem in (None, "both empty")


def test_entry(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"qid", "query", "source", "matched_query", "sim", "value"}
    assert {r["source"] for r in df.collect()} <= {"exact", "semantic", "miss"}


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
