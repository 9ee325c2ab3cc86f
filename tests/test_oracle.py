"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
ENTRY = compare.load_entry()
ORACLES = ENTRY.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return compare.duck(SF)


@pytest.mark.parametrize("name", list(ENTRY.queries()))
def test_query(spark, con, name):
    _, _, problem = compare.compare(spark, con, ENTRY.queries()[name], ORACLES.get(name), SF)
    assert problem is None, problem


def test_entry(spark):
    assert ENTRY.entry(spark).limit(1).count() == 1
    assert set(ORACLES) <= set(ENTRY.queries())
