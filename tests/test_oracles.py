"""Every registered query against its SQL, on the smallest supplied tables."""

import os

import pytest

import __spark_entry__ as entry
from remitlens import plans
from compare import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not mounted")
plans.load_all()
QUERIES, ORACLES = plans.QUERIES, plans.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF_DIR) in (None, "no rows on either side")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["corridor", "source", "avg_reliability", "total_volume", "avg_latency_ms"]
    assert df.count() > 0
