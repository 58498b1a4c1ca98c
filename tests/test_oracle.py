"""Every query with SQL agrees with it on the smallest tables (WEFTLINE_SF_DIR picks others)."""

import os

import oracle
import pytest

from weftline.plans import catalog

QUERIES, ORACLES = catalog.load()
SF = os.environ.get("WEFTLINE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert oracle.differences(spark, con, QUERIES[name], ORACLES[name], SF) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["src", "dst", "value", "flag"]
    assert df.count() == 10
