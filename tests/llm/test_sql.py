"""Queries with SQL agree with it."""

import os

import oracle
import pytest

from weftline.llm import queries as q

SF = os.environ.get("WEFTLINE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_matches_sql(spark, name):
    assert oracle.differences(spark, oracle.connect(SF), q.QUERIES[name], q.ORACLES[name], SF) == ""
