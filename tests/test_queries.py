"""Every query against its SQL on the smallest tables; queries without SQL must run and keep their schema."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(__spark_entry__.queries()))
def test_query(spark, con, name):
    query, sql = __spark_entry__.queries()[name], __spark_entry__.oracle_sql().get(name)
    if sql:
        assert compare(spark, con, query, sql, SF) == ""
    else:
        df = query(spark, SF)
        assert len(set(df.columns)) == len(df.columns)
        df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
