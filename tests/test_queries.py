"""Registered queries against SQL on the smallest tables.

Every query that has SQL runs, and those without it for their schema; the queries
of ``llm`` have tests of their own. CHECK=<prefix> picks some.
"""

import os

import __spark_entry__ as entry
import pytest
from fieldtally import plans
from harness import differences, duck

SF = "/root/testdata/sf0.001"

def names():
    return [n for n in plans.all_queries() if n.startswith(os.environ.get("CHECK", ""))]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_oracles_belong_to_queries():
    assert not set(entry.oracle_sql()) - set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        assert differences(got, con.execute(sql).df()) is None
