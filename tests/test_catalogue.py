"""Every catalogue query gives what its SQL gives, without cross joins or Python rows."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences, plan
from tidewater.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(request):
    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "PythonUDF" not in text and "BatchEvalPython" not in text and "InPandas" not in text
    assert differences(df, con, ORACLES[name]) == []


def test_entry_gives_revenue_for_every_nation(spark, con):
    rows = entry.entry(spark).collect()
    expected = con.sql("""
        SELECT n_name, count(*), CAST(sum(CAST(o_totalprice AS DECIMAL(14, 2))) AS DOUBLE)
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""").fetchall()
    assert sorted(tuple(r) for r in rows) == sorted(expected)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
