"""Every registered query against its SQL twin, and the shape of the plans."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from postsift.plans.catalog import QUERIES
from postsift.plans.oracles import ORACLES
from compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["priority", "label", "method", "route", "n"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert difference(df, entry.oracle_sql()[name], con) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream_")])
def test_plan(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["recent_pending"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "value" not in plan
    assert "TakeOrderedAndProject" in plan
    oldest = entry.queries()["queue_oldest"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert oldest.count("WindowGroupLimit") == 2
