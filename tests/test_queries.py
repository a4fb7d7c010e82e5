"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import os

import pytest

from intertie.queries import load

from .oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REGISTRY = load()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_twin_has_a_query():
    assert set(REGISTRY.sql) <= set(REGISTRY.queries)


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_query_matches_sql(spark, duck, name):
    frame = REGISTRY.queries[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert unwanted not in plan
    status, _, _ = compare(spark, FOLDER, duck, lambda *_: frame, REGISTRY.sql[name])
    assert status.startswith("ok"), status


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.sql)))
def test_query_runs(spark, name):
    assert REGISTRY.queries[name](spark, FOLDER).columns


def test_entry_points(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
