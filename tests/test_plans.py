"""Physical plans: what must and must not appear in them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from intertie.operators import calibration, market, network, ordering, versions
from intertie.queries import load
from intertie.queries import roles as R
from intertie.queries import settlement as Q

FOLDER = "/root/testdata/sf0.001"
REGISTRY = load()


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_latest_row_is_picked_before_the_shuffle(spark):
    rows = R.table(spark, FOLDER, "lineitem")
    text = plan(versions.latest_version(rows, ["l_orderkey"], ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"]))
    # Read from the bottom: partial limit, exchange, final limit.
    assert re.search(r"WindowGroupLimit.*Final.*Exchange.*WindowGroupLimit.*Partial", text, re.S)


def test_calibration_shuffles_aggregates_only(spark):
    backtest = calibration.backtest_frame(R.auction(spark, FOLDER), R.quarterly_residue(spark, FOLDER))
    text = plan(calibration.calibration_scores(backtest, Q.CONFIG))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    # Two build the facts, which are part of the plan now; one adds up the scores. Auction rows are not shuffled.
    assert text.count("Exchange hashpartitioning") == 3
    assert re.search(r"Exchange hashpartitioning.*HashAggregate.*partial_sum", text, re.S)


def test_scans_read_only_what_they_need(spark):
    text = plan(REGISTRY.queries["keyword_search"](spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    text = plan(network.filter_sites(
        R.table(spark, FOLDER, "customer").select(
            F.col("c_name").alias("network"), F.col("c_acctbal").alias("annual_deferral_aud"),
            F.col("c_custkey").alias("latitude"), F.col("c_custkey").alias("longitude"),
        ),
        ["x"], None, True,
    ))
    assert re.search(r"PushedFilters: \[IsNotNull.*EqualTo\(c_name,x\), GreaterThan", text)


def test_top_n_keeps_n_rows_per_task(spark):
    frame = market.market_frame(R.auction(spark, FOLDER))
    assert "TakeOrderedAndProject" in plan(market.top_trends(market.trend_by_product(frame, R.FILE_ORDER)))


def test_global_windows_are_limited_to_slices(spark):
    """A window without partitions may only see one row per slice."""
    rows = R.table(spark, FOLDER, "lineitem").select("l_orderkey", "l_quantity")
    ordered = ordering.globally_ordered(rows, ["l_quantity", "l_orderkey"], 6)
    text = plan(ordering.with_index(ordered))
    single = text[text.index("Exchange SinglePartition"):]
    assert re.search(r"Exchange SinglePartition.*HashAggregate\(keys=\[_part", single, re.S)


def test_rows_stay_where_they_are_for_a_small_look_up(spark, monkeypatch):
    """Points of three hot keys are broadcast level by level; a larger tree is joined to the same rows."""
    from pyspark.sql import functions as F

    from intertie.operators import versions

    facts = spark.range(0, 3000, 1, 6).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("k"), F.when(F.col("id") % 11 > 0, F.col("id") % 400 - 20).alias("t"), "id"
    )
    points = spark.range(0, 900).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"), (F.col("id") * 10).alias("v"))

    def plan_and_rows(keys):
        found = versions.as_of_join(facts, points, keys, "t", "at", ["v"], ["v"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        return plan, sorted((r.id, r.v) for r in found.collect())

    wanted = {("k",): lambda k, t: t - (t - k) % 3 if None not in (k, t) and t >= k else None, (): lambda k, t: t if t is not None and t >= 0 else None}
    for keys, expected in wanted.items():
        small, rows = plan_and_rows(list(keys))
        assert "BroadcastHashJoin" in small and "SortMergeJoin" not in small and "NestedLoop" not in small
        want = [(r.id, None if (at := expected(r.k, r.t)) is None else at * 10) for r in facts.collect()]
        assert rows == sorted(want)
        with monkeypatch.context() as m:
            m.setattr(versions, "BROADCAST", 0)
            large, again = plan_and_rows(list(keys))
            assert "NestedLoop" not in large and again == rows


def test_report_lines_are_parsed_once(spark):
    """Conditions on fields use what was parsed; each would parse the line again below the projection."""
    from intertie.sources import reports

    lines = spark.createDataFrame([("D,IRAUCTION,RESIDUE_PUBLIC_DATA,1,C2024Q1T01,1,A,B,5,4,1.5,",)], "value string")
    read = reports.parsed(lines, 12).where("length(_f.f4) >= 9 AND try_cast(_f.f8 AS INT) > 1 AND _f.f9 IS NOT NULL").select("_f.f4", "_f.f10")
    assert read._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1
    assert read.collect() == [("C2024Q1T01", "1.5")]
