"""Streams over several files give the batch results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from intertie.functions.quarters import quarter_label
from intertie.operators import calibration, signals
from intertie.operators.residue import interval_bucket_average_then_sum
from intertie.plans import valuation
from intertie.streaming import jobs

SCHEMA = "trading_interval timestamp_ntz, interconnector_id string, from_region string, residue_aud double"


def write(spark, rows, schema, path, files=3):
    for i in range(files):
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


def test_half_hour_means_match_the_batch(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    rows = [(start + dt.timedelta(minutes=5 * i), "A-B", "AB"[i % 2], float(i % 7)) for i in range(120)]
    # A far later row moves the watermark past every half hour.
    closing = [(start + dt.timedelta(days=1), "A-B", "A", 0.0)]
    source = str(tmp_path / "in")
    write(spark, rows, SCHEMA, source)
    write(spark, closing, SCHEMA, source, 1)
    stream = jobs.read_stream(spark, source, spark.read.parquet(source).schema, files_per_trigger=1)
    out = str(tmp_path / "out")
    jobs.to_table(jobs.stream_residue_30min(stream), out, str(tmp_path / "state"), trigger_now=True).awaitTermination()
    streamed = {r.from_region: r.residue_aud for r in jobs.quarterly_from_buckets(spark.read.parquet(out)).collect()}
    batch = interval_bucket_average_then_sum(spark.createDataFrame(rows, SCHEMA))
    assert streamed == {r.from_region: r.residue_aud for r in batch.collect()}


def test_dedup_and_snapshot_over_batches(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    rows = [("R", start + dt.timedelta(minutes=5 * (i // 2)), float(i)) for i in range(30)]
    schema = "region string, timestamp timestamp_ntz, price_mwh double"
    source = str(tmp_path / "in")
    write(spark, rows, schema, source)
    read = lambda: jobs.read_stream(spark, source, schema, files_per_trigger=1)
    out = str(tmp_path / "out")
    jobs.to_table(jobs.stream_prices(read()), out, str(tmp_path / "s1"), trigger_now=True).awaitTermination()
    assert spark.read.parquet(out).count() == 15
    snap = str(tmp_path / "snap")
    newest = jobs.latest_snapshot(read(), ["region"], ["timestamp", "price_mwh"])
    jobs.snapshot_to_table(newest, snap, str(tmp_path / "s2"), trigger_now=True).awaitTermination()
    assert [r.price_mwh for r in jobs.read_snapshot(spark, snap).collect()] == [29]
    # Of three batches or more two are left; one without its mark is not read.
    kept = jobs.snapshot_batches(snap)
    assert len(kept) == 2 and kept[-1] >= 2
    spark.range(1).write.parquet(f"{snap}/batch={kept[-1] + 1}")
    (tmp_path / "snap" / f"batch={kept[-1] + 1}" / "_SUCCESS").unlink()
    assert [r.price_mwh for r in jobs.read_snapshot(spark, snap).collect()] == [29]


def test_stream_of_archives_goes_on_where_it_stopped(spark, tmp_path):
    from intertie.sources import archives, reports

    landing, out, state = (str(tmp_path / n) for n in ("landing", "out", "state"))
    start = dt.datetime(2026, 1, 1)
    for part in range(3):
        minutes = [start + dt.timedelta(minutes=5 * (12 * part + i)) for i in range(12)]
        lines = [(f"D,DISPATCH,IRSR,2,{t:%Y/%m/%d %H:%M:%S},A-B,A,{t.minute}",) for t in minutes]
        archives.write_archives(spark.createDataFrame(lines, "value string"), landing, f"PUBLIC_DISPATCH_IRSR_{part}")
        query = jobs.to_table(
            reports.stream_dispatch_residue_archives(spark, landing), out, state, interval="0 seconds"
        )
        query.processAllAvailable()
        query.stop()
        assert spark.read.parquet(out).count() == 12 * (part + 1)
    read = reports.read_dispatch_residue_archives(spark, landing)
    assert sorted(read.select("trading_interval", "residue_aud").collect()) == sorted(
        spark.read.parquet(out).select("trading_interval", "residue_aud").collect()
    )


def test_replayed_ledger_adds_nothing(spark, tmp_path):
    schema = "timestamp timestamp_ntz, product_id string, quarter string, tranche int, note string"
    rows = [(dt.datetime(2026, 1, 1), f"p{i % 5}", "C2026Q1", i // 5, "x") for i in range(20)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, rows + rows[:4], schema, source)
    for attempt in ("a", "b"):
        stream = jobs.read_stream(spark, source, schema, files_per_trigger=1)
        jobs.ledger_append(stream, out, str(tmp_path / attempt), trigger_now=True).awaitTermination()
    assert spark.read.parquet(out).count() == 20


def test_late_revision_wins_on_read(spark):
    bronze = spark.createDataFrame(
        [("k", 1, "first"), ("k", 3, "third"), ("k", 2, "late second")], "id string, revision int, v string"
    )
    assert [r.v for r in jobs.resolve_revisions(bronze, ["id"], ["revision"]).collect()] == ["third"]


def test_far_forecast_continues_the_near_one(spark):
    near = spark.createDataFrame([(1, 10.0), (2, 11.0)], "timestamp int, price_mwh double")
    far = spark.createDataFrame([(2, 99.0), (3, 12.0)], "timestamp int, price_mwh double")
    merged = signals.merge_forward_forecasts(near, far, [], "timestamp")
    assert sorted((r.timestamp, r.price_mwh) for r in merged.collect()) == [(1, 10), (2, 11), (3, 12)]
    assert signals.merge_forward_forecasts(near.limit(0), far, [], "timestamp").count() == 2


def test_one_optimum_for_all_quarters(spark):
    auction = spark.createDataFrame(
        [("C2025Q3", "A-B", "A", 1, 100, 50, 90.0), ("C2025Q4", "A-B", "A", 1, 100, 50, 45.0)],
        "quarter string, interconnector_id string, from_region string, tranche_no int, units_offered int, units_sold int, "
        "clearing_price double",
    )
    residue = spark.createDataFrame(
        [("C2025Q3", "A-B", "A", 5000.0), ("C2025Q4", "A-B", "A", 2500.0)],
        "quarter string, interconnector_id string, from_region string, residue_aud double",
    )
    config = calibration.CalibrationConfig(payout_error_weight=0.0, price_error_weight=1.0)
    scores, best, rows = valuation.calibrate(auction, residue, config, by_quarter=False)
    assert scores.count() == 121
    point = best.first()
    assert (point.model_risk_discount, point.liquidity_discount, point.rows) == (0.0, 0.1, 2)
    assert {(r.quarter, r.model_per_unit) for r in rows.collect()} == {("C2025Q3", 90.0), ("C2025Q4", 45.0)}


def test_quarter_label_is_independent_of_the_zone(spark):
    frame = spark.createDataFrame([(dt.datetime(2025, 10, 1),)], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Australia/Brisbane")
        assert frame.select(quarter_label("t")).first()[0] == "C2025Q4"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
