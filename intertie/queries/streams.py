"""Streaming jobs run over the benchmark tables until the input is consumed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import archives, reports
from ..streaming import jobs
from . import REGISTRY
from . import roles as R


def _event_stream(spark, folder):
    schema = R.table(spark, folder, "events").schema
    return jobs.read_stream(spark, folder, schema, pattern="events.parquet")


def _drain(query) -> None:
    query.awaitTermination()


@REGISTRY.add(
    "stream_residue_30min",
    f"""
    WITH {R.INTERVALS_SQL},
    b AS (SELECT interconnector_id, from_region, time_bucket(INTERVAL 30 MINUTE, trading_interval) AS bucket_start,
                 CAST(sum(residue_aud) AS DOUBLE) / count(*) AS mean_residue FROM intervals GROUP BY ALL)
    SELECT interconnector_id, from_region, bucket_start, mean_residue FROM b
    WHERE bucket_start + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
    """,
)
def stream_residue_30min(spark, folder):
    rows = _event_stream(spark, folder).select(
        F.col("ts").alias("trading_interval"), F.col("event_type").alias("interconnector_id"),
        F.expr("CASE WHEN user_id % 2 = 0 THEN 'N1' ELSE 'S1' END").alias("from_region"),
        F.col("value").cast("decimal(18,2)").alias("residue_aud"),
    )
    path = scratch_path(spark, "buckets")
    _drain(jobs.to_table(jobs.stream_residue_30min(rows), path, scratch_path(spark, "state"), trigger_now=True))
    return spark.read.parquet(path).withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


@REGISTRY.add(
    "stream_dedup",
    """
    SELECT event_type AS region, date_trunc('minute', ts)::TIMESTAMP AS timestamp FROM events GROUP BY ALL
    """,
)
def stream_dedup(spark, folder):
    rows = _event_stream(spark, folder).select(
        F.col("event_type").alias("region"), F.date_trunc("minute", "ts").alias("timestamp")
    )
    path = scratch_path(spark, "prices")
    _drain(jobs.to_table(jobs.stream_prices(rows), path, scratch_path(spark, "state"), trigger_now=True))
    return spark.read.parquet(path).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@REGISTRY.add(
    "latest_snapshot",
    """
    SELECT event_type AS region, event_id, ts, value
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
    """,
)
def latest_snapshot(spark, folder):
    rows = R.table(spark, folder, "events").select(F.col("event_type").alias("region"), "event_id", "ts", "value")
    return jobs.latest_snapshot(rows, ["region"], ["ts", "event_id"])


@REGISTRY.add(
    "stream_latest_snapshot",
    """
    SELECT event_type AS region, event_id, value
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
    """,
)
def stream_latest_snapshot(spark, folder):
    rows = _event_stream(spark, folder).select(F.col("event_type").alias("region"), "event_id", "ts", "value")
    snapshot = jobs.latest_snapshot(rows, ["region"], ["ts", "event_id"])
    path = scratch_path(spark, "snapshot")
    _drain(jobs.snapshot_to_table(snapshot, path, scratch_path(spark, "state"), trigger_now=True))
    return jobs.read_snapshot(spark, path).select("region", "event_id", "value")


@REGISTRY.add(
    "stream_ledger",
    "SELECT event_type AS product_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1",
)
def stream_ledger(spark, folder):
    rows = _event_stream(spark, folder).select(
        F.col("ts").alias("timestamp"), F.col("event_type").alias("product_id"), F.lit("C2024Q1").alias("quarter"),
        F.expr("CAST(event_id AS STRING)").alias("tranche"), "event_id",
    )
    path = scratch_path(spark, "ledger")
    # The second run replays the same input from scratch; the keys keep it from adding rows.
    for _ in range(2):
        _drain(jobs.ledger_append(rows, path, scratch_path(spark, "state"), trigger_now=True))
    return spark.read.parquet(path).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")
    )


@REGISTRY.add(
    "resolve_revisions",
    """
    SELECT o_custkey, o_orderkey, o_totalprice
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1
    """,
)
def resolve_revisions(spark, folder):
    rows = R.table(spark, folder, "orders")
    return jobs.resolve_revisions(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_totalprice"
    )


def _catch_up(query) -> None:
    """Everything that has landed, and the windows that it completes; then the query is stopped."""
    query.processAllAvailable()
    query.stop()


def _landed(spark, folder, rows, query_of, *parts, label) -> str:
    """The table that a stream over archives makes when it is stopped after half of them and started again."""
    middle = R.table(spark, folder, "events").agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("_middle"))
    halves = rows.join(F.broadcast(middle))
    landing, out, state = (scratch_path(spark, name) for name in ("landing", "table", "state"))
    value = F.concat_ws(",", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("value")
    for number, half in enumerate((halves.where("ts <= _middle"), halves.where("ts > _middle"))):
        archives.write_archives(half.select(value), landing, f"{label}_{number}")
        _catch_up(query_of(landing, out, state))
    return out


@REGISTRY.add("stream_residue_archives", REGISTRY.sql["stream_residue_30min"])
def stream_residue_archives(spark, folder):
    """Half-hour means over landed archives; the second run goes on from the checkpoint of the first."""
    rows = R.table(spark, folder, "events").select(
        "ts", F.col("event_type").alias("ic"), F.expr("CASE WHEN user_id % 2 = 0 THEN 'N1' ELSE 'S1' END").alias("region"),
        F.col("value").cast("decimal(18,2)").alias("residue"),
    )

    def query(landing, out, state):
        read = reports.stream_dispatch_residue_archives(spark, landing)
        return jobs.to_table(jobs.stream_residue_30min(read), out, state, interval="0 seconds")

    stamp = F.date_format("ts", "yyyy/MM/dd HH:mm:ss")
    out = _landed(
        spark, folder, rows, query, "D", "DISPATCH", "IRSR", "2", stamp, F.col("ic"), F.col("region"), F.col("residue"),
        label="PUBLIC_DISPATCH_IRSR",
    )
    return spark.read.parquet(out).withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


@REGISTRY.add("stream_price_archives", REGISTRY.sql["stream_dedup"])
def stream_price_archives(spark, folder):
    """One row per region and minute over landed archives, each archive read once over both runs."""
    rows = R.table(spark, folder, "events").select("ts", "event_type")

    def query(landing, out, state):
        read = reports.stream_dispatch_prices(spark, landing).select("region", "timestamp")
        return jobs.to_table(jobs.stream_prices(read), out, state, interval="0 seconds")

    minute = F.date_format(F.date_trunc("minute", "ts"), "yyyy/MM/dd HH:mm:ss")
    out = _landed(
        spark, folder, rows, query, "D", "DISPATCH", "PRICE", "5", minute, "1", F.col("event_type"), "1", "0", "10", "x", "x",
        label="PUBLIC_DISPATCHIS",
    )
    return spark.read.parquet(out).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
