"""Reports over a table of dispatched intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import globally_ordered, running

MONEY = "decimal(18,2)"


def monthly_revenue(dispatch: DataFrame, key: str = "strategy_id", ts: str = "timestamp") -> DataFrame:
    """Revenue and numbers of discharging and charging intervals per month."""
    return dispatch.groupBy(key, F.date_format(ts, "yyyy-MM").alias("month")).agg(
        F.sum(F.col("interval_revenue_aud").cast(MONEY)).cast("double").alias("revenue_aud"),
        F.count_if(F.col("action") == "discharge").alias("discharge_intervals"),
        F.count_if(F.col("action") == "charge").alias("charge_intervals"),
    )


def period_revenue(dispatch: DataFrame, ytd_start, year: int, key: str = "strategy_id", ts: str = "timestamp") -> DataFrame:
    """Revenue since a date and in a calendar year."""
    money = F.col("interval_revenue_aud").cast(MONEY)
    return dispatch.groupBy(key).agg(
        F.coalesce(F.sum(F.when(F.col(ts) >= F.lit(ytd_start), money)), F.lit(0)).cast("double").alias("ytd_revenue_aud"),
        F.coalesce(F.sum(F.when(F.year(ts) == year, money)), F.lit(0)).cast("double").alias("annual_revenue_aud"),
    )


def cumulative_revenue(
    dispatch: DataFrame, keys: Sequence[str] = ("strategy_id",), order: Sequence[str] = ("timestamp",)
) -> DataFrame:
    """Running revenue per series, without gathering a series on one task."""
    staged = dispatch.withColumn("_money", F.col("interval_revenue_aud").cast(MONEY))
    ordered = globally_ordered(staged, [*keys, *order])
    summed = running(ordered, keys, {"cumulative_revenue_aud": ("sum", "_money")})
    return summed.select(*dispatch.columns, F.col("cumulative_revenue_aud").cast("double"))


def dispatch_summary(dispatch: DataFrame, key: str = "strategy_id") -> DataFrame:
    def total(name: str):
        return F.sum(F.col(name).cast(MONEY)).cast("double")

    return dispatch.groupBy(key).agg(
        total("interval_revenue_aud").alias("total_revenue_aud"),
        total("arb_revenue_aud").alias("arb_revenue_aud"),
        total("fcas_revenue_aud").alias("fcas_revenue_aud"),
        F.count_if(F.col("action") == "discharge").alias("intervals_dispatched"),
        F.count_if(F.col("action") == "charge").alias("intervals_charged"),
        F.max("soc_pct").alias("peak_soc_pct"),
        F.min("soc_pct").alias("min_soc_pct"),
    )


def strategy_rank(summary: DataFrame, key: str = "strategy_id") -> DataFrame:
    """Rank by revenue. ``summary`` has one row per named strategy, so a single window is enough."""
    window = Window.orderBy(F.col("total_revenue_aud").desc(), F.col(key))
    return summary.withColumn("rank", F.row_number().over(window))


def strategy_parameters(strategies: DataFrame) -> DataFrame:
    """Flags and overrides of each strategy as one map; overrides win."""
    base = F.create_map(
        F.lit("enable_fcas"), F.col("enable_fcas").cast("string"),
        F.lit("allocation_strategy"), F.col("allocation_strategy"),
        F.lit("force_dispatch_mode"), F.col("force_mode"),
        F.lit("adaptive_thresholds"), F.col("adaptive_thresholds").cast("string"),
    )
    overrides = F.coalesce("engine_overrides", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(overrides, k))
    return strategies.select("strategy_id", F.map_concat(kept, overrides).alias("parameters"))


def apply_strategy_params(rows: DataFrame, strategies: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """Rows with the named parameters of their strategy as columns."""
    joined = rows.join(strategy_parameters(strategies), ["strategy_id"], "left")
    return joined.select(*rows.columns, *[F.try_element_at("parameters", F.lit(p)).alias(p) for p in parameters])
