"""Accuracy of recorded recommendations."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Centres of the confidence bins, 0.05 to either side.
BIN_CENTRES = ("0.6", "0.7", "0.8", "0.9")
BIN_HALF_WIDTH = "0.05"


def _rate(flag: str) -> Column:
    return F.round(F.coalesce(F.avg(F.col(flag).cast("double")), F.lit(0.0)), 3)


def hit_rate(ledger: DataFrame) -> DataFrame:
    """Count, hit rate, confidence and spread per recommendation; NULL outcomes are ignored."""
    return ledger.groupBy("recommendation").agg(
        F.count(F.lit(1)).alias("count"),
        _rate("recommendation_correct_24h").alias("hit_rate_24h"),
        F.round(F.avg(F.col("confidence").cast("double")), 3).alias("avg_confidence"),
        F.round(F.avg(F.col("spread_pct").cast("double")), 2).alias("avg_spread_pct"),
    )


def hit_rate_overall(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.count(F.lit(1)).alias("total_recommendations"),
        _rate("recommendation_correct_24h").alias("hit_rate_24h"),
        _rate("recommendation_correct_7d").alias("hit_rate_7d"),
    )


def confidence_bins(
    ledger: DataFrame, centres: Sequence[str] = BIN_CENTRES, half_width: str = BIN_HALF_WIDTH
) -> DataFrame:
    """Claimed confidence against the actual hit rate per bin; decimal edges, lower one included."""
    half = Decimal(half_width)
    bins = F.array(
        *[
            F.struct(
                F.lit(Decimal(c)).cast("decimal(6,4)").alias("centre"),
                F.lit(Decimal(c) - half).cast("decimal(6,4)").alias("low"),
                F.lit(Decimal(c) + half).cast("decimal(6,4)").alias("high"),
            )
            for c in centres
        ]
    )
    confidence = F.col("confidence").cast("decimal(6,4)")
    placed = ledger.select(
        "recommendation_correct_24h",
        F.explode(F.filter(bins, lambda b: (confidence >= b["low"]) & (confidence < b["high"]))).alias("_bin"),
    )
    return placed.groupBy(F.col("_bin.centre").cast("double").alias("claimed_confidence")).agg(
        _rate("recommendation_correct_24h").alias("actual_hit_rate"), F.count(F.lit(1)).alias("count")
    )


def average_markout(ledger: DataFrame) -> DataFrame:
    """Mean and sample deviation of the 24 h markout per recommendation."""
    value = F.col("markout_24h_pct").cast("double")
    return (
        ledger.groupBy("recommendation")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.round(F.avg(value), 2).alias("avg_markout_24h_pct"),
            F.round(F.stddev_samp(value), 2).alias("std_markout_24h_pct"),
            F.count(value).alias("_valid"),
        )
        .where("_valid > 0")
        .drop("_valid")
    )


def versus_baseline(ledger: DataFrame, fill_percentile: float = 80.0) -> DataFrame:
    """Mean markout of all recommendations against buying every high-fill product."""
    value = F.col("markout_24h_pct").cast("double")
    strategy = F.avg(value)
    baseline = F.coalesce(F.avg(F.when(F.col("fill_rate_percentile") > fill_percentile, value)), F.lit(0.0))
    valid_hit = F.avg(F.when(value.isNotNull(), F.col("recommendation_correct_24h").cast("double")))
    return ledger.agg(
        F.round(strategy, 2).alias("strategy_pnl_24h_pct"),
        F.round(valid_hit, 3).alias("strategy_hit_rate"),
        F.round(baseline, 2).alias("baseline_high_fill_pnl_24h_pct"),
        F.lit(0.0).alias("baseline_market_pnl_24h_pct"),
        F.round(strategy - baseline, 2).alias("strategy_vs_baseline_pnl"),
    )
