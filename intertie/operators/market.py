"""Auction demand analytics: percentiles, correlations, trends and the sequential back-test."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.market import fill_rate
from ..session import materialised
from .ordering import globally_ordered, neighbour, running, value_positions


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation; 0 for a constant column or fewer than two rows."""
    a = a if isinstance(a, Column) else F.col(a)
    b = b if isinstance(b, Column) else F.col(b)
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    ratio = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
    return F.coalesce(ratio, F.lit(0.0))


def market_frame(auction: DataFrame) -> DataFrame:
    """Priced auction rows with fill rate and product key."""
    return auction.where(F.col("clearing_price") > 0).select(
        "*",
        F.concat_ws(":", "quarter", "interconnector_id", "from_region").alias("product_key"),
        fill_rate("units_sold", "units_offered").alias("fill_rate"),
    )


def _ranked(df: DataFrame, value: str, name: str, measure: Column) -> DataFrame:
    places = value_positions(df, [], value)
    return df.join(places.select(value, measure.alias(name)), [value], "left")


def _mean_rank() -> Column:
    return F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0


def percentile_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Percentile rank x 100 over all rows, ties at their average rank."""
    return _ranked(df, value, name, _mean_rank() / F.col("total") * 100.0)


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average rank of ``value``."""
    return _ranked(df, value, name, _mean_rank())


def with_ranks(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Average ranks of several columns, ``names`` giving each its output; NULL values have none.

    The distinct values of all columns go through one order together, by
    column and value, and one running count.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("_column"), F.col(c).alias("_value")) for i, c in enumerate(names)])
    values = df.select(F.explode(cells).alias("_cell")).select("_cell.*").where(F.col("_value").isNotNull())
    counts = values.groupBy("_column", "_value").agg(F.count(F.lit(1)).alias("n"))
    ordered = globally_ordered(counts, ["_column", "_value"])
    placed = running(ordered, ["_column"], {"upto": ("sum", "n")})
    ranks = materialised(placed.select("_column", "_value", _mean_rank().alias("_rank")))
    for i, (column, name) in enumerate(names.items()):
        own = ranks.where(F.col("_column") == i).select(F.col("_value").alias(f"_value_{i}"), F.col("_rank").alias(name))
        df = df.join(own, F.col(column) == F.col(f"_value_{i}"), "left").drop(f"_value_{i}")
    return df


def share_at_or_below(df: DataFrame, value: str, name: str) -> DataFrame:
    """Share of rows not above the row's value, x 100, two decimals."""
    share = F.round(F.col("upto") / F.col("total") * 100.0, 2)
    return _ranked(df, value, name, share).withColumn(name, F.coalesce(F.col(name), F.lit(50.0)))


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """Long table (a, b, corr); one aggregation for all pairs."""
    used = list(columns)
    if method == "spearman":
        used = [f"_rank_{c}" for c in columns]
        df = with_ranks(df.select(*columns), dict(zip(columns, used)))
    names = dict(zip(used, columns))
    pairs = [(a, b) for i, a in enumerate(used) for b in used[i:]]
    sums = df.agg(*[safe_corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = [
        F.struct(
            F.lit(names[a]).alias("a"),
            F.lit(names[b]).alias("b"),
            F.round(F.col(f"`{a}|{b}`" if (a, b) in pairs else f"`{b}|{a}`"), 4).alias("corr"),
        )
        for a, b in product(used, used)
    ]
    return sums.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def group_stats(frame: DataFrame, key: str) -> DataFrame:
    """Rows, price mean and deviation, fill mean and fill-price correlation per key."""
    return frame.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg(F.col("clearing_price").cast("double")), 4).alias("mean_price"),
        F.round(F.coalesce(F.stddev_samp(F.col("clearing_price").cast("double")), F.lit(0.0)), 4).alias("price_std"),
        F.round(F.avg("fill_rate"), 4).alias("mean_fill_rate"),
        F.round(safe_corr("fill_rate", "clearing_price"), 4).alias("fill_vs_price_corr"),
    )


def trend_by_product(frame: DataFrame, tie_break: Sequence[str] = ("source_file",)) -> DataFrame:
    """Price slope per tranche for products seen in at least two tranches."""
    order = F.struct("tranche_no", *tie_break)
    x, y = F.col("tranche_no").cast("double"), F.col("clearing_price").cast("double")
    grouped = frame.groupBy("product_key").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min("tranche_no").alias("tranche_start"),
        F.max("tranche_no").alias("tranche_end"),
        F.round(F.regr_slope(y, x), 4).alias("price_slope_per_tranche"),
        F.round(safe_corr("fill_rate", "clearing_price"), 4).alias("fill_price_corr"),
        F.round(F.min_by(y, order), 2).alias("start_price"),
        F.round(F.max_by(y, order), 2).alias("end_price"),
    )
    return grouped.where("tranche_start < tranche_end")


def trend_totals(trends: DataFrame) -> DataFrame:
    slope = F.col("price_slope_per_tranche")
    return trends.agg(
        F.count(F.lit(1)).alias("products_with_trend"),
        F.count_if(slope > 0).alias("rising_trends"),
        F.count_if(slope < 0).alias("falling_trends"),
        F.round(F.avg(slope), 4).alias("avg_slope"),
    )


def top_trends(trends: DataFrame, n: int = 100) -> DataFrame:
    return trends.orderBy(F.col("price_slope_per_tranche").desc(), "product_key").limit(n)


def tranche_pairs(frame: DataFrame, order: Sequence[str] = ("tranche_no", "source_file")) -> DataFrame:
    """Consecutive auctions of a product with the fill-rate signal and what followed.

    ``frame`` carries ``fill_rate_pct``. The next row is found in one global
    order, so a product of any size is fine.
    """
    narrow = frame.select(
        "product_key", "quarter", *dict.fromkeys(["tranche_no", *order]), "fill_rate_pct",
        F.col("clearing_price").cast("double").alias("current_price"),
    )
    paired = neighbour(narrow, ["product_key"], order, {"next_price": ("current_price", 1)}).where(
        F.col("next_price").isNotNull() & (F.col("current_price") > 0)
    )
    signal = (
        F.when(F.col("fill_rate_pct") >= 70, "BUY").when(F.col("fill_rate_pct") <= 30, "AVOID").otherwise("WATCH")
    )
    change = (F.col("next_price") - F.col("current_price")) / F.col("current_price") * 100.0
    staged = paired.withColumn("recommendation", signal).withColumn("_change", change)
    is_buy, is_avoid = F.col("recommendation") == "BUY", F.col("recommendation") == "AVOID"
    change = F.col("_change")
    return staged.select(
        "product_key",
        "quarter",
        "tranche_no",
        "recommendation",
        F.round("fill_rate_pct", 2).alias("fill_rate_pct"),
        F.round("current_price", 2).alias("current_price"),
        F.round("next_price", 2).alias("next_price"),
        F.round(change, 4).alias("forward_return_pct"),
        F.round(F.when(is_buy, change).when(is_avoid, -change).otherwise(-F.abs(change)), 4).alias(
            "signal_markout_pct"
        ),
        F.when(is_buy, change > 0).when(is_avoid, change < 0).otherwise(F.abs(change) <= 2.0).alias("correct"),
    )


def backtest_by_recommendation(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("recommendation").agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg(F.col("correct").cast("double")), 4).alias("hit_rate"),
        F.round(F.avg("forward_return_pct"), 4).alias("avg_forward_return_pct"),
        F.round(F.avg("signal_markout_pct"), 4).alias("avg_signal_markout_pct"),
    )


def backtest_overall(pairs: DataFrame) -> DataFrame:
    """Hit rate, mean markout and the uplift over watching everything."""
    strategy = F.avg("signal_markout_pct")
    baseline = -F.avg(F.abs(F.col("forward_return_pct")))
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs_evaluated"),
        F.round(F.avg(F.col("correct").cast("double")), 4).alias("overall_hit_rate"),
        F.round(strategy, 4).alias("strategy_avg_signal_markout_pct"),
        F.round(baseline, 4).alias("baseline_watch_all_markout_pct"),
        F.round(strategy - baseline, 4).alias("uplift_vs_baseline_pct"),
    )
