"""Product marks, trade candidates and their summaries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.market import arbitrage_fields, other_region, product_id
from ..functions.quarters import quarter_end, quarter_progress_pct, quarter_start, quarter_time_scales
from ..functions.valuation import execution_limits, fill_rate_fair_value, recommendation
from ..session import materialised
from .market import share_at_or_below
from .versions import latest_version, top_per_key


def product_marks(auction: DataFrame, file_order: Sequence[str], as_of: dt.date) -> DataFrame:
    """Latest row per product valued by the fill-rate model.

    ``file_order`` ranks publications (later wins).
    """
    latest = latest_version(auction, ["contract_id", "interconnector_id", "from_region"], file_order)
    price = F.round(F.col("clearing_price").cast("double"), 2)
    offered = F.greatest(F.col("units_offered"), F.lit(1))
    base = latest.select(
        "contract_id", "quarter", "tranche_no", "interconnector_id", "from_region",
        other_region("interconnector_id", "from_region").alias("to_region"),
        offered.alias("units_offered"),
        "units_sold",
        F.round(F.col("units_sold").cast("double") / offered, 6).alias("fill_rate"),
        price.alias("market_price_aud"),
    )
    # One row per product is left; both rankings and the marks read it.
    base = materialised(base)
    ranked = share_at_or_below(base, "fill_rate", "fill_rate_percentile")
    ranked = share_at_or_below(ranked, "units_offered", "volume_percentile")
    valued = ranked.withColumn(
        "_m",
        fill_rate_fair_value(F.col("market_price_aud"), F.col("fill_rate_percentile"), F.col("volume_percentile")),
    )
    valued = valued.select(
        *ranked.columns,
        F.col("_m.fair_value").alias("fair_value_per_unit_aud"),
        F.col("_m.confidence").alias("recommendation_confidence"),
        F.col("_m.fill_rate_signal").alias("fill_rate_signal"),
        F.col("_m.volume_signal").alias("volume_signal"),
        F.col("_m.model_notes").alias("fair_value_model"),
    )
    fair, market = F.col("fair_value_per_unit_aud"), F.col("market_price_aud")
    advised = valued.withColumn("_r", recommendation(fair, market, F.col("recommendation_confidence"))).withColumn(
        "_a", arbitrage_fields(fair, market, F.col("units_sold"))
    )
    return advised.select(
        product_id("contract_id", "interconnector_id", "from_region").alias("product_id"),
        *valued.columns,
        F.concat(F.col("from_region"), F.lit("→"), F.col("to_region")).alias("direction_label"),
        F.round(market * F.col("units_sold"), 2).alias("current_value_total_aud"),
        F.round(fair * F.col("units_sold"), 2).alias("fair_value_total_aud"),
        quarter_progress_pct("quarter", as_of).alias("quarter_progress_pct"),
        "_a.*",
        "_r.*",
    )


def candidate_filter(
    marks: DataFrame, min_confidence: float = 0.35, min_edge_pct: float = 2.0, sides: Sequence[str] | None = None
) -> DataFrame:
    """Marks with enough confidence and edge, on one of ``sides`` (never NEUTRAL)."""
    kept = marks.where(
        (F.col("recommendation_confidence") >= min_confidence)
        & (F.abs("fair_premium_pct") >= min_edge_pct)
        & (F.col("arbitrage_side") != "NEUTRAL")
    )
    return kept if not sides else kept.where(F.col("arbitrage_side").isin(*sides))


def trade_candidates(
    marks: DataFrame,
    as_of: dt.date,
    min_confidence: float = 0.35,
    min_edge_pct: float = 2.0,
    risk_budget: float = 25000.0,
    participation_pct: float = 10.0,
    sides: Sequence[str] | None = None,
) -> DataFrame:
    """Sized candidates, the best one per product direction."""
    kept = candidate_filter(marks, min_confidence, min_edge_pct, sides)
    sized = kept.withColumn(
        "_s",
        execution_limits(
            F.col("market_price_aud"), F.col("arbitrage_per_unit_aud"), F.col("units_sold"), F.col("units_offered"),
            risk_budget, participation_pct,
        ),
    )
    edge = F.round(F.abs("arbitrage_per_unit_aud") * F.col("_s.suggested_units"), 2)
    candidates = sized.select(
        "product_id", "contract_id", "quarter", "tranche_no", "interconnector_id",
        F.col("direction_label").alias("direction"),
        F.when(F.col("arbitrage_side") == "LONG", "BUY_CALLS").otherwise("BUY_PUTS").alias("trade_action"),
        F.col("arbitrage_side").alias("side"),
        F.col("fair_value_per_unit_aud").alias("fair_value_aud"),
        F.round("fair_premium_pct", 2).alias("delta_edge_pct"),
        "arbitrage_per_unit_aud",
        F.round("recommendation_confidence", 3).alias("confidence"),
        "_s.*",
        edge.alias("expected_edge_aud"),
        F.coalesce(F.round(F.try_divide(edge, F.col("_s.suggested_spend_aud")), 6), F.lit(0.0)).alias(
            "expected_edge_per_dollar"
        ),
        "recommendation",
        "recommendation_reason",
    )
    best = top_per_key(
        candidates,
        ["product_id", "contract_id", "quarter", "tranche_no", "interconnector_id", "direction"],
        [F.abs("expected_edge_aud").desc(), F.col("confidence").desc(), F.col("suggested_units").desc()],
    )
    return best.withColumn("_t", quarter_time_scales("quarter", as_of)).select(*best.columns, "_t.*")


def rank_candidates(candidates: DataFrame, n: int = 20) -> DataFrame:
    return candidates.orderBy(
        F.abs("expected_edge_aud").desc(), F.col("confidence").desc(), "product_id"
    ).limit(n)


def best_buys(candidates: DataFrame, n: int = 12) -> DataFrame:
    return candidates.where(F.col("side") == "LONG").orderBy(
        F.col("expected_edge_per_dollar").desc(), F.abs("expected_edge_aud").desc(), F.col("confidence").desc(),
        "product_id",
    ).limit(n)


def _exact(column) -> Column:
    """Money as a decimal, so that a sum does not depend on the order of rows."""
    return column.cast("decimal(28,6)")


def quarter_trade_summary(candidates: DataFrame) -> DataFrame:
    """Spend, edge, confidence-weighted edge and risk per quarter (sums rounded to cents)."""
    def total(column) -> Column:
        return F.round(F.sum(_exact(column)), 2).cast("double")

    grouped = candidates.groupBy("quarter").agg(
        F.count(F.lit(1)).alias("count"),
        total(F.col("suggested_spend_aud")).alias("total_suggested_spend_aud"),
        total(F.col("expected_edge_aud")).alias("total_expected_edge_aud"),
        total(F.col("expected_edge_aud") * F.col("confidence")).alias("total_projected_profit_aud"),
        total(F.col("risk_per_unit_aud") * F.col("suggested_units")).alias("total_capital_at_risk_aud"),
    )
    ratio = F.coalesce(F.try_divide(F.col("total_projected_profit_aud"), F.col("total_capital_at_risk_aud")), F.lit(0.0))
    return grouped.select(
        F.substring("quarter", 2, 4).alias("year"),
        "quarter",
        quarter_start("quarter").alias("quarter_start"),
        quarter_end("quarter").alias("quarter_end"),
        "count",
        "total_suggested_spend_aud",
        "total_expected_edge_aud",
        "total_projected_profit_aud",
        "total_capital_at_risk_aud",
        F.round(F.round(ratio, 4) * 100.0, 2).alias("return_on_risked_capital_pct"),
        F.col("total_suggested_spend_aud").alias("sell_now_value_aud"),
        F.round(F.col("total_expected_edge_aud") - F.col("total_projected_profit_aud"), 2).alias(
            "implied_exit_spread_aud"
        ),
    )


def year_trade_summary(quarters: DataFrame) -> DataFrame:
    """Quarter summaries added up by year."""
    def total(name: str) -> Column:
        return F.round(F.sum(_exact(F.col(name))), 2).cast("double").alias(name)

    grouped = quarters.groupBy("year").agg(
        F.sum("count").alias("count"),
        total("total_suggested_spend_aud"),
        total("total_expected_edge_aud"),
        total("total_projected_profit_aud"),
        total("total_capital_at_risk_aud"),
    )
    ratio = F.coalesce(F.try_divide(F.col("total_projected_profit_aud"), F.col("total_capital_at_risk_aud")), F.lit(0.0))
    return grouped.withColumn("return_on_risked_capital_pct", F.round(F.round(ratio, 4) * 100.0, 2))


def sell_quarter(quarters: DataFrame) -> DataFrame:
    """Exit view of the quarter summaries."""
    return quarters.select(
        "*",
        F.col("sell_now_value_aud").alias("exit_price_aud"),
        F.col("total_projected_profit_aud").alias("projected_hold_pnl_aud"),
        F.lit("SELL_ENTIRE_QUARTER").alias("sell_action"),
    )


def arbitrage_totals(marks: DataFrame) -> DataFrame:
    """Gross long and short edge."""
    value = F.col("arbitrage_total_aud")
    long_edge = F.sum(_exact(F.when(F.col("arbitrage_side") == "LONG", value)))
    short_edge = F.sum(_exact(F.when(F.col("arbitrage_side") == "SHORT", F.abs(value))))
    zero = F.lit(0).cast("decimal(28,6)")
    a, b = F.round(F.coalesce(long_edge, zero), 2), F.round(F.coalesce(short_edge, zero), 2)
    return marks.agg(
        F.count(F.lit(1)).alias("count"),
        a.cast("double").alias("gross_long_edge_aud"),
        b.cast("double").alias("gross_short_edge_aud"),
        (a + b).cast("double").alias("gross_total_edge_aud"),
    )


def arbitrage_top(marks: DataFrame, n: int = 25) -> DataFrame:
    size = F.round(F.abs("arbitrage_total_aud"), 2)
    return marks.withColumn("arbitrage_abs_total_aud", size).orderBy(
        F.col("arbitrage_abs_total_aud").desc(), "product_id"
    ).limit(n)


def collapse_directions(marks: DataFrame) -> DataFrame:
    """One row per contract and interconnector: the leg with the largest total plus all legs, largest first.

    ``marks`` holds one row per direction, so a group has as many legs as the
    interconnector has directions.
    """
    noted = F.when(
        (F.col("recommendation") == "HOLD") & ~F.lower("recommendation_reason").contains("no new buy"),
        F.concat(F.col("recommendation_reason"), F.lit(" · no new buy (hold existing only)")),
    ).otherwise(F.col("recommendation_reason"))
    marks = marks.withColumn("recommendation_reason", noted)
    leg = F.struct(
        (-F.abs("arbitrage_total_aud")).alias("rank"),
        F.col("from_region").alias("from_region"),
        F.col("direction_label").alias("direction"),
        "market_price_aud", "fair_value_per_unit_aud", "arbitrage_per_unit_aud", "arbitrage_total_aud",
        "arbitrage_side", "recommendation", "recommendation_reason",
    )
    grouped = marks.groupBy("contract_id", "quarter", "interconnector_id", "tranche_no").agg(
        F.array_sort(F.collect_list(leg)).alias("_legs")
    )
    top = F.col("_legs")[0]
    return grouped.select(
        "contract_id", "quarter", "interconnector_id", "tranche_no",
        F.array_join(F.transform("_legs", lambda x: x["direction"]), " | ").alias("direction_label"),
        F.lit("PAIR").alias("from_region"),
        F.lit("PAIR").alias("to_region"),
        top["arbitrage_total_aud"].alias("arbitrage_total_aud"),
        top["arbitrage_side"].alias("arbitrage_side"),
        top["recommendation"].alias("recommendation"),
        top["recommendation_reason"].alias("recommendation_reason"),
        F.transform("_legs", lambda x: x.dropFields("rank", "from_region", "recommendation_reason")).alias("legs"),
    )
