"""Back-test of fair values and grid calibration of discounts.

A model value depends on a grid point only through its total discount, so rows
are scored once per distinct total (21 totals for the default 11 x 11 grid) and
the grid is expanded afterwards, on the aggregated scores.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.market import capped_error, other_region, round_cents
from .residue import CATEGORY
from .versions import top_per_key


@dataclass(frozen=True)
class CalibrationConfig:
    """Grid in whole percent points, so that totals carry no binary rounding."""

    risk_percent: Sequence[int] = tuple(range(11))
    liquidity_percent: Sequence[int] = tuple(range(11))
    payout_error_weight: float = 0.7
    price_error_weight: float = 0.3
    ape_cap: float | None = None
    quarter_balanced: bool = False
    min_total_discount: float = 0.0
    penalty_strength: float = 100.0
    downside_multiplier: float = 0.8
    upside_multiplier: float = 1.2

    @property
    def weights(self) -> tuple[float, float]:
        total = self.payout_error_weight + self.price_error_weight
        if total <= 0:
            return 0.5, 0.5
        return self.payout_error_weight / total, self.price_error_weight / total

    @property
    def totals_percent(self) -> list[int]:
        return sorted({r + q for r in self.risk_percent for q in self.liquidity_percent})


def backtest_frame(auction: DataFrame, residue: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Auction rows with the units sold in their category and the payout that category made.

    Every published row counts, re-publications included; deduplicate the input
    first for the other reading. Rows without residue drop out.
    """
    facts = (
        auction.groupBy(*keys)
        .agg(F.sum("units_sold").alias("total_units_sold"))
        .join(residue.select(*keys, F.col("residue_aud").cast("double").alias("actual_residue_total")), list(keys))
        .where(F.col("actual_residue_total").isNotNull())
    )
    per_unit = F.when(F.col("total_units_sold") <= 0, F.lit(0.0)).otherwise(
        F.try_divide(F.col("actual_residue_total"), F.col("total_units_sold"))
    )
    facts = facts.withColumn("actual_per_unit", per_unit)
    rows = auction.join(facts, list(keys))
    return rows.withColumn("to_region", other_region("interconnector_id", "from_region")).withColumn(
        "actual_total_payout", F.col("actual_per_unit") * F.col("units_sold")
    )


def model_per_unit(discount: Column) -> Column:
    """Rounded fair value per unit of a back-test row at a total discount."""
    max_units = F.greatest(F.col("units_offered"), F.lit(1)).cast("double")
    expected = F.col("actual_residue_total") * max_units / F.greatest(F.col("total_units_sold"), F.lit(1))
    return round_cents(F.lit(1.0) / max_units * expected * (1 - discount))


def model_total(discount: Column) -> Column:
    max_units = F.greatest(F.col("units_offered"), F.lit(1)).cast("double")
    expected = F.col("actual_residue_total") * max_units / F.greatest(F.col("total_units_sold"), F.lit(1))
    return round_cents(F.lit(1.0) / max_units * expected * (1 - discount) * F.col("units_sold"))


def _total_scores(backtest: DataFrame, config: CalibrationConfig, by_quarter: bool) -> DataFrame:
    """Mean errors per (quarter and) total discount."""
    totals = F.array(*[F.lit(t) for t in config.totals_percent])
    exploded = backtest.select(
        "quarter",
        "actual_per_unit",
        F.col("clearing_price").cast("double").alias("_price"),
        "actual_residue_total",
        "units_offered",
        "total_units_sold",
        F.explode(totals).alias("total_percent"),
    )
    predicted = model_per_unit(F.col("total_percent") / 100.0)
    errors = exploded.select("quarter", "total_percent", "actual_per_unit", "_price", predicted.alias("_model"))
    sums = errors.groupBy("quarter", "total_percent").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(capped_error(F.col("actual_per_unit"), F.col("_model"), config.ape_cap)).alias("_payout"),
        F.sum(capped_error(F.col("_price"), F.col("_model"), config.ape_cap)).alias("_market"),
    )
    if by_quarter:
        # Inside one quarter balanced and plain weights are the same.
        return sums.select(
            "quarter", "total_percent", "rows",
            (F.col("_payout") / F.col("rows")).alias("mape_actual_per_unit"),
            (F.col("_market") / F.col("rows")).alias("mape_clearing_price"),
        )
    weight = F.lit(1.0) / F.col("rows") if config.quarter_balanced else F.lit(1.0)
    pooled = sums.groupBy("total_percent").agg(
        F.sum("rows").alias("rows"),
        F.sum(F.col("_payout") * weight).alias("_payout"),
        F.sum(F.col("_market") * weight).alias("_market"),
        F.sum(F.col("rows") * weight).alias("_weight"),
    )
    return pooled.select(
        F.lit("ALL").alias("quarter"), "total_percent", "rows",
        (F.col("_payout") / F.col("_weight")).alias("mape_actual_per_unit"),
        (F.col("_market") / F.col("_weight")).alias("mape_clearing_price"),
    )


def calibration_scores(
    backtest: DataFrame, config: CalibrationConfig = CalibrationConfig(), by_quarter: bool = True
) -> DataFrame:
    """Score of every grid point, per quarter or over all rows."""
    points = [(r, q, r + q) for r in config.risk_percent for q in config.liquidity_percent]
    by_total: dict[int, list[tuple[int, int]]] = {}
    for risk, liquidity, total in points:
        by_total.setdefault(total, []).append((risk, liquidity))
    entries: list[Column] = []
    for total, pairs in by_total.items():
        entries += [
            F.lit(total),
            F.array(*[F.struct(F.lit(r).alias("risk"), F.lit(q).alias("liquidity")) for r, q in pairs]),
        ]
    payout_weight, price_weight = config.weights
    scores = _total_scores(backtest, config, by_quarter)
    expanded = scores.select("*", F.explode(F.element_at(F.create_map(*entries), F.col("total_percent"))).alias("_p"))
    total = F.col("total_percent") / 100.0
    shortfall = F.greatest(F.lit(0.0), config.min_total_discount - total)
    return expanded.select(
        "quarter",
        "rows",
        (F.col("_p.risk") / 100.0).alias("model_risk_discount"),
        (F.col("_p.liquidity") / 100.0).alias("liquidity_discount"),
        total.alias("total_discount"),
        shortfall.alias("discount_shortfall"),
        "mape_actual_per_unit",
        "mape_clearing_price",
        (
            payout_weight * F.col("mape_actual_per_unit")
            + price_weight * F.col("mape_clearing_price")
            + shortfall * config.penalty_strength
        ).alias("weighted_score"),
    )


def best_grid_point(scores: DataFrame) -> DataFrame:
    """Lowest score per quarter; ties go to the smaller risk, then liquidity, discount."""
    return top_per_key(scores, ["quarter"], ["weighted_score", "model_risk_discount", "liquidity_discount"])


def ordered_diagnostics(scores: DataFrame) -> DataFrame:
    return scores.orderBy("quarter", "weighted_score", "model_risk_discount", "liquidity_discount")


def apply_calibration(backtest: DataFrame, best: DataFrame, config: CalibrationConfig = CalibrationConfig()) -> DataFrame:
    """Model values and errors of every row at the discounts chosen for its quarter."""
    chosen = best.select(
        "quarter",
        F.col("model_risk_discount").alias("calibrated_model_risk_discount"),
        F.col("liquidity_discount").alias("calibrated_liquidity_discount"),
        F.col("total_discount").alias("_discount"),
    )
    rows = backtest.join(chosen, ["quarter"])
    rows = rows.withColumn("model_per_unit", model_per_unit(F.col("_discount"))).withColumn(
        "model_total_payout", model_total(F.col("_discount"))
    )
    price = F.col("clearing_price").cast("double")
    return (
        rows.withColumn(
            "pct_error_actual_per_unit",
            capped_error(F.col("actual_per_unit"), F.col("model_per_unit"), config.ape_cap),
        )
        .withColumn("pct_error_clearing_price", capped_error(price, F.col("model_per_unit"), config.ape_cap))
        .drop("_discount")
    )


def summarize_by_quarter(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("quarter").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("pct_error_actual_per_unit").alias("actual_per_unit_mape"),
        F.avg("pct_error_clearing_price").alias("clearing_price_mape"),
        F.sum("actual_total_payout").alias("actual_total_payout"),
        F.sum("model_total_payout").alias("model_total_payout"),
    )


def row_weighted_means(best: DataFrame) -> DataFrame:
    """Means of the per-quarter metrics weighted by rows."""
    n = F.sum("rows")
    return best.agg(
        n.alias("rows"),
        F.count(F.lit(1)).alias("quarters"),
        *[
            (F.sum(F.col(c) * F.col("rows")) / n).alias(f"{c}_mean")
            for c in ("mape_actual_per_unit", "mape_clearing_price", "weighted_score")
        ],
    )
