"""Identifiers, lenient casts, fill rates and error measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quarters import as_column, col_of, quarter_number, quarter_year

# Interconnector ids published under a second name.
INTERCONNECTOR_ALIASES = {"V-S-MNSP1": "V-SA"}

# Words that make a news item relevant.
NEWS_KEYWORDS = [
    "solar", "wind", "battery", "storage", "hydrogen", "renewable", "clean energy", "EV", "electric vehicle",
    "grid", "BESS", "VPP", "NEM", "AEMO", "offshore", "onshore", "lithium", "green energy", "net zero",
    "decarbonisation", "decarbonization", "power purchase", "PPA", "curtailment", "frequency", "firming",
    "capacity", "interconnector", "rooftop solar", "community battery", "microgrid",
]


def alias_interconnector(ic) -> Column:
    ic = col_of(ic)
    result = ic
    for published, canonical in INTERCONNECTOR_ALIASES.items():
        result = F.when(ic == published, F.lit(canonical)).otherwise(result)
    return result


def other_region(ic, from_region) -> Column:
    """Counter-region of ``A-B``; empty when ``from_region`` is neither end."""
    ic, region = col_of(ic), col_of(from_region)
    dash = F.locate("-", ic)
    left = F.substring_index(ic, "-", 1)
    right = F.substr(ic, dash + 1)
    return (
        F.when(dash == 0, F.lit(""))
        .when(region == left, right)
        .when(region == right, left)
        .otherwise(F.lit(""))
    )


def safe_int(text) -> Column:
    return F.coalesce(F.trim(col_of(text)).try_cast("int"), F.lit(0))


def safe_decimal(text, kind: str = "decimal(18,4)") -> Column:
    return F.coalesce(F.regexp_replace(F.trim(col_of(text)), ",", "").try_cast(kind), F.lit(0).cast(kind))


def result_status(units_offered, units_sold) -> Column:
    offered, sold = col_of(units_offered), col_of(units_sold)
    return (
        F.when(sold <= 0, F.lit("no_clearance"))
        .when(sold < offered, F.lit("partial_clearance"))
        .otherwise(F.lit("cleared"))
    )


def auction_id(quarter) -> Column:
    """``Ayyyymm`` with the last month of the quarter."""
    return F.concat(
        F.lit("A"),
        quarter_year(quarter).cast("string"),
        F.lpad((quarter_number(quarter) * 3).cast("string"), 2, "0"),
    )


def product_id(contract_id, ic, from_region) -> Column:
    return F.concat_ws(":", col_of(contract_id), col_of(ic), col_of(from_region))


def category_id(ic, from_region) -> Column:
    return F.concat_ws("_", col_of(ic), col_of(from_region))


def fill_rate(units_sold, units_offered) -> Column:
    return col_of(units_sold).cast("double") / F.greatest(col_of(units_offered), F.lit(1))


def round_cents(value) -> Column:
    """``round(value, 2)`` of a double without building a decimal, except next to a tie."""
    value = as_column(value)
    scaled = value * 100.0
    nearest = F.rint(scaled)
    clear = (F.abs(F.abs(scaled - nearest) - 0.5) > 1e-5) & (F.abs(value) < 1e10)
    return F.when(clear, nearest / 100.0 + 0.0).otherwise(F.round(value, 2))


def percent_error(actual, predicted) -> Column:
    actual, predicted = as_column(actual), as_column(predicted)
    return (
        F.when((actual == 0) & (predicted == 0), F.lit(0.0))
        .when(actual == 0, F.lit(100.0))
        .otherwise(F.abs(F.try_divide(predicted - actual, actual)) * 100.0)
    )


def capped_error(actual, predicted, cap: float | None = None) -> Column:
    error = percent_error(actual, predicted)
    return error if cap is None else F.when(error > cap, F.lit(float(cap))).otherwise(error)


def arbitrage_fields(fair_value, market_price, units) -> Column:
    """Spread, premium and side of a fair value against a market price."""
    fair, market, units = as_column(fair_value), as_column(market_price), as_column(units)
    premium = F.coalesce(F.round(F.try_divide(fair - market, market) * 100.0, 1), F.lit(0.0))
    per_unit = F.round(fair - market, 2)
    return F.struct(
        per_unit.alias("arbitrage_per_unit_aud"),
        premium.alias("fair_premium_pct"),
        F.coalesce(F.round(F.try_divide(market, fair) * 100.0, 1), F.lit(0.0)).alias("market_share_of_fair_pct"),
        F.round(per_unit * units, 2).alias("arbitrage_total_aud"),
        F.when(premium >= 2.0, "LONG").when(premium <= -2.0, "SHORT").otherwise("NEUTRAL").alias("arbitrage_side"),
    )


def is_relevant(title, summary, keywords: Sequence[str] = tuple(NEWS_KEYWORDS)) -> Column:
    """Any keyword as a lower-case substring of title and summary."""
    text = F.lower(F.concat_ws(" ", col_of(title), col_of(summary)))
    hit = F.lit(False)
    for word in keywords:
        hit = hit | text.contains(word.lower())
    return hit


def action_label(charge_mw, discharge_mw, dead_band: float = 0.05) -> Column:
    net = col_of(discharge_mw) - col_of(charge_mw)
    return F.when(net > dead_band, "discharge").when(net < -dead_band, "charge").otherwise("idle")
