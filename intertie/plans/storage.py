"""Price signals and ancillary-service stacks for a storage asset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fcas import StackConfig, fcas_costack, fcas_direction_priority
from ..functions.valuation import dynamic_thresholds
from ..operators import signals


def decision_inputs(prices: DataFrame, forecast: DataFrame | None = None) -> DataFrame:
    """Deduplicated prices with signals, optionally overlaid by a forecast, and the bent thresholds."""
    unique = signals.first_per_timestamp(prices, ["region"], "timestamp", ["source_file"])
    enriched = signals.price_signals(unique)
    if forecast is not None:
        enriched = signals.overlay_forecast(enriched, forecast, keys=["region"])
    bent = dynamic_thresholds(
        "price_mwh", "adaptive_charge_threshold", "adaptive_discharge_threshold", "price_trend", "forward_max_price",
        has_forward="has_forward",
    )
    return enriched.withColumn("_t", bent).select(*enriched.columns, "_t.*")


def service_stacks(
    intervals: DataFrame, rated_mw: float, energy_mwh: float, config: StackConfig = StackConfig()
) -> DataFrame:
    """Raise and lower stacks within the shared budget, at the state of charge given per row.

    ``intervals`` holds the service prices, ``raise_headroom_mw``,
    ``lower_headroom_mw`` and ``soc_fraction``.
    """
    soc, energy, rated = F.col("soc_fraction"), F.lit(energy_mwh), F.lit(rated_mw)
    up = fcas_costack(intervals, "raise", F.col("raise_headroom_mw"), soc, energy, rated, config)
    both = fcas_costack(up, "lower", F.col("lower_headroom_mw"), soc, energy, rated, config)
    return fcas_direction_priority(both, F.least("raise_headroom_mw", "lower_headroom_mw"), config)
