"""Wind summaries, all taken from counts per distinct speed so that no median gathers a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.wind import ALTITUDE_BANDS_M, SHEAR_ALPHA, SPEED_THRESHOLDS_MS, power_law_speed
from .joins import null_safe_join
from .ordering import as_columns, exact_quantiles, globally_ordered, neighbour, running, value_positions


def wind_annual(wind: DataFrame, speed: str = "ws10") -> DataFrame:
    """Mean, median, maximum, upper percentiles and hours above thresholds."""
    n, v = F.col("n"), F.col(speed)
    extra = [
        F.sum("n").alias("hours_total"),
        F.round(F.sum(v.cast("double") * n) / F.sum("n"), 3).alias("annual_mean_ms"),
        F.round(F.max(v), 3).alias("annual_max_ms"),
        *[
            F.sum(F.when(v >= t, n).otherwise(F.lit(0))).alias(f"hours_above_{t}ms")
            for t in (4, 6, 8, 10)
        ],
    ]
    stats = exact_quantiles(wind, [], speed, {"_p50": 0.5, "_p75": 0.75, "_p90": 0.9}, extra=extra)
    return stats.select(
        "annual_mean_ms",
        F.round("_p50", 3).alias("annual_median_ms"),
        "annual_max_ms",
        F.round("_p75", 3).alias("annual_p75_ms"),
        F.round("_p90", 3).alias("annual_p90_ms"),
        "hours_total",
        "hours_above_4ms", "hours_above_6ms", "hours_above_8ms", "hours_above_10ms",
    )


def wind_monthly(wind: DataFrame, ts: str = "timestamp", speed: str = "ws10") -> DataFrame:
    """Mean, median, maximum and sample deviation per calendar month."""
    keyed = wind.select(F.month(ts).alias("month"), F.col(speed).cast("double").alias(speed))
    medians = exact_quantiles(keyed, ["month"], speed, {"median": 0.5})
    moments = keyed.groupBy("month").agg(
        F.round(F.avg(speed), 3).alias("mean"), F.round(F.max(speed), 3).alias("max"),
        F.round(F.stddev_samp(speed), 3).alias("std"),
    )
    return null_safe_join(moments, medians, ["month"]).select(
        "month", "mean", F.round("median", 3).alias("median"), "max", "std"
    )


def threshold_table(
    wind: DataFrame,
    speed: str = "ws10",
    reference_m: int = 10,
    bands: Sequence[int] = tuple(ALTITUDE_BANDS_M),
    thresholds: Sequence[int] = tuple(SPEED_THRESHOLDS_MS),
    alpha: float = SHEAR_ALPHA,
) -> DataFrame:
    """Mean, median and hours above thresholds per altitude.

    The shear law keeps the order of speeds, so the position of each distinct
    reference speed serves every altitude; only the distinct values are spread
    over the altitudes.
    """
    counts = value_positions(wind, [], speed)
    spread = counts.select("*", F.explode(F.array(*[F.lit(z) for z in bands])).alias("altitude_m"))
    scaled = F.when(F.col("altitude_m") == reference_m, F.col(speed).cast("double")).otherwise(
        power_law_speed(F.col(speed).cast("double"), reference_m, F.col("altitude_m").cast("double"), alpha)
    )
    spread = spread.withColumn("_z", scaled)
    start, upto, total = F.col("upto") - F.col("n"), F.col("upto"), F.col("total")
    low, high = F.floor((total - 1) / 2), F.ceil((total - 1) / 2)
    stats = spread.groupBy("altitude_m").agg(
        F.round(F.sum(F.col("_z") * F.col("n")) / F.sum("n"), 2).alias("annual_mean_ms"),
        F.round(
            (
                F.max(F.when((start <= low) & (low < upto), F.col("_z")))
                + F.max(F.when((start <= high) & (high < upto), F.col("_z")))
            )
            / 2,
            2,
        ).alias("annual_p50_ms"),
        F.max("total").alias("_hours"),
        *[F.sum(F.when(F.col("_z") >= t, F.col("n")).otherwise(F.lit(0))).alias(f"hrs_above_{t}ms") for t in thresholds],
    )
    return stats.select(
        "altitude_m", "annual_mean_ms", "annual_p50_ms",
        *[F.col(f"hrs_above_{t}ms") for t in thresholds],
        *[F.round(F.col(f"hrs_above_{t}ms") / F.col("_hours") * 100, 1).alias(f"pct_above_{t}ms") for t in thresholds],
    )


def monthly_altitude_means(
    wind: DataFrame,
    ts: str = "timestamp",
    speed: str = "ws10",
    reference_m: int = 10,
    bands: Sequence[int] = tuple(ALTITUDE_BANDS_M),
    alpha: float = SHEAR_ALPHA,
) -> DataFrame:
    """Mean speed per month, one column per altitude: one aggregation, since the shear law is a factor per altitude."""
    means = wind.groupBy(F.month(ts).alias("month")).agg(F.avg(F.col(speed).cast("double")).alias("_mean"))
    return means.select(
        "month",
        *[
            F.round(
                F.col("_mean") if z == reference_m else power_law_speed(F.col("_mean"), reference_m, F.lit(float(z)), alpha), 2
            ).alias(f"ws_{z}m")
            for z in bands
        ],
    )


def altitude_profile(
    wind: DataFrame, speed: str = "ws10", reference_m: int = 10, bands: Sequence[int] = tuple(ALTITUDE_BANDS_M),
    alpha: float = SHEAR_ALPHA,
) -> DataFrame:
    """The series with one column per altitude."""
    return wind.select(
        "*",
        *[
            (F.col(speed) if z == reference_m else power_law_speed(F.col(speed), reference_m, F.lit(float(z)), alpha)).alias(
                f"ws_{z}m"
            )
            for z in bands
        ],
    )


def time_gaps(series: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str] = ()) -> DataFrame:
    """Gap to the previous row in seconds."""
    gapped = neighbour(series, keys, [ts, *order], {"_previous": (ts, -1)})
    seconds = (
        F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_previous").cast("timestamp"))
    ) / 1000000.0
    return gapped.withColumn("gap_seconds", seconds).drop("_previous")


def gap_report(series: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp", order: Sequence[str] = ()) -> DataFrame:
    """Most frequent step and the number of steps that differ from it."""
    counts = (
        time_gaps(series, keys, ts, order)
        .where(F.col("gap_seconds").isNotNull())
        .groupBy(*keys, "gap_seconds")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grouped = counts.groupBy(*keys).agg(
        # Equal counts: the smallest step, as the first mode.
        F.min_by(F.struct("gap_seconds", "n"), F.struct((-F.col("n")).alias("a"), F.col("gap_seconds"))).alias("_m"),
        F.sum("n").alias("steps"),
    )
    return grouped.select(
        *keys, F.col("_m.gap_seconds").alias("expected_step_seconds"), "steps",
        (F.col("steps") - F.col("_m.n")).alias("bad_gaps"),
    )


def clean_speed(wind: DataFrame, speed: str = "ws10") -> DataFrame:
    """Negative speeds set to zero."""
    return wind.withColumn(speed, F.when(F.col(speed) < 0, F.lit(0.0)).otherwise(F.col(speed)))


def interpolate_time(
    series: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp", value: str = "ws10", order: Sequence[str] = ()
) -> DataFrame:
    """Missing values filled linearly in time; nothing before the first value, the last one carried to the end."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(value).cast("double").alias("v")))
    tie = as_columns(order)
    forward = globally_ordered(series.withColumn("_known", known), [*keys, ts, *tie])
    with_before = running(forward, keys, {"_before": ("last", "_known")}).drop("_part", "_pos")
    backward = globally_ordered(with_before, [*keys, F.col(ts).desc(), *[c.desc() for c in tie]])
    both = running(backward, keys, {"_after": ("last", "_known")})

    def micros(c):
        return F.unix_micros(c.cast("timestamp")).cast("double")

    t0, t1, t = micros(F.col("_before.t")), micros(F.col("_after.t")), micros(F.col(ts))
    mixed = F.col("_before.v") + (F.col("_after.v") - F.col("_before.v")) * F.try_divide(t - t0, t1 - t0)
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value).cast("double"))
        .when(F.col("_before").isNull(), F.lit(None).cast("double"))
        .when(F.col("_after").isNull(), F.col("_before.v"))
        .otherwise(mixed)
    )
    return both.select(*[c for c in series.columns if c != value], filled.alias(value))
