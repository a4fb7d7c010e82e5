"""Rolling price signals and forecast overlays."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.api.indexers import BaseIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import with_package
from .ordering import CHUNK, INDEX, OWN, globally_ordered, running, with_halo
from .versions import look_up, top_per_key


def trend_signal(delta: Column, flat_band: float, saturation: float) -> Column:
    """Price move scaled to -1..1, 0 inside the flat band."""
    return F.when(F.abs(delta) < flat_band, F.lit(0.0)).when(
        delta.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), delta / saturation))
    )


class _Frames(BaseIndexer):
    """Row frames ``start[i]`` to ``end[i]``; both never go back."""

    def __init__(self, start: np.ndarray, end: np.ndarray) -> None:
        super().__init__()
        self.start, self.end = start, end

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.start, self.end


def _runs(rows: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """For every row the first row of its key's run and the row after the last."""
    n = rows.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for key in keys:
        codes = rows.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, n))
    return np.repeat(starts, lengths), np.repeat(starts + lengths, lengths)


def _frame_values(v: np.ndarray, start: np.ndarray, width: int, end: np.ndarray) -> np.ndarray:
    """Values of short frames, one row each, missing ones NaN."""
    place = start[:, None] + np.arange(width)
    return np.where(place < end[:, None], v[np.minimum(place, len(v) - 1)], np.nan)


FRAME_COLUMNS = {
    "_n_ahead": "long", "_max": "double", "_min": "double", "_mean": "double", "_high": "double",
    "_n_recent": "long", "_std": "double", "_n_day": "long", "_low": "double",
}


def _frames(
    chunks: DataFrame, columns: Sequence[str], keys: Sequence[str], lookahead: int, lookback: int, backcast: int,
    high: float, low: float,
) -> DataFrame:
    """``columns`` and the frame values of every own row of chunks with their halo.

    Order statistics slide along the frames: a value enters and one leaves for
    every row, so no frame is gathered or sorted.
    """
    own = [chunks.schema[c] for c in columns]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), *(f"{n} {t}" for n, t in FRAME_COLUMNS.items())])

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(INDEX)
        n = rows.num_rows
        first, after = _runs(rows, keys)
        v = rows.column("_v").to_numpy().astype(float)
        at = np.arange(n)
        series = pd.Series(v)

        def quantile(start: np.ndarray, end: np.ndarray, fraction: float) -> np.ndarray:
            return series.rolling(_Frames(start, end), min_periods=1).quantile(fraction).to_numpy()

        ahead = at + 1, np.minimum(at + 1 + lookahead, after)
        recent = np.maximum(first, at - lookback), at + 1
        day = np.maximum(first, at - backcast), at + 1
        with warnings.catch_warnings():
            # Frames without values give NaN, which is what is wanted.
            warnings.simplefilter("ignore", RuntimeWarning)
            later = _frame_values(v, ahead[0], lookahead, ahead[1])
            found = [
                ahead[1] - ahead[0], np.nanmax(later, axis=1), np.nanmin(later, axis=1), np.nanmean(later, axis=1),
                quantile(*ahead, high), recent[1] - recent[0],
                np.nanstd(_frame_values(v, recent[0], lookback + 1, recent[1]), axis=1),
                day[1] - day[0], quantile(*day, low),
            ]
        arrays = [pa.array(f, pa.int64()) if t == "long" else pa.array(f, pa.float64(), from_pandas=True)
                  for f, t in zip(found, FRAME_COLUMNS.values())]
        table = rows.select(list(columns))
        for name, array in zip(FRAME_COLUMNS, arrays):
            table = table.append_column(name, array)
        return table.filter(rows.column(OWN))

    with_package(chunks.sparkSession)
    kept = chunks.select(*dict.fromkeys([CHUNK, INDEX, OWN, "_v", *columns, *keys]))
    return kept.groupBy(CHUNK).applyInArrow(work, schema)


def price_signals(
    prices: DataFrame,
    keys: Sequence[str] = ("region",),
    ts: str = "timestamp",
    price: str = "price_mwh",
    tie_break: Sequence[str] = (),
    lookahead: int = 36,
    lookback: int = 12,
    backcast: int = 288,
    discharge_percentile: float = 75.0,
    charge_percentile: float = 25.0,
    discharge_threshold: float = 100.0,
    charge_threshold: float = 50.0,
    roundtrip_eff: float = 0.90,
    flat_band: float = 5.0,
    saturation: float = 50.0,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Nine look-ahead and look-back signals per row of a price series.

    Frames count rows. The series is cut into chunks with a halo of
    ``backcast`` rows before and ``lookahead`` rows after, so one long series
    spreads over the cluster. Chunks are handed to workers as Arrow tables.
    """
    narrow = prices.select(*dict.fromkeys([*keys, ts, price, *tie_break]))
    ordered = globally_ordered(narrow, [*keys, ts, *tie_break])
    chunks = with_halo(ordered, max(lookback, backcast), lookahead, chunk_rows)
    value = F.col(price).cast("double")
    value = F.when(~F.isnan(value), value)
    chunks = chunks.withColumn("_v", value)
    v = F.col("_v")
    staged = _frames(
        chunks, [*narrow.columns, "_v"], keys, lookahead, lookback, backcast, discharge_percentile / 100.0,
        charge_percentile / 100.0,
    )
    high, low = F.col("_high"), F.col("_low")
    static = max(0.0, (discharge_threshold + charge_threshold) / 2.0)
    has_ahead = F.col("_n_ahead") > 0
    delta = F.col("_mean") - v
    return staged.select(
        *narrow.columns,
        F.when(has_ahead, F.greatest(F.lit(0.0), F.col("_max") * roundtrip_eff)).otherwise(F.lit(static)).alias(
            "stored_energy_value"
        ),
        F.when(has_ahead & delta.isNotNull(), trend_signal(delta, flat_band, saturation)).otherwise(F.lit(0.0)).alias(
            "price_trend"
        ),
        F.coalesce(F.col("_min") < 0, F.lit(False)).alias("neg_price_ahead"),
        F.when(F.col("_n_recent") > 1, F.coalesce("_std", F.lit(0.0))).otherwise(F.lit(0.0)).alias("volatility"),
        F.when(has_ahead, F.col("_max")).otherwise(F.coalesce(v, F.lit(static))).alias("forward_max_price"),
        F.when(has_ahead, F.col("_min")).otherwise(F.coalesce(v, F.lit(0.0))).alias("forward_min_price"),
        F.when(has_ahead, F.col("_mean")).otherwise(F.coalesce(v, F.lit(static))).alias("forward_mean_price"),
        F.when(F.col("_n_ahead") > 2, high).otherwise(F.lit(discharge_threshold)).alias(
            "adaptive_discharge_threshold"
        ),
        F.when(F.col("_n_day") > 2, low).otherwise(F.lit(charge_threshold)).alias(
            "adaptive_charge_threshold"
        ),
        has_ahead.alias("has_forward"),
    )


def overlay_forecast(
    signals: DataFrame,
    forecast: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "timestamp",
    price: str = "price_mwh",
    tie_break: Sequence[str] = (),
    roundtrip_eff: float = 0.90,
) -> DataFrame:
    """Replace signals by those of all forecast points later than the row, where there are at least two.

    What follows each forecast time is summed once along the order of the
    times; a row then looks up the first of them that is later. Signals are
    neither ordered nor stored. ``tie_break`` is not needed any more.
    """
    point = F.col(price).cast("double")
    exact = point.cast("decimal(28,8)")
    times = forecast.where(F.col(ts).isNotNull()).groupBy(*keys, F.col(ts).alias("_time")).agg(
        F.count(point).alias("_c"), F.sum(exact).alias("_e"), F.max(point).alias("_h"), F.min(point).alias("_l")
    )
    # From the last time backwards, so that every time knows what follows from it on.
    folds = {"_n": ("sum", "_c"), "_s": ("sum", "_e"), "_max": ("max", "_h"), "_min": ("min", "_l")}
    ordered = globally_ordered(times, [*keys, F.col("_time").desc()])
    ranked = running(ordered, keys, {**folds, "_upto": ("count", F.lit(1))}).select(
        *keys, "_time", F.struct(*folds).alias("_found"), (F.col("_upto") - 1).alias("_rank")
    )
    looked = look_up(signals, ranked, keys, ts, "_time", "_found", lambda begins, t: begins > t)
    later = looked.select(F.struct(*signals.columns).alias("_row"), "_found.*")
    enough = F.col("_n") >= 2
    mean = F.col("_s").cast("double") / F.col("_n")
    replaced = {
        "stored_energy_value": F.greatest(F.lit(0.0), F.col("_max") * roundtrip_eff),
        "forward_max_price": F.col("_max"),
        "forward_min_price": F.col("_min"),
        "forward_mean_price": mean,
        "neg_price_ahead": F.col("_min") < 0,
    }
    if price in signals.columns:
        spot = F.col(f"_row.{price}").cast("double")
        replaced["price_trend"] = F.coalesce(trend_signal(mean - spot, 5.0, 50.0), F.col("_row.price_trend"))
    return later.select(
        *[
            F.when(enough, replaced[c]).otherwise(F.col(f"_row.{c}")).alias(c) if c in replaced
            else F.col(f"_row.{c}").alias(c)
            for c in signals.columns
        ]
    )


def merge_forward_forecasts(near: DataFrame, far: DataFrame, keys: Sequence[str] = ("region",), ts: str = "timestamp") -> DataFrame:
    """The near forecast, continued by the far one after the last near point."""
    if not keys:
        last = near.agg(F.max(ts)).first()[0]
        return near.unionByName(far if last is None else far.where(F.col(ts) > F.lit(last)))
    last = near.groupBy(*keys).agg(F.max(ts).alias("_last"))
    tail = far.join(last, list(keys), "left").where(F.col("_last").isNull() | (F.col(ts) > F.col("_last")))
    return near.unionByName(tail.select(*far.columns))


def first_per_timestamp(rows: DataFrame, keys: Sequence[str], ts: str, load_order: Sequence[str]) -> DataFrame:
    """Duplicate timestamps dropped, the first loaded row kept."""
    return top_per_key(rows, [*keys, ts], load_order)


def last_days(rows: DataFrame, ts: str, now, days: int) -> DataFrame:
    return rows.where(F.col(ts) >= F.lit(now) - F.make_dt_interval(F.lit(days)))


def last_rows(rows: DataFrame, order: Sequence[str], n: int = 288) -> DataFrame:
    """The ``n`` newest rows."""
    return rows.orderBy(*[F.col(c).desc() for c in order]).limit(n)
