"""Network-deferral sites: latest figures, nearest factors, leaderboards."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_KM as EARTH_KM
from ..functions.geo import KM_PER_DEGREE, haversine_km
from ..functions.network import (
    contract_term,
    deferral_value,
    deficit_and_sizing,
    network_region,
    network_state,
)
from ..session import materialised
from .versions import latest_version, top_per_key


def latest_year_rows(rows: DataFrame, year: str = "year") -> DataFrame:
    """Rows of the newest year in the table."""
    newest = rows.agg(F.max(year).alias(year))
    # One row by construction.
    return rows.join(F.broadcast(newest), year, "left_semi")


def latest_per_asset(rows: DataFrame, asset: str = "asset_code", year: str = "year", tie_break: Sequence[str] = ()) -> DataFrame:
    return latest_version(rows, [asset], [year, *tie_break])


def assets_with_latest(assets: DataFrame, deferral: DataFrame, capacity: DataFrame) -> DataFrame:
    """Assets with the newest published deferral value and capacity, falling back to their own figures."""
    values = latest_year_rows(deferral).select("asset_code", F.col("annual_deferral_aud").alias("_adv"))
    limits = latest_per_asset(capacity).select(
        "asset_code",
        F.col("capacity").alias("_cap"),
        F.col("load").alias("_load"),
        F.col("available_capacity").alias("_avail"),
    )
    joined = assets.join(values, "asset_code", "left").join(limits, "asset_code", "left")
    replaced = {
        "annual_deferral_aud": "_adv", "capacity_mva": "_cap", "peak_demand_mva": "_load", "available_mva": "_avail",
    }
    return joined.select(
        *[
            F.coalesce(F.col(replaced[c]), F.col(c).cast("double")).alias(c) if c in replaced else F.col(c)
            for c in assets.columns
        ]
    )


def site_economics(assets: DataFrame, current_year: int) -> DataFrame:
    """Deferral value, deficit, sizing and contract term; only rows with coordinates."""
    cost = F.coalesce(F.col("aug_cost_aud").cast("double"), F.lit(0.0))
    staged = assets.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).withColumn(
        "aug_cost_aud", cost
    )
    staged = staged.withColumn("deferrable_m", F.col("aug_cost_aud") / 1000000.0)
    state = F.coalesce("state", network_state("network")) if "state" in assets.columns else network_state("network")
    return staged.select(
        *[c for c in staged.columns if c != "state"],
        state.alias("state"),
        network_region("network").alias("nem_region"),
        deferral_value("annual_deferral_aud", "aug_cost_aud").alias("adv_real"),
        contract_term("proposed_timing", current_year).alias("nna_term_yrs"),
        deficit_and_sizing("available_mva", "deferrable_m").alias("_s"),
    ).select("*", "_s.*").drop("_s")


def nearest_factor(
    points: DataFrame,
    references: DataFrame,
    max_km: float = 100.0,
    keys: Sequence[str] = ("region",),
    factor: str = "factor",
    default: float = 1.0,
    tie_break: Sequence[str] = (),
    leaf: int = 16,
) -> DataFrame:
    """Factor of the nearest reference of the same region within ``max_km``, else ``default``.

    References are held in cubes of space (so neither poles nor the date line
    matter), and cubes of more than ``leaf`` references are cut until none is.
    A distinct location starts with the cubes that ``max_km`` reaches. In each
    turn it keeps those that can hold something nearer than the nearest one it
    knows of; small ones are compared, large ones cut. So a location meets a
    few cubes a turn however many references stand close together, and copies
    of a location are collapsed before and restored after.
    """
    where = [*keys, "latitude", "longitude"]
    rank = F.struct(*(tie_break or [factor]))
    refs = _in_space(
        references.where(F.col(factor).isNotNull())
        .groupBy(*where)
        .agg(F.min(F.struct(rank.alias("rank"), F.col(factor).alias("factor"))).alias("_ref")),
        "latitude", "longitude",
    ).withColumnsRenamed({"latitude": "_lat", "longitude": "_lon"})
    spots = points.select(*where).where("latitude IS NOT NULL AND longitude IS NOT NULL").distinct()
    spots = _in_space(spots, "latitude", "longitude")
    reach = 2 * EARTH_KM * math.sin(min(max_km, math.pi * EARTH_KM) / (2 * EARTH_KM)) * (1 + 1e-9) + 1e-6
    level = max(0, math.floor(math.log2(2 * EARTH_KM / reach)))
    # Cubes as wide as the reach: those around a location's own are all it can need.
    offsets = F.array(*[F.lit(d) for d in ((-1, 0, 1) if level else (0,))])
    placed = refs.select("*", *_cube(level, *SPACE))
    open_spots = spots.withColumn("_known", F.lit(reach)).select("*", *_cube(level, *SPACE))
    for axis in CUBE:
        open_spots = open_spots.withColumn("_d", F.explode(offsets)).withColumn(axis, F.col(axis) + F.col("_d")).drop("_d")
    found: DataFrame | None = None
    while True:
        cubes = placed.groupBy(*keys, *CUBE).agg(
            F.count(F.lit(1)).alias("_n"), F.min(F.struct("_x", "_y", "_z")).alias("_one")
        )
        met = open_spots.join(cubes, [*keys, *CUBE])
        side = 2 * EARTH_KM / 2**level
        gap = [
            F.greatest(F.lit(0.0), F.col(c) * side - EARTH_KM - F.col(x), F.col(x) - (F.col(c) + 1) * side + EARTH_KM)
            for c, x in zip(CUBE, SPACE)
        ]
        met = met.withColumn("_least", _length(gap)).withColumn(
            "_most", _length([F.col(f"_one.{x}") - F.col(x) for x in SPACE])
        )
        nearest = met.groupBy(*where).agg(F.least(F.min("_most"), F.min("_known")).alias("_best"))
        candidates = materialised(
            met.join(nearest, where).where(F.col("_least") <= F.col("_best") * (1 + 1e-9) + 1e-6)
            .select(*where, *SPACE, F.col("_best").alias("_known"), *CUBE, "_n")
        )
        near = candidates.where(F.col("_n") <= leaf).select(*where, *CUBE).join(placed.select(
            *keys, *CUBE, "_lat", "_lon", "_ref"), [*keys, *CUBE])
        distance = haversine_km(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon"))
        hits = near.withColumn("_d", distance).where(F.col("_d") <= max_km).groupBy(*where).agg(
            F.min(F.struct(F.col("_d").alias("km"), F.col("_ref").alias("ref"))).alias("_hit")
        )
        found = hits if found is None else found.unionByName(hits)
        large = candidates.where(F.col("_n") > leaf)
        if level >= DEEPEST or large.isEmpty():
            break
        # The cubes that are still wanted, and their references, go down two levels.
        wanted = large.select(*keys, *CUBE).distinct()
        placed = materialised(placed.join(wanted, [*keys, *CUBE], "left_semi").drop(*CUBE).select("*", *_cube(level + 2, *SPACE)))
        quarters = F.array(*[F.lit(d) for d in range(4)])
        open_spots = large.select(*where, *SPACE, "_known", *CUBE)
        for axis in CUBE:
            open_spots = open_spots.withColumn("_d", F.explode(quarters)).withColumn(axis, F.col(axis) * 4 + F.col("_d")).drop("_d")
        level += 2
        if level >= DEEPEST:
            # Below a millimetre nothing is cut any more.
            leaf = 1 << 62
    best = found.groupBy(*where).agg(F.min("_hit").alias("_best")).select(
        *where, F.col("_best.ref.factor").alias("_factor"), F.col("_best.km").alias("_km")
    )
    joined = points.join(best, list(where), "left")
    return joined.select(
        *points.columns, F.coalesce(F.col("_factor"), F.lit(default)).alias(factor), F.col("_km").alias("distance_km")
    )


SPACE, CUBE = ("_x", "_y", "_z"), ("_cx", "_cy", "_cz")
#: Cubes of this level are narrower than a millimetre.
DEEPEST = 34


def _in_space(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Kilometres from the centre of the earth along three axes."""
    phi, theta = F.radians(lat), F.radians(lon)
    return df.withColumns({
        "_x": EARTH_KM * F.cos(phi) * F.cos(theta), "_y": EARTH_KM * F.cos(phi) * F.sin(theta), "_z": EARTH_KM * F.sin(phi),
    })


def _cube(level: int, *axes: str) -> list[Column]:
    """The cube of a level that holds a place; the surface belongs to the last one."""
    side = 2 * EARTH_KM / 2**level
    return [
        F.greatest(F.lit(0), F.least(F.lit(2**level - 1), F.floor((F.col(x) + EARTH_KM) / side))).cast("long").alias(c)
        for x, c in zip(axes, CUBE)
    ]


def _length(parts: Sequence[Column]) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def combined_loss_factor(points: DataFrame, transmission: DataFrame, distribution: DataFrame, max_km: float = 100.0) -> DataFrame:
    """Product of the nearest transmission and distribution factors."""
    first = nearest_factor(points, transmission, max_km).withColumnsRenamed({"factor": "mlf"}).drop("distance_km")
    second = nearest_factor(first, distribution, max_km).withColumnsRenamed({"factor": "dlf"}).drop("distance_km")
    return (
        second.withColumn("mlf", F.round("mlf", 4))
        .withColumn("dlf", F.round("dlf", 4))
        .withColumn("combined_lf", F.round(F.col("mlf") * F.col("dlf"), 4))
    )


def with_distance(sites: DataFrame, lat: float, lon: float) -> DataFrame:
    return sites.withColumn(
        "distance_km", F.round(haversine_km(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude")), 1)
    )


def within_radius(sites: DataFrame, lat: float, lon: float, radius_km: float) -> DataFrame:
    """Sites not farther than ``radius_km``; a latitude band is tested first and reaches the scan."""
    reach = radius_km / KM_PER_DEGREE * 1.01
    banded = sites.where(F.col("latitude").between(lat - reach, lat + reach))
    return with_distance(banded, lat, lon).where(
        haversine_km(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude")) <= radius_km
    )


def filter_sites(
    sites: DataFrame, networks: Sequence[str] | None = None, states: Sequence[str] | None = None, published_only: bool = False
) -> DataFrame:
    kept = sites.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    if networks:
        kept = kept.where(F.col("network").isin(*networks))
    if states:
        kept = kept.where(F.col("state").isin(*states))
    if published_only:
        kept = kept.where(F.col("annual_deferral_aud") > 0)
    return kept


def leaderboards(
    sites: DataFrame, lat: float, lon: float, state: str, id_column: str = "asset_code", radius_km: float = 10.0
) -> DataFrame:
    """Nearby, state, national and value-per-MW boards in one table (``board``, ``place``)."""
    ranked = with_distance(sites, lat, lon)
    by_value = [F.col("adv_real").desc(), F.col("deferrable_m").desc(), F.col(id_column)]
    per_mw = F.when(F.col("ideal_bess_mw") > 0, F.col("adv_real") / F.col("ideal_bess_mw"))

    def board(name: str, rows: DataFrame, order, n: int) -> DataFrame:
        return rows.orderBy(*order).limit(n).select(F.lit(name).alias("board"), "*")

    boards = [
        board("nearby", ranked.where(F.col("distance_km") <= radius_km), by_value, 5),
        board("state", ranked.where(F.col("state") == state), by_value, 10),
        board("national", ranked, by_value, 5),
        board("per_mw", ranked.where(per_mw.isNotNull()), [per_mw.desc(), F.col(id_column)], 10),
    ]
    combined = boards[0]
    for extra in boards[1:]:
        combined = combined.unionByName(extra)
    return combined


def leaderboard_metrics(sites: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sites.groupBy(*by).agg(
        F.round(F.sum(F.col("aug_cost_aud").cast("decimal(28,6)")), 2).cast("double").alias("total_cost_aud"),
        F.round(F.sum(F.col("adv_real").cast("decimal(28,6)")), 2).cast("double").alias("total_adv_aud"),
        F.round(F.avg("combined_lf"), 4).alias("mean_combined_lf"),
    )


def merge_registers(
    registers: Sequence[DataFrame], id_column: str = "id", load_order: Sequence[str] = ()
) -> DataFrame:
    """Union of provider registers; the first provider wins for an id.

    Within a provider the first row by ``load_order`` wins, and among rows that
    it leaves equal the smallest.
    """
    merged: DataFrame | None = None
    for order, register in enumerate(registers):
        part = register.withColumn("_provider", F.lit(order))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    rest = [c for c in merged.columns if c not in ("_provider", id_column)]
    return top_per_key(merged, [id_column], ["_provider", *load_order, *[c for c in rest if c not in load_order]]).drop("_provider")
