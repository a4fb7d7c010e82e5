"""Selections and unions that market tables share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.market import category_id
from .versions import top_per_key


def select_rows(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose named columns equal the given values; None leaves a column open.

    The conditions reach the scan of a file that has the columns.
    """
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def union_by_key(
    frames: Sequence[DataFrame], keys: Sequence[str], later_wins: bool = True, within: Sequence[str] = ()
) -> DataFrame:
    """One row per key from several frames of one schema: that of the last frame (or of the first) which has it.

    ``within`` orders the rows of one frame; the first stays. NULL keys are equal.
    """
    merged: DataFrame | None = None
    for place, frame in enumerate(frames):
        part = frame.withColumn("_frame", F.lit(-place if later_wins else place))
        merged = part if merged is None else merged.unionByName(part)
    if merged is None:
        raise ValueError("at least one frame is needed")
    rest = [c for c in merged.columns if c not in ("_frame", *keys, *within)]
    return top_per_key(merged, list(keys), ["_frame", *within, *rest]).drop("_frame")


def products_of(auction: DataFrame) -> DataFrame:
    """Products that auction rows speak of: one per interconnector, source region and contract.

    With the ids, the region at the other end (empty where the interconnector
    has no two ends), the quarter and tranche of the contract, the most units
    offered and the share that one of them is (0 where none is).
    """
    keys = ["interconnector_id", "from_region", "contract_id"]
    found = auction.groupBy(*keys).agg(
        F.max("units_offered").alias("max_units"), F.min("quarter").alias("quarter"), F.min("tranche_no").alias("tranche_no")
    )
    ends = F.split("interconnector_id", "-", 2)
    other = F.when(F.size(ends) < 2, F.lit("")).when(F.col("from_region") == F.get(ends, 0), F.get(ends, 1)).otherwise(F.get(ends, 0))
    return found.select(
        F.concat_ws("_", "interconnector_id", "contract_id", "from_region").alias("product_id"),
        category_id("interconnector_id", "from_region").alias("unit_category_id"), *keys, other.alias("to_region"),
        "quarter", "tranche_no", F.lit("PRIMARY").alias("allocation_type"), "max_units",
        F.when(F.col("max_units") != 0, 1.0 / F.col("max_units")).otherwise(F.lit(0.0)).alias("unit_proportion"),
    )


def calendar_of(auction: DataFrame) -> DataFrame:
    """One auction event per contract: its id, quarter and tranche, how many products it offers and their units."""
    return products_of(auction).groupBy("contract_id").agg(
        F.concat(F.first("contract_id"), F.lit("_v1")).alias("auction_id"), F.min("quarter").alias("quarter"),
        F.min("tranche_no").alias("tranche_no"), F.count(F.lit(1)).alias("products"), F.sum("max_units").alias("max_units"),
    )
