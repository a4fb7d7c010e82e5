"""Constraint checks that return the failing rows with their messages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def failing_rows(
    df: DataFrame, rules: Mapping[str, Column], id_columns: Sequence[str], unique: Sequence[str] = ()
) -> DataFrame:
    """Rows breaking any rule. ``rules`` maps a message to the condition that must hold.

    A NULL condition counts as broken. ``unique`` adds a duplicate-id check.
    """
    messages = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for message, ok in rules.items()]
    if unique:
        repeated = (
            df.groupBy(*unique).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*unique, F.lit(True).alias("_dup"))
        )
        df = df.join(repeated, list(unique), "left")
        messages.append(F.when(F.col("_dup"), F.lit(f"duplicate {', '.join(unique)}")))
    checked = df.select(*id_columns, F.array_compact(F.array(*messages)).alias("messages"))
    return checked.where(F.size("messages") > 0)


def product_rules() -> dict[str, Column]:
    return {
        "tranche_no must be 1..12": F.col("tranche_no").between(1, 12),
        "max_units must be > 0": F.col("max_units") > 0,
        "unit_proportion must be between 0 and 1": (F.col("unit_proportion") > 0) & (F.col("unit_proportion") < 1),
    }


def position_rules() -> dict[str, Column]:
    return {
        "units_held must be >= 0": F.col("units_held") >= 0,
        "acquisition_price_per_unit must be >= 0": F.col("acquisition_price_per_unit") >= 0,
    }


def input_rules() -> dict[str, Column]:
    return {
        "confidence_level must be between 0 and 1": (F.col("confidence_level") > 0) & (F.col("confidence_level") < 1),
        "model_risk_discount must be in [0, 1)": (F.col("model_risk_discount") >= 0) & (F.col("model_risk_discount") < 1),
        "liquidity_discount must be in [0, 1)": (F.col("liquidity_discount") >= 0) & (F.col("liquidity_discount") < 1),
    }


def order_rules() -> dict[str, Column]:
    return {
        "quantity must be > 0": F.col("quantity") > 0,
        "price cannot be negative": F.col("price") >= 0,
        "product_id required": F.length(F.coalesce("product_id", F.lit(""))) > 0,
        "auction_id required": F.length(F.coalesce("auction_id", F.lit(""))) > 0,
    }


def mark_rules() -> dict[str, Column]:
    return {
        "Bid mark cannot exceed mid mark": F.col("bid_mark") <= F.col("mid_mark"),
        "Mid mark cannot exceed offer mark": F.col("mid_mark") <= F.col("offer_mark"),
        "Confidence score must be 0-100": F.col("confidence_score").between(0, 100),
        "Model risk discount must be 0-1": F.col("model_risk_discount").between(0, 1),
        "Liquidity discount must be 0-1": F.col("liquidity_discount").between(0, 1),
    }
