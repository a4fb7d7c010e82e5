"""Join helpers: group totals and NULL-safe equality.

No side is hinted or counted here: adaptive execution picks the join from the
sizes it meets, and splits skewed partitions of shuffle joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet; keys are taken from the left side."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in on], *[F.col(c) for c in right.columns if c not in on]
    )
    condition = F.lit(True)
    for key in on:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*[f"_r_{k}" for k in on])


def attach_group_total(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over ``keys`` on every row.

    Aggregates before joining, so a group with a third of the rows is combined
    on the map side instead of being gathered by a window.
    """
    totals = df.groupBy(*keys).agg(F.sum(value).alias(name))
    return df.join(totals, list(keys), "left")


def attach_group_size(df: DataFrame, keys: Sequence[str], name: str = "group_rows") -> DataFrame:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return df.join(sizes, list(keys), "left")


def exclude_existing(
    candidates: DataFrame, existing: DataFrame, on: Sequence[str], null_safe: bool = False
) -> DataFrame:
    """Rows of ``candidates`` whose key is not in ``existing``; with ``null_safe``, NULL key parts are equal."""
    if null_safe:
        return null_safe_join(candidates, existing.select(*on).distinct(), on, "left_anti")
    return candidates.join(existing.select(*on).distinct(), list(on), "left_anti")


def wanted_minus_existing(wanted: DataFrame, existing: DataFrame, on: Sequence[str]) -> DataFrame:
    """Outputs still to be built: an incremental job works on these only."""
    return exclude_existing(wanted.select(*on).distinct(), existing, on)


def align_flags(prices: DataFrame, flags: DataFrame, on: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Left join of event flags or activation factors, defaults where the flags have no row."""
    # One row per key: a repeated flag keeps its largest value and adds no rows.
    unique = flags.groupBy(*on).agg(*[F.max(c).alias(c) for c in defaults])
    joined = prices.join(unique, list(on), "left")
    filled = [F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()]
    return joined.select(*prices.columns, *filled)
