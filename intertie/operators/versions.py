"""Versioned rows: the latest, the first, the best, and values as of a date.

Picking one row per key is written as ``row_number() = 1``: Spark keeps at most
one row per key and map task before the shuffle (WindowGroupLimit), so a hot
key does not travel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised
from .ordering import as_columns, globally_ordered, running


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int = 1) -> DataFrame:
    """First ``n`` rows per key in ``order`` (give a total order)."""
    window = Window.partitionBy(*keys).orderBy(*as_columns(order))
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def latest_version(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Row with the highest version per key; later entries of ``version`` break ties."""
    return top_per_key(df, keys, [F.col(c).desc() for c in version])


def first_occurrence(df: DataFrame, keys: Sequence[str], load_order: Sequence[str | Column]) -> DataFrame:
    return top_per_key(df, keys, load_order)


def latest_non_null(df: DataFrame, keys: Sequence[str], version: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per key and column, the value of the latest version that is not NULL."""
    order = F.struct(*version)
    return df.groupBy(*keys).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in values]
    )


def final_period_rows(
    rows: DataFrame,
    keys: Sequence[str] = ("settlement_date", "period_id", "interconnector_id", "from_region"),
    run: str = "run_no",
    value: str = "surplus_aud",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Value of the highest run per settlement period."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(run, *tie_break)).alias(value))


def as_of_join(
    facts: DataFrame,
    definitions: DataFrame,
    keys: Sequence[str],
    fact_time: str,
    definition_time: str,
    values: Sequence[str],
    tie_break: Sequence[str] = (),
    fact_order: Sequence[str] = (),
) -> DataFrame:
    """Latest definition at or before each fact, per key; facts without one keep NULLs.

    Facts are neither ordered nor stored: they look the definition up
    (:func:`latest_point`). Equal times: the definition counts; of equal
    definitions the highest ``tie_break`` wins.
    """
    value = F.struct(*[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])
    known = definitions.dropna(subset=[*keys, definition_time])
    points = known.groupBy(*keys, F.col(definition_time).alias("_time")).agg(
        (F.max_by(value, F.struct(*tie_break)) if tie_break else F.first(value)).alias("_found")
    )
    found = latest_point(facts, points, keys, fact_time, "_time", "_found")
    rest = [c for c in facts.columns if c not in values]
    return found.select(*rest, *[F.col(f"_found._v{i}").alias(v) for i, v in enumerate(values)])


def latest_point(
    rows: DataFrame, points: DataFrame, keys: Sequence[str], time: str, point_time: str, value: str, fanout: int = 64
) -> DataFrame:
    """``rows`` with the ``value`` of the last point of their key whose time is not after theirs; NULL if there is none.

    Times of points are distinct within a key. Only the points are ordered.
    """
    ordered = globally_ordered(points.select(*keys, point_time, value), [*keys, point_time])
    ranked = running(ordered, keys, {"_upto": ("count", F.lit(1))}).withColumn("_rank", F.col("_upto") - 1)
    return look_up(rows, ranked, keys, time, point_time, value, lambda begins, t: begins <= t, fanout)


#: Entries of a level of a search tree that are sent to every executor.
BROADCAST = 100_000


def look_up(
    rows: DataFrame, ranked: DataFrame, keys: Sequence[str], time: str, point_time: str, value: str,
    passed: Callable[[Column, Column], Column], fanout: int = 64,
) -> DataFrame:
    """``rows`` with the ``value`` of the last point of their key, by ``_rank``, that they have passed; NULL if there is none.

    ``passed(point time, row time)`` holds for the first points of a key and
    for none after them; ``_rank`` counts a key's points from 0. Points become
    a search tree: leaves of ``fanout`` (a power of two) points, and above them
    nodes that hold where their children begin. A row takes one equi-join for
    each level, with one row on the other side, so nothing is multiplied and
    rows are neither ordered nor stored. A level of at most ``BROADCAST``
    entries is broadcast, so rows with hot keys, which the upper levels bring
    together, stay where they are; of larger levels adaptive execution can
    split a hot node. The number of levels is the logarithm of the largest
    number of points of a key.
    """
    ranked = materialised(ranked.select(*keys, point_time, value, "_rank"))
    # Entries of each level, for as many as a rank can need.
    depth = 1
    while fanout**depth < 1 << 40:
        depth += 1
    counted = ranked.agg(F.max("_rank"), *[F.count_if(F.col("_rank") % fanout**i == 0) for i in range(depth)]).first()
    most, sizes = counted[0] or 0, counted[1:]
    levels = 1
    while fanout**levels <= most:
        levels += 1
    on = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    # A column name that neither side can have.
    # Always 0; a literal would leave rows without keys no equality to join by.
    reached = rows.withColumn("_block_", F.xxhash64(F.col(time)) % 1)
    # How many entries a row has passed, found by halving.
    strides = [fanout >> i for i in range(1, fanout.bit_length())] + [1]
    for level in range(levels - 1, -1, -1):
        step = fanout**level
        entry = F.struct(F.col(point_time).alias("begins"), *([] if level else [F.col(value).alias("value")]))
        nodes = ranked.where(F.col("_rank") % step == 0).groupBy(
            *on, F.floor(F.col("_rank") / (step * fanout)).alias("_node")
        ).agg(F.sort_array(F.collect_list(F.struct("_rank", entry.alias("entry")))).alias("_sorted"))
        nodes = nodes.select(*[f"_k{i}" for i in range(len(keys))], "_node", F.col("_sorted.entry").alias("_entries"))
        if sizes[level] <= BROADCAST:
            nodes = F.broadcast(nodes)
        meets = F.col("_block_") == F.col("_node")
        for i, key in enumerate(keys):
            meets = meets & (F.col(key) == F.col(f"_k{i}"))
        joined = reached.join(nodes, meets, "left")

        def halved(place: Column, stride: Column) -> Column:
            begins = F.get("_entries", place + stride - 1)["begins"]
            goes_on = (place + stride <= F.size("_entries")) & passed(begins, F.col(time))
            return F.when(goes_on, place + stride).otherwise(place)

        joined = joined.withColumn("_place_", F.aggregate(F.array(*map(F.lit, strides)), F.lit(0), halved))
        place = F.col("_place_")
        if level:
            block = F.when(place > 0, F.col("_block_") * fanout + place - 1)
            reached = joined.select(*rows.columns, block.alias("_block_"))
        else:
            found = F.when(place > 0, F.get("_entries", place - 1)["value"])
            reached = joined.select(*rows.columns, found.alias(value))
    return reached


def as_of_date(
    versions: DataFrame, keys: Sequence[str], time: str, as_of, tie_break: Sequence[str] = (), equal: dict | None = None
) -> DataFrame:
    """Latest row per key with ``time <= as_of``, optionally only rows matching ``equal``."""
    rows = versions.where(F.col(time) <= F.lit(as_of))
    for column, value in (equal or {}).items():
        rows = rows.where(F.col(column) == value)
    return latest_version(rows, keys, [time, *tie_break])


def definitions_file_as_of(rows: DataFrame, catalog: DataFrame, requested) -> DataFrame:
    """Rows of the newest file (date, revision, name) published on or before ``requested``."""
    newest = (
        catalog.where(F.col("effective_date") <= F.lit(requested))
        .agg(F.max(F.struct("effective_date", "revision", "source_file")).alias("file"))
        .select(F.col("file.source_file").alias("source_file"))
    )
    # One row by construction.
    return rows.join(F.broadcast(newest), "source_file", "left_semi")


# Settlement runs in the order they are published.
RUN_ORDER = {"R0": 0, "R1": 1, "R2": 2, "FINAL": 3}


def run_ordinal(run: str = "settlement_run") -> Column:
    value = F.lit(-1)
    for name, ordinal in RUN_ORDER.items():
        value = F.when(F.col(run) == name, ordinal).otherwise(value)
    return value


def latest_snapshot_per_run(
    snapshots: DataFrame, as_of=None, keys: Sequence[str] = ("category_id", "quarter"), tie_break: Sequence[str] = ()
) -> DataFrame:
    rows = snapshots if as_of is None else snapshots.where(F.col("effective_date") <= F.lit(as_of))
    return latest_version(rows, [*keys, "settlement_run"], ["effective_date", *tie_break])


def run_delta(
    snapshots: DataFrame, payout: str = "payout_per_unit", keys: Sequence[str] = ("category_id", "quarter"),
    as_of=None, tie_break: Sequence[str] = (),
) -> DataFrame:
    """Payout change from one settlement run to the next."""
    latest = latest_snapshot_per_run(snapshots, as_of, keys, tie_break).withColumn("_run", run_ordinal())
    # One row per run and category is left, so the window holds at most four rows.
    window = Window.partitionBy(*keys).orderBy("_run", "settlement_run")
    staged = latest.select(
        *keys,
        F.lag("settlement_run").over(window).alias("from_run"),
        F.col("settlement_run").alias("to_run"),
        F.col(payout).alias("payout_per_unit"),
        F.lag(payout).over(window).alias("_previous"),
    ).where(F.col("from_run").isNotNull())
    delta = F.col("payout_per_unit") - F.col("_previous")
    return staged.select(
        *keys, "from_run", "to_run", "payout_per_unit", delta.alias("delta"),
        F.coalesce(F.try_divide(delta, F.col("_previous")) * 100, F.lit(0)).alias("delta_percentage"),
    )
