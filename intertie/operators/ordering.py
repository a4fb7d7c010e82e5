"""Global order, running values, neighbours and exact order statistics.

A window partitioned by a hot key, or by nothing, puts that key's rows on one
task. The operators here range-partition the rows by a total order instead, so
every task holds an even slice whatever the keys look like, and then carry a
few boundary values (at most one row per slice) from slice to slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised
from .joins import null_safe_join

PART, POS, INDEX, CHUNK, OWN = "_part", "_pos", "_index", "_chunk", "_own"


def as_columns(items: Sequence[str | Column]) -> list[Column]:
    return [item if isinstance(item, Column) else F.col(item) for item in items]


def globally_ordered(df: DataFrame, order: Sequence[str | Column], num_partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by ``order`` (a total order), numbered by slice and position.

    The result is checkpointed: slice bounds come from a sample, so they must
    be fixed before anything refers to slice numbers.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = as_columns(order)
    # Bits above 33 of the generated id hold the slice, the rest the position inside it.
    numbered = (
        df.repartitionByRange(n, *columns)
        .sortWithinPartitions(*columns)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    fixed = materialised(numbered)
    return fixed.select(
        *df.columns,
        F.shiftright("_id", 33).cast("int").alias(PART),
        F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias(POS),
    )


_FOLD = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, lambda a, b: F.coalesce(a + b, a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "last": (None, lambda a, b: F.coalesce(b, a)),
}


def _over(name: str, value: Column, window) -> Column:
    if name == "last":
        return F.last(value, ignorenulls=True).over(window)
    return _FOLD[name][0](value).over(window)


def running(
    ordered: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, tuple[str, str | Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Running aggregates per key in global order.

    ``values`` maps an output name to ``(sum|count|min|max|last, input)``;
    ``last`` skips NULLs. ``ordered`` must come from :func:`globally_ordered`
    with ``keys`` leading its order.
    """
    columns = {name: (fold, as_columns([value])[0]) for name, (fold, value) in values.items()}
    inside = (
        Window.partitionBy(PART, *keys)
        .orderBy(POS)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    )
    local = ordered.select("*", *[_over(f, c, inside).alias(f"_in_{n}") for n, (f, c) in columns.items()])

    def slice_value(fold: str, value: Column) -> Column:
        if fold == "last":
            return F.max_by(value, F.when(value.isNotNull(), F.col(POS)))
        return _FOLD[fold][0](value)

    slices = ordered.groupBy(PART, *keys).agg(*[slice_value(f, c).alias(n) for n, (f, c) in columns.items()])
    # A key that spans slices has a row per slice, so no group here exceeds the number of slices.
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    merge = {"count": "sum"}
    carried = slices.select(
        F.col(PART).alias("_to_part"),
        *[F.col(k).alias(f"_to_{k}") for k in keys],
        F.count(F.lit(1)).over(before).alias("_earlier"),
        *[_over(merge.get(f, f), F.col(n), before).alias(f"_carry_{n}") for n, (f, _) in columns.items()],
    ).where("_earlier > 0").drop("_earlier")
    # Only the first key of a slice can continue from an earlier slice: at most one row per slice.
    on = F.col(PART) == F.col("_to_part")
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"_to_{key}"))
    joined = local.join(F.broadcast(carried), on, "left")
    return joined.select(
        *ordered.columns,
        *[_FOLD[f][1](F.col(f"_carry_{n}"), F.col(f"_in_{n}")).alias(n) for n, (f, _) in columns.items()],
    )


def with_index(ordered: DataFrame, start: int = 0) -> DataFrame:
    """Consecutive row number over the whole global order."""
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy(PART).agg(F.count(F.lit(1)).alias("_rows")).select(
        F.col(PART).alias("_to_part"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    # One row per slice.
    joined = ordered.join(F.broadcast(offsets), F.col(PART) == F.col("_to_part"))
    return joined.select(*ordered.columns, (F.col("_offset") + F.col(POS) + start).alias(INDEX))


def with_halo(ordered: DataFrame, before: int, after: int, chunk_rows: int | None = None) -> DataFrame:
    """Rows cut into equal chunks, each with copies of its ``before``/``after`` neighbours.

    Row frames that reach no further than the halo are exact inside
    ``Window.partitionBy("_chunk", *keys).orderBy("_index")``; keep the rows
    where ``_own`` is true afterwards.
    """
    size = chunk_rows or max(2048, 6 * (before + after))
    if size < max(before, after):
        raise ValueError("a chunk must be at least as long as its halo")
    indexed = with_index(ordered)
    home = F.floor(F.col(INDEX) / size)
    offset = F.col(INDEX) - home * size
    targets = [home]
    if before:
        targets.append(F.when(offset >= size - before, home + 1))
    if after:
        targets.append(F.when(offset < after, home - 1))
    copies = indexed.select("*", home.alias("_home"), F.explode(F.array_compact(F.array(*targets))).alias(CHUNK))
    # Frames cost far more than the bytes they read, so the number of tasks is fixed here instead of
    # being derived from the size of the shuffle.
    tasks = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.withColumn(OWN, F.col(CHUNK) == F.col("_home")).drop("_home").repartition(tasks, CHUNK)


def halo_window(keys: Sequence[str], start: int | None = None, end: int | None = None):
    window = Window.partitionBy(CHUNK, *keys).orderBy(INDEX)
    return window if start is None else window.rowsBetween(start, end)


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    values: Mapping[str, tuple[str | Column, int]],
) -> DataFrame:
    """Values from ``n`` rows ahead (n > 0) or behind (n < 0) inside a key, for any key size."""
    ordered = globally_ordered(df, [*keys, *order])
    offsets = [offset for _, offset in values.values()]
    chunks = with_halo(ordered, max(0, -min(offsets)), max(0, max(offsets)))
    window = halo_window(keys)
    picked = []
    for name, (value, offset) in values.items():
        column = as_columns([value])[0]
        shifted = F.lead(column, offset) if offset > 0 else F.lag(column, -offset)
        picked.append(shifted.over(window).alias(name))
    return chunks.select(*df.columns, OWN, *picked).where(OWN).drop(OWN)


def value_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per distinct value of a key: count, rows up to and including it, rows in the key."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ordered = globally_ordered(counts, [*keys, value])
    cumulative = running(ordered, keys, {"upto": ("sum", "n")})
    if not keys:
        # One number for the whole table, read from the checkpointed counts.
        total = ordered.agg(F.sum("n")).first()[0] or 0
        return cumulative.select(value, "n", "upto", F.lit(total).cast("long").alias("total"))
    totals = ordered.groupBy(*keys).agg(F.sum("n").alias("total"))
    return null_safe_join(cumulative, totals, keys).select(*keys, value, "n", "upto", "total")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Mapping[str, float],
    interpolate: bool = True,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Exact quantiles per key (linear interpolation), one output column per entry of ``fractions``.

    With ``interpolate=False`` the value at rank ``floor(fraction * n)`` is returned.
    ``extra`` are further aggregates over ``value``, ``n``, ``upto`` and ``total``.
    """
    positions = value_positions(df, keys, value)
    start, upto, total = F.col("upto") - F.col("n"), F.col("upto"), F.col("total")
    picks, outputs = [], []
    for name, fraction in fractions.items():
        if interpolate:
            place = F.lit(float(fraction)) * (total - 1)
            low, high = F.floor(place), F.ceil(place)
            picks += [
                F.max(F.when((start <= low) & (low < upto), F.col(value))).alias(f"_lo_{name}"),
                F.max(F.when((start <= high) & (high < upto), F.col(value))).alias(f"_hi_{name}"),
                F.max(place - low).alias(f"_w_{name}"),
            ]
            lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
            outputs.append((lo + (hi - lo) * F.col(f"_w_{name}")).alias(name))
        else:
            rank = F.greatest(F.lit(0), F.least(total - 1, F.floor(F.lit(float(fraction)) * total)))
            picks.append(F.max(F.when((start <= rank) & (rank < upto), F.col(value))).alias(name))
            outputs.append(F.col(name))
    stats = positions.groupBy(*keys).agg(*picks, *extra)
    produced = [c for c in stats.columns if not c.startswith(("_lo_", "_hi_", "_w_")) and c not in fractions]
    return stats.select(*produced, *outputs)
