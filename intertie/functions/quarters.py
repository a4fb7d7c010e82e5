"""Quarter labels ``CyyyyQn``, contract ids and calendar arithmetic."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

QUARTER_PATTERN = r"^C(\d{4})Q([1-4])$"
CONTRACT_PATTERN = r"^C(\d{4})Q([1-4])T(\d{2})$"

# Dispatch intervals in a day, and the share of them assumed to pay.
INTERVALS_PER_DAY = 288
PAYING_SHARE = 0.85


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def col_of(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def quarter_label(ts) -> Column:
    ts = col_of(ts)
    return F.concat(F.lit("C"), F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))


def quarter_year(label) -> Column:
    return F.regexp_extract(col_of(label), QUARTER_PATTERN, 1).try_cast("int")


def quarter_number(label) -> Column:
    return F.regexp_extract(col_of(label), QUARTER_PATTERN, 2).try_cast("int")


def quarter_ordinal(label) -> Column:
    """``year * 4 + quarter``; NULL for a label that does not parse."""
    return quarter_year(label) * 4 + quarter_number(label)


def parse_quarter(label) -> Column:
    return F.struct(
        quarter_year(label).alias("year"),
        quarter_number(label).alias("quarter_no"),
        quarter_ordinal(label).alias("ordinal"),
    )


def quarter_in_range(label, start, end) -> Column:
    return quarter_ordinal(label).between(quarter_ordinal(as_column(start)), quarter_ordinal(as_column(end)))


def quarter_start(label) -> Column:
    return F.make_date(quarter_year(label), quarter_number(label) * 3 - 2, F.lit(1))


def quarter_end(label) -> Column:
    return F.last_day(F.make_date(quarter_year(label), quarter_number(label) * 3, F.lit(1)))


def quarter_bounds(label) -> Column:
    return F.struct(quarter_start(label).alias("start_date"), quarter_end(label).alias("end_date"))


def is_quarter_closed(label, as_of: dt.date, grace_days: int = 0) -> Column:
    return F.lit(as_of) > F.date_add(quarter_end(label), grace_days)


def contract_quarter(contract_id) -> Column:
    contract_id = col_of(contract_id)
    return F.when(contract_id.rlike(CONTRACT_PATTERN), F.substring(contract_id, 1, 7))


def contract_tranche(contract_id) -> Column:
    return F.regexp_extract(col_of(contract_id), CONTRACT_PATTERN, 3).try_cast("int")


def parse_contract_id(contract_id) -> Column:
    return F.struct(
        contract_quarter(contract_id).alias("quarter"), contract_tranche(contract_id).alias("tranche_no")
    )


def quarter_time_scales(label, as_of: dt.date) -> Column:
    """Days and dispatch intervals of a quarter seen from ``as_of``."""
    start, end = quarter_start(label), quarter_end(label)
    today = F.lit(as_of)
    days = F.datediff(end, start) + 1
    intervals = days * INTERVALS_PER_DAY
    scales = F.struct(
        start.alias("quarter_start"),
        end.alias("quarter_end"),
        days.alias("calendar_days"),
        F.greatest(F.datediff(start, today), F.lit(0)).alias("days_to_start"),
        F.greatest(F.datediff(end, today), F.lit(0)).alias("days_remaining"),
        intervals.alias("total_5min_intervals"),
        F.bround(intervals * PAYING_SHARE, 0).cast("int").alias("expected_paying_intervals"),
        (today >= start).alias("quarter_started"),
    )
    return F.when(start.isNotNull(), scales)


def quarter_progress_pct(label, as_of: dt.date) -> Column:
    start, end = quarter_start(label), quarter_end(label)
    today = F.lit(as_of)
    elapsed = F.datediff(today, start)
    total = F.greatest(F.datediff(end, start), F.lit(1))
    return (
        F.when(start.isNull() | (today <= start), F.lit(0.0))
        .when(today >= end, F.lit(100.0))
        .otherwise(F.round(elapsed / total * 100.0, 1))
    )


def thirty_minute_floor(ts) -> Column:
    """Start of the half hour; works on ``timestamp_ntz`` without touching time zones."""
    ts = col_of(ts)
    return F.date_trunc("hour", ts) + F.when(
        F.minute(ts) >= 30, F.expr("INTERVAL '30' MINUTE")
    ).otherwise(F.expr("INTERVAL '0' MINUTE"))
