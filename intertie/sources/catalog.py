"""What a file name says: effective date, revision, quarter, tranche, publication time."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quarters import col_of, quarter_in_range, quarter_label

# File name patterns of the reports.
SETTLEMENT_NAME = r"(?i)AUCUNITS_(\d{8})\.R(\d+)"
AUCTION_NAME = r"PUBLIC_SRRES_(C\d{4}Q[1-4])T(\d{2})_(\d*?)(\d{14})\.csv"
DISPATCH_NAME = r"PUBLIC_DISPATCH_IRSR_(\d{8})(\d{4}_\d+)?\.zip"


def _date(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")


def _part(name: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(name, pattern, group)
    return F.when(found != "", found)


def effective_date(file_name) -> Column:
    """Date in the name of a settlement or auction-result file; NULL for other names."""
    name = col_of(file_name)
    settlement = _part(name, SETTLEMENT_NAME, 1)
    auction = F.substring(_part(name, AUCTION_NAME, 4), 1, 8)
    return _date(F.coalesce(settlement, auction))


def file_catalog(df: DataFrame, file_name: str = "source_file") -> DataFrame:
    """Columns derived from the file name."""
    name = F.col(file_name)
    return df.withColumns(
        {
            "effective_date": effective_date(name),
            "revision": F.coalesce(_part(name, SETTLEMENT_NAME, 2).try_cast("int"), F.lit(0)),
            "file_quarter": F.coalesce(
                _part(name, AUCTION_NAME, 1), quarter_label(_date(_part(name, DISPATCH_NAME, 1)))
            ),
            "file_tranche": _part(name, AUCTION_NAME, 2).try_cast("int"),
            "file_time": F.coalesce(_part(name, AUCTION_NAME, 4), F.lit("00000000000000")),
            "file_sequence": F.coalesce(_part(name, AUCTION_NAME, 3), F.lit("0")),
        }
    )


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Names, paths, sizes and times of the files below ``path``; contents are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return listed.select(
        F.element_at(F.split("path", "/"), -1).alias("source_file"), "path", "length", "modificationTime"
    )


def load_range(catalog: DataFrame, start_quarter: str, end_quarter: str) -> DataFrame:
    """Catalog rows whose quarter lies in the range."""
    return catalog.where(quarter_in_range("file_quarter", start_quarter, end_quarter))


def newest_files(catalog: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` newest files by date, revision and name."""
    return catalog.orderBy(
        F.col("effective_date").desc_nulls_last(), F.col("revision").desc(), F.col("source_file").desc()
    ).limit(n)


def newest_name(spark: SparkSession, path: str, pattern: str = "*") -> str | None:
    """The last file name below ``path``, found without opening a file; report names end in their time."""
    return list_files(spark, path, pattern).agg(F.max("source_file")).first()[0]


def literal_pattern(name: str) -> str:
    """A glob that only this file name matches."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", name)


def dispatch_pattern(start_quarter: str, end_quarter: str) -> str:
    """Glob for the dispatch archives of a range of quarters, by the day in their name.

    A day on either side is included, for intervals that end at midnight.
    """
    (y0, q0), (y1, q1) = ((int(q[1:5]), int(q[6])) for q in (start_quarter, end_quarter))
    first = dt.date(y0, 3 * q0 - 2, 1)
    after = dt.date(y1 + (q1 == 4), 3 * q1 % 12 + 1, 1)
    months = range(first.year * 12 + first.month - 1, after.year * 12 + after.month - 1)
    days = [f"{m // 12}{m % 12 + 1:02d}" for m in months] + [
        d.strftime("%Y%m%d") for d in (first - dt.timedelta(days=1), after)
    ]
    return "PUBLIC_DISPATCH_IRSR_{" + ",".join(days) + "}*.[zZ][iI][pP]"
