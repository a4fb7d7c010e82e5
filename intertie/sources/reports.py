"""Market report files (``C``/``I``/``D`` lines), plain or in (nested) zip archives.

Plain files are read with the splittable text source, archives with the data
source of :mod:`.archives`; everything after that is Spark SQL.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.market import auction_id, result_status, safe_decimal, safe_int
from ..functions.quarters import CONTRACT_PATTERN, contract_quarter, contract_tranche
from ..operators.versions import first_occurrence
from ..schemas import FCAS_SERVICES
from ..session import with_package
from .archives import ARCHIVES, archive_outcomes, read_archive_lines, stream_archive_lines  # noqa: F401 - outcomes go with the readers
from .catalog import effective_date, literal_pattern, newest_name

STAMP = "yyyy/MM/dd HH:mm:ss"

# Positions of price fields in the dispatch-price record, used for files without a header row.
PRICE_POSITIONS = {
    "settlement": 4, "region": 6, "price_mwh": 9,
    "fcas_raise_6sec_aud_per_mw": 15, "fcas_raise_60sec_aud_per_mw": 18, "fcas_raise_5min_aud_per_mw": 21,
    "fcas_reg_raise_aud_per_mw": 24, "fcas_lower_6sec_aud_per_mw": 27, "fcas_lower_60sec_aud_per_mw": 30,
    "fcas_lower_5min_aud_per_mw": 33, "fcas_reg_lower_aud_per_mw": 36, "fcas_raise_1sec_aud_per_mw": 49,
    "fcas_lower_1sec_aud_per_mw": 52,
}
# Header names of the same fields.
PRICE_HEADERS = {
    "settlement": "SETTLEMENTDATE", "region": "REGIONID", "price_mwh": "RRP",
    "fcas_raise_6sec_aud_per_mw": "RAISE6SECRRP", "fcas_raise_60sec_aud_per_mw": "RAISE60SECRRP",
    "fcas_raise_5min_aud_per_mw": "RAISE5MINRRP", "fcas_reg_raise_aud_per_mw": "RAISEREGRRP",
    "fcas_lower_6sec_aud_per_mw": "LOWER6SECRRP", "fcas_lower_60sec_aud_per_mw": "LOWER60SECRRP",
    "fcas_lower_5min_aud_per_mw": "LOWER5MINRRP", "fcas_reg_lower_aud_per_mw": "LOWERREGRRP",
    "fcas_raise_1sec_aud_per_mw": "RAISE1SECRRP", "fcas_lower_1sec_aud_per_mw": "LOWER1SECRRP",
}


def read_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Lines of plain text files with the name and the full path of their file."""
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    return lines.select(
        F.trim("value").alias("value"), F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_path").alias("source_path"),
    )


def _lines(spark: SparkSession, path: str, prefixes: Sequence[str], archived: bool, pattern: str | None) -> DataFrame:
    """Wanted lines; for plain files the prefix test runs before anything is parsed."""
    if archived:
        return read_archive_lines(spark, path, prefixes, pattern or ARCHIVES)
    lines = read_lines(spark, path, pattern or "*")
    wanted = F.lit(False)
    for prefix in prefixes:
        wanted = wanted | F.col("value").startswith(prefix)
    return lines.where(wanted)


def fields(count: int, value: str = "value") -> Column:
    """The first ``count`` fields of a CSV line as a struct ``f0 .. fn``."""
    ddl = ", ".join(f"f{i} string" for i in range(count))
    return F.from_csv(F.col(value), F.lit(ddl), {"mode": "PERMISSIVE"})


def parsed(lines: DataFrame, count: int, *others: str) -> DataFrame:
    """Other columns and the first ``count`` fields as ``_f``.

    Filters stay above the array, so every line is parsed once; below it the
    optimizer would parse a line again for each condition.
    """
    return lines.select(*others, F.explode(F.array(fields(count))).alias("_f"))


def field_count(value: str = "value") -> Column:
    """Number of fields; commas inside quotes do not count."""
    return F.size(F.split(F.regexp_replace(F.col(value), r'"[^"]*"', ""), ","))


def _text(position: int) -> Column:
    return F.trim(F.coalesce(F.col(f"_f.f{position}"), F.lit("")))


def _ntz(text: Column, fmt: str = STAMP) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def read_auction_results(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Auction results: one row per data line with at least 12 fields and a valid contract id."""
    rows = _auction_lines(spark, path, pattern)
    return rows.select(
        auction_id("quarter").alias("auction_id"), "contract_id", "quarter", "tranche_no", "interconnector_id",
        "from_region", "units_offered", "units_sold",
        safe_decimal("_price").alias("clearing_price"), safe_decimal("_reserve").alias("reserve_price"), "source_file",
    )


def _auction_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    lines = _lines(spark, path, ["D,RESIDUE_PUBLIC_DATA,"], False, pattern).where(field_count() >= 12)
    read = parsed(lines, 12, "source_file", "source_path")
    return read.select(
        "source_file",
        "source_path",
        _text(4).alias("contract_id"),
        contract_quarter(_text(4)).alias("quarter"),
        contract_tranche(_text(4)).alias("tranche_no"),
        safe_int(_text(5)).alias("version_no"),
        _text(6).alias("interconnector_id"),
        _text(7).alias("from_region"),
        safe_int(_text(8)).alias("units_offered"),
        safe_int(_text(9)).alias("units_sold"),
        _text(10).alias("_price"),
        _text(11).alias("_reserve"),
    ).where(F.col("contract_id").rlike(CONTRACT_PATTERN))


def read_auction_results_versioned(
    spark: SparkSession, path: str, pattern: str = "*.csv",
    load_order: Sequence[str] = ("source_file", "clearing_price", "units_cleared"),
) -> DataFrame:
    """Auction results with version, report time, revenue and status.

    Of repeated publications of a version the first in ``load_order`` stays.

    The result id includes the interconnector, so that two interconnectors
    sharing a region do not displace each other.
    """
    headers = (
        _lines(spark, path, ["C,"], False, pattern)
        .select("source_path", F.regexp_extract("value", r'PUBLIC,"([^"]+)"', 1).alias("_stamp"))
        .where(F.col("_stamp") != "")
        .groupBy("source_path")
        .agg(F.min(_ntz(F.col("_stamp"))).alias("auction_datetime"))
    )
    rows = _auction_lines(spark, path, pattern).join(headers, ["source_path"], "left")
    price = F.col("_price").try_cast("decimal(18,4)")
    results = rows.select(
        F.concat_ws(
            "_", "contract_id", F.concat(F.lit("v"), F.lpad(F.col("version_no").cast("string"), 2, "0")),
            "interconnector_id", "from_region",
        ).alias("result_id"),
        F.col("interconnector_id").alias("category_id"), "from_region", "quarter", "tranche_no", "version_no",
        "units_offered", F.col("units_sold").alias("units_cleared"), price.alias("clearing_price"),
        (price * F.col("units_sold")).cast("decimal(24,4)").alias("total_revenue"), "auction_datetime",
        result_status("units_offered", "units_sold").alias("status"), "source_file",
    )
    return first_occurrence(results, ["result_id"], list(load_order))


def ingest_summary(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Audit row per auction file: rows, products, auction events and report time; files without rows are left out."""
    rows = _auction_lines(spark, path, pattern)
    per_file = rows.groupBy("source_path", "source_file").agg(
        F.min("quarter").alias("quarter"),
        F.min("tranche_no").alias("tranche_no"),
        F.count(F.lit(1)).alias("snapshot_rows"),
        F.count_distinct("interconnector_id", "contract_id", "from_region").alias("products_loaded"),
        F.count_distinct("quarter", "tranche_no").alias("events_loaded"),
    )
    headers = (
        _lines(spark, path, ["C,"], False, pattern)
        .select("source_path", F.regexp_extract("value", r'PUBLIC,"([^"]+)"', 1).alias("_stamp"))
        .where(F.col("_stamp") != "")
        .groupBy("source_path")
        .agg(F.min(_ntz(F.col("_stamp"))).alias("report_datetime"))
    )
    return per_file.join(headers, "source_path", "left").drop("source_path")


SETTLEMENT_MONEY = {
    "total_surplus": 15, "distributed_surplus": 16, "auction_fees": 17, "net_payment": 18, "net_payment_per_unit": 19,
    "accumulated_net_payment": 20, "accumulated_net_payment_per_unit": 21,
}


def file_hashes(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Full path and SHA-256 of each plain file with a line.

    Tasks read splits of the files and join consecutive lines to chunks. The
    digest takes bytes in order, so a file's chunks pass one task in turn;
    nothing holds a file.
    """
    lines = _raw_lines(spark, path, pattern).select(
        F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("content"),
    )

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            path, size, block, content = batch.columns
            file = path.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            changes = (np.diff(file, prepend=-1) != 0) | (np.diff(block.to_numpy(zero_copy_only=False), prepend=-1) != 0)
            first = np.flatnonzero(changes)
            reach = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1]
            at = reach[np.append(first, len(content))].tolist()
            joined = [content.buffers()[2][i:j].to_pybytes() for i, j in zip(at, at[1:])]
            own = pa.array(first)
            yield pa.RecordBatch.from_arrays(
                [path.take(own), size.take(own), block.take(own), pa.array(range(count, count + len(own)), pa.int64()),
                 pa.array(joined, pa.binary())],
                names=["source_path", "size", "block", "chunk", "content"],
            )
            count += len(own)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size, seen, plain, marked = None, 0, 0, None, None

        def closed() -> pa.RecordBatch:
            # The last line feed is held back, as the file can lack it; the reader passes over a byte-order mark.
            digest, missing = (marked, size - seen - 3) if size - seen > 1 else (plain, size - seen)
            if missing not in (0, 1):
                raise ValueError(f"{name} has {size} bytes, of which its lines have {seen}")
            digest.update(b"\n" * missing)
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([digest.hexdigest()])], names=["source_path", "source_hash"]
            )

        for batch in batches:
            for i in range(batch.num_rows):
                content = memoryview(batch.column(4)[i].as_buffer())
                if batch.column(0)[i].as_py() != name:
                    if name is not None:
                        yield closed()
                    name, size, seen = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), -1
                    plain, marked = hashlib.sha256(), hashlib.sha256(codecs.BOM_UTF8)
                for digest in (plain, marked):
                    digest.update(b"" if seen < 0 else b"\n")
                    digest.update(content[:-1])
                seen += len(content)
        if name is not None:
            yield closed()

    with_package(spark)
    joined = lines.mapInArrow(chunks, "source_path string, size long, block long, chunk long, content binary")
    ordered = joined.repartition("source_path").sortWithinPartitions("source_path", "block", "chunk")
    return ordered.mapInArrow(digests, "source_path string, source_hash string")


def _raw_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)


def read_settlement_lines(spark: SparkSession, path: str, pattern: str = "AUCUNITS_*.R*") -> DataFrame:
    """Weekly settlement lines, each marked ``_ok`` when every field parses.

    Files are read line by line and cut into splits, whatever their size.
    """
    files = _raw_lines(spark, path, pattern).select(
        F.col("_metadata.file_path").alias("source_path"),
        # Spark gives the name as in a URL, where a plus sign stands for itself.
        F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("source_file"),
        F.regexp_replace(F.decode(F.col("value").cast("binary"), "UTF-8"), r"\r$", "").alias("value"),
    )
    lines = files.withColumn("value", F.trim("value")).where(F.col("value").startswith("D,BILLING,AUCTION_UNITS"))
    read = parsed(lines.where(field_count() >= 22), 22, "source_path", "source_file", "value")

    def day(position: int) -> Column:
        text = _text(position)
        return F.coalesce(_ntz(text), _ntz(text, "yyyy/MM/dd")).cast("date")

    year, quarter = _text(10).try_cast("int"), _text(11).try_cast("int")
    rows = read.select(
        "source_file", effective_date("source_file").alias("effective_date"), _text(9).alias("bill_run_type"),
        _text(4).try_cast("int").alias("contract_year"), _text(5).try_cast("int").alias("week_no"),
        _text(6).try_cast("int").alias("bill_run_no"), day(7).alias("start_date"), day(8).alias("end_date"),
        year.alias("residue_year"), quarter.alias("quarter_no"),
        F.concat(F.lit("C"), year.cast("string"), F.lit("Q"), quarter.cast("string")).alias("quarter"),
        _text(12).alias("interconnector_id"), _text(13).alias("from_region"),
        _text(14).try_cast("double").cast("int").alias("purchased_units"),
        *[_text(i).try_cast("decimal(22,8)").alias(name) for name, i in SETTLEMENT_MONEY.items()],
        "source_path", "value",
    )
    needed = ["contract_year", "week_no", "bill_run_no", "residue_year", "quarter_no", "purchased_units", *SETTLEMENT_MONEY]
    ok = F.lit(True)
    for name in needed:
        ok = ok & F.col(name).isNotNull()
    return rows.withColumn("_ok", ok)


def read_settlement_weeks(spark: SparkSession, path: str, pattern: str = "AUCUNITS_*.R*") -> DataFrame:
    """Settlement rows, each with the SHA-256 of its file."""
    rows = read_settlement_lines(spark, path, pattern).where("_ok").drop("_ok", "value")
    # One row for each file.
    hashes = F.broadcast(file_hashes(spark, path, pattern))
    return rows.join(hashes, "source_path").drop("source_path")


def read_settlement_rejects(spark: SparkSession, path: str, pattern: str = "AUCUNITS_*.R*") -> DataFrame:
    """Settlement lines with a field that does not parse."""
    return read_settlement_lines(spark, path, pattern).where("NOT _ok").select("source_file", "value")


def read_header_driven_report(
    spark: SparkSession, path: str, section: str, columns: Sequence[str], archived: bool = False, pattern: str | None = None
) -> DataFrame:
    """``D`` lines of a section with the named ``columns`` of the ``I`` line of their own file.

    ``section`` is the text after the line type, e.g. ``BILLING,AUCTION_UNITS``.
    """
    lines = _lines(spark, path, [f"I,{section}", f"D,{section}"], archived, pattern)
    # A field is a run of quoted parts and other characters, so one pass keeps every field, whatever the width.
    found = F.regexp_extract_all("value", F.lit(r'((?:"[^"]*+"|[^",]++|")*+)(?:,|$)'), F.lit(1))
    parts = F.transform(found, lambda p: F.btrim(p, F.lit('" ')))
    split = lines.select(
        "source_file", "source_path", F.substring("value", 1, 1).alias("_kind"), parts.alias("_parts")
    ).withColumn("_version", F.coalesce(F.get("_parts", F.lit(section.count(",") + 2)), F.lit("")))
    # A file can hold a section in several versions, each with a header of its own.
    headers = split.where("_kind = 'I'").groupBy("source_path", "_version").agg(F.max("_parts").alias("_names"))
    rows = split.where("_kind = 'D'").drop("_kind").join(headers, ["source_path", "_version"])
    return rows.select(
        "source_file",
        *[
            F.get("_parts", F.array_position("_names", name).cast("int") - 1).alias(name)
            for name in columns
        ],
    )


def read_dispatch_residue_archives(spark: SparkSession, path: str, archived: bool = True, pattern: str | None = None) -> DataFrame:
    """Interval residue rows; lines whose value is not a number are skipped."""
    return _residue_rows(_lines(spark, path, [RESIDUE_PREFIX], archived, pattern))


def stream_dispatch_residue_archives(spark: SparkSession, path: str, pattern: str = ARCHIVES) -> DataFrame:
    """The same as a stream over archives as they land."""
    return _residue_rows(stream_archive_lines(spark, path, [RESIDUE_PREFIX], pattern))


RESIDUE_PREFIX = "D,DISPATCH,IRSR,2,"


def _residue_rows(lines: DataFrame) -> DataFrame:
    lines = lines.where(field_count() >= 8)
    return (
        parsed(lines, 8, "source_file")
        .select(
            _ntz(_text(4)).alias("trading_interval"), _text(5).alias("interconnector_id"), _text(6).alias("from_region"),
            _text(7).try_cast("decimal(20,6)").alias("residue_aud"), "source_file",
        )
        .where("residue_aud IS NOT NULL AND trading_interval IS NOT NULL")
    )


def read_interval_surplus(spark: SparkSession, path: str, archived: bool = True, pattern: str | None = None) -> DataFrame:
    """Settlement-period surplus rows."""
    lines = _lines(spark, path, ["D,SETTLEMENTS,IRSURPLUS"], archived, pattern)
    return (
        parsed(lines, 12)
        .select(
            _ntz(_text(4)).alias("settlement_date"), _text(5).try_cast("int").alias("run_no"),
            _text(6).try_cast("int").alias("period_id"), _text(7).alias("interconnector_id"),
            _text(8).alias("from_region"), _text(11).try_cast("double").alias("surplus_aud"),
        )
        .where(
            "settlement_date IS NOT NULL AND run_no IS NOT NULL AND period_id IS NOT NULL AND surplus_aud IS NOT NULL"
        )
    )


def read_billing_runs(spark: SparkSession, path: str, archived: bool = True, pattern: str | None = None) -> DataFrame:
    lines = _lines(spark, path, ["D,BILLING,RUNTRK"], archived, pattern)
    return (
        parsed(lines, 8)
        .select(
            _text(4).try_cast("int").alias("contract_year"), _text(5).try_cast("int").alias("week_no"),
            _text(6).try_cast("int").alias("bill_run_no"), F.upper(_text(7)).alias("status"),
        )
        .where("contract_year IS NOT NULL AND week_no IS NOT NULL AND bill_run_no IS NOT NULL")
    )


def read_residue_results_raw(
    spark: SparkSession, path: str, month: str | None = None, archived: bool = True, pattern: str | None = None
) -> DataFrame:
    """Monthly residue results from the raw reports."""
    lines = _lines(spark, path, ["D,IRAUCTION,RESIDUE_PUBLIC_DATA"], archived, pattern).where(field_count() >= 12)
    rows = parsed(lines, 12, "source_file").where(F.length(_text(4)) >= 9)
    named = F.lit(month) if month else F.regexp_extract("source_file", r"(\d{4}-?\d{2})", 1)
    return rows.select(
        named.alias("mmsdm_month"), F.substring(_text(4), 1, 7).alias("quarter"),
        F.substr(_text(4), F.lit(8)).alias("tranche"), _text(4).alias("contract_id"),
        _text(5).try_cast("int").alias("version_no"), _text(6).alias("interconnector_id"), _text(7).alias("from_region"),
        _text(8).try_cast("int").alias("units_offered"), _text(9).try_cast("int").alias("units_sold"),
        _text(10).try_cast("double").alias("clearing_price"),
        F.when(_text(11) == "", F.lit(0.0)).otherwise(_text(11).try_cast("double")).alias("reserve_price"),
    ).where(
        "version_no IS NOT NULL AND units_offered IS NOT NULL AND units_sold IS NOT NULL "
        "AND clearing_price IS NOT NULL AND reserve_price IS NOT NULL"
    )


def read_dispatch_prices(
    spark: SparkSession, path: str, regions: Sequence[str] | None = None, archived: bool = True, by_header: bool = True,
    pattern: str | None = None,
) -> DataFrame:
    """Spot and ancillary-service prices; a missing service price is 0.

    Positions differ between publications, so they come from the header row;
    ``by_header=False`` uses the usual positions for files without one.
    """
    if by_header:
        raw = read_header_driven_report(
            spark, path, "DISPATCH,PRICE", list(PRICE_HEADERS.values()), archived, pattern
        ).withColumnsRenamed({v: k for k, v in PRICE_HEADERS.items()})
    else:
        raw = _placed_prices(_lines(spark, path, [PRICE_PREFIX], archived, pattern))
    return _price_rows(raw, regions)


def stream_dispatch_prices(
    spark: SparkSession, path: str, regions: Sequence[str] | None = None, pattern: str = ARCHIVES
) -> DataFrame:
    """Prices at their usual positions as a stream over archives as they land."""
    return _price_rows(_placed_prices(stream_archive_lines(spark, path, [PRICE_PREFIX], pattern)), regions)


PRICE_PREFIX = "D,DISPATCH,PRICE,"


def _placed_prices(lines: DataFrame) -> DataFrame:
    width = max(PRICE_POSITIONS.values()) + 1
    return parsed(lines.where(field_count() >= 12), width, "source_file").select(
        "source_file", *[_text(i).alias(name) for name, i in PRICE_POSITIONS.items()]
    )


def _price_rows(raw: DataFrame, regions: Sequence[str] | None) -> DataFrame:
    if regions:
        raw = raw.where(F.col("region").isin(*regions))
    rows = raw.select(
        _ntz(F.col("settlement")).alias("timestamp"), F.col("price_mwh").try_cast("double").alias("price_mwh"), "region",
        *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in FCAS_SERVICES], "source_file",
    )
    return rows.where("timestamp IS NOT NULL AND price_mwh IS NOT NULL")


def _read_forecast(
    spark, path, prefix: str, width: int, stamp: int, region: int, price: int, source: str, regions, archived, pattern,
    newest_only: bool,
) -> DataFrame:
    if newest_only:
        # Chosen by name, so no other file is opened.
        newest = newest_name(spark, path, pattern or (ARCHIVES if archived else "*"))
        pattern = literal_pattern(newest) if newest else pattern
    lines = _lines(spark, path, [prefix], archived, pattern).where(field_count() >= width)
    rows = parsed(lines, max(width, stamp + 1), "source_file").select(
        _ntz(_text(stamp)).alias("timestamp"), _text(region).alias("region"),
        _text(price).try_cast("double").alias("price_mwh"), F.lit(source).alias("source"), "source_file",
    )
    rows = rows.where("timestamp IS NOT NULL AND price_mwh IS NOT NULL")
    return rows.where(F.col("region").isin(*regions)) if regions else rows


def read_p5min_forecast(
    spark: SparkSession, path: str, regions: Sequence[str] | None = None, archived: bool = True, pattern: str | None = None,
    newest_only: bool = True,
) -> DataFrame:
    """Five-minute forecast, of the newest file unless told otherwise."""
    return _read_forecast(
        spark, path, "D,P5MIN,REGIONSOLUTION,", 10, 6, 7, 8, "p5min_5min", regions, archived, pattern, newest_only
    )


def read_predispatch_forecast(
    spark: SparkSession, path: str, regions: Sequence[str] | None = None, archived: bool = True, pattern: str | None = None,
    newest_only: bool = True,
) -> DataFrame:
    """Half-hour forecast, of the newest file unless told otherwise."""
    return _read_forecast(
        spark, path, "D,PREDISPATCH,REGION_PRICES,", 29, 28, 6, 9, "predispatch_30min", regions, archived, pattern,
        newest_only,
    )
