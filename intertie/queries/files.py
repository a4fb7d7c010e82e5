"""Readers and writers: report files that Spark derives from the benchmark tables, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import residue
from ..operators.joins import wanted_minus_existing
from ..session import scratch_path
from ..sources import archives, catalog, reports, sinks, tables
from . import REGISTRY
from . import roles as R
from .settlement import CERTIFY_SQL, _certified


def _report(spark, df, *parts) -> str:
    """Report lines written as text; returns the folder. Files stay of the size that one task can hash."""
    path = scratch_path(spark, "report")
    lines = df.select(F.concat_ws(",", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("value"))
    lines.write.option("maxRecordsPerFile", 500_000).text(path)
    return path


def _stamp(column: str):
    return F.concat(F.lit('"'), F.date_format(column, "yyyy/MM/dd HH:mm:ss"), F.lit('"'))


@REGISTRY.add(
    "read_auction_report",
    f"""
    WITH {R.AUCTION_SQL}
    SELECT contract_id, 'A' || substr(contract_id, 2, 4) || lpad(CAST(CAST(substr(contract_id, 7, 1) AS INTEGER) * 3 AS VARCHAR), 2, '0') AS auction_id,
           interconnector_id, from_region, count(*) AS n, CAST(sum(units_offered) AS BIGINT) AS units_offered,
           CAST(sum(CASE WHEN part_key % 9 = 0 THEN 0 ELSE units_sold END) AS BIGINT) AS units_sold,
           CAST(sum(clearing_price) AS DOUBLE) AS clearing_price
    FROM auction GROUP BY ALL
    """,
)
def read_auction_report(spark, folder):
    rows = R.auction(spark, folder)
    sold = F.when(F.expr("part_key % 9 = 0"), F.lit("")).otherwise(F.col("units_sold").cast("string"))
    path = _report(
        spark, rows, "D", "RESIDUE_PUBLIC_DATA", "", "1", F.col("contract_id"), F.lit(1), F.col("interconnector_id"),
        F.col("from_region"), F.col("units_offered"), sold, F.col("clearing_price"), "0",
    )
    read = reports.read_auction_results(spark, path, "*.txt")
    return read.groupBy("contract_id", "auction_id", "interconnector_id", "from_region").agg(
        F.count(F.lit(1)).alias("n"), F.sum("units_offered").alias("units_offered"), F.sum("units_sold").alias("units_sold"),
        F.sum("clearing_price").cast("double").alias("clearing_price"),
    )


@REGISTRY.add(
    "read_auction_versions",
    f"""
    WITH {R.AUCTION_SQL},
    v AS (SELECT *, order_key % 3 AS version_no FROM auction),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contract_id, version_no, interconnector_id, from_region
                               ORDER BY clearing_price, units_sold) AS rn FROM v) WHERE rn = 1)
    SELECT contract_id || '_v' || lpad(CAST(version_no AS VARCHAR), 2, '0') || '_' || interconnector_id || '_' || from_region AS result_id,
           CAST(clearing_price AS DOUBLE) AS clearing_price, CAST(clearing_price * units_sold AS DOUBLE) AS total_revenue,
           CASE WHEN units_sold < units_offered THEN 'partial_clearance' ELSE 'cleared' END AS status
    FROM f
    """,
)
def read_auction_versions(spark, folder):
    rows = R.auction(spark, folder)
    path = _report(
        spark, rows.withColumn("version_no", F.expr("order_key % 3")), "D", "RESIDUE_PUBLIC_DATA", "", "1",
        F.col("contract_id"), F.col("version_no"), F.col("interconnector_id"), F.col("from_region"),
        F.col("units_offered"), F.col("units_sold"), F.col("clearing_price"), "0",
    )
    read = reports.read_auction_results_versioned(
        spark, path, "*.txt", ["clearing_price", "units_cleared", "units_offered"]
    )
    return read.select(
        "result_id", F.col("clearing_price").cast("double").alias("clearing_price"),
        F.col("total_revenue").cast("double").alias("total_revenue"), "status",
    )


@REGISTRY.add(
    "read_settlement_report",
    f"""
    WITH {R.WEEKS_SQL}
    SELECT quarter, bill_run_type, count(*) AS n, CAST(sum(purchased_units) AS BIGINT) AS purchased_units,
           CAST(sum(total_surplus) AS DOUBLE) AS total_surplus, CAST(sum(net_payment) AS DOUBLE) AS net_payment
    FROM weeks WHERE interconnector_id <> 'P7' GROUP BY ALL
    """,
)
def read_settlement_report(spark, folder):
    weeks = R.settlement_weeks(spark, folder)
    # The lines of one category carry a blank amount and belong to the rejects.
    net = F.when(F.col("interconnector_id") == "P7", F.lit("")).otherwise(F.col("net_payment").cast("string"))
    path = _report(
        spark, weeks, "D", "BILLING", "AUCTION_UNITS", "1", F.substring("quarter", 2, 4), F.col("week_no"), "1",
        _stamp("effective_date"), _stamp("effective_date"), F.col("bill_run_type"), F.substring("quarter", 2, 4),
        F.substring("quarter", 7, 1), F.col("interconnector_id"), F.col("from_region"), F.col("purchased_units"),
        F.col("total_surplus"), F.col("distributed_surplus"), F.col("auction_fees"), net, "0",
        F.col("accumulated_net_payment"), "0",
    )
    read = reports.read_settlement_weeks(spark, path, "*.txt")
    return read.groupBy("quarter", "bill_run_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("purchased_units").alias("purchased_units"),
        F.sum("total_surplus").cast("double").alias("total_surplus"), F.sum("net_payment").cast("double").alias("net_payment"),
    )


@REGISTRY.add(
    "read_settlement_rejects",
    f"WITH {R.WEEKS_SQL} SELECT count(*) AS n FROM weeks WHERE interconnector_id = 'P7'",
)
def read_settlement_rejects(spark, folder):
    weeks = R.settlement_weeks(spark, folder)
    net = F.when(F.col("interconnector_id") == "P7", F.lit("")).otherwise(F.col("net_payment").cast("string"))
    path = _report(
        spark, weeks, "D", "BILLING", "AUCTION_UNITS", "1", "2024", F.col("week_no"), "1", _stamp("effective_date"),
        _stamp("effective_date"), F.col("bill_run_type"), "2024", "1", F.col("interconnector_id"), F.col("from_region"),
        "1", "1", "1", "1", net, "0", "1", "0",
    )
    return reports.read_settlement_rejects(spark, path, "*.txt").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.add(
    "read_residue_report",
    f"""
    WITH {R.INTERVALS_SQL}
    SELECT interconnector_id, from_region, date_trunc('day', trading_interval)::TIMESTAMP AS day, count(*) AS n,
           CAST(sum(residue_aud) AS DOUBLE) AS residue_aud
    FROM intervals WHERE residue_aud >= 5 GROUP BY ALL
    """,
)
def read_residue_report(spark, folder):
    rows = R.intervals(spark, folder)
    # Small values are written as text that is not a number; the reader skips those lines.
    value = F.when(F.col("residue_aud") < 5, F.lit("n/a")).otherwise(F.col("residue_aud").cast("string"))
    path = _report(
        spark, rows, "D", "DISPATCH", "IRSR", "2", _stamp("trading_interval"), F.col("interconnector_id"),
        F.col("from_region"), value,
    )
    read = reports.read_dispatch_residue_archives(spark, path, archived=False)
    return read.groupBy(
        "interconnector_id", "from_region", F.date_trunc("day", "trading_interval").cast("timestamp_ntz").alias("day")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("residue_aud").cast("double").alias("residue_aud"))


@REGISTRY.add(
    "read_surplus_report",
    """
    SELECT CAST(l_linenumber AS BIGINT) AS period_id, l_returnflag AS interconnector_id, count(*) AS n,
           round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS surplus_aud
    FROM lineitem GROUP BY ALL
    """,
)
def read_surplus_report(spark, folder):
    rows = R.table(spark, folder, "lineitem")
    path = _report(
        spark, rows, "D", "SETTLEMENTS", "IRSURPLUS", "1", _stamp("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"),
        F.col("l_returnflag"), F.col("l_linestatus"), "0", "0", F.col("l_extendedprice").cast("decimal(18,2)"),
    )
    read = reports.read_interval_surplus(spark, path, archived=False)
    return read.groupBy(F.col("period_id").cast("long").alias("period_id"), "interconnector_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.col("surplus_aud").cast("decimal(18,2)")).cast("double"), 2).alias("surplus_aud"),
    )


@REGISTRY.add(
    "read_billing_runs",
    """
    SELECT CAST(isoyear(o_orderdate) AS BIGINT) AS contract_year, CAST(week(o_orderdate) AS BIGINT) AS week_no,
           upper(o_orderpriority) AS status, count(*) AS n, CAST(max(o_custkey % 30) AS BIGINT) AS last_run
    FROM orders GROUP BY ALL
    """,
)
def read_billing_runs(spark, folder):
    rows = R.table(spark, folder, "orders")
    path = _report(
        spark, rows, "D", "BILLING", "RUNTRK", "1", F.extract(F.lit("YEAROFWEEK"), F.col("o_orderdate")),
        F.weekofyear("o_orderdate"), F.expr("o_custkey % 30"),
        F.concat(F.lit('"'), F.lower("o_orderpriority"), F.lit('"')),
    )
    read = reports.read_billing_runs(spark, path, archived=False)
    return read.groupBy(
        F.col("contract_year").cast("long").alias("contract_year"), F.col("week_no").cast("long").alias("week_no"), "status"
    ).agg(F.count(F.lit(1)).alias("n"), F.max("bill_run_no").cast("long").alias("last_run"))


@REGISTRY.add(
    "read_price_report",
    f"""
    WITH {R.PRICES_SQL}
    SELECT region, date_trunc('second', timestamp)::TIMESTAMP AS timestamp, round(value, 2) AS price_mwh, round(value, 2) AS fcas_raise_6sec_aud_per_mw,
           0.0::DOUBLE AS fcas_lower_1sec_aud_per_mw
    FROM prices WHERE region IN ('view', 'click')
    """,
)
def read_price_report(spark, folder):
    blank = [""] * 5
    price = F.col("value").cast("decimal(18,2)")
    path = _report(
        spark, R.prices(spark, folder), "D", "DISPATCH", "PRICE", "5", _stamp("timestamp"), "1", F.col("region"), "1", "0",
        price, *blank, price, "", "", "", "", "",
    )
    read = reports.read_dispatch_prices(spark, path, ["view", "click"], archived=False, by_header=False)
    return read.select("region", "timestamp", "price_mwh", "fcas_raise_6sec_aud_per_mw", "fcas_lower_1sec_aud_per_mw")


@REGISTRY.add(
    "read_header_driven",
    """
    SELECT c_mktsegment AS "SEGMENT", count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1
    """,
)
def read_header_driven(spark, folder):
    rows = R.table(spark, folder, "customer")
    lines = rows.select(
        F.concat_ws(
            ",", F.lit("D,BILLING,AUCTION_UNITS,1"), F.concat(F.lit('"'), F.lit("x, y"), F.lit('"')),
            F.col("c_mktsegment"), F.col("c_custkey").cast("string"),
        ).alias("value")
    )
    path = scratch_path(spark, "report")
    # Every written file starts with its own header row.
    header = "I,BILLING,AUCTION_UNITS,1,NOTE,SEGMENT,CUSTKEY"

    def with_header(frames):
        import pandas as pd

        yield pd.DataFrame({"value": [header]})
        yield from frames

    lines.mapInPandas(with_header, "value string").write.text(path)
    read = reports.read_header_driven_report(spark, path, "BILLING,AUCTION_UNITS", ["SEGMENT", "CUSTKEY"], pattern="*.txt")
    return read.groupBy("SEGMENT").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("CUSTKEY").cast("long")).alias("keys")
    )


@REGISTRY.add(
    "read_residue_monthly",
    f"""
    WITH {R.AUCTION_SQL}
    SELECT quarter, 'T' || lpad(CAST(tranche_no AS VARCHAR), 2, '0') AS tranche, count(*) AS n, CAST(sum(units_sold) AS BIGINT) AS units_sold,
           CAST(sum(clearing_price) AS DOUBLE) AS clearing_price
    FROM auction GROUP BY ALL
    """,
)
def read_residue_monthly(spark, folder):
    rows = R.auction(spark, folder)
    path = _report(
        spark, rows, "D", "IRAUCTION", "RESIDUE_PUBLIC_DATA", "1", F.col("contract_id"), "1", F.col("interconnector_id"),
        F.col("from_region"), F.col("units_offered"), F.col("units_sold"), F.col("clearing_price"), "", "x",
    )
    read = reports.read_residue_results_raw(spark, path, "2024-01", archived=False)
    return read.groupBy("quarter", "tranche").agg(
        F.count(F.lit(1)).alias("n"), F.sum("units_sold").alias("units_sold"),
        F.sum(F.col("clearing_price").cast("decimal(18,2)")).cast("double").alias("clearing_price"),
    )


@REGISTRY.add(
    "read_forecasts",
    """
    SELECT 'p5min_5min' AS source, event_type AS region, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS price
    FROM events GROUP BY ALL
    UNION ALL SELECT 'predispatch_30min', event_type, count(*), round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2)
    FROM events WHERE event_type = 'view' GROUP BY ALL
    """,
)
def read_forecasts(spark, folder):
    rows = R.prices(spark, folder)
    price = F.col("value").cast("decimal(18,2)")
    first = _report(
        spark, rows, "D", "P5MIN", "REGIONSOLUTION", "1", "x", "x", _stamp("timestamp"), F.col("region"), price, "0"
    )
    second = _report(
        spark, rows, "D", "PREDISPATCH", "REGION_PRICES", "1", "x", "x", F.col("region"), "x", "x", price,
        *["0"] * 18, _stamp("timestamp"),
    )
    both = reports.read_p5min_forecast(spark, first, archived=False, newest_only=False).unionByName(
        reports.read_predispatch_forecast(spark, second, ["view"], archived=False, newest_only=False)
    )
    return both.groupBy("source", "region").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("price_mwh").cast("decimal(18,2)")).cast("double"), 2).alias("price")
    )


@REGISTRY.add(
    "file_catalog",
    """
    WITH f AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, o_custkey % 20 AS r FROM orders)
    SELECT 'AUCUNITS_' || strftime(d, '%Y%m%d') || '.R' || lpad(CAST(r AS VARCHAR), 3, '0') AS source_file, d AS effective_date,
           CAST(r AS BIGINT) AS revision FROM f
    UNION ALL
    SELECT DISTINCT 'PUBLIC_SRRES_C' || year(o_orderdate) || 'Q' || quarter(o_orderdate) || 'T' || lpad(CAST(o_custkey % 12 + 1 AS VARCHAR), 2, '0')
           || '_3' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '.csv', CAST(o_orderdate AS DATE), 0 FROM orders
    """,
)
def file_catalog(spark, folder):
    orders = R.table(spark, folder, "orders")
    settlement = orders.select(
        F.concat(
            F.lit("AUCUNITS_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".R"),
            F.lpad(F.expr("CAST(o_custkey % 20 AS STRING)"), 3, "0"),
        ).alias("source_file")
    )
    auctions = orders.select(
        F.concat(
            F.lit("PUBLIC_SRRES_"), R.quarter_label("o_orderdate"), F.lit("T"),
            F.lpad(F.expr("CAST(o_custkey % 12 + 1 AS STRING)"), 2, "0"), F.lit("_3"),
            F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit(".csv"),
        ).alias("source_file")
    )
    listed = catalog.file_catalog(settlement.union(auctions).distinct())
    return listed.select("source_file", "effective_date", F.col("revision").cast("long").alias("revision"))


@REGISTRY.add(
    "load_range",
    """
    SELECT DISTINCT 'PUBLIC_DISPATCH_IRSR_' || strftime(o_orderdate, '%Y%m%d') || '.zip' AS source_file,
           'C' || year(o_orderdate) || 'Q' || quarter(o_orderdate) AS file_quarter
    FROM orders WHERE year(o_orderdate) * 4 + quarter(o_orderdate) BETWEEN 1996 * 4 + 3 AND 1997 * 4 + 2
    """,
)
def load_range(spark, folder):
    names = R.table(spark, folder, "orders").select(
        F.concat(
            F.lit("PUBLIC_DISPATCH_IRSR_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".zip")
        ).alias("source_file")
    ).distinct()
    ranged = catalog.load_range(catalog.file_catalog(names), "C1996Q3", "C1997Q2")
    return ranged.select("source_file", "file_quarter")


@REGISTRY.add(
    "write_quarterly",
    f"WITH {R.QUARTERLY_RESIDUE_SQL} SELECT quarter, interconnector_id, from_region, CAST(residue_aud AS DOUBLE) AS residue_aud FROM quarterly WHERE quarter >= 'C1998Q1'",
)
def write_quarterly(spark, folder):
    path = scratch_path(spark, "quarterly")
    sinks.write_quarterly(R.quarterly_residue(spark, folder), path)
    stored = spark.read.parquet(path).where("quarter >= 'C1998Q1'")
    return stored.select("quarter", "interconnector_id", "from_region", F.col("residue_aud").cast("double").alias("residue_aud"))


@REGISTRY.add(
    "incremental_build",
    """
    SELECT DISTINCT 'C' || year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter FROM orders
    WHERE year(o_orderdate) >= 1998
    """,
)
def incremental_build(spark, folder):
    wanted = R.quarterly_residue(spark, folder)
    path = scratch_path(spark, "quarterly")
    sinks.write_quarterly(wanted.where("quarter < 'C1998Q1'"), path)
    return wanted_minus_existing(wanted, spark.read.parquet(path), ["quarter"])


@REGISTRY.add(
    "append_recommendations",
    "SELECT event_type AS product_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1",
)
def append_recommendations(spark, folder):
    rows = R.table(spark, folder, "events").select(
        F.col("ts").alias("timestamp"), F.col("event_type").alias("product_id"), F.lit("C2024Q1").alias("quarter"),
        F.expr("CAST(event_id AS STRING)").alias("tranche"), "event_id",
    )
    path = scratch_path(spark, "ledger")
    sinks.append_recommendations(rows, path)
    sinks.append_recommendations(rows, path)
    return spark.read.parquet(path).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")
    )


@REGISTRY.add(
    "reconciliation_report",
    f"WITH {CERTIFY_SQL} SELECT quarter, num_categories, certification_status, count(*) OVER () AS total_quarters FROM certified",
)
def reconciliation_report(spark, folder):
    path = scratch_path(spark, "report")
    sinks.write_reconciliation_report(_certified(spark, folder), path)
    document = F.from_json(
        "value",
        "quarters array<struct<quarter string, num_categories bigint, certification_status string>>, "
        "summary struct<total_quarters bigint>",
    )
    parsed = spark.read.text(path).select(document.alias("_d"))
    return parsed.select(F.explode("_d.quarters").alias("_q"), F.col("_d.summary.total_quarters").alias("total_quarters")).select(
        "_q.quarter", "_q.num_categories", "_q.certification_status", "total_quarters"
    )


@REGISTRY.add(
    "read_quarterly_csv",
    """
    WITH f AS (SELECT 'C' || year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter,
                      CASE o_orderstatus WHEN 'P' THEN 'NSW1-QLD1' ELSE 'V-SA' END AS ic, o_orderpriority AS from_region,
                      CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS v FROM orders)
    SELECT quarter, ic AS interconnector_id, from_region, round(CAST(sum(v) AS DOUBLE), 2) AS residue_aud FROM f GROUP BY ALL
    """,
)
def read_quarterly_csv(spark, folder):
    rows = R.table(spark, folder, "orders").select(
        R.quarter_label("o_orderdate").alias("quarter"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'V-S-MNSP1' WHEN 'O' THEN 'V-SA' ELSE 'NSW1-QLD1' END").alias(
            "interconnector_id"
        ),
        F.col("o_orderpriority").alias("from_region"),
        F.expr("CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END").alias("v"),
    )
    sums = rows.groupBy("quarter", "interconnector_id", "from_region", F.col("v").isNull().alias("_bad")).agg(
        F.sum("v").alias("v")
    )
    # Both names of an interconnector go into the same file, since the last file wins.
    canonical = F.when(F.col("interconnector_id") == "V-S-MNSP1", "V-SA").otherwise(F.col("interconnector_id"))
    path = scratch_path(spark, "residue-csv")
    sums.repartition("quarter", canonical, "from_region").select(
        "quarter", "interconnector_id", "from_region",
        F.when(F.col("_bad"), F.lit("bad")).otherwise(F.col("v").cast("string")).alias("residue_aud"),
    ).write.option("header", "true").csv(path)
    return tables.read_quarterly_residue(spark, path).withColumn("residue_aud", F.round("residue_aud", 2))


@REGISTRY.add(
    "opportunities",
    """
    SELECT 'ena_A_' || c_custkey AS id, 'Site ' || c_custkey AS name,
           CASE c_nationkey % 4 WHEN 0 THEN 'Energex' WHEN 1 THEN 'Powercor' END AS dnsp,
           CASE c_nationkey % 4 WHEN 0 THEN 'QLD' WHEN 1 THEN 'VIC' END AS state,
           CASE WHEN c_custkey % 5 > 0 AND c_acctbal > 0 THEN round(c_acctbal / ((0.0262::DOUBLE + 0.033::DOUBLE) * 1000) * 10, 2) END AS demand_reduction_mw
    FROM customer WHERE c_nationkey % 4 IN (0, 1)
    """,
)
def opportunities(spark, folder):
    raw = R.table(spark, folder, "customer").select(
        F.expr("concat('A ', c_custkey)").alias("asset_code"), F.expr("concat(' Site ', c_custkey)").alias("asset_name"),
        F.expr(
            "CASE c_nationkey % 4 WHEN 0 THEN 'Energex' WHEN 1 THEN ' Powercor' WHEN 2 THEN 'Ausgrid' ELSE 'Jemena' END"
        ).alias("network"),
        F.lit("-33.5").alias("latitude"), F.lit("150").alias("longitude"),
        F.expr("CAST(c_custkey % 5 AS STRING)").alias("annual_deferral_pool"),
        F.expr("CAST(c_acctbal AS STRING)").alias("deferrable_invest"),
    )
    return tables.opportunities(raw).select("id", "name", "dnsp", "state", "demand_reduction_mw")


@REGISTRY.add(
    "hourly_wind_at",
    """
    WITH g AS (SELECT ts, event_id, -30.0 - (user_id % 10) AS latitude, 140.0 + (event_id % 8) AS longitude, value / 10.0 AS u, value / 20.0 AS v FROM events)
    SELECT ts AS timestamp, sqrt(u * u + v * v) AS ws10 FROM g
    WHERE latitude = (SELECT arg_min(latitude, (abs(latitude + 34.6), latitude)) FROM g)
      AND longitude = (SELECT arg_min(longitude, (abs(longitude - 142.7), longitude)) FROM g)
    """,
)
def hourly_wind_at(spark, folder):
    grid = R.table(spark, folder, "events").select(
        F.col("ts").alias("timestamp"), F.expr("-30D - (user_id % 10)").alias("latitude"),
        F.expr("140D + (event_id % 8)").alias("longitude"), F.expr("value / 10D").alias("u10"),
        F.expr("value / 20D").alias("v10"), F.expr("value / 5D").alias("u100"), F.expr("value / 10D").alias("v100"),
    )
    return tables.hourly_wind_at(grid, -34.6, 142.7).select("timestamp", "ws10")


@REGISTRY.add(
    "surplus_without_auctions",
    f"""
    WITH {R.QUARTERLY_RESIDUE_SQL},
    sold AS (SELECT DISTINCT 'C' || year(l_shipdate) || 'Q' || quarter(l_shipdate) AS quarter FROM lineitem)
    SELECT quarter, interconnector_id, from_region, CAST(residue_aud AS DOUBLE) AS surplus_aud FROM (
      SELECT 'C' || (year(trading_interval) - 3) || 'Q' || quarter(trading_interval) AS quarter, interconnector_id, from_region,
             sum(residue_aud) AS residue_aud FROM residue GROUP BY ALL)
    WHERE quarter NOT IN (SELECT quarter FROM sold)
    """,
)
def surplus_without_auctions(spark, folder):
    # Quarters moved back three years, so that some have no auction.
    shifted = F.concat(F.lit("C"), (F.year("trading_interval") - 3).cast("string"), F.lit("Q"), F.quarter("trading_interval"))
    surplus = (
        R.residue(spark, folder)
        .groupBy(shifted.alias("quarter"), "interconnector_id", "from_region")
        .agg(F.sum("residue_aud").cast("double").alias("surplus_aud"))
    )
    return residue.surplus_without_auctions(surplus, R.auction(spark, folder), ["quarter"])


@REGISTRY.add(
    "newest_files",
    """
    WITH f AS (SELECT DISTINCT 'AUCUNITS_' || strftime(o_orderdate, '%Y%m%d') || '.R' || lpad(CAST(o_custkey % 20 AS VARCHAR), 3, '0') AS source_file,
                      o_orderdate AS d, o_custkey % 20 AS r FROM orders)
    SELECT source_file FROM f ORDER BY d DESC, r DESC, source_file DESC LIMIT 3
    """,
)
def newest_files(spark, folder):
    names = R.table(spark, folder, "orders").select(
        F.concat(
            F.lit("AUCUNITS_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".R"),
            F.lpad(F.expr("CAST(o_custkey % 20 AS STRING)"), 3, "0"),
        ).alias("source_file")
    ).distinct()
    return catalog.newest_files(catalog.file_catalog(names), 3).select("source_file")


def _archives(spark, path, df, *parts, label="PUBLIC_REPORT", header=None, cut=False) -> str:
    """Report lines in nested archives, written by the tasks; returns the folder."""
    lines = df.select(F.concat_ws(",", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("value"))
    archives.write_archives(lines, path, label, header, cut)
    return path


def _residue_archives(spark, folder) -> str:
    """Values of 5 and more in whole archives, smaller ones in archives cut short, and archives of another report."""
    path = scratch_path(spark, "archives")
    rows = R.intervals(spark, folder)
    line = [
        "D", "DISPATCH", "IRSR", "2", _stamp("trading_interval"), F.col("interconnector_id"), F.col("from_region"),
        F.col("residue_aud"),
    ]
    _archives(spark, path, rows.where("residue_aud >= 5"), *line, label="PUBLIC_DISPATCH_IRSR_20240101")
    _archives(spark, path, rows.where("residue_aud < 5"), *line, label="PUBLIC_DISPATCH_IRSR_20240102", cut=True)
    return _archives(spark, path, rows, "D", "DISPATCH", "OTHER", "2", F.col("from_region"), label="PUBLIC_OTHER_20240101")


@REGISTRY.add("read_residue_archives", REGISTRY.sql["read_residue_report"])
def read_residue_archives(spark, folder):
    read = reports.read_dispatch_residue_archives(spark, _residue_archives(spark, folder))
    return read.groupBy(
        "interconnector_id", "from_region", F.date_trunc("day", "trading_interval").cast("timestamp_ntz").alias("day")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("residue_aud").cast("double").alias("residue_aud"))


@REGISTRY.add(
    "archive_outcomes",
    f"""
    WITH {R.INTERVALS_SQL}
    SELECT 'ok' AS outcome, CAST(count_if(residue_aud >= 5) AS BIGINT) AS n_lines FROM intervals
    UNION ALL SELECT 'empty', 0 UNION ALL SELECT 'corrupt', 0
    """,
)
def archive_outcomes(spark, folder):
    found = archives.archive_outcomes(spark, _residue_archives(spark, folder), ["D,DISPATCH,IRSR,2,"])
    return found.groupBy("outcome").agg(F.sum("n_lines").alias("n_lines"))


@REGISTRY.add("read_surplus_archives", REGISTRY.sql["read_surplus_report"])
def read_surplus_archives(spark, folder):
    rows = R.table(spark, folder, "lineitem")
    path = _archives(
        spark, scratch_path(spark, "archives"), rows, "D", "SETTLEMENTS", "IRSURPLUS", "1", _stamp("l_shipdate"),
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_linestatus"), "0", "0",
        F.col("l_extendedprice").cast("decimal(18,2)"),
    )
    read = reports.read_interval_surplus(spark, path)
    return read.groupBy(F.col("period_id").cast("long").alias("period_id"), "interconnector_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.col("surplus_aud").cast("decimal(18,2)")).cast("double"), 2).alias("surplus_aud"),
    )


@REGISTRY.add("read_billing_archives", REGISTRY.sql["read_billing_runs"])
def read_billing_archives(spark, folder):
    path = _archives(
        spark, scratch_path(spark, "archives"), R.table(spark, folder, "orders"), "D", "BILLING", "RUNTRK", "1",
        F.extract(F.lit("YEAROFWEEK"), F.col("o_orderdate")), F.weekofyear("o_orderdate"), F.expr("o_custkey % 30"),
        F.concat(F.lit('"'), F.lower("o_orderpriority"), F.lit('"')),
    )
    return reports.read_billing_runs(spark, path).groupBy(
        F.col("contract_year").cast("long").alias("contract_year"), F.col("week_no").cast("long").alias("week_no"), "status"
    ).agg(F.count(F.lit(1)).alias("n"), F.max("bill_run_no").cast("long").alias("last_run"))


@REGISTRY.add("read_price_archives", REGISTRY.sql["read_price_report"])
def read_price_archives(spark, folder):
    """Prices by the header of their own archive; columns stand elsewhere than in files without one."""
    price = F.col("value").cast("decimal(18,2)")
    path = _archives(
        spark, scratch_path(spark, "archives"), R.prices(spark, folder), "D", "DISPATCH", "PRICE", "5", F.col("region"), price,
        _stamp("timestamp"), price, "",
        header="I,DISPATCH,PRICE,5,REGIONID,RRP,SETTLEMENTDATE,RAISE6SECRRP,LOWER1SECRRP",
    )
    read = reports.read_dispatch_prices(spark, path, ["view", "click"])
    return read.select("region", "timestamp", "price_mwh", "fcas_raise_6sec_aud_per_mw", "fcas_lower_1sec_aud_per_mw")


@REGISTRY.add("read_monthly_archives", REGISTRY.sql["read_residue_monthly"])
def read_monthly_archives(spark, folder):
    path = _archives(
        spark, scratch_path(spark, "archives"), R.auction(spark, folder), "D", "IRAUCTION", "RESIDUE_PUBLIC_DATA", "1",
        F.col("contract_id"), "1", F.col("interconnector_id"), F.col("from_region"), F.col("units_offered"),
        F.col("units_sold"), F.col("clearing_price"), "", "x", label="PUBLIC_RESIDUE_202401",
    )
    read = reports.read_residue_results_raw(spark, path)
    return read.where("mmsdm_month = '202401'").groupBy("quarter", "tranche").agg(
        F.count(F.lit(1)).alias("n"), F.sum("units_sold").alias("units_sold"),
        F.sum(F.col("clearing_price").cast("decimal(18,2)")).cast("double").alias("clearing_price"),
    )


@REGISTRY.add(
    "read_newest_forecasts",
    """
    WITH f AS (SELECT event_type AS region, date_trunc('hour', ts) AS h, CAST(max(value) AS DECIMAL(18,2)) AS p FROM events GROUP BY ALL)
    SELECT 'p5min_5min' AS source, region, count(*) AS n, CAST(sum(p) AS DOUBLE) AS price FROM f
    WHERE h >= (SELECT max(h) - INTERVAL 5 DAY FROM f) GROUP BY ALL
    UNION ALL SELECT 'predispatch_30min', region, count(*), CAST(sum(p) AS DOUBLE) FROM f
    WHERE region = 'view' AND h >= (SELECT max(h) - INTERVAL 5 DAY FROM f) GROUP BY ALL
    """,
)
def read_newest_forecasts(spark, folder):
    """Forecasts of the last days in one file, as one publication has them; an older file is left closed."""
    hours = R.table(spark, folder, "events").groupBy(
        F.col("event_type").alias("region"), F.date_trunc("hour", "ts").alias("hour")
    ).agg(F.max("value").cast("decimal(18,2)").alias("price"))
    hours = spark.read.schema(hours.schema).parquet(_stored(spark, hours))
    last = hours.agg(F.max("hour").alias("last"))
    # A publication holds five days of hours of a few regions.
    recent = hours.join(F.broadcast(last), F.expr("hour >= last - INTERVAL 5 DAYS")).drop("last").coalesce(1)
    near = scratch_path(spark, "near")
    far = scratch_path(spark, "far")
    for stamp, rows in (("202401010000", hours), ("202401020000", recent)):
        _archives(
            spark, near, rows, "D", "P5MIN", "REGIONSOLUTION", "1", "x", "x", _stamp("hour"), F.col("region"), F.col("price"), "0",
            label=f"PUBLIC_P5MIN_{stamp}",
        )
        _archives(
            spark, far, rows, "D", "PREDISPATCH", "REGION_PRICES", "1", "x", "x", F.col("region"), "x", "x", F.col("price"),
            *["0"] * 18, _stamp("hour"), label=f"PUBLIC_PREDISPATCH_{stamp}",
        )
    both = reports.read_p5min_forecast(spark, near).unionByName(reports.read_predispatch_forecast(spark, far, ["view"]))
    return both.groupBy("source", "region").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("price_mwh").cast("decimal(18,2)")).cast("double").alias("price")
    )


def _stored(spark, df) -> str:
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return path
