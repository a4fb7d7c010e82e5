"""The benchmark tables in the roles of market tables, as DataFrames and as SQL.

Every function reads a whole table and renames or derives columns; the SQL text
next to it says the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quarters import quarter_label
from ..sources.tables import read_table


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def number(expression: str):
    return F.expr(expression)


def sql_round(expression: str, digits: int) -> str:
    """SQL for rounding a double half up on its decimal text, which is how ``round`` works in Spark."""
    return f"CAST(round(CAST(CAST({expression} AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


# Auction rows: one per line item.
AUCTION_SQL = """
auction AS (
  SELECT 'C' || year(l_shipdate) || 'Q' || quarter(l_shipdate) AS quarter,
         'C' || year(l_shipdate) || 'Q' || quarter(l_shipdate) || 'T' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS contract_id,
         l_linenumber AS tranche_no,
         l_returnflag || '1-' || l_linestatus || '1' AS interconnector_id,
         CASE WHEN l_partkey % 2 = 0 THEN l_returnflag || '1' ELSE l_linestatus || '1' END AS from_region,
         CAST(l_quantity AS INTEGER) + 2 * CAST(round(l_tax * 100) AS INTEGER) AS units_offered,
         CAST(l_quantity AS INTEGER) AS units_sold,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS clearing_price,
         l_orderkey AS order_key, l_partkey AS part_key, l_suppkey AS supp_key, l_shipdate AS ship_date
  FROM lineitem
)"""
FILE_ORDER = ["order_key", "part_key", "supp_key"]


def auction(spark: SparkSession, folder: str) -> DataFrame:
    label = quarter_label("l_shipdate")
    return table(spark, folder, "lineitem").select(
        label.alias("quarter"),
        F.concat(label, F.lit("T"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0")).alias("contract_id"),
        F.col("l_linenumber").alias("tranche_no"),
        number("concat(l_returnflag, '1-', l_linestatus, '1')").alias("interconnector_id"),
        number("CASE WHEN l_partkey % 2 = 0 THEN concat(l_returnflag, '1') ELSE concat(l_linestatus, '1') END").alias(
            "from_region"
        ),
        number("CAST(l_quantity AS INT) + 2 * CAST(round(l_tax * 100) AS INT)").alias("units_offered"),
        number("CAST(l_quantity AS INT)").alias("units_sold"),
        number("CAST(l_extendedprice AS DECIMAL(18,2))").alias("clearing_price"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        F.col("l_shipdate").alias("ship_date"),
    )


# Residue records: one per order.
RESIDUE_SQL = """
residue AS (
  SELECT o_orderdate AS trading_interval,
         'C' || year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter,
         CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END || '1-'
           || CASE WHEN o_orderkey % 2 = 0 THEN 'F1' ELSE 'O1' END AS interconnector_id,
         CASE WHEN o_custkey % 2 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'A1' WHEN 'O' THEN 'N1' ELSE 'R1' END
              ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'F1' ELSE 'O1' END END AS from_region,
         CAST(o_totalprice AS DECIMAL(18,2)) AS residue_aud,
         o_orderkey AS order_key
  FROM orders
)"""


def residue(spark: SparkSession, folder: str) -> DataFrame:
    first = "CASE o_orderstatus WHEN 'F' THEN 'A1' WHEN 'O' THEN 'N1' ELSE 'R1' END"
    second = "CASE WHEN o_orderkey % 2 = 0 THEN 'F1' ELSE 'O1' END"
    return table(spark, folder, "orders").select(
        F.col("o_orderdate").alias("trading_interval"),
        quarter_label("o_orderdate").alias("quarter"),
        number(f"concat({first}, '-', {second})").alias("interconnector_id"),
        number(f"CASE WHEN o_custkey % 2 = 0 THEN {first} ELSE {second} END").alias("from_region"),
        number("CAST(o_totalprice AS DECIMAL(18,2))").alias("residue_aud"),
        F.col("o_orderkey").alias("order_key"),
    )


QUARTERLY_RESIDUE_SQL = RESIDUE_SQL + """,
quarterly AS (
  SELECT quarter, interconnector_id, from_region, sum(residue_aud) AS residue_aud FROM residue GROUP BY ALL
)"""


def quarterly_residue(spark: SparkSession, folder: str) -> DataFrame:
    return residue(spark, folder).groupBy("quarter", "interconnector_id", "from_region").agg(
        F.sum("residue_aud").alias("residue_aud")
    )


# Weekly settlement rows: one per line item, a few per category.
WEEKS_SQL = """
weeks AS (
  SELECT 'C' || year(l_shipdate) || 'Q' || quarter(l_shipdate) AS quarter,
         'P' || (l_partkey % 500) AS interconnector_id, l_linestatus AS from_region,
         CASE WHEN l_linenumber = 1 THEN 'PRELIMINARY' WHEN l_linenumber <= 5 THEN 'REVISION ' || (l_linenumber - 1)
              ELSE 'FINAL' END AS bill_run_type,
         CAST(week(l_shipdate) AS INTEGER) AS week_no, CAST(l_shipdate AS DATE) AS effective_date,
         lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_partkey AS VARCHAR), 12, '0')
           || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') || l_linenumber AS source_file,
         CAST(l_quantity AS INTEGER) AS purchased_units,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS total_surplus,
         CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS distributed_surplus,
         CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS auction_fees,
         CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_tax AS DECIMAL(4,2))) AS net_payment,
         CAST(l_extendedprice AS DECIMAL(18,2)) * 3 AS accumulated_net_payment
  FROM lineitem
)"""


def settlement_weeks(spark: SparkSession, folder: str) -> DataFrame:
    price, tax, discount = (
        "CAST(l_extendedprice AS DECIMAL(18,2))", "CAST(l_tax AS DECIMAL(4,2))", "CAST(l_discount AS DECIMAL(4,2))",
    )
    return table(spark, folder, "lineitem").select(
        quarter_label("l_shipdate").alias("quarter"),
        number("concat('P', l_partkey % 500)").alias("interconnector_id"),
        F.col("l_linestatus").alias("from_region"),
        number(
            "CASE WHEN l_linenumber = 1 THEN 'PRELIMINARY' WHEN l_linenumber <= 5 "
            "THEN concat('REVISION ', l_linenumber - 1) ELSE 'FINAL' END"
        ).alias("bill_run_type"),
        F.weekofyear("l_shipdate").alias("week_no"),
        F.to_date("l_shipdate").alias("effective_date"),
        number(
            "concat(lpad(l_orderkey, 12, '0'), lpad(l_partkey, 12, '0'), lpad(l_suppkey, 12, '0'), l_linenumber)"
        ).alias("source_file"),
        number("CAST(l_quantity AS INT)").alias("purchased_units"),
        number(price).alias("total_surplus"),
        number(f"{price} * (1 - {discount})").alias("distributed_surplus"),
        number(f"{price} * {tax}").alias("auction_fees"),
        number(f"{price} * (1 - {tax})").alias("net_payment"),
        number(f"{price} * 3").alias("accumulated_net_payment"),
    )


# Price series: one row per event.
PRICES_SQL = """
prices AS (
  SELECT event_type AS region, ts AS timestamp, value - 20.0 AS price_mwh, event_id, user_id, value FROM events
)"""


def prices(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_type").alias("region"),
        F.col("ts").alias("timestamp"),
        number("value - 20.0D").alias("price_mwh"),
        "event_id",
        "user_id",
        "value",
    )


# Interval residue: one row per event.
INTERVALS_SQL = """
intervals AS (
  SELECT ts AS trading_interval, event_type AS interconnector_id,
         CASE WHEN user_id % 2 = 0 THEN 'N1' ELSE 'S1' END AS from_region,
         CAST(value AS DECIMAL(18,2)) AS residue_aud, event_id
  FROM events
)"""


def intervals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("ts").alias("trading_interval"),
        F.col("event_type").alias("interconnector_id"),
        number("CASE WHEN user_id % 2 = 0 THEN 'N1' ELSE 'S1' END").alias("from_region"),
        number("CAST(value AS DECIMAL(18,2))").alias("residue_aud"),
        "event_id",
    )


# Dispatched intervals: one row per event.
DISPATCH_SQL = """
dispatch AS (
  SELECT event_type AS strategy_id, ts AS timestamp, event_id,
         value - 20.0 AS interval_revenue_aud,
         round(value * 0.6, 2) AS arb_revenue_aud, round(value * 0.4, 2) AS fcas_revenue_aud,
         CAST(user_id % 101 AS DOUBLE) AS soc_pct,
         CASE WHEN (event_id % 7) / 2.0 - (user_id % 5) / 2.0 > 0.05 THEN 'discharge'
              WHEN (event_id % 7) / 2.0 - (user_id % 5) / 2.0 < -0.05 THEN 'charge' ELSE 'idle' END AS action
  FROM events
)"""


def dispatch(spark: SparkSession, folder: str) -> DataFrame:
    from ..functions.market import action_label

    staged = table(spark, folder, "events").withColumns(
        {"_charge": number("(user_id % 5) / 2.0D"), "_discharge": number("(event_id % 7) / 2.0D")}
    )
    return staged.select(
        F.col("event_type").alias("strategy_id"),
        F.col("ts").alias("timestamp"),
        "event_id",
        number("value - 20.0D").alias("interval_revenue_aud"),
        number("round(value * 0.6D, 2)").alias("arb_revenue_aud"),
        number("round(value * 0.4D, 2)").alias("fcas_revenue_aud"),
        number("CAST(user_id % 101 AS DOUBLE)").alias("soc_pct"),
        action_label("_charge", "_discharge").alias("action"),
    )


# Wind series: one row per line item.
WIND_SQL = """
wind AS (SELECT l_shipdate AS timestamp, l_extendedprice / 5000.0 AS ws10 FROM lineitem)"""


def wind(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_shipdate").alias("timestamp"), number("l_extendedprice / 5000.0D").alias("ws10")
    )


# Sites: one per customer, on a made-up grid of coordinates.
SITES_SQL = """
sites AS (
  SELECT 'A' || c_custkey AS asset_code, c_name AS asset_name,
         CASE c_nationkey % 7 WHEN 0 THEN 'Ausgrid' WHEN 1 THEN 'Powercor' WHEN 2 THEN 'Energex' WHEN 3 THEN 'TasNetworks'
              WHEN 4 THEN 'Evoenergy' WHEN 5 THEN 'SA Power Networks' ELSE 'Other' END AS network,
         -44.0 + (c_custkey * 37 % 3400) / 100.0 AS latitude, 113.0 + (c_custkey * 91 % 4000) / 100.0 AS longitude,
         CASE WHEN c_acctbal > 0 THEN c_acctbal * 1000 ELSE 0 END AS aug_cost_aud,
         CASE WHEN c_custkey % 3 = 0 THEN c_acctbal * 50 END AS annual_deferral_aud,
         CASE WHEN c_custkey % 4 = 0 THEN c_acctbal * 1000 END AS available_mva,
         CAST(2020 + c_custkey % 30 AS VARCHAR) AS proposed_timing
  FROM customer
)"""


def sites(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        number("concat('A', c_custkey)").alias("asset_code"),
        F.col("c_name").alias("asset_name"),
        number(
            "CASE c_nationkey % 7 WHEN 0 THEN 'Ausgrid' WHEN 1 THEN 'Powercor' WHEN 2 THEN 'Energex' "
            "WHEN 3 THEN 'TasNetworks' WHEN 4 THEN 'Evoenergy' WHEN 5 THEN 'SA Power Networks' ELSE 'Other' END"
        ).alias("network"),
        number("-44.0D + (c_custkey * 37 % 3400) / 100.0D").alias("latitude"),
        number("113.0D + (c_custkey * 91 % 4000) / 100.0D").alias("longitude"),
        number("CASE WHEN c_acctbal > 0 THEN c_acctbal * 1000 ELSE 0D END").alias("aug_cost_aud"),
        number("CASE WHEN c_custkey % 3 = 0 THEN c_acctbal * 50 END").alias("annual_deferral_aud"),
        number("CASE WHEN c_custkey % 4 = 0 THEN c_acctbal * 1000 END").alias("available_mva"),
        number("CAST(2020 + c_custkey % 30 AS STRING)").alias("proposed_timing"),
    )


# Positions: one per order.
POSITIONS_SQL = """
positions AS (
  SELECT 'S' || o_orderkey AS srda_id, o_orderpriority AS category_id,
         'C' || year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter,
         CAST(o_orderkey % 50 + 1 AS INTEGER) AS units,
         CAST(o_totalprice AS DECIMAL(18,2)) AS acquisition_price,
         CAST(o_totalprice AS DECIMAL(18,2)) * (o_orderkey % 50 + 1) AS acquisition_cost,
         CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'EXPIRED' ELSE 'ASSIGNED' END AS status,
         CAST(o_custkey * 100 AS DECIMAL(18,2)) AS accrued_value, CAST(o_custkey * 250 AS DECIMAL(18,2)) AS forward_value,
         o_custkey AS custkey
  FROM orders
)"""


def positions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        number("concat('S', o_orderkey)").alias("srda_id"),
        F.col("o_orderpriority").alias("category_id"),
        quarter_label("o_orderdate").alias("quarter"),
        number("CAST(o_orderkey % 50 + 1 AS INT)").alias("units"),
        number("CAST(o_totalprice AS DECIMAL(18,2))").alias("acquisition_price"),
        number("CAST(o_totalprice AS DECIMAL(18,2)) * CAST(o_orderkey % 50 + 1 AS INT)").alias("acquisition_cost"),
        number("CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'EXPIRED' ELSE 'ASSIGNED' END").alias("status"),
        number("CAST(o_custkey * 100 AS DECIMAL(18,2))").alias("accrued_value"),
        number("CAST(o_custkey * 250 AS DECIMAL(18,2))").alias("forward_value"),
        F.col("o_custkey").alias("custkey"),
    )


# Recommendation ledger: one row per event, the outcome is the next event of the type.
LEDGER_SQL = """
ledger AS (
  SELECT *, CASE WHEN markout_24h_pct IS NULL THEN NULL WHEN recommendation IN ('BUY', 'HOLD') THEN markout_24h_pct > 0
                 WHEN recommendation = 'AVOID' THEN markout_24h_pct < 0 ELSE abs(markout_24h_pct) <= 50 END
              AS recommendation_correct_24h,
         CASE WHEN user_id % 3 = 0 THEN NULL ELSE next_value > value END AS recommendation_correct_7d
  FROM (
    SELECT event_id, user_id, value, next_value,
           CASE event_type WHEN 'error' THEN 'AVOID' WHEN 'view' THEN 'WATCH' WHEN 'click' THEN 'HOLD' ELSE 'BUY' END
             AS recommendation,
           CAST((event_id % 60 + 40) / 100.0 AS DECIMAL(6,4)) AS confidence,
           value - 50.0 AS spread_pct,
           CAST(user_id % 101 AS DOUBLE) AS fill_rate_percentile,
           (next_value - value) / nullif(value, 0) * 100.0 AS markout_24h_pct
    FROM (SELECT *, lead(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS next_value FROM events)
  )
)"""


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.ordering import neighbour

    paired = neighbour(table(spark, folder, "events"), ["event_type"], ["ts", "event_id"], {"next_value": ("value", 1)})
    staged = paired.select(
        "event_id", "user_id", "value", "next_value",
        number(
            "CASE event_type WHEN 'error' THEN 'AVOID' WHEN 'view' THEN 'WATCH' WHEN 'click' THEN 'HOLD' ELSE 'BUY' END"
        ).alias("recommendation"),
        number("CAST((event_id % 60 + 40) / 100.0 AS DECIMAL(6,4))").alias("confidence"),
        number("value - 50.0D").alias("spread_pct"),
        number("CAST(user_id % 101 AS DOUBLE)").alias("fill_rate_percentile"),
        number("(next_value - value) / nullif(value, 0D) * 100.0D").alias("markout_24h_pct"),
    )
    return staged.select(
        "*",
        number(
            "CASE WHEN markout_24h_pct IS NULL THEN NULL WHEN recommendation IN ('BUY', 'HOLD') THEN markout_24h_pct > 0 "
            "WHEN recommendation = 'AVOID' THEN markout_24h_pct < 0 ELSE abs(markout_24h_pct) <= 50 END"
        ).alias("recommendation_correct_24h"),
        number("CASE WHEN user_id % 3 = 0 THEN NULL ELSE next_value > value END").alias("recommendation_correct_7d"),
    )
