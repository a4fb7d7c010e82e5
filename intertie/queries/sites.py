"""Portfolio, validation, network sites, text, vectors and link graph over the benchmark tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.network import contract_economics
from ..operators import graph, joins, network, portfolio, text, validation
from ..session import scratch_path
from ..sources import tables
from . import REGISTRY
from . import roles as R

S = R.sql_round


@REGISTRY.add(
    "portfolio_pnl",
    f"""
    WITH {R.POSITIONS_SQL}
    SELECT CAST(sum(acquisition_cost) AS DOUBLE) AS total_cost, CAST(sum(accrued_value) AS DOUBLE) AS total_accrued,
           CAST(sum(forward_value) AS DOUBLE) AS total_forward,
           CAST(sum(accrued_value) + sum(forward_value) - sum(acquisition_cost) AS DOUBLE) AS unrealized_pnl,
           CAST(sum(accrued_value) + sum(forward_value) - sum(acquisition_cost) AS DOUBLE) AS total_pnl
    FROM positions WHERE status NOT IN ('EXPIRED', 'CANCELLED')
    """,
)
def portfolio_pnl(spark, folder):
    pnl = portfolio.portfolio_pnl(R.positions(spark, folder))
    return pnl.select(*[F.col(c).cast("double").alias(c) for c in pnl.columns])


@REGISTRY.add(
    "partial_assignment",
    f"""
    WITH {R.POSITIONS_SQL},
    given AS (SELECT srda_id, CAST(custkey % 60 AS INTEGER) AS g FROM positions WHERE category_id = '1-URGENT'),
    j AS (SELECT p.*, g FROM positions p LEFT JOIN given USING (srda_id)),
    parts AS (
      SELECT srda_id, units, acquisition_cost::DOUBLE AS cost, CASE WHEN g = units THEN 'ASSIGNED' ELSE status END AS status,
             accrued_value::DOUBLE AS accrued_value, forward_value::DOUBLE AS forward_value
      FROM j WHERE g IS NULL OR g >= units
      UNION ALL SELECT srda_id, g, acquisition_price::DOUBLE * g, 'ASSIGNED', accrued_value::DOUBLE * g / units, forward_value::DOUBLE * g / units
      FROM j WHERE g < units
      UNION ALL SELECT srda_id || '_remainder', units - g, acquisition_price::DOUBLE * (units - g), status,
             accrued_value::DOUBLE * (units - g) / units, forward_value::DOUBLE * (units - g) / units FROM j WHERE g < units
    )
    SELECT srda_id, CAST(units AS BIGINT) AS units, cost AS acquisition_cost, status, accrued_value, forward_value FROM parts
    """,
)
def partial_assignment(spark, folder):
    positions = R.positions(spark, folder)
    given = positions.where("category_id = '1-URGENT'").select(
        "srda_id", F.expr("CAST(custkey % 60 AS INT)").alias("units_assigned")
    )
    split = portfolio.partial_assignment(positions, given)
    return split.select(
        "srda_id", F.col("units").cast("long").alias("units"), "acquisition_cost", "status", "accrued_value", "forward_value"
    )


SCENARIO_SQL = """
scenarios AS (
  SELECT 'N' || s_nationkey AS category_id, 'C2025Q1' AS quarter, CAST(s_acctbal AS DECIMAL(18,2)) AS forecast_irsr,
         CASE WHEN s_nationkey % 2 = 0 THEN 0.25 ELSE 0.2 END::DECIMAL(6,4) AS probability
  FROM supplier
)"""


def _scenarios(spark, folder):
    return R.table(spark, folder, "supplier").select(
        F.expr("concat('N', s_nationkey)").alias("category_id"),
        F.lit("C2025Q1").alias("quarter"),
        F.expr("CAST(s_acctbal AS DECIMAL(18,2))").alias("forecast_irsr"),
        F.expr("CAST(CASE WHEN s_nationkey % 2 = 0 THEN 0.25 ELSE 0.2 END AS DECIMAL(6,4))").alias("probability"),
    )


@REGISTRY.add(
    "scenario_weighted",
    f"""
    WITH {SCENARIO_SQL}
    SELECT category_id, CASE WHEN abs(sum(probability) - 1) <= 0.01 THEN CAST(sum(forecast_irsr * probability) AS DOUBLE) END AS expected_irsr
    FROM scenarios GROUP BY category_id
    """,
)
def scenario_weighted(spark, folder):
    expected = portfolio.probability_weighted(_scenarios(spark, folder))
    return expected.select("category_id", F.col("expected_irsr").cast("double").alias("expected_irsr"))


@REGISTRY.add(
    "scenario_percentile",
    f"""
    WITH {SCENARIO_SQL},
    r AS (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY forecast_irsr) - 1 AS i, count(*) OVER (PARTITION BY category_id) AS n
          FROM scenarios)
    SELECT category_id, p, CAST(forecast_irsr AS DOUBLE) AS irsr FROM r, (SELECT unnest([5, 25, 50, 75, 95])::BIGINT AS p)
    WHERE i = CASE WHEN n = 3 THEN CASE WHEN p <= 25 THEN 0 WHEN p <= 75 THEN 1 ELSE 2 END
              ELSE greatest(0, least(n - 1, CAST(floor(p / 100.0 * n) AS BIGINT))) END
    """,
)
def scenario_percentile(spark, folder):
    parts = None
    for p in (5, 25, 50, 75, 95):
        part = portfolio.scenario_percentile(_scenarios(spark, folder), p).select(
            "category_id", F.lit(p).cast("long").alias("p"), F.col("irsr").cast("double").alias("irsr")
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


@REGISTRY.add(
    "calendar_events",
    """
    WITH e AS (SELECT o_orderkey, o_orderdate AS s, o_orderdate + INTERVAL 10 DAY AS e FROM orders)
    SELECT 'active' AS kind, o_orderkey FROM e WHERE TIMESTAMP '1998-02-15' BETWEEN s AND e
    UNION ALL SELECT 'upcoming', o_orderkey FROM (SELECT * FROM e WHERE s > TIMESTAMP '1998-02-15' ORDER BY s, o_orderkey LIMIT 5)
    """,
)
def calendar_events(spark, folder):
    at = dt.datetime(1998, 2, 15)
    events = R.table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("open_datetime"),
        (F.col("o_orderdate") + F.expr("INTERVAL '10' DAY")).alias("close_datetime"),
    )
    active = portfolio.active_events(events, at).select(F.lit("active").alias("kind"), "o_orderkey")
    upcoming = portfolio.upcoming_events(events, at, 5, ["o_orderkey"]).select(
        F.lit("upcoming").alias("kind"), "o_orderkey"
    )
    return active.unionByName(upcoming)


@REGISTRY.add(
    "order_reconcile",
    """
    SELECT (SELECT count(*) FROM orders) AS orders_submitted, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS orders_reported,
           (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS orders_matched,
           (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS orders_missing
    """,
)
def order_reconcile(spark, folder):
    submitted = R.table(spark, folder, "orders").select(F.col("o_orderkey").alias("order_id"))
    reported = R.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("order_id"))
    return portfolio.reconcile_orders(submitted, reported)


@REGISTRY.add(
    "orders_missing",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def orders_missing(spark, folder):
    submitted = R.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    reported = R.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return portfolio.missing_orders(submitted, reported, "o_orderkey")


@REGISTRY.add(
    "orders_matched",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
)
def orders_matched(spark, folder):
    submitted = R.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    reported = R.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return portfolio.matched_orders(submitted, reported, "o_orderkey")


@REGISTRY.add(
    "auction_units",
    f"""
    WITH {R.AUCTION_SQL},
    last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY interconnector_id, quarter, tranche_no
                              ORDER BY order_key DESC, part_key DESC, supp_key DESC) AS rn FROM auction) WHERE rn = 1)
    SELECT interconnector_id AS category_id, quarter, CAST(sum(units_offered) AS BIGINT) AS units_offered,
           CAST(sum(units_sold) AS BIGINT) AS units_sold,
           (SELECT CAST(sum(clearing_price) AS DOUBLE) FROM last l WHERE l.interconnector_id = a.interconnector_id AND l.quarter = a.quarter)
             AS last_prices
    FROM auction a GROUP BY ALL
    """,
)
def auction_units(spark, folder):
    results = R.auction(spark, folder).select(
        F.col("interconnector_id").alias("category_id"), "quarter", "tranche_no", "units_offered",
        F.col("units_sold").alias("units_cleared"), "clearing_price", *R.FILE_ORDER,
    )
    last = portfolio.clearing_price_lookup(results, R.FILE_ORDER).groupBy("category_id", "quarter").agg(
        F.sum("clearing_price").cast("double").alias("last_prices")
    )
    return portfolio.auction_units(results).join(last, ["category_id", "quarter"])


@REGISTRY.add(
    "validate_products",
    """
    WITH p AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber * 2 AS tranche_no, CAST(l_quantity AS INTEGER) - 1 AS max_units,
                      1.0 / l_quantity AS unit_proportion FROM lineitem),
    m AS (SELECT l_orderkey, l_partkey, l_suppkey,
                 concat_ws('|', CASE WHEN tranche_no NOT BETWEEN 1 AND 12 THEN 'tranche_no must be 1..12' END,
                           CASE WHEN max_units <= 0 THEN 'max_units must be > 0' END,
                           CASE WHEN NOT (unit_proportion > 0 AND unit_proportion < 1) THEN 'unit_proportion must be between 0 and 1' END) AS messages FROM p)
    SELECT * FROM m WHERE messages <> ''
    """,
)
def validate_products(spark, folder):
    rows = R.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.expr("l_linenumber * 2").alias("tranche_no"),
        F.expr("CAST(l_quantity AS INT) - 1").alias("max_units"), F.expr("1D / l_quantity").alias("unit_proportion"),
    )
    failing = validation.failing_rows(rows, validation.product_rules(), ["l_orderkey", "l_partkey", "l_suppkey"])
    return failing.withColumn("messages", F.array_join("messages", "|"))


@REGISTRY.add(
    "validate_orders",
    """
    WITH d AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL HAVING count(*) > 1),
    o AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey, l_suppkey, l_quantity - 3 AS quantity, l_extendedprice - 2000.0 AS price,
                 c IS NOT NULL AS dup FROM lineitem LEFT JOIN d USING (l_orderkey, l_linenumber)),
    m AS (SELECT l_orderkey, line, l_partkey, l_suppkey, concat_ws('|', CASE WHEN quantity <= 0 THEN 'quantity must be > 0' END,
                 CASE WHEN price < 0 THEN 'price cannot be negative' END,
                 CASE WHEN l_partkey % 40 = 0 THEN 'product_id required' END,
                 CASE WHEN dup THEN 'duplicate l_orderkey, line' END) AS messages FROM o)
    SELECT * FROM m WHERE messages <> ''
    """,
)
def validate_orders(spark, folder):
    rows = R.table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_partkey", "l_suppkey",
        F.expr("l_quantity - 3").alias("quantity"), F.expr("l_extendedprice - 2000D").alias("price"),
        F.expr("CASE WHEN l_partkey % 40 = 0 THEN '' ELSE concat('P', l_partkey) END").alias("product_id"),
        F.lit("A").alias("auction_id"),
    )
    failing = validation.failing_rows(
        rows, validation.order_rules(), ["l_orderkey", "line", "l_partkey", "l_suppkey"], ["l_orderkey", "line"]
    )
    return failing.withColumn("messages", F.array_join("messages", "|"))


ASSETS_SQL = f"""{R.SITES_SQL},
history AS (SELECT 'A' || o_custkey AS asset_code, CAST(year(o_orderdate) AS INTEGER) AS year, max(o_totalprice) AS v, min(o_totalprice) AS w
            FROM orders GROUP BY ALL),
def AS (SELECT asset_code, v * 0.5 AS adv FROM history WHERE year = (SELECT max(year) FROM history)),
cap AS (SELECT asset_code, v AS cap, w AS load, (v - w * 10) * 100 AS avail FROM (
          SELECT *, row_number() OVER (PARTITION BY asset_code ORDER BY year DESC) AS rn FROM history) WHERE rn = 1),
assets AS (
  SELECT s.* EXCLUDE (annual_deferral_aud, available_mva), coalesce(adv, annual_deferral_aud) AS annual_deferral_aud, cap AS capacity_mva,
         load AS peak_demand_mva, coalesce(avail, available_mva) AS available_mva
  FROM sites s LEFT JOIN def USING (asset_code) LEFT JOIN cap USING (asset_code)
)"""


def _assets(spark, folder):
    history = R.table(spark, folder, "orders").groupBy(
        F.expr("concat('A', o_custkey)").alias("asset_code"), F.year("o_orderdate").alias("year")
    ).agg(F.max("o_totalprice").alias("v"), F.min("o_totalprice").alias("w"))
    deferral = history.select("asset_code", "year", F.expr("v * 0.5D").alias("annual_deferral_aud"))
    capacity = history.select(
        "asset_code", "year", F.col("v").alias("capacity"), F.col("w").alias("load"),
        F.expr("(v - w * 10) * 100").alias("available_capacity"),
    )
    assets = R.sites(spark, folder).withColumns(
        {"capacity_mva": F.lit(None).cast("double"), "peak_demand_mva": F.lit(None).cast("double")}
    )
    return network.assets_with_latest(assets, deferral, capacity)


@REGISTRY.add(
    "asset_latest",
    f"""
    WITH {ASSETS_SQL}
    SELECT asset_code, annual_deferral_aud, capacity_mva, peak_demand_mva, available_mva FROM assets
    """,
)
def asset_latest(spark, folder):
    return _assets(spark, folder).select(
        "asset_code", "annual_deferral_aud", "capacity_mva", "peak_demand_mva", "available_mva"
    )


@REGISTRY.add("read_network_assets", REGISTRY.sql["asset_latest"])
def read_network_assets(spark, folder):
    """The three network tables written as CSV and read back; a figure that is no number counts as missing."""
    history = R.table(spark, folder, "orders").groupBy(
        F.expr("concat('A', o_custkey)").alias("asset_code"), F.year("o_orderdate").alias("year")
    ).agg(F.max("o_totalprice").alias("v"), F.min("o_totalprice").alias("w"))
    place = [F.lit("x").alias(c) for c in ("asset_name", "network", "state")] + [
        F.lit(0.0).alias(c) for c in ("latitude", "longitude")
    ]
    deferral = history.select("asset_code", *place, F.expr("v * 0.5D").alias("annual_deferral_aud"), "year")
    capacity = history.select(
        "asset_code", *place, F.col("v").alias("capacity"), F.col("w").alias("load"),
        F.expr("(v - w * 10) * 100").alias("available_capacity"), "year",
    )
    investment = R.sites(spark, folder).withColumns({
        "capacity_mva": F.lit("n/a"), "peak_demand_mva": F.lit(""),
        "available_mva": F.coalesce(F.col("available_mva").cast("string"), F.lit("unknown")),
    })
    paths = []
    for table in (investment, deferral, capacity):
        paths.append(scratch_path(spark, "network"))
        table.write.option("header", "true").csv(paths[-1])
    return network.assets_with_latest(*tables.read_network_assets(spark, *paths)).select(
        "asset_code", "annual_deferral_aud", "capacity_mva", "peak_demand_mva", "available_mva"
    )


@REGISTRY.add(
    "validate_positions",
    """
    WITH p AS (SELECT o_orderkey, o_custkey % 7 - 1 AS units_held, o_totalprice - 50000.0 AS price FROM orders),
    m AS (SELECT o_orderkey, concat_ws('|', CASE WHEN units_held < 0 THEN 'units_held must be >= 0' END,
                 CASE WHEN price < 0 THEN 'acquisition_price_per_unit must be >= 0' END) AS messages FROM p)
    SELECT * FROM m WHERE messages <> ''
    """,
)
def validate_positions(spark, folder):
    rows = R.table(spark, folder, "orders").select(
        "o_orderkey", F.expr("o_custkey % 7 - 1").alias("units_held"),
        F.expr("o_totalprice - 50000D").alias("acquisition_price_per_unit"),
    )
    failing = validation.failing_rows(rows, validation.position_rules(), ["o_orderkey"])
    return failing.withColumn("messages", F.array_join("messages", "|"))


@REGISTRY.add(
    "validate_inputs",
    """
    WITH p AS (SELECT o_orderkey, (o_orderkey % 12) / 10.0 AS c, (o_custkey % 13 - 1) / 10.0 AS r,
                      CASE WHEN o_custkey % 5 > 0 THEN (o_custkey % 11) / 10.0 END AS l FROM orders),
    m AS (SELECT o_orderkey, concat_ws('|', CASE WHEN NOT (c > 0 AND c < 1) THEN 'confidence_level must be between 0 and 1' END,
                 CASE WHEN NOT (r >= 0 AND r < 1) THEN 'model_risk_discount must be in [0, 1)' END,
                 CASE WHEN NOT coalesce(l >= 0 AND l < 1, false) THEN 'liquidity_discount must be in [0, 1)' END) AS messages FROM p)
    SELECT * FROM m WHERE messages <> ''
    """,
)
def validate_inputs(spark, folder):
    """Valuation inputs out of their ranges; a missing one counts as out of range."""
    rows = R.table(spark, folder, "orders").select(
        "o_orderkey", F.expr("(o_orderkey % 12) / 10D").alias("confidence_level"),
        F.expr("(o_custkey % 13 - 1) / 10D").alias("model_risk_discount"),
        F.expr("CASE WHEN o_custkey % 5 > 0 THEN (o_custkey % 11) / 10D END").alias("liquidity_discount"),
    )
    failing = validation.failing_rows(rows, validation.input_rules(), ["o_orderkey"])
    return failing.withColumn("messages", F.array_join("messages", "|"))


ECONOMICS_SQL = f"""{ASSETS_SQL},
e1 AS (
  SELECT *, aug_cost_aud / 1000000.0 AS deferrable_m,
         CASE network WHEN 'Ausgrid' THEN 'NSW' WHEN 'Powercor' THEN 'VIC' WHEN 'Energex' THEN 'QLD' WHEN 'TasNetworks' THEN 'TAS'
              WHEN 'Evoenergy' THEN 'ACT' WHEN 'SA Power Networks' THEN 'SA' ELSE '' END AS state,
         CASE network WHEN 'Ausgrid' THEN 'NSW1' WHEN 'Powercor' THEN 'VIC1' WHEN 'Energex' THEN 'QLD1' WHEN 'TasNetworks' THEN 'TAS1'
              WHEN 'Evoenergy' THEN 'NSW1' WHEN 'SA Power Networks' THEN 'SA1' ELSE '' END AS nem_region,
         coalesce(CASE WHEN annual_deferral_aud > 0 THEN annual_deferral_aud ELSE aug_cost_aud * 0.08::DOUBLE END, 0.0) AS adv_real,
         greatest(1, least(CAST(substr(proposed_timing, 1, 4) AS INTEGER) - 2026, 15)) AS nna_term_yrs,
         CASE WHEN available_mva < 0 THEN abs(available_mva) / 1000000.0 ELSE 0.0 END AS deficit_mw
  FROM assets
), economics AS (
  SELECT *, CASE WHEN deficit_mw > 0 THEN {S("greatest(deficit_mw, 1.0)", 1)} WHEN deferrable_m > 0 THEN {S("greatest(deferrable_m * 3.0, 2.0)", 1)} ELSE 5.0 END AS ideal_bess_mw,
         CASE WHEN deficit_mw > 0 THEN {S("deficit_mw * 2.5", 1)} WHEN deferrable_m > 0 THEN {S(S("greatest(deferrable_m * 3.0, 2.0)", 1) + " * 2.0", 1)} ELSE 10.0 END AS ideal_solar_mw
  FROM e1
)"""


def _economics(spark, folder):
    return network.site_economics(_assets(spark, folder), 2026)


@REGISTRY.add(
    "site_economics",
    f"""
    WITH {ECONOMICS_SQL}
    SELECT asset_code, state, nem_region, adv_real, CAST(nna_term_yrs AS BIGINT) AS nna_term_yrs, deficit_mw, ideal_bess_mw, ideal_solar_mw,
           adv_real * nna_term_yrs AS contract_total_aud, ideal_bess_mw * 800000 AS capex_low_aud,
           CASE WHEN adv_real > 0 THEN ideal_bess_mw * 1200000 / adv_real END AS payback_high_years,
           CASE WHEN adv_real > 0 AND ideal_bess_mw > 0 THEN adv_real / ideal_bess_mw END AS value_per_mw
    FROM economics
    """,
)
def site_economics(spark, folder):
    rows = _economics(spark, folder).withColumn(
        "_c", contract_economics("adv_real", "aug_cost_aud", "ideal_bess_mw", "nna_term_yrs")
    )
    return rows.select(
        "asset_code", "state", "nem_region", "adv_real", F.col("nna_term_yrs").cast("long").alias("nna_term_yrs"),
        "deficit_mw", "ideal_bess_mw", "ideal_solar_mw", "_c.contract_total_aud", "_c.capex_low_aud",
        "_c.payback_high_years", "_c.value_per_mw",
    )


DISTANCE = (
    "2 * 6371.0 * asin(sqrt(pow(sin(radians({0} - {2}) / 2), 2) + cos(radians({0})) * cos(radians({2})) "
    "* pow(sin(radians({1} - {3}) / 2), 2)))"
)


@REGISTRY.add(
    "within_radius",
    f"""
    WITH {R.SITES_SQL}, d AS (SELECT asset_code, {DISTANCE.format("latitude", "longitude", "-33.87", "149.2")} AS km FROM sites)
    SELECT asset_code, round(km, 1) AS distance_km FROM d WHERE km <= 300
    """,
)
def within_radius(spark, folder):
    return network.within_radius(R.sites(spark, folder), -33.87, 149.2, 300.0).select("asset_code", "distance_km")


FACTORS_SQL = """
factors AS (
  SELECT CASE s_suppkey % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' ELSE 'Z' END AS region, s_suppkey,
         -44.0 + (s_suppkey * 53 % 3400) / 100.0 AS latitude, 113.0 + (s_suppkey * 71 % 4000) / 100.0 AS longitude,
         0.9 + (s_suppkey % 20) / 100.0 AS factor
  FROM supplier
), points AS (
  SELECT asset_code, CASE CAST(substr(asset_code, 2) AS BIGINT) % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' ELSE 'Z' END AS region,
         latitude, longitude FROM sites
)"""


@REGISTRY.add(
    "nearest_factor",
    f"""
    WITH {R.SITES_SQL}, {FACTORS_SQL.strip()},
    d AS (SELECT asset_code, factor, s_suppkey, {DISTANCE.format("p.latitude", "p.longitude", "f.latitude", "f.longitude")} AS km
          FROM points p JOIN factors f ON p.region = f.region),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_code ORDER BY round(km, 6), s_suppkey) AS rn FROM d WHERE km <= 300) WHERE rn = 1)
    SELECT asset_code, coalesce(factor, 1.0) AS factor, round(km, 6) AS distance_km FROM points LEFT JOIN b USING (asset_code)
    """,
)
def nearest_factor(spark, folder):
    factors = R.table(spark, folder, "supplier").select(
        F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' ELSE 'Z' END").alias("region"), "s_suppkey",
        F.expr("-44D + (s_suppkey * 53 % 3400) / 100D").alias("latitude"),
        F.expr("113D + (s_suppkey * 71 % 4000) / 100D").alias("longitude"),
        F.expr("0.9D + (s_suppkey % 20) / 100D").alias("factor"),
    )
    points = R.sites(spark, folder).select(
        "asset_code",
        F.expr(
            "CASE CAST(substr(asset_code, 2) AS BIGINT) % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' ELSE 'Z' END"
        ).alias("region"),
        "latitude", "longitude",
    )
    found = network.nearest_factor(points, factors, 300.0, tie_break=["s_suppkey"])
    return found.select("asset_code", "factor", F.round("distance_km", 6).alias("distance_km"))


BOARD_SQL = f"""{ECONOMICS_SQL},
dist AS (SELECT *, round({DISTANCE.format("-33.87", "149.2", "latitude", "longitude")}, 1) AS distance_km FROM economics),
boards AS (
  SELECT 'nearby' AS board, * FROM (SELECT * FROM dist WHERE distance_km <= 150 ORDER BY adv_real DESC, deferrable_m DESC, asset_code LIMIT 5)
  UNION ALL SELECT 'state', * FROM (SELECT * FROM dist WHERE state = 'NSW' ORDER BY adv_real DESC, deferrable_m DESC, asset_code LIMIT 10)
  UNION ALL SELECT 'national', * FROM (SELECT * FROM dist ORDER BY adv_real DESC, deferrable_m DESC, asset_code LIMIT 5)
  UNION ALL SELECT 'per_mw', * FROM (SELECT * FROM dist WHERE ideal_bess_mw > 0 ORDER BY adv_real / ideal_bess_mw DESC, asset_code LIMIT 10)
)"""


def _boards(spark, folder):
    return network.leaderboards(_economics(spark, folder), -33.87, 149.2, "NSW", radius_km=150.0)


@REGISTRY.add("leaderboards", f"WITH {BOARD_SQL} SELECT board, asset_code, adv_real, distance_km FROM boards")
def leaderboards(spark, folder):
    return _boards(spark, folder).select("board", "asset_code", "adv_real", "distance_km")


@REGISTRY.add(
    "leaderboard_metrics",
    f"""
    WITH {ECONOMICS_SQL}
    SELECT state, CAST(round(sum(CAST(aug_cost_aud AS DECIMAL(28,6))), 2) AS DOUBLE) AS total_cost_aud,
           CAST(round(sum(CAST(adv_real AS DECIMAL(28,6))), 2) AS DOUBLE) AS total_adv_aud, round(avg(0.9 + nna_term_yrs / 100.0), 4) AS mean_combined_lf
    FROM economics GROUP BY state
    """,
)
def leaderboard_metrics(spark, folder):
    rows = _economics(spark, folder).withColumn("combined_lf", F.expr("0.9D + nna_term_yrs / 100D"))
    return network.leaderboard_metrics(rows, ["state"])


@REGISTRY.add(
    "merge_registers",
    """
    WITH u AS (SELECT 'R' || (c_custkey % 700) AS id, c_name AS name, 0 AS o, c_acctbal AS v, NULL AS z FROM customer
               UNION ALL SELECT 'R' || (s_suppkey * 9), s_name, 1, s_acctbal, s_nationkey FROM supplier)
    SELECT id, name, v, CAST(z AS BIGINT) AS z FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, name, v, z) AS rn FROM u) WHERE rn = 1
    """,
)
def merge_registers(spark, folder):
    first = R.table(spark, folder, "customer").select(
        F.expr("concat('R', c_custkey % 700)").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("v")
    )
    second = R.table(spark, folder, "supplier").select(
        F.expr("concat('R', s_suppkey * 9)").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("v"),
        F.col("s_nationkey").cast("long").alias("z"),
    )
    return network.merge_registers([first, second])


SEARCH = "the and of people"


def _search_sql() -> str:
    score = " + ".join(
        f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in text.query_words(SEARCH)
    )
    return f"""
    WITH s AS (SELECT doc_id, {score} AS score, text FROM documents)
    SELECT doc_id, CAST(score AS BIGINT) AS score, replace(substr(trim(text, E' \\t\\n\\r'), 1, 600), E'\\n', ' ') AS snippet
    FROM s WHERE score > 0 ORDER BY score DESC, doc_id DESC LIMIT 8
    """


@REGISTRY.add("keyword_search", _search_sql())
def keyword_search(spark, folder):
    return text.keyword_search(R.table(spark, folder, "documents"), SEARCH)


def _first_n_sql() -> str:
    from ..functions.market import NEWS_KEYWORDS

    hit = " OR ".join(f"contains(lower(lang || ' ' || text), '{k.lower()}')" for k in NEWS_KEYWORDS)
    return f"""
    SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
                                FROM documents WHERE {hit}) WHERE rn <= 5
    """


@REGISTRY.add("first_relevant_per_feed", _first_n_sql())
def first_relevant_per_feed(spark, folder):
    rows = R.table(spark, folder, "documents").select("source", "doc_id", "lang", "text")
    return text.first_relevant_per_feed(rows, 5, "source", ["doc_id"], "lang", "text").select("source", "doc_id")


@REGISTRY.add(
    "exclude_drafted",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def exclude_drafted(spark, folder):
    return joins.exclude_existing(
        R.table(spark, folder, "documents").select("doc_id", "source"), R.table(spark, folder, "labels"), ["doc_id"]
    )


@REGISTRY.add(
    "vector_search",
    """
    WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS similarity FROM embeddings, q
    ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id LIMIT 8
    """,
)
def vector_search(spark, folder):
    vectors = R.table(spark, folder, "embeddings")
    # The query vector is an argument of the search: one row of the table.
    query = vectors.where("vec_id = 0").select("embedding").first()[0]
    return text.vector_search(vectors, query).withColumn("similarity", F.round("similarity", 9))


LINK = 'href="/([^"#]+)"'
EDGES_SQL = f"""
notes AS (SELECT regexp_extract(html, '{LINK}', 1) AS name, html, page_id FROM pages),
links AS (SELECT name AS source, trim(unnest(regexp_extract_all(html, '{LINK}', 1))) AS target FROM notes),
edges AS (SELECT source, target FROM links WHERE source <> target AND target IN (SELECT name FROM notes)),
ends AS (SELECT source AS n, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, 0, 1 FROM edges),
degrees AS (SELECT name, CAST(coalesce(sum(o), 0) AS BIGINT) AS out_degree, CAST(coalesce(sum(i), 0) AS BIGINT) AS in_degree,
                   CAST(coalesce(sum(o + i), 0) AS BIGINT) AS degree, coalesce(sum(o + i), 0) = 0 AS orphan
            FROM (SELECT DISTINCT name FROM notes) LEFT JOIN ends ON name = n GROUP BY name)"""


def _notes(spark, folder):
    return R.table(spark, folder, "pages").select(
        F.regexp_extract("html", LINK, 1).alias("name"), F.col("html").alias("text"), "page_id"
    )


def _edges(spark, folder):
    return graph.link_edges(_notes(spark, folder), pattern=LINK)


@REGISTRY.add("link_edges", f"WITH {EDGES_SQL} SELECT source, target, count(*) AS n FROM edges GROUP BY ALL")
def link_edges(spark, folder):
    return _edges(spark, folder).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.add("degree_counts", f"WITH {EDGES_SQL} SELECT * FROM degrees")
def degree_counts(spark, folder):
    counts = graph.degree_counts(_edges(spark, folder), _notes(spark, folder))
    return counts.withColumns({c: F.col(c).cast("long") for c in ("out_degree", "in_degree", "degree")})


@REGISTRY.add(
    "top_nodes",
    f"""
    WITH {EDGES_SQL}
    SELECT name, substr(name, 1, 50) AS label, CAST(least(3 + degree * 0.4, 14) AS DOUBLE) AS size, degree, orphan
    FROM degrees ORDER BY degree DESC, name LIMIT 40
    """,
)
def top_nodes(spark, folder):
    degrees = graph.degree_counts(_edges(spark, folder), _notes(spark, folder))
    return graph.top_nodes(degrees, 40).withColumn("degree", F.col("degree").cast("long"))


@REGISTRY.add(
    "induced_edges",
    f"""
    WITH {EDGES_SQL}, top AS (SELECT name FROM degrees ORDER BY degree DESC, name LIMIT 40)
    SELECT source, target, count(*) AS n FROM edges WHERE source IN (SELECT name FROM top) AND target IN (SELECT name FROM top) GROUP BY ALL
    """,
)
def induced_edges(spark, folder):
    edges = _edges(spark, folder)
    top = graph.top_nodes(graph.degree_counts(edges, _notes(spark, folder)), 40)
    return graph.induced_edges(edges, top).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.add(
    "folder_counts",
    "SELECT source AS folder, count(*) AS n FROM documents GROUP BY source",
)
def folder_counts(spark, folder):
    rows = R.table(spark, folder, "documents").select(F.col("source").alias("folder"))
    return graph.folder_counts(rows)


@REGISTRY.add(
    "most_recent_orders",
    "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10",
)
def most_recent_orders(spark, folder):
    rows = R.table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return text.most_recent(rows, "o_orderdate", 10, ["o_orderkey"])


@REGISTRY.add(
    "distinct_values",
    """
    SELECT DISTINCT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders
    UNION SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders
    """,
)
def distinct_values(spark, folder):
    return graph.distinct_values(R.table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])


@REGISTRY.add(
    "filter_sites",
    f"""
    WITH {R.SITES_SQL} SELECT asset_code, network, annual_deferral_aud FROM sites
    WHERE network IN ('Ausgrid', 'Energex') AND annual_deferral_aud > 0
    """,
)
def filter_sites(spark, folder):
    return network.filter_sites(R.sites(spark, folder), ["Ausgrid", "Energex"], None, True).select(
        "asset_code", "network", "annual_deferral_aud"
    )


@REGISTRY.add(
    "align_flags",
    """
    WITH f AS (SELECT date_trunc('hour', ts) AS h, max(value > 100) AS flag, max(value / 100.0) AS act FROM events
               WHERE event_type = 'error' GROUP BY 1)
    SELECT event_id, coalesce(flag, false) AS event_flag, coalesce(act, 1.0) AS activation
    FROM events LEFT JOIN f ON date_trunc('hour', ts) = h
    """,
)
def align_flags(spark, folder):
    hourly = R.table(spark, folder, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    flags = hourly.where("event_type = 'error'").select(
        "hour", (F.col("value") > 100).alias("event_flag"), (F.col("value") / 100.0).alias("activation")
    )
    aligned = joins.align_flags(hourly.select("event_id", "hour"), flags, ["hour"], {"event_flag": False, "activation": 1.0})
    return aligned.drop("hour")


@REGISTRY.add(
    "cancellation_prices",
    """
    SELECT o_orderpriority AS category_id, 'C' || year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, count(*) AS n,
           max(o_totalprice) AS highest
    FROM orders WHERE o_totalprice >= 100000 GROUP BY ALL
    """,
)
def cancellation_prices(spark, folder):
    results = R.table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("category_id"), R.quarter_label("o_orderdate").alias("quarter"),
        F.expr("CASE WHEN o_totalprice < 100000 THEN 0D ELSE o_totalprice END").alias("cancellation_price"),
    )
    return portfolio.cancellation_prices(results).groupBy("category_id", "quarter").agg(
        F.count(F.lit(1)).alias("n"), F.max("cancellation_price").alias("highest")
    )


@REGISTRY.add(
    "validate_marks",
    """
    WITH m AS (SELECT event_id, value AS bid, value + (user_id % 5) - 1 AS mid, value + 2.0 AS offer, (event_id % 110) - 2.0 AS conf,
                      (user_id % 12) / 10.0 AS risk FROM events),
    x AS (SELECT event_id, concat_ws('|', CASE WHEN bid > mid THEN 'Bid mark cannot exceed mid mark' END,
                 CASE WHEN mid > offer THEN 'Mid mark cannot exceed offer mark' END,
                 CASE WHEN conf NOT BETWEEN 0 AND 100 THEN 'Confidence score must be 0-100' END,
                 CASE WHEN risk NOT BETWEEN 0 AND 1 THEN 'Model risk discount must be 0-1' END) AS messages FROM m)
    SELECT * FROM x WHERE messages <> ''
    """,
)
def validate_marks(spark, folder):
    marks = R.table(spark, folder, "events").select(
        "event_id", F.col("value").alias("bid_mark"), F.expr("value + (user_id % 5) - 1").alias("mid_mark"),
        F.expr("value + 2D").alias("offer_mark"), F.expr("(event_id % 110) - 2D").alias("confidence_score"),
        F.expr("(user_id % 12) / 10D").alias("model_risk_discount"), F.lit(0.03).alias("liquidity_discount"),
    )
    failing = validation.failing_rows(marks, validation.mark_rules(), ["event_id"])
    return failing.withColumn("messages", F.array_join("messages", "|"))


@REGISTRY.add(
    "combined_loss_factor",
    f"""
    WITH {R.SITES_SQL}, {FACTORS_SQL.strip()},
    d AS (SELECT asset_code, s_suppkey, factor, 1.0 + (s_suppkey % 7) / 100.0 AS factor2,
                 {DISTANCE.format("p.latitude", "p.longitude", "f.latitude", "f.longitude")} AS km
          FROM points p JOIN factors f ON p.region = f.region),
    a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_code ORDER BY round(km, 6), factor) AS rn FROM d WHERE km <= 100) WHERE rn = 1),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_code ORDER BY round(km, 6), factor2) AS rn FROM d WHERE km <= 100) WHERE rn = 1),
    f AS (SELECT asset_code, {S("coalesce(a.factor, 1.0)", 4)} AS mlf, {S("coalesce(b.factor2, 1.0)", 4)} AS dlf
          FROM points LEFT JOIN a USING (asset_code) LEFT JOIN b USING (asset_code))
    SELECT asset_code, mlf, dlf, {S("mlf * dlf", 4)} AS combined_lf FROM f
    """,
)
def combined_loss_factor(spark, folder):
    placed = R.table(spark, folder, "supplier").select(
        F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' ELSE 'Z' END").alias("region"),
        F.expr("-44D + (s_suppkey * 53 % 3400) / 100D").alias("latitude"),
        F.expr("113D + (s_suppkey * 71 % 4000) / 100D").alias("longitude"),
        F.expr("0.9D + (s_suppkey % 20) / 100D").alias("first"), F.expr("1D + (s_suppkey % 7) / 100D").alias("second"),
    )
    points = R.sites(spark, folder).select(
        "asset_code",
        F.expr(
            "CASE CAST(substr(asset_code, 2) AS BIGINT) % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' ELSE 'Z' END"
        ).alias("region"),
        "latitude", "longitude",
    )
    where = ["region", "latitude", "longitude"]
    found = network.combined_loss_factor(
        points, placed.select(*where, F.col("first").alias("factor")), placed.select(*where, F.col("second").alias("factor"))
    )
    return found.select("asset_code", "mlf", "dlf", "combined_lf")
