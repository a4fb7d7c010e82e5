"""Column builders over the benchmark tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import geo, market, network, quarters, valuation, wind
from . import REGISTRY
from . import roles as R

AS_OF = dt.date(1998, 1, 1)


@REGISTRY.add(
    "quarter_label_counts",
    """
    SELECT 'C' || year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter,
           CAST(year(o_orderdate) AS BIGINT) AS year, CAST(quarter(o_orderdate) AS BIGINT) AS quarter_no,
           CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS BIGINT) AS ordinal,
           year(o_orderdate) * 4 + quarter(o_orderdate) BETWEEN 1996 * 4 + 2 AND 1998 * 4 + 3 AS in_range,
           count(*) AS n
    FROM orders GROUP BY ALL
    """,
)
def quarter_label_counts(spark, folder):
    counts = R.table(spark, folder, "orders").groupBy(quarters.quarter_label("o_orderdate").alias("quarter")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.withColumn("_q", quarters.parse_quarter("quarter")).select(
        "quarter",
        F.col("_q.year").cast("long").alias("year"),
        F.col("_q.quarter_no").cast("long").alias("quarter_no"),
        F.col("_q.ordinal").cast("long").alias("ordinal"),
        quarters.quarter_in_range("quarter", "C1996Q2", "C1998Q3").alias("in_range"),
        "n",
    )


@REGISTRY.add(
    "quarter_closed",
    """
    WITH q AS (
      SELECT DISTINCT 'C' || year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter,
             date_trunc('quarter', o_orderdate) AS s FROM orders
    ), b AS (SELECT quarter, CAST(s AS DATE) AS start_date, last_day(CAST(s + INTERVAL 2 MONTH AS DATE)) AS end_date FROM q)
    SELECT quarter, start_date, end_date, DATE '1998-01-01' > end_date AS closed,
           DATE '1998-01-01' > end_date + 95 AS closed_with_grace
    FROM b
    """,
)
def quarter_closed(spark, folder):
    labels = R.residue(spark, folder).select("quarter").distinct()
    return labels.withColumn("_b", quarters.quarter_bounds("quarter")).select(
        "quarter",
        "_b.*",
        quarters.is_quarter_closed("quarter", AS_OF).alias("closed"),
        quarters.is_quarter_closed("quarter", AS_OF, 95).alias("closed_with_grace"),
    )


@REGISTRY.add(
    "quarter_time_scales",
    """
    WITH q AS (
      SELECT DISTINCT 'C' || year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter,
             CAST(date_trunc('quarter', o_orderdate) AS DATE) AS s FROM orders
    ), b AS (SELECT quarter, s, last_day(CAST(s + INTERVAL 2 MONTH AS DATE)) AS e, DATE '1998-02-15' AS t FROM q),
    d AS (SELECT *, e - s + 1 AS days FROM b)
    SELECT quarter, s AS quarter_start, e AS quarter_end, CAST(days AS BIGINT) AS calendar_days,
           CAST(greatest(s - t, 0) AS BIGINT) AS days_to_start, CAST(greatest(e - t, 0) AS BIGINT) AS days_remaining,
           CAST(days * 288 AS BIGINT) AS total_5min_intervals,
           CAST(round_even(days * 288 * 0.85, 0) AS BIGINT) AS expected_paying_intervals, t >= s AS quarter_started,
           CASE WHEN t <= s THEN 0.0 WHEN t >= e THEN 100.0
                ELSE round((t - s) / CAST(greatest(e - s, 1) AS DOUBLE) * 100.0, 1) END AS progress_pct
    FROM d
    """,
)
def quarter_time_scales(spark, folder):
    day = dt.date(1998, 2, 15)
    labels = R.residue(spark, folder).select("quarter").distinct()
    staged = labels.withColumn("_t", quarters.quarter_time_scales("quarter", day)).select(
        "quarter", "_t.*", quarters.quarter_progress_pct("quarter", day).alias("progress_pct")
    )
    whole = ["calendar_days", "days_to_start", "days_remaining", "total_5min_intervals", "expected_paying_intervals"]
    return staged.withColumns({c: F.col(c).cast("long") for c in whole})


@REGISTRY.add(
    "contract_identifiers",
    f"""
    WITH {R.AUCTION_SQL}
    SELECT contract_id, substr(contract_id, 1, 7) AS quarter, CAST(substr(contract_id, 9, 2) AS BIGINT) AS tranche_no,
           'A' || substr(contract_id, 2, 4) || lpad(CAST(CAST(substr(contract_id, 7, 1) AS INTEGER) * 3 AS VARCHAR), 2, '0') AS auction_id,
           contract_id || ':' || interconnector_id || ':' || from_region AS product_id,
           CASE WHEN from_region = split_part(interconnector_id, '-', 1) THEN split_part(interconnector_id, '-', 2)
                WHEN from_region = split_part(interconnector_id, '-', 2) THEN split_part(interconnector_id, '-', 1)
                ELSE '' END AS to_region,
           count(*) AS n
    FROM auction GROUP BY ALL
    """,
)
def contract_identifiers(spark, folder):
    counts = R.auction(spark, folder).groupBy("contract_id", "interconnector_id", "from_region").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.withColumn("_c", quarters.parse_contract_id("contract_id")).select(
        "contract_id",
        "_c.quarter",
        F.col("_c.tranche_no").cast("long").alias("tranche_no"),
        market.auction_id("_c.quarter").alias("auction_id"),
        market.product_id("contract_id", "interconnector_id", "from_region").alias("product_id"),
        market.other_region("interconnector_id", "from_region").alias("to_region"),
        "n",
    )


@REGISTRY.add(
    "lenient_numbers",
    """
    WITH raw AS (
      SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
             CASE WHEN l_partkey % 5 = 0 THEN '' WHEN l_partkey % 5 = 1 THEN ' ' || CAST(l_quantity AS INTEGER) || ' '
                  ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS units_text,
             CASE WHEN l_suppkey % 7 = 0 THEN '' WHEN l_suppkey % 7 = 1 THEN '1,' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '.5'
                  ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS price_text
      FROM lineitem
    )
    SELECT CAST(l_linenumber AS BIGINT) AS line,
           sum(CAST(coalesce(TRY_CAST(trim(units_text) AS INTEGER), 0) AS BIGINT))::BIGINT AS units,
           CAST(sum(coalesce(TRY_CAST(replace(trim(price_text), ',', '') AS DECIMAL(18,4)), 0)) AS DOUBLE) AS price
    FROM raw GROUP BY l_linenumber
    """,
)
def lenient_numbers(spark, folder):
    raw = R.table(spark, folder, "lineitem").select(
        "l_linenumber",
        F.expr(
            "CASE WHEN l_partkey % 5 = 0 THEN '' WHEN l_partkey % 5 = 1 THEN concat(' ', CAST(l_quantity AS INT), ' ') "
            "ELSE CAST(CAST(l_quantity AS INT) AS STRING) END"
        ).alias("units_text"),
        F.expr(
            "CASE WHEN l_suppkey % 7 = 0 THEN '' "
            "WHEN l_suppkey % 7 = 1 THEN concat('1,', lpad(l_linenumber, 3, '0'), '.5') "
            "ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) END"
        ).alias("price_text"),
    )
    return raw.groupBy(F.col("l_linenumber").cast("long").alias("line")).agg(
        F.sum(market.safe_int("units_text")).alias("units"),
        F.sum(market.safe_decimal("price_text")).cast("double").alias("price"),
    )


@REGISTRY.add(
    "result_status_counts",
    f"""
    WITH {R.AUCTION_SQL}
    SELECT quarter, CASE WHEN units_sold <= 0 THEN 'no_clearance' WHEN units_sold < units_offered THEN 'partial_clearance'
                         ELSE 'cleared' END AS status,
           count(*) AS n, CAST(sum(units_offered) AS BIGINT) AS units_offered,
           round(sum(CAST(round(units_sold / greatest(units_offered, 1), 6) AS DECIMAL(12,6))) / count(*), 6)::DOUBLE AS mean_fill_rate
    FROM auction GROUP BY ALL
    """,
)
def result_status_counts(spark, folder):
    rate = F.round(market.fill_rate("units_sold", "units_offered"), 6).cast("decimal(12,6)")
    return R.auction(spark, folder).groupBy(
        "quarter", market.result_status("units_offered", "units_sold").alias("status")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("units_offered").alias("units_offered"),
        F.round(F.sum(rate).cast("double") / F.count(F.lit(1)), 6).alias("mean_fill_rate"),
    )


@REGISTRY.add(
    "percent_errors",
    """
    WITH p AS (
      SELECT l_linenumber, CASE WHEN l_partkey % 50 = 0 THEN 0.0 ELSE l_extendedprice END AS actual,
             CASE WHEN l_suppkey % 9 = 0 THEN 0.0 ELSE l_quantity * 1000.0 END AS predicted
      FROM lineitem
    ), e AS (
      SELECT l_linenumber, CASE WHEN actual = 0 AND predicted = 0 THEN 0.0 WHEN actual = 0 THEN 100.0
                                ELSE abs((predicted - actual) / actual) * 100.0 END AS err FROM p
    )
    SELECT CAST(l_linenumber AS BIGINT) AS line,
           CAST(sum(CAST(round(err, 4) AS DECIMAL(18,4))) AS DOUBLE) AS error_sum,
           CAST(sum(CAST(round(least(err, 200.0), 4) AS DECIMAL(18,4))) AS DOUBLE) AS capped_sum
    FROM e GROUP BY 1
    """,
)
def percent_errors(spark, folder):
    staged = R.table(spark, folder, "lineitem").select(
        "l_linenumber",
        F.expr("CASE WHEN l_partkey % 50 = 0 THEN 0D ELSE l_extendedprice END").alias("actual"),
        F.expr("CASE WHEN l_suppkey % 9 = 0 THEN 0D ELSE l_quantity * 1000D END").alias("predicted"),
    )

    def total(error):
        return F.sum(F.round(error, 4).cast("decimal(18,4)")).cast("double")

    actual, predicted = F.col("actual"), F.col("predicted")
    return staged.groupBy(F.col("l_linenumber").cast("long").alias("line")).agg(
        total(market.percent_error(actual, predicted)).alias("error_sum"),
        total(market.capped_error(actual, predicted, 200.0)).alias("capped_sum"),
    )


@REGISTRY.add(
    "alias_counts",
    """
    SELECT CASE l_returnflag WHEN 'A' THEN 'V-SA' WHEN 'N' THEN 'V-SA' ELSE 'NSW1-QLD1' END AS interconnector_id,
           count(*) AS n
    FROM lineitem GROUP BY 1
    """,
)
def alias_counts(spark, folder):
    named = R.table(spark, folder, "lineitem").select(
        F.expr(
            "CASE l_returnflag WHEN 'A' THEN 'V-S-MNSP1' WHEN 'N' THEN 'V-SA' ELSE 'NSW1-QLD1' END"
        ).alias("published")
    )
    return named.groupBy(market.alias_interconnector("published").alias("interconnector_id")).agg(
        F.count(F.lit(1)).alias("n")
    )


@REGISTRY.add(
    "interval_irsr",
    """
    WITH x AS (
      SELECT event_id, value AS p_from, value * 1.5 - 10.0 AS p_to, CAST(user_id % 41 - 20 AS DOUBLE) AS flow,
             (event_id % 5) / 2.0 AS loss FROM events
    )
    SELECT event_id,
           CASE WHEN flow >= 0 THEN p_to * (abs(flow) - loss * 0.3333::DOUBLE) - p_from * (abs(flow) + loss * 0.6667::DOUBLE)
                ELSE p_from * (abs(flow) - loss * 0.6667::DOUBLE) - p_to * (abs(flow) + loss * 0.3333::DOUBLE) END AS irsr,
           CASE WHEN flow >= 0 THEN 'forward' ELSE 'reverse' END AS direction
    FROM x
    """,
)
def interval_irsr(spark, folder):
    staged = R.table(spark, folder, "events").select(
        "event_id",
        F.col("value").alias("p_from"),
        F.expr("value * 1.5D - 10D").alias("p_to"),
        F.expr("CAST(user_id % 41 - 20 AS DOUBLE)").alias("flow"),
        F.expr("(event_id % 5) / 2D").alias("loss"),
    )
    return staged.select(
        "event_id",
        valuation.interval_irsr(F.col("p_from"), F.col("p_to"), F.col("flow"), F.col("loss")).alias("_v"),
    ).select("event_id", "_v.*")


@REGISTRY.add(
    "distribution",
    f"""
    WITH {R.QUARTERLY_RESIDUE_SQL}, {R.AUCTION_SQL.strip()},
    sold AS (SELECT quarter, interconnector_id, from_region, sum(units_sold)::BIGINT AS sold, sum(units_offered)::BIGINT AS issued
             FROM auction GROUP BY ALL),
    x AS (SELECT quarter, interconnector_id, from_region, CAST(residue_aud AS DOUBLE) - 9000000.0 AS irsr, sold, issued
          FROM quarterly JOIN sold USING (quarter, interconnector_id, from_region))
    SELECT quarter, interconnector_id, from_region,
           CASE WHEN sold <= 0 THEN 0 WHEN irsr - 5000.0 - 50.0 <= 0 THEN 0
                ELSE greatest((irsr - 5000.0 - 50.0) / sold, 30.0) END AS per_unit,
           CASE WHEN sold <= 0 THEN 0 ELSE (irsr - 5000.0 - 50.0) / sold END AS per_unit_signed,
           greatest(irsr - 5000.0 - 50.0, 0) AS distributable_irsr, greatest(issued - sold, 0) AS units_unsold,
           30.0 * sold AS minimum_payment,
           'Includes 50.0 AUD settlement fees deducted before allocation; minimum payment floor 30.0 AUD/unit' AS fee_treatment,
           CASE WHEN sold <= 0 THEN 0 ELSE greatest(greatest(irsr - 5000.0 - 50.0, 0) / sold, 30.0 * sold / sold) END AS record_payout
    FROM x
    """,
)
def distribution(spark, folder):
    keys = ["quarter", "interconnector_id", "from_region"]
    sold = R.auction(spark, folder).groupBy(*keys).agg(
        F.sum("units_sold").alias("sold"), F.sum("units_offered").alias("issued")
    )
    joined = R.quarterly_residue(spark, folder).join(sold, keys).withColumn(
        "irsr", F.col("residue_aud").cast("double") - 9000000.0
    )
    irsr, units, costs, fee, floor = F.col("irsr"), F.col("sold"), F.lit(5000.0), F.lit(50.0), F.lit(30.0)
    staged = joined.select(
        *keys,
        "sold",
        valuation.distribution_per_unit(irsr, costs, units, True, fee, floor).cast("double").alias("per_unit"),
        valuation.distribution_per_unit(irsr, costs, units, False, fee).cast("double").alias("per_unit_signed"),
        valuation.distribution_record(irsr, costs, F.col("issued"), units, fee, floor).alias("_r"),
    ).select("*", "_r.*")
    return staged.select(
        *keys, "per_unit", "per_unit_signed", "distributable_irsr", "units_unsold", "minimum_payment", "fee_treatment",
        valuation.record_payout_per_unit(F.col("distributable_irsr"), units, F.col("minimum_payment"))
        .cast("double").alias("record_payout"),
    )


@REGISTRY.add(
    "fair_value",
    f"""
    WITH x AS (
      SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS line, 1.0::DOUBLE / (l_quantity + 1) AS share,
             l_extendedprice * 100 AS irsr, l_quantity AS units, l_discount AS risk, l_tax AS liq FROM lineitem
    )
    SELECT l_orderkey, l_partkey, l_suppkey, line,
           {R.sql_round("share * irsr * (1 - (risk + liq))", 2)} AS fair_value_per_unit,
           {R.sql_round("share * irsr * (1 - (risk + liq)) * units", 2)} AS fair_value_total,
           {R.sql_round("share * irsr", 2)} AS expected_distribution_per_unit,
           {R.sql_round("share * irsr * units", 2)} AS expected_distribution_total,
           {R.sql_round("share * (irsr * 0.7::DOUBLE) * (1 - (risk + liq))", 2)} AS confidence_band_low,
           {R.sql_round("share * (irsr * 1.3::DOUBLE) * (1 - (risk + liq))", 2)} AS confidence_band_high
    FROM x
    """,
)
def fair_value(spark, folder):
    staged = R.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("line"),
        F.expr("1D / (l_quantity + 1)").alias("share"), F.expr("l_extendedprice * 100").alias("irsr"),
        "l_quantity", "l_discount", "l_tax",
    )
    irsr = F.col("irsr")
    value = valuation.fair_value(
        F.col("share"), irsr, irsr * 0.7, irsr * 1.3, F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    )
    return staged.select("l_orderkey", "l_partkey", "l_suppkey", "line", value.alias("_v")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "line", "_v.*"
    )


@REGISTRY.add(
    "mark",
    """
    WITH x AS (
      SELECT event_id, value AS accrued, value * 40.0 AS forward, (user_id % 10) / 100.0 AS risk, (event_id % 7) / 100.0 AS liq,
             CASE user_id % 3 WHEN 0 THEN 'live' WHEN 1 THEN '30min_old' ELSE 'stale' END AS fresh FROM events
    ), c AS (SELECT *, forward * (1 - risk) AS fwd, accrued + forward * (1 - risk) AS clean FROM x)
    SELECT event_id, clean AS clean_fair_value, clean - clean * liq AS bid_mark, clean AS mid_mark, clean + clean * liq AS offer_mark,
           (CASE fresh WHEN 'live' THEN 100 WHEN '30min_old' THEN 80 ELSE 50 END + 75 + 70) / 3.0 AS confidence_score,
           forward - fwd AS model_risk_impact, -(clean * liq) AS liquidity_bid_adjustment
    FROM c
    """,
)
def mark(spark, folder):
    staged = R.table(spark, folder, "events").select(
        "event_id",
        F.col("value").alias("accrued"),
        F.expr("value * 40D").alias("forward"),
        F.expr("(user_id % 10) / 100D").alias("risk"),
        F.expr("(event_id % 7) / 100D").alias("liq"),
        F.expr("CASE user_id % 3 WHEN 0 THEN 'live' WHEN 1 THEN '30min_old' ELSE 'stale' END").alias("fresh"),
    )
    marked = staged.select(
        "event_id",
        valuation.mark(F.col("accrued"), F.col("forward"), F.col("risk"), F.col("liq"), F.col("fresh")).alias("_m"),
    )
    return marked.select(
        "event_id", "_m.clean_fair_value", "_m.bid_mark", "_m.mid_mark", "_m.offer_mark", "_m.confidence_score",
        F.col("_m.drivers")["model_risk_impact"].alias("model_risk_impact"),
        F.col("_m.drivers")["liquidity_bid_adjustment"].alias("liquidity_bid_adjustment"),
    )


@REGISTRY.add(
    "recommendation",
    f"""
    WITH x AS (
      SELECT event_id, value AS fair, 50.0 + (user_id % 30) AS market, (event_id % 100) / 100.0 AS conf FROM events
    ), s AS (SELECT *, (fair - market) / market * 100.0 AS spread FROM x)
    SELECT event_id,
           CASE WHEN spread >= 12.0 * (1.0 - conf * 0.5) THEN 'BUY' WHEN spread >= 4.0 * (1.0 - conf * 0.3) THEN 'HOLD'
                WHEN spread <= -(4.0 * (1.0 - conf * 0.3)) THEN 'AVOID' ELSE 'WATCH' END AS label,
           CASE WHEN spread >= 12 THEN 'BUY' WHEN spread >= 4 THEN 'HOLD' WHEN spread <= -8 THEN 'AVOID' ELSE 'WATCH' END
             AS static_label,
           {R.sql_round('fair - market', 2)} AS per_unit, {R.sql_round('spread', 1)} AS premium_pct,
           CASE WHEN {R.sql_round('spread', 1)} >= 2.0 THEN 'LONG' WHEN {R.sql_round('spread', 1)} <= -2.0 THEN 'SHORT' ELSE 'NEUTRAL' END AS side
    FROM s
    """,
)
def recommendation(spark, folder):
    staged = R.table(spark, folder, "events").select(
        "event_id",
        F.col("value").alias("fair"),
        F.expr("50D + (user_id % 30)").alias("market"),
        F.expr("(event_id % 100) / 100D").alias("conf"),
    )
    fair, market_price = F.col("fair"), F.col("market")
    advised = staged.select(
        "event_id",
        valuation.recommendation(fair, market_price, F.col("conf")).alias("_r"),
        valuation.static_recommendation(fair, market_price).alias("_s"),
        market.arbitrage_fields(fair, market_price, F.lit(1)).alias("_a"),
    )
    return advised.select(
        "event_id", F.col("_r.recommendation").alias("label"), F.col("_s.recommendation").alias("static_label"),
        F.col("_a.arbitrage_per_unit_aud").alias("per_unit"), F.col("_a.fair_premium_pct").alias("premium_pct"),
        F.col("_a.arbitrage_side").alias("side"),
    )


@REGISTRY.add(
    "wind_expressions",
    """
    SELECT event_id, sqrt(u * u + v * v) AS speed,
           round(sqrt(u * u + v * v) * pow(100.0 / 10.0, 0.14), 6) AS speed_100m,
           round(greatest(0.0, sin((hour(ts) + minute(ts) / 60.0 - 6.0) / 13.0 * pi())) * (5000.0 / 1000.0 * 0.85), 6) AS solar_mw
    FROM (SELECT event_id, ts, value / 10.0 AS u, (user_id % 20) / 2.0 - 5.0 AS v FROM events)
    """,
)
def wind_expressions(spark, folder):
    staged = R.table(spark, folder, "events").select(
        "event_id", "ts", F.expr("value / 10D").alias("u"), F.expr("(user_id % 20) / 2D - 5D").alias("v")
    )
    speed = wind.wind_speed("u", "v")
    return staged.select(
        "event_id",
        speed.alias("speed"),
        F.round(wind.power_law_speed(speed, 10, F.lit(100.0)), 6).alias("speed_100m"),
        F.round(wind.solar_profile("ts", 5000.0), 6).alias("solar_mw"),
    )


@REGISTRY.add(
    "state_names",
    """
    SELECT CASE c_nationkey % 5 WHEN 0 THEN 'NSW' WHEN 1 THEN 'VIC' WHEN 2 THEN 'QLD' WHEN 3 THEN 'ATL' ELSE '' END AS state,
           CASE c_nationkey % 3 WHEN 0 THEN 'SA' WHEN 1 THEN 'QLD' ELSE '' END AS network_state,
           CASE c_nationkey % 3 WHEN 0 THEN 'SA1' WHEN 1 THEN 'QLD1' ELSE '' END AS nem_region, count(*) AS n
    FROM customer GROUP BY ALL
    """,
)
def state_names(spark, folder):
    staged = R.table(spark, folder, "customer").select(
        F.expr(
            "CASE c_nationkey % 5 WHEN 0 THEN ' New South Wales' WHEN 1 THEN 'vic' WHEN 2 THEN 'queensland' "
            "WHEN 3 THEN 'atlantis' ELSE '' END"
        ).alias("s"),
        F.expr(
            "CASE c_nationkey % 3 WHEN 0 THEN 'SA Power Networks' WHEN 1 THEN 'Energex' ELSE 'Unknown' END"
        ).alias("net"),
    )
    return staged.groupBy(
        network.normalise_state("s").alias("state"),
        network.network_state("net").alias("network_state"),
        network.network_region("net").alias("nem_region"),
    ).agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.add(
    "registration_category",
    """
    SELECT category, requires_registration, agc_interface, causer_pays, CAST(rules AS BIGINT) AS rules, count(*) AS n FROM (
      SELECT CASE WHEN p_size <= 5 THEN 'exempt' WHEN p_size <= 30 THEN 'semi-scheduled' ELSE 'scheduled' END AS category,
             p_size > 5 AS requires_registration, p_size > 5 AS agc_interface, p_size > 5 AS causer_pays,
             CASE WHEN p_size <= 5 THEN 1 WHEN p_size <= 30 THEN 8 ELSE 10 END AS rules
      FROM part) GROUP BY ALL
    """,
)
def registration_category(spark, folder):
    staged = R.table(spark, folder, "part").select(
        F.col("p_size").cast("double").alias("mw")
    ).withColumn("_r", network.registration_category("mw"))
    return staged.groupBy(
        F.col("_r.registration_category").alias("category"),
        F.col("_r.requires_registration").alias("requires_registration"),
        F.col("_r.agc_interface").alias("agc_interface"),
        F.col("_r.causer_pays").alias("causer_pays"),
        F.size("_r.applicable_rules").cast("long").alias("rules"),
    ).agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.add(
    "demand_reduction",
    """
    SELECT p_partkey, CASE WHEN p_size - 10 > 0 AND p_retailprice > 0
      THEN round(p_retailprice / ((CASE WHEN p_size % 2 = 0 THEN 0.0262::DOUBLE ELSE 0.05::DOUBLE END
                                   + 0.033::DOUBLE) * 1000) * 10, 2) END AS mw
    FROM part
    """,
)
def demand_reduction(spark, folder):
    staged = R.table(spark, folder, "part").select(
        "p_partkey", "p_retailprice", F.expr("CAST(p_size - 10 AS DOUBLE)").alias("deferral"),
        F.expr("CASE WHEN p_size % 2 = 0 THEN NULL ELSE 0.05D END").alias("wacc"),
    )
    return staged.select(
        "p_partkey",
        network.demand_reduction_estimate("p_retailprice", "deferral", F.col("wacc"), F.lit(0.0)).alias("mw"),
    )


@REGISTRY.add(
    "haversine",
    f"""
    WITH {R.SITES_SQL}
    SELECT asset_code, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(latitude - -33.87) / 2), 2)
        + cos(radians(-33.87)) * cos(radians(latitude)) * pow(sin(radians(longitude - 151.21) / 2), 2))), 6) AS km
    FROM sites
    """,
)
def haversine(spark, folder):
    return R.sites(spark, folder).select(
        "asset_code",
        F.round(geo.haversine_km(-33.87, 151.21, F.col("latitude"), F.col("longitude")), 6).alias("km"),
    )
