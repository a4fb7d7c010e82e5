"""Market analytics and trades over the benchmark tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import market, trades
from . import REGISTRY
from . import roles as R

AS_OF = dt.date(1998, 2, 15)
S = R.sql_round

FRAME_SQL = f"""{R.AUCTION_SQL},
frame AS (
  SELECT *, quarter || ':' || interconnector_id || ':' || from_region AS product_key,
         CAST(units_sold AS DOUBLE) / greatest(units_offered, 1) AS fill_rate
  FROM auction WHERE clearing_price > 0
)"""


def _frame(spark, folder):
    return market.market_frame(R.auction(spark, folder))


@REGISTRY.add(
    "percentile_rank_avg",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS line,
           (rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0) / count(*) OVER () * 100.0 AS pct
    FROM lineitem
    """,
)
def percentile_rank_avg(spark, folder):
    rows = R.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("line"), "l_quantity"
    )
    return market.percentile_rank(rows, "l_quantity", "pct").drop("l_quantity")


@REGISTRY.add(
    "cume_pct",
    f"""
    SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS line,
           {S("cume_dist() OVER (ORDER BY l_extendedprice) * 100.0", 2)} AS pct
    FROM lineitem
    """,
)
def cume_pct(spark, folder):
    rows = R.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("line"), "l_extendedprice"
    )
    return market.share_at_or_below(rows, "l_extendedprice", "pct").drop("l_extendedprice")


PAIR_NAMES = ["fill_rate", "units_sold", "units_offered", "clearing_price"]


def _corr_sql(method: str) -> str:
    columns = PAIR_NAMES
    if method == "spearman":
        ranks = ", ".join(
            f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in columns
        )
        source, used = f"(SELECT {ranks} FROM frame)", [f"r_{c}" for c in columns]
    else:
        source, used = "frame", columns
    parts = [
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)), 4) AS corr FROM src"
        for a, x in zip(columns, used)
        for b, y in zip(columns, used)
    ]
    return f"WITH {FRAME_SQL}, src AS (SELECT * FROM {source}) " + " UNION ALL ".join(parts)


@REGISTRY.add("correlation_pearson", _corr_sql("pearson"))
def correlation_pearson(spark, folder):
    return market.correlation_matrix(_frame(spark, folder), PAIR_NAMES)


@REGISTRY.add("correlation_spearman", _corr_sql("spearman"))
def correlation_spearman(spark, folder):
    narrow = _frame(spark, folder).select(*PAIR_NAMES)
    return market.correlation_matrix(narrow, PAIR_NAMES, "spearman")


def _stats_sql(key: str) -> str:
    return f"""
    WITH {FRAME_SQL}
    SELECT {key}, count(*) AS rows, round(avg(CAST(clearing_price AS DOUBLE)), 4) AS mean_price,
           round(coalesce(stddev_samp(CAST(clearing_price AS DOUBLE)), 0), 4) AS price_std, round(avg(fill_rate), 4) AS mean_fill_rate,
           round(corr(fill_rate, CAST(clearing_price AS DOUBLE)), 4) AS fill_vs_price_corr
    FROM frame GROUP BY {key}
    """


@REGISTRY.add("group_stats_interconnector", _stats_sql("interconnector_id"))
def group_stats_interconnector(spark, folder):
    return market.group_stats(_frame(spark, folder), "interconnector_id")


@REGISTRY.add("group_stats_quarter", _stats_sql("quarter"))
def group_stats_quarter(spark, folder):
    return market.group_stats(_frame(spark, folder), "quarter")


TREND_SQL = f"""{FRAME_SQL},
trends AS (
  SELECT product_key, count(*) AS n_points, CAST(min(tranche_no) AS BIGINT) AS tranche_start,
         CAST(max(tranche_no) AS BIGINT) AS tranche_end,
         round(regr_slope(CAST(clearing_price AS DOUBLE), CAST(tranche_no AS DOUBLE)), 4) AS price_slope_per_tranche,
         round(coalesce(CASE WHEN stddev_samp(fill_rate) = 0 OR stddev_samp(CAST(clearing_price AS DOUBLE)) = 0 THEN 0
                             ELSE corr(fill_rate, CAST(clearing_price AS DOUBLE)) END, 0), 4) AS fill_price_corr,
         CAST(arg_min(clearing_price, (tranche_no, order_key, part_key, supp_key)) AS DOUBLE) AS start_price,
         CAST(arg_max(clearing_price, (tranche_no, order_key, part_key, supp_key)) AS DOUBLE) AS end_price
  FROM frame GROUP BY product_key HAVING count(DISTINCT tranche_no) >= 2
)"""


def _trends(spark, folder):
    trends = market.trend_by_product(_frame(spark, folder), tie_break=R.FILE_ORDER)
    return trends.withColumns({c: F.col(c).cast("long") for c in ("tranche_start", "tranche_end")})


@REGISTRY.add("tranche_trend", f"WITH {TREND_SQL} SELECT * FROM trends")
def tranche_trend(spark, folder):
    return _trends(spark, folder)


@REGISTRY.add(
    "tranche_trend_totals",
    f"""
    WITH {TREND_SQL}
    SELECT count(*) AS products_with_trend, count(*) FILTER (price_slope_per_tranche > 0) AS rising_trends,
           count(*) FILTER (price_slope_per_tranche < 0) AS falling_trends, round(avg(price_slope_per_tranche), 4) AS avg_slope
    FROM trends
    """,
)
def tranche_trend_totals(spark, folder):
    return market.trend_totals(_trends(spark, folder))


@REGISTRY.add(
    "tranche_trend_top",
    f"""
    WITH {TREND_SQL}
    SELECT product_key, price_slope_per_tranche, n_points FROM trends
    ORDER BY price_slope_per_tranche DESC, product_key LIMIT 100
    """,
)
def tranche_trend_top(spark, folder):
    return market.top_trends(_trends(spark, folder)).select("product_key", "price_slope_per_tranche", "n_points")


PAIRS_SQL = f"""{FRAME_SQL},
ranked AS (
  SELECT *, (rank() OVER (ORDER BY fill_rate) + (count(*) OVER (PARTITION BY fill_rate) - 1) / 2.0) / count(*) OVER () * 100.0 AS f
  FROM frame
), led AS (
  SELECT *, CAST(clearing_price AS DOUBLE) AS cur,
         CAST(lead(clearing_price) OVER (PARTITION BY product_key ORDER BY tranche_no, order_key, part_key, supp_key) AS DOUBLE) AS nxt
  FROM ranked
), chg AS (
  SELECT *, CASE WHEN f >= 70 THEN 'BUY' WHEN f <= 30 THEN 'AVOID' ELSE 'WATCH' END AS recommendation,
         (nxt - cur) / cur * 100.0 AS change FROM led WHERE nxt IS NOT NULL
), pairs AS (
  SELECT product_key, quarter, CAST(tranche_no AS BIGINT) AS tranche_no, recommendation, {S("f", 2)} AS fill_rate_pct,
         cur AS current_price, nxt AS next_price, {S("change", 4)} AS forward_return_pct,
         {S("CASE recommendation WHEN 'BUY' THEN change WHEN 'AVOID' THEN -change ELSE -abs(change) END", 4)} AS signal_markout_pct,
         CASE recommendation WHEN 'BUY' THEN change > 0 WHEN 'AVOID' THEN change < 0 ELSE abs(change) <= 2.0 END AS correct
  FROM chg
)"""


def _pairs(spark, folder):
    frame = market.percentile_rank(_frame(spark, folder), "fill_rate", "fill_rate_pct")
    return market.tranche_pairs(frame, ["tranche_no", *R.FILE_ORDER]).withColumn(
        "tranche_no", F.col("tranche_no").cast("long")
    )


@REGISTRY.add("tranche_pairs", f"WITH {PAIRS_SQL} SELECT * FROM pairs")
def tranche_pairs(spark, folder):
    return _pairs(spark, folder)


@REGISTRY.add(
    "tranche_backtest",
    f"""
    WITH {PAIRS_SQL}
    SELECT recommendation, count(*) AS count, round(avg(CAST(correct AS DOUBLE)), 4) AS hit_rate,
           round(avg(forward_return_pct), 4) AS avg_forward_return_pct, round(avg(signal_markout_pct), 4) AS avg_signal_markout_pct
    FROM pairs GROUP BY recommendation
    """,
)
def tranche_backtest(spark, folder):
    return market.backtest_by_recommendation(_pairs(spark, folder))


@REGISTRY.add(
    "tranche_backtest_overall",
    f"""
    WITH {PAIRS_SQL}
    SELECT count(*) AS pairs_evaluated, round(avg(CAST(correct AS DOUBLE)), 4) AS overall_hit_rate,
           round(avg(signal_markout_pct), 4) AS strategy_avg_signal_markout_pct,
           round(-avg(abs(forward_return_pct)), 4) AS baseline_watch_all_markout_pct,
           round(avg(signal_markout_pct) + avg(abs(forward_return_pct)), 4) AS uplift_vs_baseline_pct
    FROM pairs
    """,
)
def tranche_backtest_overall(spark, folder):
    return market.backtest_overall(_pairs(spark, folder))


MARKS_SQL = f"""{R.AUCTION_SQL},
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contract_id, interconnector_id, from_region
                        ORDER BY order_key DESC, part_key DESC, supp_key DESC) AS rn FROM auction) WHERE rn = 1
), base AS (
  SELECT contract_id, quarter, tranche_no, interconnector_id, from_region,
         CASE WHEN from_region = split_part(interconnector_id, '-', 1) THEN split_part(interconnector_id, '-', 2)
              ELSE split_part(interconnector_id, '-', 1) END AS to_region,
         greatest(units_offered, 1) AS units_offered, units_sold,
         {S("CAST(units_sold AS DOUBLE) / greatest(units_offered, 1)", 6)} AS fill_rate,
         CAST(clearing_price AS DOUBLE) AS market_price_aud
  FROM latest
), ranked AS (
  SELECT *, {S("cume_dist() OVER (ORDER BY fill_rate) * 100.0", 2)} AS fill_rate_percentile,
         {S("cume_dist() OVER (ORDER BY units_offered) * 100.0", 2)} AS volume_percentile FROM base
), sig AS (
  SELECT *, least(greatest((fill_rate_percentile - 50.0) / 50.0, -1.0), 1.0) AS fs,
         least(greatest((volume_percentile - 50.0) / 50.0, -1.0), 1.0) AS vs FROM ranked
), val AS (
  SELECT *, {S("least(greatest(market_price_aud * (1.0 + 0.20 * fs + 0.05 * vs), market_price_aud * 0.60), market_price_aud * 1.60)", 2)} AS fair,
         {S("least(greatest(0.74::DOUBLE * abs(fs) + 0.15::DOUBLE * greatest(0.5, 0.5 + 0.5 * vs) + 0.10::DOUBLE * CASE WHEN market_price_aud > 0 THEN 1.0 ELSE 0.0 END, 0.0), 1.0)", 3)} AS conf
  FROM sig
), adv AS (
  SELECT *, (fair - market_price_aud) / market_price_aud * 100 AS spread,
         {S("(fair - market_price_aud) / market_price_aud * 100.0", 1)} AS fair_premium_pct,
         {S("fair - market_price_aud", 2)} AS arbitrage_per_unit_aud FROM val
), marks AS (
  SELECT contract_id || ':' || interconnector_id || ':' || from_region AS product_id, contract_id, quarter, tranche_no,
         interconnector_id, from_region, to_region, from_region || '→' || to_region AS direction_label, units_offered, units_sold,
         fill_rate, fill_rate_percentile, volume_percentile, market_price_aud, fair AS fair_value_per_unit_aud,
         conf AS recommendation_confidence, {S("fs", 2)} AS fill_rate_signal, {S("vs", 2)} AS volume_signal,
         fair_premium_pct, arbitrage_per_unit_aud, {S("arbitrage_per_unit_aud * units_sold", 2)} AS arbitrage_total_aud,
         CASE WHEN fair_premium_pct >= 2.0 THEN 'LONG' WHEN fair_premium_pct <= -2.0 THEN 'SHORT' ELSE 'NEUTRAL' END AS arbitrage_side,
         CASE WHEN spread >= 12.0 * (1.0 - conf * 0.5) THEN 'BUY' WHEN spread >= 4.0 * (1.0 - conf * 0.3) THEN 'HOLD'
              WHEN spread <= -(4.0 * (1.0 - conf * 0.3)) THEN 'AVOID' ELSE 'WATCH' END AS recommendation
  FROM adv
)"""


def _marks(spark, folder):
    return trades.product_marks(R.auction(spark, folder), R.FILE_ORDER, AS_OF)


@REGISTRY.add(
    "product_marks",
    f"""
    WITH {MARKS_SQL}
    SELECT product_id, quarter, CAST(tranche_no AS BIGINT) AS tranche_no, direction_label, CAST(units_offered AS BIGINT) AS units_offered,
           CAST(units_sold AS BIGINT) AS units_sold, fill_rate, fill_rate_percentile, volume_percentile, market_price_aud,
           fair_value_per_unit_aud, recommendation_confidence, fill_rate_signal, volume_signal, fair_premium_pct,
           arbitrage_per_unit_aud, arbitrage_total_aud, arbitrage_side, recommendation
    FROM marks
    """,
)
def product_marks(spark, folder):
    whole = ("tranche_no", "units_offered", "units_sold")
    return _marks(spark, folder).withColumns({c: F.col(c).cast("long") for c in whole}).select(
        "product_id", "quarter", "tranche_no", "direction_label", "units_offered", "units_sold", "fill_rate",
        "fill_rate_percentile", "volume_percentile", "market_price_aud", "fair_value_per_unit_aud",
        "recommendation_confidence", "fill_rate_signal", "volume_signal", "fair_premium_pct", "arbitrage_per_unit_aud",
        "arbitrage_total_aud", "arbitrage_side", "recommendation",
    )


CANDIDATES_SQL = f"""{MARKS_SQL},
kept AS (SELECT * FROM marks WHERE recommendation_confidence >= 0.35 AND abs(fair_premium_pct) >= 2.0 AND arbitrage_side <> 'NEUTRAL'),
sized AS (
  SELECT *, greatest(abs(arbitrage_per_unit_aud) * 0.5, market_price_aud * 0.05, 1.0) AS stop,
         greatest(units_sold, units_offered, 1) AS basis FROM kept
), lim AS (
  SELECT *, least(greatest(1, CAST(floor(basis * (10.0 / 100.0)) AS BIGINT)), units_offered) AS no_impact,
         greatest(1, CAST(floor(25000.0 / stop) AS BIGINT)) AS by_risk FROM sized
), un AS (SELECT *, least(by_risk, no_impact) AS units FROM lim),
candidates AS (
  SELECT product_id, contract_id, quarter, tranche_no, interconnector_id, direction_label AS direction,
         CASE arbitrage_side WHEN 'LONG' THEN 'BUY_CALLS' ELSE 'BUY_PUTS' END AS trade_action, arbitrage_side AS side,
         recommendation_confidence AS confidence, {S("stop", 2)} AS risk_per_unit_aud, CAST(no_impact AS BIGINT) AS max_no_impact_units,
         CAST(units AS BIGINT) AS suggested_units, {S("units * market_price_aud", 2)} AS suggested_spend_aud,
         {S("CAST(units AS DOUBLE) / basis * 100.0", 2)} AS liquidity_participation_pct,
         {S("abs(arbitrage_per_unit_aud) * units", 2)} AS expected_edge_aud
  FROM un
), edged AS (
  SELECT *, coalesce({S("expected_edge_aud / nullif(suggested_spend_aud, 0)", 6)}, 0.0) AS expected_edge_per_dollar FROM candidates
)"""

CANDIDATE_COLUMNS = [
    "product_id", "quarter", "direction", "trade_action", "side", "confidence", "risk_per_unit_aud", "max_no_impact_units",
    "suggested_units", "suggested_spend_aud", "liquidity_participation_pct", "expected_edge_aud", "expected_edge_per_dollar",
]
CANDIDATE_LIST = ", ".join(CANDIDATE_COLUMNS)


def _candidates(spark, folder):
    return trades.trade_candidates(_marks(spark, folder), AS_OF)


def _shown(candidates):
    return candidates.withColumns(
        {c: F.col(c).cast("long") for c in ("max_no_impact_units", "suggested_units")}
    ).select(*CANDIDATE_COLUMNS)


@REGISTRY.add("trade_candidates", f"WITH {CANDIDATES_SQL} SELECT {CANDIDATE_LIST} FROM edged")
def trade_candidates(spark, folder):
    return _shown(_candidates(spark, folder))


@REGISTRY.add(
    "trade_candidates_top",
    f"WITH {CANDIDATES_SQL} SELECT {CANDIDATE_LIST} FROM edged ORDER BY abs(expected_edge_aud) DESC, confidence DESC, product_id LIMIT 20",
)
def trade_candidates_top(spark, folder):
    return _shown(trades.rank_candidates(_candidates(spark, folder)))


@REGISTRY.add(
    "best_buys",
    f"""
    WITH {CANDIDATES_SQL} SELECT {CANDIDATE_LIST} FROM edged WHERE side = 'LONG'
    ORDER BY expected_edge_per_dollar DESC, abs(expected_edge_aud) DESC, confidence DESC, product_id LIMIT 12
    """,
)
def best_buys(spark, folder):
    return _shown(trades.best_buys(_candidates(spark, folder)))


GROUPS_SQL = f"""{CANDIDATES_SQL},
q AS (
  SELECT quarter, count(*) AS n, CAST(round(sum(CAST(suggested_spend_aud AS DECIMAL(28,6))), 2) AS DOUBLE) AS spend,
         CAST(round(sum(CAST(expected_edge_aud AS DECIMAL(28,6))), 2) AS DOUBLE) AS edge,
         CAST(round(sum(CAST(expected_edge_aud * confidence AS DECIMAL(28,6))), 2) AS DOUBLE) AS profit,
         CAST(round(sum(CAST(risk_per_unit_aud * suggested_units AS DECIMAL(28,6))), 2) AS DOUBLE) AS risk
  FROM edged GROUP BY quarter
)"""


@REGISTRY.add(
    "trade_groups_quarter",
    f"""
    WITH {GROUPS_SQL}
    SELECT substr(quarter, 2, 4) AS year, quarter, n AS count, spend AS total_suggested_spend_aud, edge AS total_expected_edge_aud,
           profit AS total_projected_profit_aud, risk AS total_capital_at_risk_aud,
           CASE WHEN risk > 0 THEN {S(S("profit / risk", 4) + " * 100.0", 2)} ELSE 0.0 END AS return_on_risked_capital_pct,
           {S("edge - profit", 2)} AS implied_exit_spread_aud
    FROM q
    """,
)
def trade_groups_quarter(spark, folder):
    return trades.quarter_trade_summary(_candidates(spark, folder)).drop(
        "quarter_start", "quarter_end", "sell_now_value_aud"
    )


@REGISTRY.add(
    "trade_groups_year",
    f"""
    WITH {GROUPS_SQL},
    y AS (SELECT substr(quarter, 2, 4) AS year, CAST(sum(n) AS BIGINT) AS count,
                 CAST(round(sum(CAST(spend AS DECIMAL(28,6))), 2) AS DOUBLE) AS spend,
                 CAST(round(sum(CAST(edge AS DECIMAL(28,6))), 2) AS DOUBLE) AS edge,
                 CAST(round(sum(CAST(profit AS DECIMAL(28,6))), 2) AS DOUBLE) AS profit,
                 CAST(round(sum(CAST(risk AS DECIMAL(28,6))), 2) AS DOUBLE) AS risk FROM q GROUP BY 1)
    SELECT year, count, spend AS total_suggested_spend_aud, edge AS total_expected_edge_aud, profit AS total_projected_profit_aud,
           risk AS total_capital_at_risk_aud,
           CASE WHEN risk > 0 THEN {S(S("profit / risk", 4) + " * 100.0", 2)} ELSE 0.0 END AS return_on_risked_capital_pct
    FROM y
    """,
)
def trade_groups_year(spark, folder):
    return trades.year_trade_summary(trades.quarter_trade_summary(_candidates(spark, folder)))


@REGISTRY.add(
    "sell_quarter",
    f"""
    WITH {GROUPS_SQL}
    SELECT quarter, n AS count, spend AS exit_price_aud, profit AS projected_hold_pnl_aud, 'SELL_ENTIRE_QUARTER' AS sell_action FROM q
    """,
)
def sell_quarter(spark, folder):
    summary = trades.quarter_trade_summary(_candidates(spark, folder))
    return trades.sell_quarter(summary).select(
        "quarter", "count", "exit_price_aud", "projected_hold_pnl_aud", "sell_action"
    )


@REGISTRY.add(
    "arbitrage_totals",
    f"""
    WITH {MARKS_SQL},
    s AS (SELECT count(*) AS n, coalesce(sum(CAST(arbitrage_total_aud AS DECIMAL(28,6))) FILTER (arbitrage_side = 'LONG'), 0) AS a,
                 coalesce(sum(CAST(abs(arbitrage_total_aud) AS DECIMAL(28,6))) FILTER (arbitrage_side = 'SHORT'), 0) AS b FROM marks)
    SELECT n AS count, CAST(a AS DOUBLE) AS gross_long_edge_aud, CAST(b AS DOUBLE) AS gross_short_edge_aud,
           CAST(a + b AS DOUBLE) AS gross_total_edge_aud
    FROM s
    """,
)
def arbitrage_totals(spark, folder):
    return trades.arbitrage_totals(_marks(spark, folder))


@REGISTRY.add(
    "arbitrage_top",
    f"""
    WITH {MARKS_SQL}
    SELECT product_id, arbitrage_side, abs(arbitrage_total_aud) AS arbitrage_abs_total_aud FROM marks
    ORDER BY abs(arbitrage_total_aud) DESC, product_id LIMIT 25
    """,
)
def arbitrage_top(spark, folder):
    return trades.arbitrage_top(_marks(spark, folder)).select("product_id", "arbitrage_side", "arbitrage_abs_total_aud")


@REGISTRY.add(
    "collapse_directions",
    f"""
    WITH {MARKS_SQL}
    SELECT contract_id, interconnector_id, CAST(tranche_no AS BIGINT) AS tranche_no,
           string_agg(direction_label, ' | ' ORDER BY abs(arbitrage_total_aud) DESC, from_region) AS direction_label,
           string_agg(recommendation, ',' ORDER BY abs(arbitrage_total_aud) DESC, from_region) AS legs,
           first(arbitrage_total_aud ORDER BY abs(arbitrage_total_aud) DESC, from_region) AS arbitrage_total_aud
    FROM marks GROUP BY ALL
    """,
)
def collapse_directions(spark, folder):
    collapsed = trades.collapse_directions(_marks(spark, folder))
    return collapsed.select(
        "contract_id", "interconnector_id", F.col("tranche_no").cast("long").alias("tranche_no"), "direction_label",
        F.array_join(F.transform("legs", lambda x: x["recommendation"]), ",").alias("legs"), "arbitrage_total_aud",
    )
