"""Price signals, dispatch reports, ancillary services, ledger and wind over the benchmark tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import fcas
from ..functions.valuation import dynamic_thresholds
from ..operators import dispatch, ledger, signals, wind
from . import REGISTRY
from . import roles as R

S = R.sql_round

SIGNALS_SQL = f"""{R.PRICES_SQL},
w AS (
  SELECT *, count(*) OVER f AS nf, max(price_mwh) OVER f AS mx, min(price_mwh) OVER f AS mn, avg(price_mwh) OVER f AS me,
         quantile_cont(price_mwh, 0.75) OVER f AS hi, count(*) OVER b AS nb, stddev_pop(price_mwh) OVER b AS sd,
         count(*) OVER d AS nd, quantile_cont(price_mwh, 0.25) OVER d AS lo
  FROM prices
  WINDOW f AS (PARTITION BY region ORDER BY timestamp, event_id ROWS BETWEEN 1 FOLLOWING AND 36 FOLLOWING),
         b AS (PARTITION BY region ORDER BY timestamp, event_id ROWS BETWEEN 12 PRECEDING AND CURRENT ROW),
         d AS (PARTITION BY region ORDER BY timestamp, event_id ROWS BETWEEN 288 PRECEDING AND CURRENT ROW)
), sig AS (
  SELECT region, timestamp, event_id, price_mwh,
         CASE WHEN nf > 0 THEN greatest(0.0, mx * 0.9) ELSE 75.0 END AS stored_energy_value,
         CASE WHEN nf = 0 OR abs(me - price_mwh) < 5.0 THEN 0.0
              ELSE greatest(-1.0, least(1.0, (me - price_mwh) / 50.0)) END AS price_trend,
         coalesce(mn < 0, false) AS neg_price_ahead, CASE WHEN nb > 1 THEN sd ELSE 0.0 END AS volatility,
         CASE WHEN nf > 0 THEN mx ELSE price_mwh END AS forward_max_price,
         CASE WHEN nf > 0 THEN mn ELSE price_mwh END AS forward_min_price,
         CASE WHEN nf > 0 THEN me ELSE price_mwh END AS forward_mean_price,
         CASE WHEN nf > 2 THEN hi ELSE 100.0 END AS adaptive_discharge_threshold,
         CASE WHEN nd > 2 THEN lo ELSE 50.0 END AS adaptive_charge_threshold, nf > 0 AS has_forward
  FROM w
)"""


def _signals(spark, folder):
    rows = R.prices(spark, folder).select("region", "timestamp", "event_id", "price_mwh")
    return signals.price_signals(rows, ["region"], tie_break=["event_id"])


ROUNDED = [
    "stored_energy_value", "price_trend", "volatility", "forward_max_price", "forward_min_price", "forward_mean_price",
    "adaptive_discharge_threshold", "adaptive_charge_threshold",
]


@REGISTRY.add(
    "price_signals",
    f"WITH {SIGNALS_SQL} SELECT event_id, neg_price_ahead, "
    + ", ".join(f"round({c}, 9) AS {c}" for c in ROUNDED)
    + " FROM sig",
)
def price_signals(spark, folder):
    return _signals(spark, folder).select(
        "event_id", "neg_price_ahead", *[F.round(c, 9).alias(c) for c in ROUNDED]
    )


@REGISTRY.add(
    "dynamic_thresholds",
    f"""
    WITH {SIGNALS_SQL},
    t AS (
      SELECT event_id, price_mwh AS spot, adaptive_charge_threshold AS c, adaptive_discharge_threshold AS d, price_trend AS tr,
             forward_max_price AS pk, has_forward FROM sig
    ), u AS (
      SELECT *, CASE WHEN pk > d * 1.3 AND tr > 0.1 THEN least(c * 1.3, c + (pk - d) * 0.15) ELSE c END AS ch,
             CASE WHEN tr < -0.2 THEN d * 0.9 ELSE d END AS lowered,
             spot < 0.0 AND has_forward AND (pk * 0.9 - spot) >= 50.0 AS override FROM t
    )
    SELECT event_id, round(ch, 6) AS charge_threshold,
           round(CASE WHEN override THEN lowered ELSE greatest(lowered, 0.0) END, 6) AS discharge_threshold
    FROM u
    """,
)
def dynamic_thresholds_query(spark, folder):
    bent = _signals(spark, folder).select(
        "event_id",
        dynamic_thresholds(
            "price_mwh", "adaptive_charge_threshold", "adaptive_discharge_threshold", "price_trend", "forward_max_price",
            has_forward="has_forward",
        ).alias("_t"),
    )
    return bent.select(
        "event_id", F.round("_t.charge_threshold", 6).alias("charge_threshold"),
        F.round("_t.discharge_threshold", 6).alias("discharge_threshold"),
    )


@REGISTRY.add(
    "forecast_overlay",
    f"""
    WITH {SIGNALS_SQL},
    fc AS (SELECT ts, value AS p, event_id FROM events WHERE event_type = 'view'),
    u AS (SELECT timestamp AS t, 1 AS k, event_id, NULL AS p FROM sig WHERE region <> 'view'
          UNION ALL SELECT ts, 0, event_id, p FROM fc),
    a AS (SELECT t, k, event_id, count(p) OVER w AS n, max(p) OVER w AS mx, min(p) OVER w AS mn, CAST(sum(CAST(p AS DECIMAL(18,2))) OVER w AS DOUBLE) AS s FROM u
          WINDOW w AS (ORDER BY t DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP))
    SELECT a.event_id, CASE WHEN n >= 2 THEN greatest(0.0, mx * 0.9) ELSE stored_energy_value END AS stored_energy_value,
           CASE WHEN n >= 2 THEN mx ELSE forward_max_price END AS forward_max_price,
           CASE WHEN n >= 2 THEN mn ELSE forward_min_price END AS forward_min_price,
           round(CASE WHEN n >= 2 THEN s / n ELSE forward_mean_price END, 9) AS forward_mean_price,
           CASE WHEN n >= 2 THEN mn < 0 ELSE neg_price_ahead END AS neg_price_ahead,
           round(CASE WHEN n < 2 THEN price_trend WHEN abs(s / n - price_mwh) < 5.0 THEN 0.0
                      ELSE greatest(-1.0, least(1.0, (s / n - price_mwh) / 50.0)) END, 9) AS price_trend
    FROM a JOIN sig ON a.event_id = sig.event_id WHERE k = 1
    """,
)
def forecast_overlay(spark, folder):
    forecast = R.prices(spark, folder).where("region = 'view'").select("timestamp", F.col("value").alias("price_mwh"))
    rows = _signals(spark, folder).where("region <> 'view'").drop("has_forward")
    overlaid = signals.overlay_forecast(rows, forecast, tie_break=["event_id"])
    return overlaid.select(
        "event_id", "neg_price_ahead", "stored_energy_value", "forward_max_price", "forward_min_price",
        F.round("forward_mean_price", 9).alias("forward_mean_price"), F.round("price_trend", 9).alias("price_trend"),
    )


@REGISTRY.add(
    "forecast_merge",
    """
    WITH near AS (SELECT user_id % 5 AS region, ts, value, 'p5min_5min' AS source FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-10'),
    far AS (SELECT user_id % 5 AS region, ts, value, 'predispatch_30min' AS source FROM events WHERE event_type <> 'view'),
    m AS (SELECT region, max(ts) AS last FROM near GROUP BY region)
    SELECT * FROM near UNION ALL SELECT far.* FROM far LEFT JOIN m USING (region) WHERE last IS NULL OR ts > last
    """,
)
def forecast_merge(spark, folder):
    events = R.table(spark, folder, "events").withColumn("region", F.expr("user_id % 5"))
    near = events.where("event_type = 'view' AND ts < timestamp_ntz'2024-01-10 00:00:00'").select(
        "region", "ts", "value", F.lit("p5min_5min").alias("source")
    )
    far = events.where("event_type <> 'view'").select(
        "region", "ts", "value", F.lit("predispatch_30min").alias("source")
    )
    return signals.merge_forward_forecasts(near, far, ["region"], "ts")


@REGISTRY.add(
    "dedup_timestamps",
    """
    SELECT event_type, minute, event_id, value FROM (
      SELECT *, date_trunc('minute', ts) AS minute,
             row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY event_id) AS rn FROM events) WHERE rn = 1
    """,
)
def dedup_timestamps(spark, folder):
    rows = R.table(spark, folder, "events").select(
        "event_type", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"), "event_id", "value"
    )
    return signals.first_per_timestamp(rows, ["event_type"], "minute", ["event_id"])


@REGISTRY.add(
    "recent_rows",
    """
    SELECT event_id, ts, value FROM (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY)
    ORDER BY ts DESC, event_id DESC LIMIT 288
    """,
)
def recent_rows(spark, folder):
    recent = signals.last_days(R.table(spark, folder, "events"), "ts", dt.datetime(2024, 1, 30), 7)
    return signals.last_rows(recent.select("event_id", "ts", "value"), ["ts", "event_id"])


@REGISTRY.add(
    "monthly_revenue",
    f"""
    WITH {R.DISPATCH_SQL}
    SELECT strategy_id, strftime(timestamp, '%Y-%m') AS month,
           CAST(sum(CAST(interval_revenue_aud AS DECIMAL(18,2))) AS DOUBLE) AS revenue_aud,
           count(*) FILTER (action = 'discharge') AS discharge_intervals, count(*) FILTER (action = 'charge') AS charge_intervals
    FROM dispatch GROUP BY ALL
    """,
)
def monthly_revenue(spark, folder):
    return dispatch.monthly_revenue(R.dispatch(spark, folder))


@REGISTRY.add(
    "period_revenue",
    f"""
    WITH {R.DISPATCH_SQL}
    SELECT strategy_id,
           CAST(coalesce(sum(CAST(interval_revenue_aud AS DECIMAL(18,2))) FILTER (timestamp >= TIMESTAMP '2024-01-15'), 0) AS DOUBLE) AS ytd_revenue_aud,
           CAST(coalesce(sum(CAST(interval_revenue_aud AS DECIMAL(18,2))) FILTER (year(timestamp) = 2024), 0) AS DOUBLE) AS annual_revenue_aud
    FROM dispatch GROUP BY ALL
    """,
)
def period_revenue(spark, folder):
    return dispatch.period_revenue(R.dispatch(spark, folder), dt.datetime(2024, 1, 15), 2024)


@REGISTRY.add(
    "cumulative_revenue",
    f"""
    WITH {R.DISPATCH_SQL}
    SELECT strategy_id, event_id, CAST(sum(CAST(interval_revenue_aud AS DECIMAL(18,2))) OVER (PARTITION BY strategy_id
             ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cumulative_revenue_aud
    FROM dispatch
    """,
)
def cumulative_revenue(spark, folder):
    rows = R.dispatch(spark, folder).select("strategy_id", "timestamp", "event_id", "interval_revenue_aud")
    summed = dispatch.cumulative_revenue(rows, order=("timestamp", "event_id"))
    return summed.select("strategy_id", "event_id", "cumulative_revenue_aud")


@REGISTRY.add(
    "dispatch_summary",
    f"""
    WITH {R.DISPATCH_SQL},
    s AS (SELECT strategy_id, CAST(sum(CAST(interval_revenue_aud AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue_aud,
           CAST(sum(CAST(arb_revenue_aud AS DECIMAL(18,2))) AS DOUBLE) AS arb_revenue_aud,
           CAST(sum(CAST(fcas_revenue_aud AS DECIMAL(18,2))) AS DOUBLE) AS fcas_revenue_aud,
           count(*) FILTER (action = 'discharge') AS intervals_dispatched, count(*) FILTER (action = 'charge') AS intervals_charged,
           max(soc_pct) AS peak_soc_pct, min(soc_pct) AS min_soc_pct
    FROM dispatch GROUP BY strategy_id)
    SELECT *, row_number() OVER (ORDER BY total_revenue_aud DESC, strategy_id) AS rank FROM s
    """,
)
def dispatch_summary(spark, folder):
    summary = dispatch.strategy_rank(dispatch.dispatch_summary(R.dispatch(spark, folder)))
    return summary.withColumn("rank", F.col("rank").cast("long"))


@REGISTRY.add(
    "strategy_params",
    """
    SELECT event_id, CASE event_type WHEN 'error' THEN 'guaranteed_reg_min' ELSE 'revenue_maximising' END AS allocation_strategy,
           CASE event_type WHEN 'error' THEN '0.4' END AS reg_min_frac, CASE event_type WHEN 'error' THEN 'false' ELSE 'true' END AS enable_fcas
    FROM events
    """,
)
def strategy_params(spark, folder):
    rows = R.table(spark, folder, "events").select("event_id", F.col("event_type").alias("strategy_id"))
    is_error = F.col("strategy_id") == "error"
    specs = rows.select("strategy_id").distinct().select(
        "strategy_id",
        F.lit(True).alias("enable_fcas"),
        F.when(is_error, "guaranteed_reg_min").otherwise("revenue_maximising").alias("allocation_strategy"),
        F.lit(None).cast("string").alias("force_mode"),
        F.lit(True).alias("adaptive_thresholds"),
        F.when(
            is_error, F.create_map(F.lit("reg_min_frac"), F.lit("0.4"), F.lit("enable_fcas"), F.lit("false"))
        ).alias("engine_overrides"),
    )
    applied = dispatch.apply_strategy_params(rows, specs, ["allocation_strategy", "reg_min_frac", "enable_fcas"])
    return applied.drop("strategy_id")


FCAS_FACTORS = {"reg": 0.5, "1sec": 0.9, "6sec": 0.7, "60sec": 0.3, "5min": 0.2}


def _fcas_rows(spark, folder):
    prices = []
    for direction, scale in (("raise", 1.0), ("lower", 0.6)):
        for service, factor in FCAS_FACTORS.items():
            name = f"fcas_reg_{direction}_aud_per_mw" if service == "reg" else f"fcas_{direction}_{service}_aud_per_mw"
            prices.append((F.col("value") * factor * scale).alias(name))
    return R.table(spark, folder, "events").select(
        "event_id",
        F.expr("(event_id * 37 % 101) / 100.0D").alias("soc"),
        F.expr("2D + (user_id % 4)").alias("headroom"),
        *prices,
    )


def _fcas_direction_sql(direction: str, scale: float, allocation: str) -> str:
    """SQL for one direction: feasible MW per service, then the allocation, then revenues."""
    services = {"reg": (0.70, 12.0), "1sec": (0.92, 3600.0), "6sec": (0.90, 600.0), "60sec": (0.88, 60.0), "5min": (0.85, 12.0)}
    distance = "(soc - 0.05::DOUBLE)" if direction == "raise" else "(0.95::DOUBLE - soc)"
    p = direction[0]
    cont = ["1sec", "6sec", "60sec", "5min"]
    hours = {"reg": "(5.0/60.0)", "1sec": "(1.0/3600.0)", "6sec": "(6.0/3600.0)", "60sec": "(60.0/3600.0)", "5min": "(5.0/60.0)"}
    columns = []
    for s, (availability, _) in services.items():
        price = f"(value * {FCAS_FACTORS[s]}::DOUBLE * {scale}::DOUBLE)"
        guard = " AND soc BETWEEN 0.10 AND 0.90" if s == "reg" else ""
        columns.append(f"{price} AS p_{s}")
        columns.append(
            f"CASE WHEN {price} > 0 AND headroom > 0 AND {distance} > 0{guard} THEN "
            f"least(headroom * {availability}::DOUBLE * CASE WHEN {distance} < 0.15 THEN {distance} / 0.15 ELSE 1.0 END, "
            f"greatest(0.0, {distance} * 10.0 / {hours[s]})) END AS m_{s}"
        )
    dt_hours = "(5.0/60.0)"
    kept = [
        f"CASE WHEN m_{s} >= 0.25 AND p_{s} * m_{s} * {dt_hours}"
        + (f" - m_{s} * 0.003 * 5.0" if s == "reg" else "")
        + f" > 0 THEN m_{s} END AS q_{s}"
        for s in services
    ]

    def reg(room: str) -> str:
        mw = f"least(q_reg, {room})"
        return (
            f"CASE WHEN q_reg IS NOT NULL AND {mw} >= 0.25 AND p_reg * {mw} * {dt_hours} - {mw} * 0.003 * 5.0 > 0 "
            f"THEN {mw} ELSE 0.0 END"
        )

    def revenue(c: str, r: str) -> str:
        parts = [f"CASE WHEN q_{s} IS NOT NULL THEN p_{s} * {c} * {dt_hours} ELSE 0.0 END" for s in cont]
        return f"({' + '.join(parts)})", f"(CASE WHEN {r} > 0 THEN p_reg * {r} * {dt_hours} - {r} * 0.003 * 5.0 ELSE 0.0 END)"

    cont_a, reg_a = revenue("c_a", "r_a")
    cont_b, reg_b = revenue("c_b", "r_b")
    if allocation == "revenue_maximising":
        first = "cmax"
    elif allocation == "guaranteed_reg_min":
        first = "least(cmax, headroom - headroom * 0.30)"
    else:
        first = "cmax"
    take_b = f"({cont_b} + {reg_b}) > ({cont_a} + {reg_a})" if allocation == "revenue_maximising" else "false"
    return f"""
{p}0 AS (SELECT event_id, soc, headroom, {', '.join(columns)} FROM x),
{p}1 AS (SELECT *, {', '.join(kept)} FROM {p}0),
{p}2 AS (SELECT *, coalesce(greatest({', '.join(f'q_{s}' for s in cont)}), 0.0) AS cmax FROM {p}1),
{p}3 AS (SELECT *, {first} AS c_a, {reg('headroom')} AS rf FROM {p}2),
{p}4 AS (SELECT *, {reg('greatest(0.0, headroom - c_a)')} AS r_a, least(cmax, greatest(0.0, headroom - rf)) AS c_b FROM {p}3),
{p}5 AS (SELECT *, {reg('greatest(0.0, headroom - c_b)')} AS r_b FROM {p}4),
{p}6 AS (SELECT event_id, headroom, p_reg, {', '.join(f'p_{s}, q_{s}' for s in cont)},
              CASE WHEN {take_b} THEN c_b ELSE c_a END AS c, CASE WHEN {take_b} THEN r_b ELSE r_a END AS r,
              CASE WHEN {take_b} THEN {cont_b} ELSE {cont_a} END AS cr, CASE WHEN {take_b} THEN {reg_b} ELSE {reg_a} END AS rr FROM {p}5)"""


X_SQL = "x AS (SELECT event_id, value, (event_id * 37 % 101) / 100.0 AS soc, 2.0::DOUBLE + (user_id % 4) AS headroom FROM events)"


def _stacked(spark, folder, allocation: str, priority: str = "revenue_weighted"):
    config = fcas.StackConfig(allocation=allocation, direction_priority=priority)
    rows = _fcas_rows(spark, folder)
    args = (F.col("headroom"), F.col("soc"), F.lit(10.0), F.lit(5.0), config)
    return config, fcas.fcas_costack(fcas.fcas_costack(rows, "raise", *args), "lower", *args)


def _stack_sql(allocation: str) -> str:
    best = "CASE " + " ".join(
        f"WHEN top > 0 AND top = {expr} THEN '{label}'"
        for label, expr in [
            ("RAISE_1SEC", "v_1sec"), ("RAISE_6SEC", "v_6sec"), ("RAISE_60SEC", "v_60sec"), ("RAISE_5MIN", "v_5min"),
            ("REG_RAISE", "rr"),
        ]
    ) + " ELSE 'NONE' END"
    values = ", ".join(
        f"CASE WHEN q_{s} IS NOT NULL THEN p_{s} * c * (5.0/60.0) ELSE 0.0 END AS v_{s}" for s in ("1sec", "6sec", "60sec", "5min")
    )
    return f"""
    WITH {X_SQL}, {_fcas_direction_sql('raise', 1.0, allocation)},
    v AS (SELECT *, {values} FROM r6), t AS (SELECT *, greatest(v_1sec, v_6sec, v_60sec, v_5min, rr) AS top FROM v)
    SELECT event_id, round(c + r, 6) AS total_mw, round(cr + rr, 6) AS total_revenue, round(c, 6) AS cont_mw, round(r, 6) AS reg_mw,
           round(cr, 6) AS cont_revenue, round(rr, 6) AS reg_revenue, {best} AS best_label
    FROM t
    """


def _stack_query(allocation: str):
    def query(spark, folder):
        _, stacked = _stacked(spark, folder, allocation)
        return stacked.select(
            "event_id",
            *[
                F.round(f"raise_stack.{c}", 6).alias(c)
                for c in ("total_mw", "total_revenue", "cont_mw", "reg_mw", "cont_revenue", "reg_revenue")
            ],
            F.col("raise_stack.best_label").alias("best_label"),
        )

    return query


for _allocation in ("contingency_first", "revenue_maximising", "guaranteed_reg_min"):
    REGISTRY.add(f"fcas_costack_{_allocation}", _stack_sql(_allocation))(_stack_query(_allocation))


def _priority_sql(priority: str) -> str:
    if priority == "revenue_weighted":
        alloc = """
    a1 AS (SELECT *, CASE WHEN ur + dr_ > 0 THEN ur / (ur + dr_) ELSE 0.5 END AS su, CASE WHEN ur + dr_ > 0 THEN dr_ / (ur + dr_) ELSE 0.5 END AS sd FROM j),
    a2 AS (SELECT *, least(um, b * su) AS fu, least(dm, b * sd) AS fd FROM a1),
    a3 AS (SELECT *, CASE WHEN NOT fu < b * su AND fd < b * sd THEN least(um, b - fd) ELSE fu END AS gu,
                  CASE WHEN fu < b * su THEN least(dm, b - fu) ELSE fd END AS gd FROM a2)"""
    elif priority == "prefer_raise":
        alloc = "a3 AS (SELECT *, least(um, b) AS gu, least(dm, greatest(0.0, b - least(um, b))) AS gd FROM j)"
    elif priority == "prefer_lower":
        alloc = "a3 AS (SELECT *, least(dm, b) AS gd, least(um, greatest(0.0, b - least(dm, b))) AS gu FROM j)"
    else:
        alloc = "a3 AS (SELECT *, um * (b / nullif(um + dm, 0)) AS gu, dm * (b / nullif(um + dm, 0)) AS gd FROM j)"
    return f"""
    WITH {X_SQL}, {_fcas_direction_sql('raise', 1.0, 'contingency_first')}, {_fcas_direction_sql('lower', 0.6, 'contingency_first')},
    j AS (SELECT r6.event_id, r6.headroom AS b, r6.c + r6.r AS um, l6.c + l6.r AS dm, r6.cr + r6.rr AS ur, l6.cr + l6.rr AS dr_
          FROM r6 JOIN l6 ON r6.event_id = l6.event_id),
    {alloc}
    SELECT event_id, round(CASE WHEN um + dm > b AND um + dm > 0 THEN coalesce(gu, 0.0) ELSE um END, 10) AS raise_mw,
           round(CASE WHEN um + dm > b AND um + dm > 0 THEN coalesce(gd, 0.0) ELSE dm END, 10) AS lower_mw,
           round(CASE WHEN um + dm > b AND um + dm > 0 THEN coalesce(ur * (gu / nullif(um, 0)), 0.0) ELSE ur END, 10) AS raise_revenue,
           round(CASE WHEN um + dm > b AND um + dm > 0 THEN coalesce(dr_ * (gd / nullif(dm, 0)), 0.0) ELSE dr_ END, 10) AS lower_revenue
    FROM a3
    """


def _priority_query(priority: str):
    def query(spark, folder):
        config, stacked = _stacked(spark, folder, "contingency_first", priority)
        scaled = fcas.fcas_direction_priority(stacked, F.col("headroom"), config)
        return scaled.select(
            "event_id",
            F.round("raise_stack.total_mw", 10).alias("raise_mw"),
            F.round("lower_stack.total_mw", 10).alias("lower_mw"),
            F.round("raise_stack.total_revenue", 10).alias("raise_revenue"),
            F.round("lower_stack.total_revenue", 10).alias("lower_revenue"),
        )

    return query


for _priority in ("revenue_weighted", "proportional", "prefer_raise", "prefer_lower"):
    REGISTRY.add(f"fcas_priority_{_priority}", _priority_sql(_priority))(_priority_query(_priority))


@REGISTRY.add(
    "hit_rate",
    f"""
    WITH {R.LEDGER_SQL}
    SELECT recommendation, count(*) AS count, round(coalesce(avg(CAST(recommendation_correct_24h AS DOUBLE)), 0.0), 3) AS hit_rate_24h,
           round(avg(CAST(confidence AS DOUBLE)), 3) AS avg_confidence, round(avg(spread_pct), 2) AS avg_spread_pct
    FROM ledger GROUP BY recommendation
    """,
)
def hit_rate(spark, folder):
    return ledger.hit_rate(R.ledger(spark, folder))


@REGISTRY.add(
    "hit_rate_overall",
    f"""
    WITH {R.LEDGER_SQL}
    SELECT count(*) AS total_recommendations, round(avg(CAST(recommendation_correct_24h AS DOUBLE)), 3) AS hit_rate_24h,
           round(avg(CAST(recommendation_correct_7d AS DOUBLE)), 3) AS hit_rate_7d FROM ledger
    """,
)
def hit_rate_overall(spark, folder):
    return ledger.hit_rate_overall(R.ledger(spark, folder))


@REGISTRY.add(
    "confidence_bins",
    f"""
    WITH {R.LEDGER_SQL},
    bins AS (SELECT unnest([0.6, 0.7, 0.8, 0.9])::DECIMAL(6,4) AS c)
    SELECT CAST(c AS DOUBLE) AS claimed_confidence, round(coalesce(avg(CAST(recommendation_correct_24h AS DOUBLE)), 0.0), 3) AS actual_hit_rate,
           count(*) AS count
    FROM ledger JOIN bins ON confidence >= c - 0.05 AND confidence < c + 0.05 GROUP BY c
    """,
)
def confidence_bins(spark, folder):
    return ledger.confidence_bins(R.ledger(spark, folder))


@REGISTRY.add(
    "average_markout",
    f"""
    WITH {R.LEDGER_SQL}
    SELECT recommendation, count(*) AS count, round(avg(markout_24h_pct), 2) AS avg_markout_24h_pct,
           round(stddev_samp(markout_24h_pct), 2) AS std_markout_24h_pct
    FROM ledger GROUP BY recommendation HAVING count(markout_24h_pct) > 0
    """,
)
def average_markout(spark, folder):
    return ledger.average_markout(R.ledger(spark, folder))


@REGISTRY.add(
    "versus_baseline",
    f"""
    WITH {R.LEDGER_SQL}
    SELECT round(avg(markout_24h_pct), 2) AS strategy_pnl_24h_pct,
           round(avg(CAST(recommendation_correct_24h AS DOUBLE)) FILTER (markout_24h_pct IS NOT NULL), 3) AS strategy_hit_rate,
           round(coalesce(avg(markout_24h_pct) FILTER (fill_rate_percentile > 80), 0.0), 2) AS baseline_high_fill_pnl_24h_pct,
           0.0::DOUBLE AS baseline_market_pnl_24h_pct,
           round(avg(markout_24h_pct) - coalesce(avg(markout_24h_pct) FILTER (fill_rate_percentile > 80), 0.0), 2) AS strategy_vs_baseline_pnl
    FROM ledger
    """,
)
def versus_baseline(spark, folder):
    return ledger.versus_baseline(R.ledger(spark, folder))


@REGISTRY.add(
    "wind_annual",
    f"""
    WITH {R.WIND_SQL}
    SELECT round(avg(ws10), 3) AS annual_mean_ms, {S("median(ws10)", 3)} AS annual_median_ms, {S("max(ws10)", 3)} AS annual_max_ms,
           {S("quantile_cont(ws10, 0.75)", 3)} AS annual_p75_ms, {S("quantile_cont(ws10, 0.9)", 3)} AS annual_p90_ms,
           count(*) AS hours_total, count(*) FILTER (ws10 >= 4) AS hours_above_4ms, count(*) FILTER (ws10 >= 6) AS hours_above_6ms,
           count(*) FILTER (ws10 >= 8) AS hours_above_8ms, count(*) FILTER (ws10 >= 10) AS hours_above_10ms
    FROM wind
    """,
)
def wind_annual(spark, folder):
    return wind.wind_annual(R.wind(spark, folder))


@REGISTRY.add(
    "wind_monthly",
    f"""
    WITH {R.WIND_SQL}
    SELECT CAST(month(timestamp) AS BIGINT) AS month, round(avg(ws10), 3) AS mean, {S("median(ws10)", 3)} AS median,
           {S("max(ws10)", 3)} AS max, round(stddev_samp(ws10), 3) AS std
    FROM wind GROUP BY 1
    """,
)
def wind_monthly(spark, folder):
    return wind.wind_monthly(R.wind(spark, folder)).withColumn("month", F.col("month").cast("long"))


BANDS = [10, 50, 100, 150, 200, 250, 300, 350, 400, 450, 500]
SCALED = "CASE WHEN z = 10 THEN ws10 ELSE ws10 * pow(CAST(z AS DOUBLE) / 10.0, 0.14) END"


@REGISTRY.add(
    "wind_thresholds",
    f"""
    WITH {R.WIND_SQL}, z AS (SELECT unnest({BANDS}) AS z), s AS (SELECT z, {SCALED} AS v FROM wind, z)
    SELECT CAST(z AS BIGINT) AS altitude_m, round(avg(v), 2) AS annual_mean_ms, {S('median(v)', 2)} AS annual_p50_ms,
           {', '.join(f'count(*) FILTER (v >= {t}) AS hrs_above_{t}ms' for t in (4, 6, 8, 10, 12))},
           {', '.join(f'{S(f"count(*) FILTER (v >= {t}) / count(*) * 100", 1)} AS pct_above_{t}ms' for t in (4, 6, 8, 10, 12))}
    FROM s GROUP BY z
    """,
)
def wind_thresholds(spark, folder):
    return wind.threshold_table(R.wind(spark, folder)).withColumn("altitude_m", F.col("altitude_m").cast("long"))


@REGISTRY.add(
    "wind_monthly_altitude",
    f"""
    WITH {R.WIND_SQL}
    SELECT CAST(month(timestamp) AS BIGINT) AS month,
           {', '.join(f'round(avg(ws10 * pow({z}.0 / 10.0, 0.14)), 2) AS ws_{z}m' for z in BANDS)}
    FROM wind GROUP BY 1
    """,
)
def wind_monthly_altitude(spark, folder):
    return wind.monthly_altitude_means(R.wind(spark, folder)).withColumn("month", F.col("month").cast("long"))


@REGISTRY.add(
    "time_gaps",
    """
    WITH d AS (SELECT o_orderstatus AS series, o_orderdate AS t, o_orderkey FROM orders),
    g AS (SELECT series, (epoch_us(t) - epoch_us(lag(t) OVER (PARTITION BY series ORDER BY t, o_orderkey))) / 1000000.0 AS gap FROM d),
    c AS (SELECT series, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL),
    m AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY n DESC, gap) AS rn, sum(n) OVER (PARTITION BY series) AS steps FROM c)
    SELECT series, gap AS expected_step_seconds, CAST(steps AS BIGINT) AS steps, CAST(steps - n AS BIGINT) AS bad_gaps FROM m WHERE rn = 1
    """,
)
def time_gaps(spark, folder):
    series = R.table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("series"), F.col("o_orderdate").alias("t"), "o_orderkey"
    )
    return wind.gap_report(series, ["series"], "t", ["o_orderkey"])


@REGISTRY.add(
    "interpolate_time",
    """
    WITH d AS (SELECT event_type AS series, ts, event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END AS v,
                      CASE WHEN user_id % 3 = 0 THEN NULL ELSE ts END AS kt FROM events),
    f AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(kt IGNORE NULLS) OVER b AS t0,
                 first_value(v IGNORE NULLS) OVER a AS v1, first_value(kt IGNORE NULLS) OVER a AS t1 FROM d
          WINDOW b AS (PARTITION BY series ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 a AS (PARTITION BY series ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT series, event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0
             ELSE v0 + (v1 - v0) * ((epoch_us(ts) - epoch_us(t0))::DOUBLE / (epoch_us(t1) - epoch_us(t0))) END, 6) AS value
    FROM f
    """,
)
def interpolate_time(spark, folder):
    rows = R.table(spark, folder, "events").select(
        F.col("event_type").alias("series"), "ts", "event_id",
        F.expr("CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END").alias("value"),
    )
    filled = wind.interpolate_time(rows, ["series"], "ts", "value", ["event_id"])
    return filled.select("series", "event_id", F.round("value", 6).alias("value"))


@REGISTRY.add(
    "altitude_profile",
    f"""
    WITH {R.WIND_SQL}
    SELECT CAST(date_trunc('month', timestamp) AS TIMESTAMP) AS month, count(*) AS n,
           {', '.join(f'round(max(ws10 * pow({z}.0 / 10.0, 0.14)), 6) AS ws_{z}m' for z in (50, 200, 500))}
    FROM wind GROUP BY 1
    """,
)
def altitude_profile(spark, folder):
    profile = wind.altitude_profile(wind.clean_speed(R.wind(spark, folder)), bands=(50, 200, 500))
    return profile.groupBy(F.date_trunc("month", "timestamp").cast("timestamp_ntz").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.max(f"ws_{z}m"), 6).alias(f"ws_{z}m") for z in (50, 200, 500)]
    )
