"""Residue, settlement, reconciliation, versions and calibration over the benchmark tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import calibration, joins, residue, versions
from . import REGISTRY
from . import roles as R

KEYS = ["quarter", "interconnector_id", "from_region"]


@REGISTRY.add(
    "bucket_avg_then_sum",
    f"""
    WITH {R.INTERVALS_SQL},
    buckets AS (SELECT interconnector_id, from_region, time_bucket(INTERVAL 30 MINUTE, trading_interval) AS b,
                       CAST(CAST(sum(residue_aud) AS DOUBLE) / count(residue_aud) AS DECIMAL(28,8)) AS m FROM intervals GROUP BY ALL)
    SELECT 'C' || year(b) || 'Q' || quarter(b) AS quarter, interconnector_id, from_region, CAST(sum(m) AS DOUBLE) AS residue_aud
    FROM buckets GROUP BY ALL
    """,
)
def bucket_avg_then_sum(spark, folder):
    return residue.interval_bucket_average_then_sum(R.intervals(spark, folder))


@REGISTRY.add(
    "quarterly_residue",
    """
    SELECT 'C' || year(l_shipdate) || 'Q' || quarter(l_shipdate) AS quarter, l_returnflag AS interconnector_id,
           l_linestatus AS from_region, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS residue_aud
    FROM lineitem GROUP BY ALL
    """,
)
def quarterly_residue(spark, folder):
    rows = R.table(spark, folder, "lineitem").select(
        F.col("l_shipdate").alias("trading_interval"),
        F.col("l_returnflag").alias("interconnector_id"),
        F.col("l_linestatus").alias("from_region"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("residue_aud"),
    )
    return residue.quarterly_sum(rows, "trading_interval", "residue_aud").withColumn(
        "residue_aud", F.col("residue_aud").cast("double")
    )


PERIODS_SQL = """
periods AS (
  SELECT CAST(l_shipdate AS TIMESTAMP) AS settlement_date, CAST(l_orderkey % 4 AS INTEGER) AS run_no,
         CAST(l_linenumber AS INTEGER) AS period_id, l_returnflag AS interconnector_id, l_linestatus AS from_region,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS surplus_aud, l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk
  FROM lineitem
)"""


def _periods(spark, folder):
    return R.table(spark, folder, "lineitem").select(
        F.col("l_shipdate").alias("settlement_date"),
        F.expr("CAST(l_orderkey % 4 AS INT)").alias("run_no"),
        F.col("l_linenumber").alias("period_id"),
        F.col("l_returnflag").alias("interconnector_id"),
        F.col("l_linestatus").alias("from_region"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("surplus_aud"),
        F.col("l_orderkey").alias("ok"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
    )


@REGISTRY.add(
    "final_period_value",
    f"""
    WITH {PERIODS_SQL}
    SELECT settlement_date, CAST(period_id AS BIGINT) AS period_id, interconnector_id, from_region,
           CAST(surplus_aud AS DOUBLE) AS surplus_aud
    FROM (SELECT *, row_number() OVER (PARTITION BY settlement_date, period_id, interconnector_id, from_region
                                       ORDER BY run_no DESC, ok DESC, pk DESC, sk DESC) AS rn FROM periods) WHERE rn = 1
    """,
)
def final_period_value(spark, folder):
    final = versions.final_period_rows(_periods(spark, folder), tie_break=["ok", "pk", "sk"])
    return final.withColumns(
        {"surplus_aud": F.col("surplus_aud").cast("double"), "period_id": F.col("period_id").cast("long")}
    )


@REGISTRY.add(
    "quarterly_surplus",
    f"""
    WITH {PERIODS_SQL},
    per_period AS (SELECT settlement_date, period_id, interconnector_id, from_region,
                          CAST(CAST(sum(surplus_aud) AS DOUBLE) / count(*) AS DECIMAL(28,8)) AS v FROM periods GROUP BY ALL),
    averaged AS (SELECT 'C' || year(settlement_date) || 'Q' || quarter(settlement_date) AS quarter, interconnector_id,
                        from_region, CAST(sum(v) AS DOUBLE) AS averaged_surplus_aud FROM per_period GROUP BY ALL),
    plain AS (SELECT 'C' || year(settlement_date) || 'Q' || quarter(settlement_date) AS quarter, interconnector_id,
                     from_region, CAST(sum(surplus_aud) AS DOUBLE) AS surplus_aud FROM periods GROUP BY ALL)
    SELECT * FROM plain JOIN averaged USING (quarter, interconnector_id, from_region)
    """,
)
def quarterly_surplus(spark, folder):
    periods = _periods(spark, folder)
    plain = residue.quarterly_surplus(periods).withColumn("surplus_aud", F.col("surplus_aud").cast("double"))
    averaged = residue.quarterly_surplus(periods, average_duplicates=True).withColumn(
        "averaged_surplus_aud", F.col("surplus_aud")
    ).drop("surplus_aud")
    return plain.join(averaged, KEYS)


@REGISTRY.add(
    "billing_run_select",
    f"""
    WITH {PERIODS_SQL},
    runs AS (SELECT CAST(isoyear(o_orderdate) AS INTEGER) AS y, CAST(week(o_orderdate) AS INTEGER) AS w,
                    CAST(o_orderkey % 4 AS INTEGER) AS bill_run_no,
                    CASE o_orderstatus WHEN 'F' THEN 'FINAL' WHEN 'O' THEN 'REVISE' ELSE 'UNKNOWN' END AS status FROM orders),
    best AS (SELECT y, w, bill_run_no FROM (
               SELECT *, row_number() OVER (PARTITION BY y, w ORDER BY CASE status WHEN 'FINAL' THEN 4 ELSE 3 END DESC,
                                            bill_run_no DESC) AS rn FROM runs WHERE status <> 'UNKNOWN') WHERE rn = 1)
    SELECT CAST(isoyear(settlement_date) AS BIGINT) AS iso_year, CAST(week(settlement_date) AS BIGINT) AS iso_week,
           count(*) AS n, CAST(sum(surplus_aud) AS DOUBLE) AS surplus_aud
    FROM periods JOIN best ON isoyear(settlement_date) = y AND week(settlement_date) = w AND run_no = bill_run_no
    GROUP BY ALL
    """,
)
def billing_run_select(spark, folder):
    runs = R.table(spark, folder, "orders").select(
        F.extract(F.lit("YEAROFWEEK"), F.col("o_orderdate")).cast("int").alias("contract_year"),
        F.weekofyear("o_orderdate").alias("week_no"),
        F.expr("CAST(o_orderkey % 4 AS INT)").alias("bill_run_no"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'FINAL' WHEN 'O' THEN 'revise' ELSE 'UNKNOWN' END").alias("status"),
    )
    chosen = residue.select_billing_run(_periods(spark, folder), runs)
    return chosen.groupBy(
        F.extract(F.lit("YEAROFWEEK"), F.col("settlement_date")).cast("long").alias("iso_year"),
        F.weekofyear("settlement_date").cast("long").alias("iso_week"),
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("surplus_aud").cast("double").alias("surplus_aud"))


@REGISTRY.add(
    "latest_version",
    """
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey, l_suppkey, l_extendedprice, l_shipdate
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn
          FROM lineitem) WHERE rn = 1
    """,
)
def latest_version(spark, folder):
    rows = R.table(spark, folder, "lineitem")
    latest = versions.latest_version(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])
    return latest.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_partkey", "l_suppkey", "l_extendedprice",
        "l_shipdate",
    )


@REGISTRY.add(
    "first_occurrence",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS line
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS rn
          FROM lineitem) WHERE rn = 1
    """,
)
def first_occurrence(spark, folder):
    rows = R.table(spark, folder, "lineitem")
    first = versions.first_occurrence(rows, ["l_orderkey"], ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"])
    return first.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("line"))


@REGISTRY.add(
    "latest_non_null",
    """
    WITH x AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_shipdate, l_partkey, l_suppkey,
                      CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_extendedprice END AS price,
                      CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_quantity END AS units FROM lineitem),
    p AS (SELECT l_orderkey, line, price FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, line
            ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM x WHERE price IS NOT NULL) WHERE rn = 1),
    u AS (SELECT l_orderkey, line, units FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, line
            ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM x WHERE units IS NOT NULL) WHERE rn = 1)
    SELECT k.l_orderkey, k.line, price, units FROM (SELECT DISTINCT l_orderkey, line FROM x) k
    LEFT JOIN p USING (l_orderkey, line) LEFT JOIN u USING (l_orderkey, line)
    """,
)
def latest_non_null(spark, folder):
    rows = R.table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_shipdate", "l_partkey", "l_suppkey",
        F.expr("CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_extendedprice END").alias("price"),
        F.expr("CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_quantity END").alias("units"),
    )
    return versions.latest_non_null(
        rows, ["l_orderkey", "line"], ["l_shipdate", "l_partkey", "l_suppkey"], ["price", "units"]
    )


FINAL_SUMMARY_SQL = f"""{R.WEEKS_SQL},
ranked AS (
  SELECT *, CASE WHEN bill_run_type = 'FINAL' THEN 2 ELSE 1 END AS class,
         CASE WHEN bill_run_type = 'FINAL' THEN 999
              ELSE coalesce(TRY_CAST(regexp_extract(bill_run_type, '(\\d+)', 1) AS INTEGER), 0) END AS rev FROM weeks
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY quarter, interconnector_id, from_region
                          ORDER BY class DESC, rev DESC, effective_date DESC, source_file) AS rn FROM ranked) WHERE rn = 1
), weekly AS (
  SELECT * FROM (
    SELECT w.*, row_number() OVER (PARTITION BY w.quarter, w.interconnector_id, w.from_region, w.week_no
                                   ORDER BY w.effective_date DESC, w.source_file) AS wrn
    FROM ranked w JOIN best b ON w.quarter = b.quarter AND w.interconnector_id = b.interconnector_id
         AND w.from_region = b.from_region AND w.bill_run_type = b.bill_run_type) WHERE wrn = 1
), sums AS (
  SELECT quarter, interconnector_id, from_region, sum(total_surplus) AS total_surplus,
         sum(distributed_surplus) AS distributed_surplus, sum(auction_fees) AS auction_fees, sum(net_payment) AS net_payment
  FROM weekly GROUP BY ALL
), summary AS (
  SELECT s.*, b.bill_run_type, b.purchased_units, b.accumulated_net_payment, b.source_file, b.effective_date
  FROM sums s JOIN best b USING (quarter, interconnector_id, from_region)
)"""


def _summary(spark, folder):
    return residue.final_settlement_summary(
        R.settlement_weeks(spark, folder),
        carried=("purchased_units", "accumulated_net_payment", "source_file", "effective_date"),
    )


@REGISTRY.add(
    "final_settlement_summary",
    f"""
    WITH {FINAL_SUMMARY_SQL}
    SELECT quarter, interconnector_id, from_region, bill_run_type, CAST(total_surplus AS DOUBLE) AS total_surplus,
           CAST(distributed_surplus AS DOUBLE) AS distributed_surplus, CAST(auction_fees AS DOUBLE) AS auction_fees,
           CAST(net_payment AS DOUBLE) AS net_payment, CAST(purchased_units AS BIGINT) AS purchased_units,
           CAST(accumulated_net_payment AS DOUBLE) AS accumulated_net_payment, source_file, effective_date
    FROM summary
    """,
)
def final_settlement_summary(spark, folder):
    money = ["total_surplus", "distributed_surplus", "auction_fees", "net_payment", "accumulated_net_payment"]
    return _summary(spark, folder).withColumns(
        {**{c: F.col(c).cast("double") for c in money}, "purchased_units": F.col("purchased_units").cast("long")}
    )


@REGISTRY.add(
    "load_quarterly_residue",
    """
    WITH f AS (SELECT 'C' || year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter,
                      CASE o_orderstatus WHEN 'F' THEN 'V-SA' WHEN 'O' THEN 'V-SA' ELSE 'NSW1-QLD1' END AS interconnector_id,
                      o_orderpriority AS from_region, CAST(o_custkey % 3 AS INTEGER) AS file_seq,
                      CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS v FROM orders),
    g AS (SELECT quarter, interconnector_id, from_region, file_seq, sum(v) AS v FROM f GROUP BY ALL)
    SELECT quarter, interconnector_id, from_region, round(CAST(arg_max(v, file_seq) AS DOUBLE), 2) AS residue_aud
    FROM g GROUP BY ALL
    """,
)
def load_quarterly_residue(spark, folder):
    files = R.table(spark, folder, "orders").select(
        R.quarter_label("o_orderdate").alias("quarter"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'V-S-MNSP1' WHEN 'O' THEN 'V-SA' ELSE 'NSW1-QLD1' END").alias(
            "interconnector_id"
        ),
        F.col("o_orderpriority").alias("from_region"),
        F.expr("CAST(o_custkey % 3 AS INT)").alias("file_seq"),
        F.expr("CASE WHEN o_orderkey % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice END").alias("residue_aud"),
    )
    return residue.load_quarterly_residue(files).withColumn("residue_aud", F.round("residue_aud", 2))


@REGISTRY.add(
    "reconcile_full_outer",
    f"""
    WITH {R.QUARTERLY_RESIDUE_SQL}, {R.AUCTION_SQL.strip()},
    settled AS (SELECT quarter, interconnector_id, from_region, sum(clearing_price) AS p FROM auction GROUP BY ALL)
    SELECT coalesce(q.quarter, s.quarter) AS quarter, coalesce(q.interconnector_id, s.interconnector_id) AS interconnector_id,
           coalesce(q.from_region, s.from_region) AS from_region,
           CAST(coalesce(residue_aud, 0) AS DOUBLE) AS dispatch_residue_aud, CAST(coalesce(p, 0) AS DOUBLE) AS auction_netpayment_aud,
           CAST(coalesce(residue_aud, 0) - coalesce(p, 0) AS DOUBLE) AS delta_aud
    FROM quarterly q FULL JOIN settled s
      ON q.quarter = s.quarter AND q.interconnector_id = s.interconnector_id AND q.from_region = s.from_region
    """,
)
def reconcile_full_outer(spark, folder):
    compared = residue.reconcile_dispatch_vs_settlement(
        R.residue(spark, folder), R.auction(spark, folder), payment="clearing_price"
    )
    return compared.withColumns(
        {c: F.col(c).cast("double") for c in ("dispatch_residue_aud", "auction_netpayment_aud", "delta_aud")}
    )


RECON_SQL = f"""{R.AUCTION_SQL},
{R.QUARTERLY_RESIDUE_SQL.strip()},
summaries AS (
  SELECT quarter, interconnector_id, from_region, CAST(sum(units_sold) AS BIGINT) AS purchased_units,
         CAST(sum(clearing_price) AS DOUBLE) AS total_surplus, CAST(sum(clearing_price) AS DOUBLE) * 0.9 AS accumulated_net_payment
  FROM auction GROUP BY ALL
), scaled AS (
  SELECT quarter, interconnector_id, from_region, CAST(residue_aud AS DOUBLE) * 0.82 AS residue_aud FROM quarterly
), j AS (
  SELECT coalesce(a.quarter, b.quarter) AS quarter, coalesce(a.interconnector_id, b.interconnector_id) AS interconnector_id,
         coalesce(a.from_region, b.from_region) AS from_region, coalesce(purchased_units, 0) AS units,
         coalesce(residue_aud, 0) AS r, coalesce(total_surplus, 0) AS s, coalesce(accumulated_net_payment, 0) AS p,
         total_surplus IS NULL AS no_a, residue_aud IS NULL AS no_r
  FROM summaries a FULL JOIN scaled b ON a.quarter = b.quarter AND a.interconnector_id = b.interconnector_id
       AND a.from_region = b.from_region
), v AS (
  SELECT *, CASE WHEN s <> 0 THEN abs(r - s) / abs(s) WHEN r = 0 THEN 0.0 ELSE 1.0 END AS pct,
         CASE WHEN p <> 0 THEN abs(r - p) / abs(p) WHEN r = 0 THEN 0.0 ELSE 1.0 END AS pct_net FROM j
), recon AS (
  SELECT *, CASE WHEN no_a OR no_r THEN 'incomplete_data' WHEN pct <= 0.01 THEN 'reconciled' WHEN pct <= 0.05 THEN 'small_variance'
                 ELSE 'unexplained_variance' END AS status FROM v
)"""


def _reconciliation(spark, folder):
    summaries = R.auction(spark, folder).groupBy(*KEYS).agg(
        F.sum("units_sold").alias("purchased_units"),
        F.sum("clearing_price").cast("double").alias("total_surplus"),
        (F.sum("clearing_price").cast("double") * 0.9).alias("accumulated_net_payment"),
        F.lit("FINAL").alias("bill_run_type"),
        F.lit("f").alias("source_file"),
    )
    rebuilt = R.quarterly_residue(spark, folder).withColumn("residue_aud", F.col("residue_aud").cast("double") * 0.82)
    return residue.reconcile_payouts(summaries, rebuilt)


@REGISTRY.add(
    "reconcile_payouts",
    f"""
    WITH {RECON_SQL}
    SELECT quarter, interconnector_id, from_region, units AS purchased_units, r AS quarterly_residue_aud, s AS total_surplus_aud,
           CASE WHEN units > 0 THEN {R.sql_round("s / units", 6)} ELSE 0.0 END AS reference_per_unit,
           CASE WHEN units > 0 THEN {R.sql_round("r / units", 6)} ELSE 0.0 END AS reconstructed_per_unit,
           abs(r - s) AS absolute_variance_aud, pct AS percentage_variance,
           abs(r - p) AS net_payment_absolute_variance_aud, pct_net AS net_payment_percentage_variance,
           status AS calculation_status,
           concat_ws('|', CASE WHEN no_a THEN 'no_aucunits' END, CASE WHEN no_r THEN 'no_dispatch_irsr' END,
                     CASE WHEN units <= 0 THEN 'zero_purchased_units' END,
                     CASE WHEN s = 0 AND r <> 0 THEN 'zero_aemo_baseline' END,
                     CASE WHEN status = 'small_variance' THEN CASE WHEN r > s THEN 'likely:settlement_revision_or_fees'
                          ELSE 'likely:negative_residue_or_completeness' END END,
                     CASE WHEN status = 'unexplained_variance' THEN 'variance' END) AS warnings
    FROM recon
    """,
)
def reconcile_payouts(spark, folder):
    rows = _reconciliation(spark, folder)
    short = F.transform("warnings", lambda w: F.when(w.startswith("variance="), F.lit("variance")).otherwise(w))
    return rows.select(
        *KEYS, "purchased_units", "quarterly_residue_aud", "total_surplus_aud", "reference_per_unit",
        "reconstructed_per_unit", "absolute_variance_aud", "percentage_variance", "net_payment_absolute_variance_aud",
        "net_payment_percentage_variance", "calculation_status", F.array_join(short, "|").alias("warnings"),
    )


@REGISTRY.add(
    "reconciliation_totals",
    f"""
    WITH {RECON_SQL}
    SELECT quarter, {R.sql_round("sum(s)", 2)} AS total_reference_aud, {R.sql_round("sum(r)", 2)} AS total_reconstructed_residue_aud,
           {R.sql_round("sum(abs(r - s))", 2)} AS total_absolute_variance_aud,
           count(*) FILTER (status = 'reconciled') AS categories_reconciled,
           count(*) FILTER (contains(status, 'variance')) AS categories_with_variance,
           count(*) FILTER (no_a) AS categories_missing_aucunits, count(*) FILTER (no_r) AS categories_missing_irsr
    FROM recon GROUP BY quarter
    """,
)
def reconciliation_totals(spark, folder):
    totals = residue.reconciliation_totals(_reconciliation(spark, folder))
    return totals.select(
        "quarter",
        *[F.round(c, 2).alias(c) for c in (
            "total_reference_aud", "total_reconstructed_residue_aud", "total_absolute_variance_aud")],
        "categories_reconciled", "categories_with_variance", "categories_missing_aucunits", "categories_missing_irsr",
    )


CERTIFY_SQL = f"""{RECON_SQL},
t AS (SELECT quarter, sum(s) AS ref, sum(r) AS reb, max(CASE WHEN NOT no_a AND NOT no_r THEN pct END) AS worst,
             count(*) FILTER (NOT no_a AND NOT no_r) AS n FROM recon GROUP BY quarter),
certified AS (
  SELECT quarter, CASE WHEN n > 0 THEN ref ELSE 0.0 END AS total_aucunits_aud,
         CASE WHEN n > 0 THEN reb - ref ELSE 0.0 END AS total_gap_aud,
         CASE WHEN n > 0 AND ref <> 0 THEN abs(reb - ref) / abs(ref) ELSE 0.0 END AS total_gap_pct,
         CASE WHEN n > 0 THEN worst ELSE 0.0 END AS max_category_gap_pct, n AS num_categories,
         CASE WHEN n = 0 THEN 'NO_COMPARABLES' WHEN abs(reb - ref) / abs(ref) <= 0.2 AND worst <= 0.9 THEN 'PASS'
              ELSE 'NOT_YET' END AS certification_status
  FROM t
)"""


def _certified(spark, folder):
    return residue.certify_quarters(_reconciliation(spark, folder), total_threshold=0.2, category_threshold=0.9)


@REGISTRY.add(
    "certify_quarters",
    f"""
    WITH {CERTIFY_SQL}
    SELECT quarter, {R.sql_round("total_aucunits_aud", 2)} AS total_aucunits_aud, {R.sql_round("total_gap_aud", 2)} AS total_gap_aud,
           round(total_gap_pct, 8) AS total_gap_pct, round(max_category_gap_pct, 8) AS max_category_gap_pct, num_categories,
           certification_status
    FROM certified
    """,
)
def certify_quarters(spark, folder):
    return _certified(spark, folder).select(
        "quarter", F.round("total_aucunits_aud", 2).alias("total_aucunits_aud"),
        F.round("total_gap_aud", 2).alias("total_gap_aud"), F.round("total_gap_pct", 8).alias("total_gap_pct"),
        F.round("max_category_gap_pct", 8).alias("max_category_gap_pct"), "num_categories", "certification_status",
    )


@REGISTRY.add(
    "certification_summary",
    f"""
    WITH {CERTIFY_SQL}
    SELECT count(*) AS total_quarters, count(*) FILTER (certification_status = 'PASS') AS passed,
           count(*) FILTER (certification_status = 'NOT_YET') AS not_yet,
           count(*) FILTER (certification_status IN ('NO_DATA', 'NO_COMPARABLES')) AS errors,
           round(avg(total_gap_pct) FILTER (certification_status = 'PASS'), 8) AS passed_mean_total_gap_pct,
           round(avg(max_category_gap_pct) FILTER (certification_status = 'PASS'), 8) AS passed_mean_category_gap_pct
    FROM certified
    """,
)
def certification_summary(spark, folder):
    summary = residue.certification_summary(_certified(spark, folder))
    return summary.withColumns(
        {c: F.round(c, 8) for c in ("passed_mean_total_gap_pct", "passed_mean_category_gap_pct")}
    )


@REGISTRY.add(
    "payout_history",
    f"""
    WITH {R.QUARTERLY_RESIDUE_SQL}, {R.AUCTION_SQL.strip()},
    a AS (SELECT quarter, interconnector_id, from_region, CAST(sum(units_sold) AS BIGINT) AS total_units_sold,
                 sum(units_sold * clearing_price) AS v FROM auction GROUP BY ALL),
    m AS (SELECT quarter, interconnector_id, from_region, CAST(residue_aud AS DOUBLE) AS surplus_aud, total_units_sold,
                 {R.sql_round("CAST(residue_aud AS DOUBLE) / total_units_sold", 4)} AS payout_per_unit,
                 {R.sql_round("CAST(v AS DOUBLE) / total_units_sold", 4)} AS weighted_avg_clearing_price
          FROM quarterly JOIN a USING (quarter, interconnector_id, from_region)),
    n AS (SELECT *, {R.sql_round("payout_per_unit - weighted_avg_clearing_price", 4)} AS alpha FROM m)
    SELECT *, {R.sql_round("alpha / weighted_avg_clearing_price * 100", 2)} AS alpha_pct FROM n
    """,
)
def payout_history(spark, folder):
    surplus = R.quarterly_residue(spark, folder).select(*KEYS, F.col("residue_aud").cast("double").alias("surplus_aud"))
    return residue.payout_history(surplus, R.auction(spark, folder))


@REGISTRY.add(
    "pair_regions",
    """
    WITH r AS (SELECT o_orderdate AS trading_interval, o_orderstatus AS interconnector_id, o_orderpriority AS from_region,
                      CAST(o_totalprice AS DECIMAL(18,2)) AS v, o_orderkey FROM orders),
    n AS (SELECT *, count(*) OVER (PARTITION BY trading_interval, interconnector_id) AS c,
                 row_number() OVER (PARTITION BY trading_interval, interconnector_id ORDER BY from_region, o_orderkey) AS rn FROM r)
    SELECT a.trading_interval, a.interconnector_id, a.from_region, b.from_region AS to_region,
           CAST(a.v AS DOUBLE) AS residue_from_region, CAST(b.v AS DOUBLE) AS residue_to_region
    FROM n a JOIN n b ON a.trading_interval = b.trading_interval AND a.interconnector_id = b.interconnector_id
    WHERE a.c = 2 AND a.rn = 1 AND b.rn = 2
    """,
)
def pair_regions(spark, folder):
    return _pairs(spark, folder).withColumns(
        {c: F.col(c).cast("double") for c in ("residue_from_region", "residue_to_region")}
    )


def _pairs(spark, folder):
    rows = R.table(spark, folder, "orders").select(
        F.col("o_orderdate").alias("trading_interval"), F.col("o_orderstatus").alias("interconnector_id"),
        F.col("o_orderpriority").alias("from_region"), F.col("o_totalprice").cast("decimal(18,2)").alias("residue_aud"),
        "o_orderkey",
    )
    return residue.pair_regions(rows, order=("from_region", "o_orderkey"))


@REGISTRY.add(
    "residue_by_interconnector",
    """
    WITH g AS (SELECT o_orderdate, o_orderstatus, count(*) AS c, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v
               FROM orders GROUP BY ALL)
    SELECT o_orderstatus AS interconnector_id, CAST(sum(v) AS DOUBLE) AS total_residue FROM g WHERE c = 2 GROUP BY 1
    """,
)
def residue_by_interconnector(spark, folder):
    return residue.residue_by_interconnector(_pairs(spark, folder)).withColumn(
        "total_residue", F.col("total_residue").cast("double")
    )


BACKTEST_SQL = f"""{R.AUCTION_SQL},
{R.QUARTERLY_RESIDUE_SQL.strip()},
sold AS (SELECT quarter, interconnector_id, from_region, CAST(sum(units_sold) AS BIGINT) AS total_units_sold
         FROM auction GROUP BY ALL),
backtest AS (
  SELECT a.*, total_units_sold, CAST(residue_aud AS DOUBLE) AS actual_residue_total,
         CASE WHEN total_units_sold <= 0 THEN 0.0 ELSE CAST(residue_aud AS DOUBLE) / total_units_sold END AS actual_per_unit,
         CAST(greatest(units_offered, 1) AS DOUBLE) AS mu
  FROM auction a JOIN sold USING (quarter, interconnector_id, from_region)
       JOIN quarterly USING (quarter, interconnector_id, from_region)
)"""

SCORES_SQL = f"""{BACKTEST_SQL},
totals AS (SELECT range AS total_percent FROM range(0, 21)),
model AS (
  SELECT quarter, total_percent, actual_per_unit, CAST(clearing_price AS DOUBLE) AS price,
         {R.sql_round("1.0::DOUBLE / mu * (actual_residue_total * mu / greatest(total_units_sold, 1)) * (1 - total_percent / 100.0::DOUBLE)", 2)} AS m
  FROM backtest, totals
), errors AS (
  SELECT quarter, total_percent,
         least(CASE WHEN actual_per_unit = 0 AND m = 0 THEN 0.0 WHEN actual_per_unit = 0 THEN 100.0
                    ELSE abs((m - actual_per_unit) / actual_per_unit) * 100.0 END, 200.0) AS e1,
         least(CASE WHEN price = 0 AND m = 0 THEN 0.0 WHEN price = 0 THEN 100.0 ELSE abs((m - price) / price) * 100.0 END, 200.0) AS e2
  FROM model
), mapes AS (SELECT quarter, total_percent, count(*) AS rows, sum(e1) / count(*) AS m1, sum(e2) / count(*) AS m2 FROM errors GROUP BY ALL),
scores AS (
  SELECT quarter, rows, r.range / 100.0 AS model_risk_discount, q.range / 100.0 AS liquidity_discount,
         total_percent / 100.0 AS total_discount, greatest(0.0, 0.1 - total_percent / 100.0::DOUBLE) AS discount_shortfall, m1, m2,
         0.6 * m1 + 0.4 * m2 + greatest(0.0, 0.1::DOUBLE - total_percent / 100.0::DOUBLE) * 100.0 AS weighted_score
  FROM mapes JOIN range(0, 11) r ON true JOIN range(0, 11) q ON r.range + q.range = total_percent
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY weighted_score, model_risk_discount,
                        liquidity_discount) AS rn FROM scores) WHERE rn = 1
)"""

CONFIG = calibration.CalibrationConfig(
    payout_error_weight=0.6, price_error_weight=0.4, ape_cap=200.0, quarter_balanced=True, min_total_discount=0.1
)


def _backtest(spark, folder):
    return calibration.backtest_frame(R.auction(spark, folder), R.quarterly_residue(spark, folder))


def _rounded(frame, columns, digits=6):
    return frame.withColumns({c: F.round(c, digits) for c in columns})


@REGISTRY.add(
    "backtest_frame",
    f"""
    WITH {BACKTEST_SQL}
    SELECT quarter, contract_id, interconnector_id, from_region, order_key, part_key, supp_key,
           CAST(units_sold AS BIGINT) AS units_sold, total_units_sold, actual_residue_total, actual_per_unit,
           actual_per_unit * units_sold AS actual_total_payout
    FROM backtest
    """,
)
def backtest_frame(spark, folder):
    return _backtest(spark, folder).select(
        "quarter", "contract_id", "interconnector_id", "from_region", "order_key", "part_key", "supp_key",
        F.col("units_sold").cast("long").alias("units_sold"), "total_units_sold", "actual_residue_total",
        "actual_per_unit", "actual_total_payout",
    )


@REGISTRY.add(
    "calibration_grid",
    f"""
    WITH {SCORES_SQL}
    SELECT quarter, rows, model_risk_discount, liquidity_discount, total_discount, round(m1, 6) AS mape_actual_per_unit,
           round(m2, 6) AS mape_clearing_price, round(weighted_score, 6) AS weighted_score
    FROM scores
    """,
)
def calibration_grid(spark, folder):
    scores = calibration.calibration_scores(_backtest(spark, folder), CONFIG)
    return _rounded(
        scores.drop("discount_shortfall"), ["mape_actual_per_unit", "mape_clearing_price", "weighted_score"]
    )


@REGISTRY.add(
    "calibration_argmin",
    f"""
    WITH {SCORES_SQL}
    SELECT quarter, rows, model_risk_discount, liquidity_discount, round(m1, 6) AS mape_actual_per_unit,
           round(m2, 6) AS mape_clearing_price, round(weighted_score, 6) AS weighted_score
    FROM best
    """,
)
def calibration_argmin(spark, folder):
    best = calibration.best_grid_point(calibration.calibration_scores(_backtest(spark, folder), CONFIG))
    return _rounded(
        best.drop("discount_shortfall", "total_discount"),
        ["mape_actual_per_unit", "mape_clearing_price", "weighted_score"],
    )


@REGISTRY.add(
    "calibration_global",
    f"""
    WITH {SCORES_SQL},
    pooled AS (SELECT total_percent, sum(rows) AS rows, sum(m1) / count(*) AS g1, sum(m2) / count(*) AS g2 FROM mapes GROUP BY ALL),
    p AS (SELECT CAST(rows AS BIGINT) AS rows, r.range / 100.0 AS model_risk_discount, q.range / 100.0 AS liquidity_discount,
                 g1, g2, 0.6 * g1 + 0.4 * g2 + greatest(0.0, 0.1::DOUBLE - total_percent / 100.0::DOUBLE) * 100.0 AS ws
          FROM pooled JOIN range(0, 11) r ON true JOIN range(0, 11) q ON r.range + q.range = total_percent)
    SELECT rows, model_risk_discount, liquidity_discount, round(g1, 6) AS mape_actual_per_unit, round(g2, 6) AS mape_clearing_price,
           round(ws, 6) AS weighted_score
    FROM p ORDER BY ws, model_risk_discount, liquidity_discount LIMIT 1
    """,
)
def calibration_global(spark, folder):
    best = calibration.best_grid_point(calibration.calibration_scores(_backtest(spark, folder), CONFIG, by_quarter=False))
    return _rounded(
        best.drop("quarter", "discount_shortfall", "total_discount"),
        ["mape_actual_per_unit", "mape_clearing_price", "weighted_score"],
    )


EVALUATED_SQL = f"""{SCORES_SQL},
evaluated AS (
  SELECT b.*, g.model_risk_discount, g.liquidity_discount,
         {R.sql_round("1.0::DOUBLE / mu * (actual_residue_total * mu / greatest(total_units_sold, 1)) * (1 - g.total_discount)", 2)} AS model_per_unit,
         {R.sql_round("1.0::DOUBLE / mu * (actual_residue_total * mu / greatest(total_units_sold, 1)) * (1 - g.total_discount) * units_sold", 2)} AS model_total_payout
  FROM backtest b JOIN best g ON b.quarter = g.quarter
), measured AS (
  SELECT *, least(CASE WHEN actual_per_unit = 0 AND model_per_unit = 0 THEN 0.0 WHEN actual_per_unit = 0 THEN 100.0
                       ELSE abs((model_per_unit - actual_per_unit) / actual_per_unit) * 100.0 END, 200.0) AS e1,
         least(abs((model_per_unit - CAST(clearing_price AS DOUBLE)) / CAST(clearing_price AS DOUBLE)) * 100.0, 200.0) AS e2
  FROM evaluated
)"""


def _evaluated(spark, folder):
    backtest = _backtest(spark, folder)
    best = calibration.best_grid_point(calibration.calibration_scores(backtest, CONFIG))
    return best, calibration.apply_calibration(backtest, best, CONFIG)


@REGISTRY.add(
    "apply_calibration",
    f"""
    WITH {EVALUATED_SQL}
    SELECT quarter, order_key, part_key, supp_key, contract_id, model_per_unit, model_total_payout,
           e1 AS pct_error_actual_per_unit, e2 AS pct_error_clearing_price
    FROM measured
    """,
)
def apply_calibration(spark, folder):
    _, rows = _evaluated(spark, folder)
    return rows.select(
        "quarter", "order_key", "part_key", "supp_key", "contract_id", "model_per_unit", "model_total_payout",
        "pct_error_actual_per_unit", "pct_error_clearing_price",
    )


@REGISTRY.add(
    "summarize_quarter",
    f"""
    WITH {EVALUATED_SQL}
    SELECT quarter, count(*) AS rows, round(avg(e1), 6) AS actual_per_unit_mape, round(avg(e2), 6) AS clearing_price_mape,
           {R.sql_round("sum(actual_per_unit * units_sold)", 2)} AS actual_total_payout,
           {R.sql_round("sum(model_total_payout)", 2)} AS model_total_payout
    FROM measured GROUP BY quarter
    """,
)
def summarize_quarter(spark, folder):
    _, rows = _evaluated(spark, folder)
    summary = _rounded(calibration.summarize_by_quarter(rows), ["actual_per_unit_mape", "clearing_price_mape"])
    return _rounded(summary, ["actual_total_payout", "model_total_payout"], 2)


@REGISTRY.add(
    "calibration_means",
    f"""
    WITH {SCORES_SQL}
    SELECT CAST(sum(rows) AS BIGINT) AS rows, count(*) AS quarters, round(sum(m1 * rows) / sum(rows), 6) AS mape_actual_per_unit_mean,
           round(sum(m2 * rows) / sum(rows), 6) AS mape_clearing_price_mean,
           round(sum(weighted_score * rows) / sum(rows), 6) AS weighted_score_mean
    FROM best
    """,
)
def calibration_means(spark, folder):
    best = calibration.best_grid_point(calibration.calibration_scores(_backtest(spark, folder), CONFIG))
    return _rounded(
        calibration.row_weighted_means(best),
        ["mape_actual_per_unit_mean", "mape_clearing_price_mean", "weighted_score_mean"],
    )


@REGISTRY.add(
    "group_total",
    f"""
    WITH {R.AUCTION_SQL}
    SELECT order_key, part_key, supp_key, contract_id,
           CAST(sum(units_sold) OVER (PARTITION BY quarter, interconnector_id, from_region) AS BIGINT) AS total_units_sold,
           count(*) OVER (PARTITION BY quarter) AS quarter_rows
    FROM auction
    """,
)
def group_total(spark, folder):
    rows = joins.attach_group_total(R.auction(spark, folder), KEYS, "units_sold", "total_units_sold")
    rows = joins.attach_group_size(rows, ["quarter"], "quarter_rows")
    return rows.select("order_key", "part_key", "supp_key", "contract_id", "total_units_sold", "quarter_rows")


@REGISTRY.add(
    "product_as_of",
    """
    WITH defs AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS product, o_orderdate AS effective,
                         o_orderkey, o_custkey,
                         row_number() OVER (PARTITION BY o_orderstatus, o_orderdate ORDER BY o_orderkey DESC) AS rn FROM orders)
    SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS line, d.o_orderkey AS definition_key, d.o_custkey AS max_units
    FROM lineitem l ASOF LEFT JOIN (SELECT * FROM defs WHERE rn = 1) d ON l.l_returnflag = d.product AND l.l_shipdate >= d.effective
    """,
)
def product_as_of(spark, folder):
    definitions = R.table(spark, folder, "orders").select(
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END").alias("product"),
        F.col("o_orderdate").alias("effective"),
        F.col("o_orderkey").alias("definition_key"),
        F.col("o_custkey").alias("max_units"),
    )
    facts = R.table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("product"), "l_shipdate", "l_orderkey", "l_partkey", "l_suppkey",
        F.col("l_linenumber").cast("long").alias("line"),
    )
    found = versions.as_of_join(
        facts, definitions, ["product"], "l_shipdate", "effective", ["definition_key", "max_units"],
        tie_break=["definition_key"], fact_order=["l_orderkey", "l_partkey", "l_suppkey", "line"],
    )
    return found.drop("product", "l_shipdate")


@REGISTRY.add(
    "snapshot_as_of",
    """
    SELECT o_orderpriority AS category_id, o_orderstatus AS settlement_run, o_orderkey, o_totalprice
    FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
          FROM orders WHERE o_orderdate <= TIMESTAMP '1999-06-30' AND o_orderstatus = 'O') WHERE rn = 1
    """,
)
def snapshot_as_of(spark, folder):
    snapshots = R.table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("category_id"), F.col("o_orderstatus").alias("settlement_run"), "o_orderdate",
        "o_orderkey", "o_totalprice",
    )
    rows = versions.as_of_date(
        snapshots, ["category_id", "settlement_run"], "o_orderdate", dt.datetime(1999, 6, 30), ["o_orderkey"],
        {"settlement_run": "O"},
    )
    return rows.drop("o_orderdate")


@REGISTRY.add(
    "definitions_file_as_of",
    """
    WITH f AS (SELECT max(o_orderdate) AS d FROM orders WHERE o_orderdate <= TIMESTAMP '1999-06-30')
    SELECT o_orderkey, o_custkey FROM orders, f
    WHERE o_orderdate = d AND o_custkey % 3 = (SELECT max(o_custkey % 3) FROM orders, f WHERE o_orderdate = d)
    """,
)
def definitions_file_as_of(spark, folder):
    rows = R.table(spark, folder, "orders").select(
        F.expr("concat(date_format(o_orderdate, 'yyyyMMdd'), '.R', o_custkey % 3)").alias("source_file"),
        F.col("o_orderdate").alias("effective_date"), F.expr("o_custkey % 3").alias("revision"), "o_orderkey", "o_custkey",
    )
    catalog = rows.select("source_file", "effective_date", "revision").distinct()
    return versions.definitions_file_as_of(
        rows.select("source_file", "o_orderkey", "o_custkey"), catalog, dt.datetime(1999, 6, 30)
    ).select("o_orderkey", "o_custkey")


@REGISTRY.add(
    "run_delta",
    """
    WITH s AS (SELECT 'S' || (l_suppkey % 10) AS category_id, 'C' || year(l_shipdate) || 'Q' || quarter(l_shipdate) AS quarter,
                      CASE l_linenumber % 4 WHEN 0 THEN 'R0' WHEN 1 THEN 'R1' WHEN 2 THEN 'R2' ELSE 'FINAL' END AS run,
                      l_linenumber % 4 AS o, l_extendedprice AS p, l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category_id, quarter, run ORDER BY l_shipdate DESC, l_orderkey DESC,
                                 l_partkey DESC, l_suppkey DESC, l_linenumber DESC) AS rn FROM s) WHERE rn = 1),
    d AS (SELECT category_id, quarter, run AS to_run, lag(run) OVER w AS from_run, p, lag(p) OVER w AS prev FROM l
          WINDOW w AS (PARTITION BY category_id, quarter ORDER BY o))
    SELECT category_id, quarter, from_run, to_run, p AS payout_per_unit, p - prev AS delta,
           CASE WHEN prev = 0 THEN 0 ELSE (p - prev) / prev * 100 END AS delta_percentage
    FROM d WHERE from_run IS NOT NULL
    """,
)
def run_delta(spark, folder):
    snapshots = R.table(spark, folder, "lineitem").select(
        F.expr("concat('S', l_suppkey % 10)").alias("category_id"),
        R.quarter_label("l_shipdate").alias("quarter"),
        F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'R0' WHEN 1 THEN 'R1' WHEN 2 THEN 'R2' ELSE 'FINAL' END").alias(
            "settlement_run"
        ),
        F.col("l_shipdate").alias("effective_date"), F.col("l_extendedprice").alias("payout_per_unit"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    )
    return versions.run_delta(snapshots, tie_break=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


@REGISTRY.add(
    "comparable_rows",
    f"""
    WITH {RECON_SQL} SELECT quarter, count(*) AS comparable, round(max(pct), 8) AS worst FROM recon WHERE NOT no_a AND NOT no_r GROUP BY quarter
    """,
)
def comparable_rows(spark, folder):
    rows = residue.comparable_rows(_reconciliation(spark, folder))
    return rows.groupBy("quarter").agg(
        F.count(F.lit(1)).alias("comparable"), F.round(F.max("percentage_variance"), 8).alias("worst")
    )


@REGISTRY.add(
    "open_and_closed_quarters",
    """
    SELECT DISTINCT 'C' || year(l_shipdate) || 'Q' || quarter(l_shipdate) AS quarter,
           DATE '1999-05-20' > last_day(CAST(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE)) + 30 AS closed
    FROM lineitem
    """,
)
def open_and_closed_quarters(spark, folder):
    labels = R.table(spark, folder, "lineitem").select(R.quarter_label("l_shipdate").alias("quarter"))
    return residue.open_and_closed(labels, dt.date(1999, 5, 20), 30)
