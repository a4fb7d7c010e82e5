"""Quarterly reconciliation from landed files to a certified report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quarters import is_quarter_closed, quarter_in_range
from ..operators import residue, versions
from ..sources import catalog, reports, tables


def dispatch_quarterly(
    spark: SparkSession, archives: str, start_quarter: str | None = None, end_quarter: str | None = None
) -> DataFrame:
    """Quarterly residue rebuilt from interval archives, every quarter in one job.

    With a range, only archives whose name has a day in it are opened.
    """
    ranged = bool(start_quarter and end_quarter)
    pattern = catalog.dispatch_pattern(start_quarter, end_quarter) if ranged else None
    rows = reports.read_dispatch_residue_archives(spark, archives, pattern=pattern)
    quarterly = residue.interval_bucket_average_then_sum(rows)
    if ranged:
        quarterly = quarterly.where(quarter_in_range("quarter", start_quarter, end_quarter))
    return quarterly


def surplus_quarterly(spark: SparkSession, archives: str, billing_runs: str | None = None) -> DataFrame:
    """Quarterly surplus from settlement periods: the highest run per period, or the billing run of the week."""
    rows = reports.read_interval_surplus(spark, archives)
    if billing_runs:
        runs = reports.read_billing_runs(spark, billing_runs)
        return residue.quarterly_surplus(residue.select_billing_run(rows, runs), average_duplicates=True)
    return residue.quarterly_surplus(versions.final_period_rows(rows, tie_break=["surplus_aud"]))


def reconcile_quarters(
    spark: SparkSession,
    settlement_files: str,
    residue_files: str,
    as_of: dt.date,
    grace_days: int = 0,
    include_open: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Reconciliation rows and certification of every settled quarter that is closed."""
    summaries = residue.final_settlement_summary(reports.read_settlement_weeks(spark, settlement_files))
    rebuilt = tables.read_quarterly_residue(spark, residue_files)
    quarters = summaries.select("quarter").distinct()
    if not include_open:
        quarters = quarters.where(is_quarter_closed("quarter", as_of, grace_days))
    rows = residue.reconcile_payouts(summaries, rebuilt)
    rows = rows.join(quarters, "quarter", "left_semi")
    return rows, residue.certify_quarters(rows, quarters)


def payout_report(spark: SparkSession, surplus: DataFrame, monthly_results: str) -> DataFrame:
    """Payout history from the latest version of the monthly auction results."""
    results = versions.latest_version(
        tables.read_residue_results_monthly(spark, monthly_results),
        ["contract_id", "interconnector_id", "from_region"],
        ["version_no", "mmsdm_month"],
    )
    return residue.payout_history(surplus, results.withColumn("clearing_price", F.col("clearing_price").cast("double")))
