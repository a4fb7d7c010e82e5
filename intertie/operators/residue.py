"""Residue rebuilding, settlement selection and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.market import alias_interconnector
from ..functions.quarters import quarter_label, thirty_minute_floor

CATEGORY = ("quarter", "interconnector_id", "from_region")

# Means are summed as decimals, so that a total does not depend on the order in which tasks deliver them.
MEAN = "decimal(28,8)"

# Billing-run status in rising precedence, and the variance bands.
BILLING_STATUS_RANK = {"DAILY": 1, "PRELIM": 2, "REVISE": 3, "FINAL": 4}
RECONCILED_UP_TO = 0.01
SMALL_VARIANCE_UP_TO = 0.05
TOTAL_GAP_UP_TO = 0.01
CATEGORY_GAP_UP_TO = 0.051


def interval_bucket_average_then_sum(
    intervals: DataFrame,
    ts: str = "trading_interval",
    value: str = "residue_aud",
    keys: Sequence[str] = ("interconnector_id", "from_region"),
) -> DataFrame:
    """Mean per half hour, summed to quarters; both levels combine on the map side."""
    # The quarter follows from the bucket: buckets start on the half hour, quarters at midnight.
    buckets = intervals.groupBy(*keys, thirty_minute_floor(ts).alias("_bucket")).agg(
        (F.sum(value).cast("double") / F.count(value)).cast(MEAN).alias("_mean")
    )
    return buckets.groupBy(quarter_label("_bucket").alias("quarter"), *keys).agg(
        F.sum("_mean").cast("double").alias(value)
    )


def quarterly_sum(rows: DataFrame, ts: str, value: str, keys: Sequence[str] = CATEGORY[1:]) -> DataFrame:
    """Sum by quarter and category."""
    return rows.groupBy(quarter_label(ts).alias("quarter"), *keys).agg(F.sum(value).alias(value))


def quarterly_surplus(
    periods: DataFrame, ts: str = "settlement_date", value: str = "surplus_aud", average_duplicates: bool = False
) -> DataFrame:
    """Surplus per quarter; optionally the mean of duplicate rows of one period first."""
    keys = ["interconnector_id", "from_region"]
    if not average_duplicates:
        return quarterly_sum(periods, ts, value, keys)
    per_period = periods.groupBy(*keys, F.to_date(ts).alias("_day"), "period_id").agg(
        (F.sum(value).cast("double") / F.count(value)).cast(MEAN).alias(value)
    )
    return quarterly_sum(per_period, "_day", value, keys).withColumn(value, F.col(value).cast("double"))


def billing_status_rank(status: str = "status") -> Column:
    rank = F.lit(None).cast("int")
    for name, value in BILLING_STATUS_RANK.items():
        rank = F.when(F.upper(F.col(status)) == name, value).otherwise(rank)
    return rank


def select_billing_run(rows: DataFrame, runs: DataFrame, ts: str = "settlement_date", run: str = "run_no") -> DataFrame:
    """Rows whose run is the best billing run of their ISO week."""
    best = (
        runs.withColumn("_rank", billing_status_rank())
        .where(F.col("_rank").isNotNull())
        .groupBy(F.col("contract_year").alias("_year"), F.col("week_no").alias("_week"))
        .agg(F.max_by("bill_run_no", F.struct("_rank", "bill_run_no")).alias("_target"))
    )
    keyed = rows.withColumn("_year", F.extract(F.lit("YEAROFWEEK"), F.col(ts)).cast("int")).withColumn(
        "_week", F.weekofyear(ts)
    )
    return keyed.join(best, ["_year", "_week"]).where(F.col(run) == F.col("_target")).select(*rows.columns)


def final_settlement_summary(
    weeks: DataFrame,
    measures: Sequence[str] = ("total_surplus", "distributed_surplus", "auction_fees", "net_payment"),
    carried: Sequence[str] = (
        "purchased_units", "accumulated_net_payment", "accumulated_net_payment_per_unit", "source_file",
        "effective_date",
    ),
    keys: Sequence[str] = CATEGORY,
) -> DataFrame:
    """Best run type per category (FINAL, then highest revision, then latest date), its latest file per week summed.

    ``carried`` columns come from the best row itself.
    """
    is_final = F.upper("bill_run_type") == "FINAL"
    revision = F.when(is_final, 999).otherwise(
        F.coalesce(F.regexp_extract("bill_run_type", r"(\d+)", 1).try_cast("int"), F.lit(0))
    )
    # The earlier in this order, the better: the latest date, then the first file name.
    day = F.coalesce(F.unix_date(F.to_date("effective_date")), F.lit(-(1 << 24)))
    newest = F.struct((-day).alias("age"), "source_file")
    # Within a run type the latest file of a week is also the week's best row, so one winner serves both questions.
    row = F.struct(newest.alias("newest"), F.struct(*measures).alias("measures"), F.struct(*carried).alias("carried"))
    weekly = weeks.groupBy(*keys, "bill_run_type", "week_no").agg(F.min_by(row, newest).alias("_row"))
    runs = weekly.groupBy(*keys, "bill_run_type").agg(
        *[F.sum(f"_row.measures.{m}").alias(m) for m in measures],
        F.min(F.struct("_row.newest", "_row.carried")).alias("_best"),
    )
    order = F.struct(
        F.when(is_final, 0).otherwise(1).alias("class"), (-revision).alias("revision"), F.col("_best.newest"), "bill_run_type"
    )
    chosen = runs.groupBy(*keys).agg(
        F.min_by(F.struct("bill_run_type", *measures, F.col("_best.carried").alias("carried")), order).alias("_run")
    )
    return chosen.select(*keys, "_run.bill_run_type", *[F.col(f"_run.{m}").alias(m) for m in measures], "_run.carried.*")


def load_quarterly_residue(files: DataFrame, file_order: str = "file_seq", value: str = "residue_aud") -> DataFrame:
    """Residue per category from several files: aliases resolved, sums per file, the last file wins."""
    per_file = (
        files.withColumn("interconnector_id", alias_interconnector("interconnector_id"))
        .groupBy(*CATEGORY, file_order)
        .agg(F.sum(F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(None)), F.lit(0.0))).alias(value))
    )
    return per_file.groupBy(*CATEGORY).agg(F.max_by(value, file_order).alias(value))


def reconcile_dispatch_vs_settlement(
    residue: DataFrame,
    settlement: DataFrame,
    keys: Sequence[str] = CATEGORY,
    residue_value: str = "residue_aud",
    payment: str = "net_payment",
) -> DataFrame:
    """Full outer comparison of rebuilt residue and settled payments; a missing side counts as 0."""
    left = residue.groupBy(*keys).agg(F.sum(residue_value).alias("dispatch_residue_aud"))
    right = settlement.groupBy(*keys).agg(F.sum(payment).alias("auction_netpayment_aud"))
    joined = left.join(right, list(keys), "full_outer")
    a = F.coalesce(F.col("dispatch_residue_aud"), F.lit(0))
    b = F.coalesce(F.col("auction_netpayment_aud"), F.lit(0))
    return joined.select(
        *keys, a.alias("dispatch_residue_aud"), b.alias("auction_netpayment_aud"), (a - b).alias("delta_aud")
    )


def reconcile_payouts(summaries: DataFrame, residue: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Rebuilt residue against settled surplus and payment, with per-unit values, warnings and a status."""
    left = summaries.select(
        *keys,
        F.col("purchased_units").alias("_units"),
        F.col("total_surplus").alias("_surplus"),
        F.col("accumulated_net_payment").alias("_payment"),
        "bill_run_type",
        "source_file",
        F.lit(True).alias("_has_settlement"),
    )
    right = residue.select(*keys, F.col("residue_aud").alias("_residue"), F.lit(True).alias("_has_residue"))
    joined = left.join(right, list(keys), "full_outer")
    units, surplus, payment, rebuilt = (
        F.coalesce(F.col(c), F.lit(0)) for c in ("_units", "_surplus", "_payment", "_residue")
    )
    staged = joined.select(
        *keys,
        units.alias("purchased_units"),
        rebuilt.alias("quarterly_residue_aud"),
        surplus.alias("total_surplus_aud"),
        payment.alias("accumulated_net_payment_aud"),
        F.coalesce("bill_run_type", F.lit("N/A")).alias("bill_run_type"),
        F.coalesce("source_file", F.lit("N/A")).alias("source_file"),
        F.col("_has_settlement").isNull().alias("_no_settlement"),
        F.col("_has_residue").isNull().alias("_no_residue"),
    )
    units, rebuilt = F.col("purchased_units"), F.col("quarterly_residue_aud")
    surplus, payment = F.col("total_surplus_aud"), F.col("accumulated_net_payment_aud")

    def per_unit(total: Column) -> Column:
        return F.when(units > 0, F.round(F.try_divide(total.cast("double"), units), 6)).otherwise(F.lit(0.0))

    def relative(base: Column) -> Column:
        return (
            F.when(base != 0, F.try_divide(F.abs(rebuilt - base).cast("double"), F.abs(base).cast("double")))
            .when(rebuilt == 0, F.lit(0.0))
            .otherwise(F.lit(1.0))
        )

    staged = staged.select(
        "*",
        per_unit(surplus).alias("reference_per_unit"),
        per_unit(rebuilt).alias("reconstructed_per_unit"),
        F.abs(rebuilt - surplus).alias("absolute_variance_aud"),
        relative(surplus).alias("percentage_variance"),
        F.abs(rebuilt - payment).alias("net_payment_absolute_variance_aud"),
        relative(payment).alias("net_payment_percentage_variance"),
    )
    missing = F.col("_no_settlement") | F.col("_no_residue")
    gap = F.col("percentage_variance")
    status = (
        F.when(missing, "incomplete_data")
        .when(gap <= RECONCILED_UP_TO, "reconciled")
        .when(gap <= SMALL_VARIANCE_UP_TO, "small_variance")
        .otherwise("unexplained_variance")
    )
    staged = staged.withColumn("calculation_status", status)
    warnings = F.array_compact(
        F.array(
            F.when(F.col("_no_settlement"), F.lit("no_aucunits")),
            F.when(F.col("_no_residue"), F.lit("no_dispatch_irsr")),
            F.when(units <= 0, F.lit("zero_purchased_units")),
            F.when((surplus == 0) & (rebuilt != 0), F.lit("zero_aemo_baseline")),
            F.when(
                F.col("calculation_status") == "small_variance",
                F.when(rebuilt > surplus, F.lit("likely:settlement_revision_or_fees")).otherwise(
                    F.lit("likely:negative_residue_or_completeness")
                ),
            ),
            F.when(
                F.col("calculation_status") == "unexplained_variance",
                F.format_string("variance=%.2f%%", gap * 100),
            ),
        )
    )
    return staged.withColumn("warnings", warnings).drop("_no_settlement", "_no_residue")


def comparable_rows(reconciliation: DataFrame) -> DataFrame:
    """Rows for which both sides were present."""
    gaps = F.array(F.lit("no_aucunits"), F.lit("no_dispatch_irsr"))
    return reconciliation.where(~F.arrays_overlap("warnings", gaps))


def reconciliation_totals(reconciliation: DataFrame, by: Sequence[str] = ("quarter",)) -> DataFrame:
    return reconciliation.groupBy(*by).agg(
        F.sum("total_surplus_aud").alias("total_reference_aud"),
        F.sum("accumulated_net_payment_aud").alias("total_accumulated_net_payment_aud"),
        F.sum("quarterly_residue_aud").alias("total_reconstructed_residue_aud"),
        F.sum("absolute_variance_aud").alias("total_absolute_variance_aud"),
        F.sum("net_payment_absolute_variance_aud").alias("total_absolute_variance_vs_net_payment_aud"),
        F.count_if(F.col("calculation_status") == "reconciled").alias("categories_reconciled"),
        F.count_if(F.col("calculation_status").contains("variance")).alias("categories_with_variance"),
        F.count_if(F.array_contains("warnings", "no_aucunits")).alias("categories_missing_aucunits"),
        F.count_if(F.array_contains("warnings", "no_dispatch_irsr")).alias("categories_missing_irsr"),
    )


def certify_quarters(
    reconciliation: DataFrame,
    quarters: DataFrame | None = None,
    total_threshold: float = TOTAL_GAP_UP_TO,
    category_threshold: float = CATEGORY_GAP_UP_TO,
) -> DataFrame:
    """Gap of the quarter total and of the worst comparable category, with a verdict.

    Totals include rows with a missing side, the category gap does not.
    ``quarters`` lists requested quarters; those without rows come out as NO_DATA.
    """
    comparable = ~F.arrays_overlap("warnings", F.array(F.lit("no_aucunits"), F.lit("no_dispatch_irsr")))
    totals = reconciliation.groupBy("quarter").agg(
        F.sum("total_surplus_aud").cast("double").alias("_reference"),
        F.sum("quarterly_residue_aud").cast("double").alias("_rebuilt"),
        F.max(F.when(comparable, F.col("percentage_variance"))).alias("_worst"),
        F.count_if(comparable).alias("_comparable"),
    )
    if quarters is not None:
        totals = quarters.select("quarter").distinct().join(totals, "quarter", "left")
    usable = F.col("_comparable") > 0
    gap = F.col("_rebuilt") - F.col("_reference")
    relative = F.coalesce(F.try_divide(F.abs(gap), F.abs(F.col("_reference"))), F.lit(0.0))

    def shown(value: Column) -> Column:
        return F.when(usable, value).otherwise(F.lit(0.0))

    return totals.select(
        "quarter",
        shown(F.col("_reference")).alias("total_aucunits_aud"),
        shown(F.col("_rebuilt")).alias("total_reconstructed_residue_aud"),
        shown(gap).alias("total_gap_aud"),
        shown(relative).alias("total_gap_pct"),
        shown(F.col("_worst")).alias("max_category_gap_pct"),
        F.coalesce("_comparable", F.lit(0)).alias("num_categories"),
        F.when(F.col("_comparable").isNull(), "NO_DATA")
        .when(F.col("_comparable") == 0, "NO_COMPARABLES")
        .when((relative <= total_threshold) & (F.col("_worst") <= category_threshold), "PASS")
        .otherwise("NOT_YET")
        .alias("certification_status"),
    )


def certification_counts() -> list[Column]:
    """Aggregates over certified quarters: all, passed, not yet, and without a verdict."""
    return [
        F.count(F.lit(1)).alias("total_quarters"),
        F.count_if(F.col("certification_status") == "PASS").alias("passed"),
        F.count_if(F.col("certification_status") == "NOT_YET").alias("not_yet"),
        F.count_if(F.col("certification_status").isin("NO_DATA", "NO_COMPARABLES")).alias("errors"),
    ]


def certification_summary(certified: DataFrame) -> DataFrame:
    passed = F.col("certification_status") == "PASS"
    return certified.agg(
        *certification_counts(),
        F.avg(F.when(passed, F.col("total_gap_pct"))).alias("passed_mean_total_gap_pct"),
        F.avg(F.when(passed, F.col("max_category_gap_pct"))).alias("passed_mean_category_gap_pct"),
    )


def sold_value(auction: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Units, value and the unit-weighted price of what was sold."""
    totals = auction.groupBy(*keys).agg(
        F.sum("units_sold").alias("total_units_sold"),
        F.sum(F.col("units_sold") * F.col("clearing_price")).alias("total_value_sold"),
    )
    return totals.withColumn(
        "weighted_avg_clearing_price",
        F.round(F.try_divide(F.col("total_value_sold").cast("double"), F.col("total_units_sold")), 4),
    )


def payout_history(surplus: DataFrame, auction: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """Payout per unit against the average price paid; categories without auctions drop out."""
    joined = surplus.join(sold_value(auction, keys), list(keys), "inner")
    staged = joined.select(
        *keys,
        "surplus_aud",
        "total_units_sold",
        F.round(F.try_divide(F.col("surplus_aud").cast("double"), F.col("total_units_sold")), 4).alias(
            "payout_per_unit"
        ),
        "weighted_avg_clearing_price",
    )
    staged = staged.withColumn("alpha", F.round(F.col("payout_per_unit") - F.col("weighted_avg_clearing_price"), 4))
    return staged.withColumn(
        "alpha_pct", F.round(F.try_divide(F.col("alpha"), F.col("weighted_avg_clearing_price")) * 100, 2)
    )


def surplus_without_auctions(surplus: DataFrame, auction: DataFrame, keys: Sequence[str] = CATEGORY) -> DataFrame:
    """The rows :func:`payout_history` drops."""
    return surplus.join(auction.select(*keys).distinct(), list(keys), "left_anti")


def pair_regions(
    residue: DataFrame, ts: str = "trading_interval", value: str = "residue_aud", order: Sequence[str] = ("from_region",)
) -> DataFrame:
    """Both regional values of an interconnector and interval; only intervals with exactly two rows."""
    side = F.struct(F.col("from_region").alias("region"), F.col(value).alias("value"))
    rank = F.struct(*order)
    grouped = residue.groupBy(ts, "interconnector_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(side, rank).alias("_a"), F.max_by(side, rank).alias("_b")
    )
    return grouped.where("_n = 2").select(
        ts,
        "interconnector_id",
        F.col("_a.region").alias("from_region"),
        F.col("_b.region").alias("to_region"),
        F.col("_a.value").alias("residue_from_region"),
        F.col("_b.value").alias("residue_to_region"),
    )


def residue_by_interconnector(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("interconnector_id").agg(
        F.sum(F.col("residue_from_region") + F.col("residue_to_region")).alias("total_residue")
    )


def open_and_closed(quarters: DataFrame, as_of, grace_days: int = 0) -> DataFrame:
    """Distinct quarters marked closed or open at ``as_of``."""
    from ..functions.quarters import is_quarter_closed

    return quarters.select("quarter").distinct().withColumn("closed", is_quarter_closed("quarter", as_of, grace_days))
