"""Positions, scenarios, auction calendar and order reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import value_positions

CLOSED_STATUSES = ("EXPIRED", "CANCELLED")


def portfolio_pnl(positions: DataFrame, excluded: Sequence[str] = CLOSED_STATUSES) -> DataFrame:
    """Cost, accrued and forward value of the open book (assigned positions still count)."""
    held = positions.where(~F.col("status").isin(*excluded)).agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(name)
            for c, name in (
                ("acquisition_cost", "total_cost"),
                ("accrued_value", "total_accrued"),
                ("forward_value", "total_forward"),
            )
        ]
    )
    pnl = F.col("total_accrued") + F.col("total_forward") - F.col("total_cost")
    return held.select("*", pnl.alias("unrealized_pnl"), pnl.alias("total_pnl"))


def partial_assignment(positions: DataFrame, assignments: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Split assigned positions into the assigned part and remainders, values pro rata.

    ``assignments`` has ``(srda_id, units_assigned)`` rows. Those of one
    position are applied in turn by ``order`` (then by units): each is held
    against the units the position still has under its id. More than that
    changes nothing, all of it changes the status only, and less leaves the
    assigned units under the id and the rest as a remainder, so units always
    add up. Later remainders of a position are numbered from 2.
    """
    turns = F.sort_array(F.collect_list(F.struct(*order, F.col("units_assigned").alias("_units"))))
    given = assignments.where(F.col("units_assigned").isNotNull()).groupBy("srda_id").agg(turns.alias("_turns"))
    joined = positions.join(given, "srda_id", "left")
    held = F.col("units").cast("int")
    none = F.array().cast("array<struct<units:int,status:string>>")
    state = F.aggregate(
        F.transform(F.coalesce("_turns", F.array().cast(given.schema["_turns"].dataType)), lambda t: t["_units"].cast("int")),
        F.struct(held.alias("units"), F.col("status").alias("status"), none.alias("rest")),
        lambda at, u: F.when(u > at["units"], at)
        .when(u == at["units"], F.struct(at["units"].alias("units"), F.lit("ASSIGNED").alias("status"), at["rest"].alias("rest")))
        .otherwise(
            F.struct(
                u.alias("units"),
                F.lit("ASSIGNED").alias("status"),
                F.concat(
                    at["rest"], F.array(F.struct((at["units"] - u).alias("units"), at["status"].alias("status")))
                ).alias("rest"),
            )
        ),
    )
    applied = joined.withColumn("_at", state)

    def part(units, identifier, status):
        def share(name: str):
            return F.try_divide(F.col(name).cast("double") * units, F.col("units"))

        return F.struct(
            identifier.alias("srda_id"), F.col("category_id"), F.col("quarter"), units.cast("int").alias("units"),
            F.col("acquisition_price").cast("double").alias("acquisition_price"),
            (F.col("acquisition_price").cast("double") * units).alias("acquisition_cost"),
            status.alias("status"), share("accrued_value").alias("accrued_value"),
            share("forward_value").alias("forward_value"),
        )

    whole = F.struct(
        F.col("srda_id"), F.col("category_id"), F.col("quarter"), held.alias("units"),
        F.col("acquisition_price").cast("double").alias("acquisition_price"),
        F.col("acquisition_cost").cast("double").alias("acquisition_cost"),
        F.col("_at.status").alias("status"),
        F.col("accrued_value").cast("double").alias("accrued_value"),
        F.col("forward_value").cast("double").alias("forward_value"),
    )
    remainders = F.transform(
        "_at.rest",
        lambda r, i: part(
            r["units"],
            F.concat(F.col("srda_id"), F.lit("_remainder"), F.when(i > 0, F.concat(F.lit("_"), (i + 1).cast("string"))).otherwise("")),
            r["status"],
        ),
    )
    split = F.concat(F.array(part(F.col("_at.units"), F.col("srda_id"), F.col("_at.status"))), remainders)
    parts = F.when(F.size("_at.rest") > 0, split).otherwise(F.array(whole))
    return applied.select(F.explode(parts).alias("_p")).select("_p.*")


def refused_assignments(positions: DataFrame, assignments: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Assignments of more units than their position has when their turn comes, or of no position at all."""
    turns = F.sort_array(F.collect_list(F.struct(*order, F.col("units_assigned").alias("_units"))))
    given = assignments.where(F.col("units_assigned").isNotNull()).groupBy("srda_id").agg(turns.alias("_turns"))
    held = F.coalesce(F.col("units").cast("int"), F.lit(-1))
    judged = F.aggregate(
        "_turns",
        F.struct(held.alias("units"), F.array().cast(given.schema["_turns"].dataType).alias("refused")),
        lambda at, t: F.when(
            t["_units"] > at["units"],
            F.struct(at["units"].alias("units"), F.concat(at["refused"], F.array(t)).alias("refused")),
        ).otherwise(F.struct(t["_units"].cast("int").alias("units"), at["refused"].alias("refused"))),
    )
    refused = given.join(positions.select("srda_id", "units"), "srda_id", "left").select(
        "srda_id", F.explode(judged["refused"]).alias("_t")
    )
    return refused.select("srda_id", *[F.col(f"_t.{c}").alias(c) for c in order], F.col("_t._units").alias("units_assigned"))


def probability_weighted(scenarios: DataFrame, keys: Sequence[str] = ("category_id", "quarter")) -> DataFrame:
    """Expected residue per product; NULL when the probabilities do not add up to 1 within 0.01."""
    total = F.sum("probability")
    return scenarios.groupBy(*keys).agg(
        F.when(F.abs(total - 1) <= 0.01, F.sum(F.col("forecast_irsr") * F.col("probability"))).alias("expected_irsr")
    )


def scenario_percentile(
    scenarios: DataFrame, percentile: int, keys: Sequence[str] = ("category_id", "quarter"), value: str = "forecast_irsr"
) -> DataFrame:
    """Discrete percentile of the scenario values of a product.

    Three scenarios map to low, base and high (up to 25, up to 75, above);
    any other number uses rank ``floor(percentile / 100 * n)``.
    """
    places = value_positions(scenarios, keys, value)
    n = F.col("total")
    by_band = 0 if percentile <= 25 else 1 if percentile <= 75 else 2
    by_rank = F.greatest(F.lit(0), F.least(n - 1, F.floor(F.lit(percentile / 100.0) * n)))
    rank = F.when(n == 3, F.lit(by_band)).otherwise(by_rank)
    hit = (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
    return places.where(hit).select(*keys, F.col(value).alias("irsr"))


def active_events(events: DataFrame, at) -> DataFrame:
    return events.where(F.lit(at).between(F.col("open_datetime"), F.col("close_datetime")))


def upcoming_events(events: DataFrame, at, n: int = 5, tie_break: Sequence[str] = ("auction_id",)) -> DataFrame:
    return events.where(F.col("open_datetime") > F.lit(at)).orderBy("open_datetime", *tie_break).limit(n)


def reconcile_orders(submitted: DataFrame, reported: DataFrame, key: str = "order_id") -> DataFrame:
    """Counts of submitted, reported, matched and missing orders."""
    ours = submitted.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    theirs = reported.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_reported", F.lit(True))
    both = ours.join(theirs.withColumnRenamed(key, "_other"), F.col(key).eqNullSafe(F.col("_other")), "full_outer")
    sent, got = F.col("_rows").isNotNull(), F.col("_reported").isNotNull()
    return both.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("orders_submitted"),
        F.count_if(got).alias("orders_reported"),
        F.count_if(sent & got).alias("orders_matched"),
        F.count_if(sent & ~got).alias("orders_missing"),
    )


def matched_orders(submitted: DataFrame, reported: DataFrame, key: str = "order_id") -> DataFrame:
    return submitted.join(reported.select(key).distinct(), key, "left_semi")


def missing_orders(submitted: DataFrame, reported: DataFrame, key: str = "order_id") -> DataFrame:
    return submitted.join(reported.select(key).distinct(), key, "left_anti")


def auction_units(results: DataFrame, keys: Sequence[str] = ("category_id", "quarter")) -> DataFrame:
    """Units offered and cleared over all tranches."""
    return results.groupBy(*keys).agg(
        F.sum("units_offered").alias("units_offered"), F.sum("units_cleared").alias("units_sold")
    )


def clearing_price_lookup(
    results: DataFrame, load_order: Sequence[str], keys: Sequence[str] = ("category_id", "quarter", "tranche_no")
) -> DataFrame:
    """Price of the last loaded result per product."""
    # A struct keeps a NULL price of the last row instead of falling back to an earlier one.
    last = F.max_by(F.struct("clearing_price"), F.struct(*load_order))
    return results.groupBy(*keys).agg(last["clearing_price"].alias("clearing_price"))


def cancellation_prices(results: DataFrame, keys: Sequence[str] = ("category_id", "quarter")) -> DataFrame:
    """Non-zero cancellation prices as rows (a list per product would grow without bound)."""
    return results.where(F.col("cancellation_price") != 0).select(*keys, "cancellation_price")
