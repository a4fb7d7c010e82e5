"""Row-wise valuation expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quarters import as_column, col_of

# Fixed values of the fill-rate model.
FILL_RATE_WEIGHT = 0.74
DEMAND_TILT = 0.20
VOLUME_TILT = 0.05


def interval_irsr(
    from_price, to_price, flow_mw, loss_mw, from_share=0.6667, to_share=0.3333, hours: float = 1.0
) -> Column:
    """Residue of one interval and its flow direction.

    ``hours`` scales MW x $/MWh to the interval length; 1 keeps the published
    one-hour worked example, 1/12 is a 5-minute interval.
    """
    p_from, p_to = as_column(from_price), as_column(to_price)
    flow, loss = as_column(flow_mw), as_column(loss_mw)
    a_from, a_to = as_column(from_share), as_column(to_share)
    forward = flow >= 0
    size = F.abs(flow)
    export_price, import_price = F.when(forward, p_from).otherwise(p_to), F.when(forward, p_to).otherwise(p_from)
    export_share, import_share = F.when(forward, a_from).otherwise(a_to), F.when(forward, a_to).otherwise(a_from)
    irsr = import_price * (size - loss * import_share) - export_price * (size + loss * export_share)
    if hours != 1.0:
        irsr = irsr * hours
    return F.struct(
        irsr.alias("irsr"), F.when(forward, F.lit("forward")).otherwise(F.lit("reverse")).alias("direction")
    )


def distribution_per_unit(
    irsr, costs, units_sold, handle_negative: bool = True, fee=0, floor=None
) -> Column:
    sold = as_column(units_sold)
    distributable = as_column(irsr) - as_column(costs) - as_column(fee)
    payout = F.try_divide(distributable, sold)
    if floor is not None:
        payout = F.greatest(payout, as_column(floor))
    result = F.when(sold <= 0, F.lit(0))
    if handle_negative:
        result = result.when(distributable <= 0, F.lit(0))
    return result.otherwise(payout)


def distribution_record(irsr, costs, units_issued, units_sold, fee=0, floor=None) -> Column:
    """Clamped distributable amount, unsold units, minimum payment and the fee note."""
    issued, sold, fee = as_column(units_issued), as_column(units_sold), as_column(fee)
    distributable = F.greatest(as_column(irsr) - as_column(costs) - fee, F.lit(0))
    note = F.when(fee == 0, F.lit("Per current Auction Participation Agreement")).otherwise(
        F.concat(F.lit("Includes "), fee.cast("string"), F.lit(" AUD settlement fees deducted before allocation"))
    )
    minimum = F.lit(None).cast("double")
    if floor is not None:
        floor = as_column(floor)
        minimum = floor * sold
        note = F.concat(note, F.lit("; minimum payment floor "), floor.cast("string"), F.lit(" AUD/unit"))
    return F.struct(
        distributable.alias("distributable_irsr"),
        F.greatest(issued - sold, F.lit(0)).alias("units_unsold"),
        minimum.alias("minimum_payment"),
        note.alias("fee_treatment"),
    )


def record_payout_per_unit(distributable, units_sold, minimum_payment=None) -> Column:
    sold = as_column(units_sold)
    payout = F.try_divide(as_column(distributable), sold)
    if minimum_payment is not None:
        payout = F.greatest(payout, F.try_divide(as_column(minimum_payment), sold))
    return F.when(sold <= 0, F.lit(0)).otherwise(payout)


def fair_value(unit_proportion, irsr, downside_irsr, upside_irsr, units, risk_discount, liquidity_discount) -> Column:
    """Discounted proportional share of the residue, per unit and in total."""
    share, units = as_column(unit_proportion), as_column(units)
    keep = 1 - (as_column(risk_discount) + as_column(liquidity_discount))
    base, low, high = (share * as_column(x) for x in (irsr, downside_irsr, upside_irsr))
    return F.struct(
        F.round(base * keep, 2).alias("fair_value_per_unit"),
        F.round(base * keep * units, 2).alias("fair_value_total"),
        F.round(base, 2).alias("expected_distribution_per_unit"),
        F.round(base * units, 2).alias("expected_distribution_total"),
        F.round(low * keep, 2).alias("confidence_band_low"),
        F.round(high * keep, 2).alias("confidence_band_high"),
    )


def mark(
    accrued, forward, risk_discount=0.05, liquidity_discount=0.03, freshness=None, stability=75, dispersion=70
) -> Column:
    """Clean value with bid, mid and offer, a confidence score and the drivers map."""
    accrued, forward = as_column(accrued), as_column(forward)
    discounted = forward * (1 - as_column(risk_discount))
    clean = accrued + discounted
    cost = clean * as_column(liquidity_discount)
    state = as_column("live" if freshness is None else freshness)
    fresh = F.when(state == "live", F.lit(100)).when(state == "30min_old", F.lit(80)).otherwise(F.lit(50))
    drivers = F.create_map(
        F.lit("accrued_value"), accrued.cast("double"),
        F.lit("forward_expected_value"), forward.cast("double"),
        F.lit("model_risk_impact"), (forward - discounted).cast("double"),
        F.lit("liquidity_bid_adjustment"), (-cost).cast("double"),
        F.lit("liquidity_offer_adjustment"), cost.cast("double"),
    )
    return F.struct(
        clean.alias("clean_fair_value"),
        (clean - cost).alias("bid_mark"),
        clean.alias("mid_mark"),
        (clean + cost).alias("offer_mark"),
        ((fresh + as_column(stability) + as_column(dispersion)) / 3.0).alias("confidence_score"),
        drivers.alias("drivers"),
    )


def _clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def fill_rate_fair_value(market_price, fill_rate_pct, volume_pct) -> Column:
    """Market price tilted by where fill rate and volume sit in the whole market."""
    price = as_column(market_price)
    fill_signal = _clip((as_column(fill_rate_pct) - 50.0) / 50.0, -1.0, 1.0)
    volume_signal = _clip((as_column(volume_pct) - 50.0) / 50.0, -1.0, 1.0)
    tilted = price * (1.0 + DEMAND_TILT * fill_signal + VOLUME_TILT * volume_signal)
    value = F.least(F.greatest(tilted, price * 0.60), price * 1.60)
    confidence = (
        FILL_RATE_WEIGHT * F.abs(fill_signal)
        + 0.15 * F.greatest(F.lit(0.5), 0.5 + 0.5 * volume_signal)
        + 0.10 * F.when(price > 0, 1.0).otherwise(0.0)
    )
    return F.struct(
        F.round(value, 2).alias("fair_value"),
        F.round(_clip(confidence, 0.0, 1.0), 3).alias("confidence"),
        F.round(fill_signal, 2).alias("fill_rate_signal"),
        F.round(volume_signal, 2).alias("volume_signal"),
        F.format_string(
            "fill_signal=%.2f, volume_signal=%.2f, demand_adj_pct=%.3f, liquidity_adj_pct=%.3f",
            fill_signal, volume_signal, DEMAND_TILT * fill_signal, VOLUME_TILT * volume_signal,
        ).alias("model_notes"),
    )


def recommendation(fair_value_col, market_price, confidence) -> Column:
    """Label and reason; thresholds tighten as confidence grows."""
    fair, market, conf = as_column(fair_value_col), as_column(market_price), as_column(confidence)
    spread = F.when(market > 0, F.try_divide(fair - market, market) * 100).otherwise(F.lit(0.0))
    buy = 12.0 * (1.0 - conf * 0.5)
    hold = 4.0 * (1.0 - conf * 0.3)
    label = (
        F.when(spread >= buy, "BUY").when(spread >= hold, "HOLD").when(spread <= -hold, "AVOID").otherwise("WATCH")
    )
    reason = (
        F.when(
            spread >= buy,
            F.format_string("Strong undervalue (%.1f%% below fair value at %.0f%% conf)", spread, conf * 100),
        )
        .when(spread >= hold, F.format_string("Slight undervalue (%.1f%% below fair value)", spread))
        .when(spread <= -hold, F.format_string("Overvalued (%.1f%% above fair value)", F.abs(spread)))
        .otherwise(F.format_string("Fair value close to market (%.1f%% spread)", spread))
    )
    return F.struct(label.alias("recommendation"), reason.alias("recommendation_reason"))


def static_recommendation(fair_value_col, market_price) -> Column:
    """The variant with fixed thresholds (12, 4 and -8 percent)."""
    fair, market = as_column(fair_value_col), as_column(market_price)
    gap = F.try_divide(fair - market, market) * 100.0
    label = (
        F.when(market <= 0, "WATCH").when(gap >= 12, "BUY").when(gap >= 4, "HOLD").when(gap <= -8, "AVOID")
        .otherwise("WATCH")
    )
    reason = (
        F.when(market <= 0, F.lit("No market price available"))
        .when(gap >= 4, F.format_string("Fair value is %.1f%% above market", gap))
        .when(gap <= -8, F.format_string("Fair value is %.1f%% below market", F.abs(gap)))
        .otherwise(F.format_string("Fair value is %.1f%% from market", F.abs(gap)))
    )
    return F.struct(label.alias("recommendation"), reason.alias("recommendation_reason"))


def execution_limits(
    market_price, arbitrage_per_unit, units_sold, units_offered, risk_budget: float, participation_pct: float
) -> Column:
    """Position size bounded by a risk budget and by a share of the traded units."""
    price = F.greatest(as_column(market_price), F.lit(0.0))
    edge = F.abs(as_column(arbitrage_per_unit))
    sold, offered = F.greatest(as_column(units_sold), F.lit(0)), F.greatest(as_column(units_offered), F.lit(0))
    stop = F.greatest(edge * 0.5, price * 0.05, F.lit(1.0))
    basis = F.greatest(sold, offered, F.lit(1))
    share = F.greatest(F.lit(1), F.floor(basis * (participation_pct / 100.0)).cast("int"))
    no_impact = F.when(offered > 0, F.least(share, offered)).otherwise(share)
    by_risk = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(float(risk_budget)) / stop))
    units = F.least(by_risk, no_impact.cast("long")).cast("int")
    return F.struct(
        price.alias("market_price_aud"),
        F.round(stop, 2).alias("risk_per_unit_aud"),
        no_impact.alias("max_no_impact_units"),
        F.round(no_impact * price, 2).alias("max_no_impact_spend_aud"),
        units.alias("suggested_units"),
        F.round(units * price, 2).alias("suggested_spend_aud"),
        basis.alias("liquidity_basis_units"),
        F.round(units / basis * 100.0, 2).alias("liquidity_participation_pct"),
    )


def dynamic_thresholds(
    spot,
    adaptive_charge,
    adaptive_discharge,
    price_trend,
    forward_max,
    discharge_floor: float = 0.0,
    roundtrip_eff: float = 0.90,
    negative_spread: float = 50.0,
    forward_ratio: float = 1.3,
    trend_trigger: float = 0.1,
    max_multiplier: float = 1.3,
    spread_fraction: float = 0.15,
    falling_trigger: float = -0.2,
    falling_multiplier: float = 0.9,
    has_forward=None,
) -> Column:
    """Charge and discharge thresholds bent by the trend, with the price floor and its exception.

    ``forward_max`` is the peak over the look-ahead frame; ``has_forward`` tells
    whether that frame held any row (the last row of a series has none).
    """
    spot, charge, discharge = col_of(spot), col_of(adaptive_charge), col_of(adaptive_discharge)
    trend, peak = col_of(price_trend), col_of(forward_max)
    ahead = F.lit(True) if has_forward is None else col_of(has_forward)
    lifted = F.least(charge * max_multiplier, charge + (peak - discharge) * spread_fraction)
    charge_threshold = F.when((peak > discharge * forward_ratio) & (trend > trend_trigger), lifted).otherwise(charge)
    lowered = F.when(trend < falling_trigger, discharge * falling_multiplier).otherwise(discharge)
    override = (spot < discharge_floor) & ahead & ((peak * roundtrip_eff - spot) >= negative_spread)
    return F.struct(
        charge_threshold.alias("charge_threshold"),
        F.when(override, lowered).otherwise(F.greatest(lowered, F.lit(discharge_floor))).alias("discharge_threshold"),
    )
