"""Network-deferral expressions: states, sizing, contract economics, registration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quarters import as_column, col_of

# State names, and where each distribution network sits.
STATE_NAMES = {
    "NSW": "New South Wales",
    "VIC": "Victoria",
    "QLD": "Queensland",
    "SA": "South Australia",
    "WA": "Western Australia",
    "TAS": "Tasmania",
    "ACT": "Australian Capital Territory",
    "NT": "Northern Territory",
}
NETWORK_STATE = {
    "Ausgrid": "NSW",
    "Endeavour Energy": "NSW",
    "AusNet Services": "VIC",
    "CitiPower": "VIC",
    "Powercor": "VIC",
    "Evoenergy": "ACT",
    "SA Power Networks": "SA",
    "Ergon Energy": "QLD",
    "Energex": "QLD",
    "Western Power": "WA",
    "TasNetworks": "TAS",
}
NETWORK_REGION = {
    "Ausgrid": "NSW1",
    "Endeavour Energy": "NSW1",
    "AusNet Services": "VIC1",
    "CitiPower": "VIC1",
    "Powercor": "VIC1",
    "Evoenergy": "NSW1",
    "SA Power Networks": "SA1",
    "Ergon Energy": "QLD1",
    "Energex": "QLD1",
    "TasNetworks": "TAS1",
    "Essential Energy": "NSW1",
    "Jemena": "VIC1",
    "United Energy": "VIC1",
    "Western Power": "WEM",
}

# Registration thresholds (MW) and the rules that apply per category.
EXEMPT_UP_TO_MW = 5.0
SEMI_SCHEDULED_UP_TO_MW = 30.0
EXEMPT_RULES = ["Small generator exemption (<5MW)"]
SEMI_SCHEDULED_RULES = [
    "NER Chapter 4 - Semi-Scheduled Generator registration",
    "NER Chapter 5 - Generator Performance Standards (GPS)",
    "S5.2.5.3 - Frequency response requirements",
    "S5.2.5.4 - Voltage ride-through requirements",
    "S5.2.5.5 - Active power control / dispatch compliance",
    "S5.2.5.11 - Remote monitoring and control (SCADA/AGC)",
    "AEMO semi-dispatch instructions",
    "Causer-pays regulation charges",
]
SCHEDULED_RULES = [
    "NER Chapter 4 - Scheduled Generator registration",
    "NER Chapter 5 - Generator Performance Standards (GPS)",
    "Full central dispatch (5-min bidding)",
    "S5.2.5.3 - Frequency response requirements",
    "S5.2.5.4 - Voltage ride-through requirements",
    "S5.2.5.5 - Active power control / dispatch compliance",
    "S5.2.5.11 - Remote monitoring and control (SCADA/AGC)",
    "AEMO dispatch instructions (binding)",
    "Causer-pays regulation charges",
    "Market prudential requirements",
]


def lookup(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """Value of a fixed table, as a literal map."""
    entries = [F.lit(part) for pair in table.items() for part in pair]
    value = F.try_element_at(F.create_map(*entries), key)
    return value if default is None else F.coalesce(value, F.lit(default))


def normalise_state(state) -> Column:
    text = F.trim(col_of(state))
    by_name: dict[str, str] = {}
    for code, name in STATE_NAMES.items():
        by_name[name] = code
        if code in ("NSW", "VIC", "QLD", "SA", "WA", "TAS"):
            by_name[name.lower()] = code
    codes = F.upper(text)
    return (
        F.when(text.isNull() | (text == ""), F.lit(""))
        .when(codes.isin(*STATE_NAMES), codes)
        .otherwise(F.coalesce(lookup(text, by_name), F.substring(codes, 1, 3)))
    )


def network_state(network) -> Column:
    return lookup(col_of(network), NETWORK_STATE, "")


def network_region(network) -> Column:
    return lookup(col_of(network), NETWORK_REGION, "")


def contract_term(timing, current_year: int) -> Column:
    """Years until the investment, 1 to 15; 5 when the timing holds no year."""
    year = F.substring(col_of(timing).cast("string"), 1, 4).try_cast("int")
    return F.when(year.isNull(), F.lit(5)).otherwise(F.greatest(F.lit(1), F.least(year - current_year, F.lit(15))))


def deferral_value(published, cost) -> Column:
    published, cost = col_of(published), col_of(cost)
    return F.coalesce(F.when(published > 0, published).otherwise(cost * 0.08), F.lit(0.0))


def deficit_and_sizing(available_va, cost_m) -> Column:
    """Negative headroom (VA) as MW, with battery and solar sizes that would cover it."""
    available, cost = col_of(available_va), F.coalesce(col_of(cost_m), F.lit(0.0))
    deficit = F.when(available < 0, F.abs(available) / 1000000.0).otherwise(F.lit(0.0))
    estimate = F.round(F.greatest(cost * 3.0, F.lit(2.0)), 1)
    bess = (
        F.when(deficit > 0, F.round(F.greatest(deficit, F.lit(1.0)), 1)).when(cost > 0, estimate).otherwise(F.lit(5.0))
    )
    solar = (
        F.when(deficit > 0, F.round(deficit * 2.5, 1))
        .when(cost > 0, F.round(estimate * 2.0, 1))
        .otherwise(F.lit(10.0))
    )
    return F.struct(deficit.alias("deficit_mw"), bess.alias("ideal_bess_mw"), solar.alias("ideal_solar_mw"))


def contract_economics(annual_value, cost, bess_mw, term_years) -> Column:
    """Contract total, battery capital range, payback range and value per MW."""
    value, bess = col_of(annual_value), col_of(bess_mw)
    low, high = bess * 800000, bess * 1200000
    return F.struct(
        (value * col_of(term_years)).alias("contract_total_aud"),
        low.alias("capex_low_aud"),
        high.alias("capex_high_aud"),
        F.when(value > 0, F.try_divide(low, value)).alias("payback_low_years"),
        F.when(value > 0, F.try_divide(high, value)).alias("payback_high_years"),
        F.when((value > 0) & (bess > 0), F.try_divide(value, bess)).alias("value_per_mw"),
    )


def registration_category(
    capacity_mw,
    exempt_up_to: float = EXEMPT_UP_TO_MW,
    semi_scheduled_up_to: float = SEMI_SCHEDULED_UP_TO_MW,
    agc_enabled: bool = True,
    causer_pays_enabled: bool = True,
) -> Column:
    """Registration class of a generator with the duties that follow from it."""
    capacity = col_of(capacity_mw)
    exempt, semi = capacity <= exempt_up_to, capacity <= semi_scheduled_up_to

    def by_class(when_exempt, when_semi, when_scheduled) -> Column:
        return F.when(exempt, when_exempt).when(semi, when_semi).otherwise(when_scheduled)

    def rules(items: list[str]) -> Column:
        return F.array(*[F.lit(item) for item in items])

    return F.struct(
        (capacity > exempt_up_to).alias("requires_registration"),
        by_class("exempt", "semi-scheduled", "scheduled").alias("registration_category"),
        (~exempt).alias("gps_required"),
        (~exempt).alias("dispatch_compliance"),
        by_class(False, agc_enabled, True).alias("agc_interface"),
        by_class(False, causer_pays_enabled, True).alias("causer_pays"),
        by_class(rules(EXEMPT_RULES), rules(SEMI_SCHEDULED_RULES), rules(SCHEDULED_RULES)).alias("applicable_rules"),
    )


def demand_reduction_estimate(capex_m, deferral_m, wacc, depreciation) -> Column:
    """MW of demand reduction implied by a deferral pool; NULL without deferral or capital."""
    capex, deferral = col_of(capex_m), col_of(deferral_m)

    def or_default(value, default: float) -> Column:
        value = as_column(value)
        return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value)

    rate = or_default(wacc, 0.0262) + or_default(depreciation, 0.033)
    return F.when((deferral > 0) & (capex > 0), F.round(capex / (rate * 1000) * 10, 2))
