"""Schemas of tables that are read as they are, as DDL text."""

from __future__ import annotations

RESIDUE_RESULT_MONTHLY = (
    "mmsdm_month string, quarter string, tranche string, contract_id string, version_no int, "
    "interconnector_id string, from_region string, units_offered int, units_sold int, "
    "clearing_price double, reserve_price double"
)

NETWORK_CAPACITY = (
    "asset_code string, asset_name string, network string, state string, latitude double, longitude double, "
    "capacity double, load double, available_capacity double, year int"
)

NETWORK_DEFERRAL = (
    "asset_code string, asset_name string, network string, state string, latitude double, longitude double, "
    "annual_deferral_aud double, year int"
)

# Price columns of the ten ancillary services, raise then lower.
FCAS_SERVICES = [
    "fcas_reg_raise_aud_per_mw",
    "fcas_raise_1sec_aud_per_mw",
    "fcas_raise_6sec_aud_per_mw",
    "fcas_raise_60sec_aud_per_mw",
    "fcas_raise_5min_aud_per_mw",
    "fcas_reg_lower_aud_per_mw",
    "fcas_lower_1sec_aud_per_mw",
    "fcas_lower_6sec_aud_per_mw",
    "fcas_lower_60sec_aud_per_mw",
    "fcas_lower_5min_aud_per_mw",
]
