"""Wind and solar expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quarters import as_column, col_of

# Altitudes (m), neutral shear exponent and operating thresholds (m/s).
ALTITUDE_BANDS_M = [10, 50, 100, 150, 200, 250, 300, 350, 400, 450, 500]
SHEAR_ALPHA = 0.14
SPEED_THRESHOLDS_MS = [4, 6, 8, 10, 12]


def wind_speed(u, v) -> Column:
    u, v = col_of(u), col_of(v)
    return F.sqrt(u * u + v * v)


def power_law_speed(speed, reference_m: float, target_m, alpha: float = SHEAR_ALPHA) -> Column:
    return as_column(speed) * F.pow(as_column(target_m) / F.lit(float(reference_m)), F.lit(alpha))


def solar_profile(ts, inverter_kw: float) -> Column:
    """Clear-sky sinusoid between 06:00 and 19:00, derated to 85 % of the inverter, in MW."""
    ts = col_of(ts)
    hour = F.hour(ts) + F.minute(ts) / 60.0
    shape = F.greatest(F.lit(0.0), F.sin((hour - 6.0) / 13.0 * math.pi))
    return shape * (inverter_kw / 1000.0 * 0.85)
