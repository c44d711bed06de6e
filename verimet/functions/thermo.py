"""Moisture and pressure conversions from published formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bolton (1980) saturation vapour pressure.
BOLTON_E0 = 6.112
BOLTON_A = 17.67
BOLTON_B = 243.5
# Standard atmosphere used in the altimeter relation.
P0_HPA = 1013.25
T0_K = 288.0
LAPSE_K_PER_M = 0.0065
GAS_DRY = 287.04749097718457
GRAVITY = 9.80665
BAROMETER_HEIGHT_M = 1.5


def dewpoint(t_celsius: Column, rh_fraction: Column) -> Column:
    """Dew point (degC) from temperature (degC) and relative humidity (0..1)."""
    vapour = rh_fraction * F.exp(F.lit(BOLTON_A) * t_celsius / (t_celsius + BOLTON_B))
    # A non-positive humidity has no dew point.
    log_ratio = F.when(vapour > 0, F.ln(vapour))
    return F.lit(BOLTON_B) * log_ratio / (F.lit(BOLTON_A) - log_ratio)


def altimeter_to_sea_level_pressure(altimeter_hpa: Column, height_m: Column, t_celsius: Column) -> Column:
    """Altimeter setting -> station pressure -> sea-level pressure (hPa)."""
    n = GAS_DRY * LAPSE_K_PER_M / GRAVITY
    base = F.pow(altimeter_hpa, F.lit(n)) - F.lit(P0_HPA**n * LAPSE_K_PER_M / T0_K) * height_m
    station = F.pow(base, F.lit(1.0 / n)) + 0.3
    scale_height = F.lit(GAS_DRY) * (t_celsius + 273.15) / F.lit(GRAVITY)
    return station * F.exp(height_m / scale_height)
