"""Unit conversions."""

from __future__ import annotations

from pyspark.sql import Column

# Fixed conversion values.
KELVIN_OFFSET = 273.15
MS_PER_KNOT = 0.514444
HPA_PER_INHG = 33.8639
MM_PER_INCH = 25.4


def kelvin_to_celsius(t: Column, offset: float = KELVIN_OFFSET) -> Column:
    return t - offset


def fahrenheit_to_celsius(t: Column) -> Column:
    return (t - 32.0) * 5.0 / 9.0


def knots_to_ms(v: Column) -> Column:
    return v * MS_PER_KNOT


def inhg_to_hpa(p: Column) -> Column:
    return p * HPA_PER_INHG


def inches_to_mm(x: Column) -> Column:
    return x * MM_PER_INCH


def percent_to_fraction(x: Column) -> Column:
    return x / 100.0
