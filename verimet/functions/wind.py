"""Wind speed and direction from components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column) -> Column:
    """Direction the wind blows from, in (0, 360]; north is 360, calm is 0.

    Calm is tested first because ``atan2`` of signed zeros has no portable value.
    """
    degrees = F.lit(90.0) - F.degrees(F.atan2(-v, -u))
    wrapped = F.when(degrees <= 0, degrees + 360.0).otherwise(degrees)
    return (
        F.when(u.isNull() | v.isNull(), F.lit(None).cast("double"))
        .when((u == 0) & (v == 0), F.lit(0.0))
        .otherwise(wrapped)
    )
