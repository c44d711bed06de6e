"""Forecast cleaning, observation refresh and profiler jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verimet.functions.clock import lead_hours
from verimet.functions.geo import wrap_longitude
from verimet.functions.thermo import BAROMETER_HEIGHT_M, altimeter_to_sea_level_pressure, dewpoint
from verimet.functions.units import KELVIN_OFFSET, kelvin_to_celsius, percent_to_fraction
from verimet.functions.values import SENTINEL, fill_sentinel
from verimet.functions.wind import wind_direction, wind_speed
from verimet.operators.features import hourly_precip_from_run_total
from verimet.operators.filters import below_range, valid_at_lead
from verimet.operators.projections import complete_schema, drop_matching
from verimet.operators.resample import airport_table, station_table
from verimet.operators.setops import split_union
from verimet.operators.spatial import at_station_coordinates, interpolate_bilinear, on_land, values_at_nearest
from verimet.operators.windows import profile_images
from verimet.sources.sinks import upsert_partitions, with_calendar


def reformat(df: DataFrame) -> DataFrame:
    """Complete rows only; longitudes, units, wind and lead time as the models need them."""
    return (
        df.dropna()
        .withColumn("longitude", wrap_longitude(F.col("longitude")))
        .withColumns({c: kelvin_to_celsius(F.col(c)) for c in ("t2m", "d2m") if c in df.columns})
        .withColumns(
            {
                "u_total": wind_speed(F.col("u10"), F.col("v10")),
                "u_dir": wind_direction(F.col("u10"), F.col("v10")),
                "lead_time": lead_hours(F.col("time"), F.col("valid_time")),
            }
        )
    )


def stitch(df: DataFrame) -> DataFrame:
    """Rows whose valid time fits their run and forecast hour."""
    return valid_at_lead(df)


def forecasts_at_stations(
    grid: DataFrame, stations: DataFrame, mask: DataFrame | None = None, model: str = "HRRR", step: float = 0.1,
    interpolated: Sequence[str] = (), values: Sequence[str] = ("t2m",),
) -> DataFrame:
    """Raw grid rows of all runs and hours -> cleaned rows per station.

    HRRR stations sit on grid points; other models are interpolated for the
    listed stations and take the nearest point elsewhere.
    """
    clean = reformat(stitch(grid))
    if mask is not None:
        clean = on_land(clean, mask)
    if model.upper() == "HRRR":
        placed = at_station_coordinates(clean, stations)
    else:
        near = values_at_nearest(stations, clean).select("station", "time", "valid_time", "fh", *values)
        smooth = interpolate_bilinear(stations, clean, list(values), step, ["time", "valid_time", "fh"])
        placed = split_union(smooth, near, interpolated)
    if "tp" in placed.columns:
        placed = hourly_precip_from_run_total(placed, step=3 if model.upper() == "GFS" else 1)
    return placed.fillna(0.0)


# Fixed column order of staged station forecasts.
STAGED = ("t2m", "d2m", "sh2", "r2", "u10", "v10", "u_total", "u_dir", "tp", "mslma", "orog", "tcc", "cape", "dswrf",
          "dlwrf", "gh", "lsm")


def stage_at_nearest(grid: DataFrame, stations: DataFrame, keys: Sequence[str] = ("time", "fh")) -> DataFrame:
    """Grid rows at each station's nearest point, derived columns, full column list."""
    placed = values_at_nearest(stations, grid)
    units = placed.withColumns({c: kelvin_to_celsius(F.col(c)) for c in ("t2m", "d2m") if c in placed.columns})
    if {"u10", "v10"} <= set(units.columns):
        units = units.withColumns(
            {"u_total": wind_speed(F.col("u10"), F.col("v10")), "u_dir": wind_direction(F.col("u10"), F.col("v10"))}
        )
    full = complete_schema(units, {c: SENTINEL for c in STAGED})
    return full.select("station", *keys, "latitude", "longitude", *STAGED)


def with_derived(raw: DataFrame) -> DataFrame:
    """Dew point and sea-level pressure for raw station rows."""
    return raw.withColumns(
        {
            "td": dewpoint(F.col("tair"), percent_to_fraction(F.col("relh"))),
            "mslp": altimeter_to_sea_level_pressure(F.col("pres"), F.col("elev") + BAROMETER_HEIGHT_M, F.col("tair")),
        }
    )


def observation_tables(raw: DataFrame, sampled: Sequence[str], tie: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Hourly and 3-hourly tables of raw station rows."""
    derived = with_derived(raw)
    return station_table(derived, 1, sampled, tie=tie), station_table(derived, 3, sampled, tie=tie)


def refresh_observations(raw: DataFrame, path: str, sampled: Sequence[str], hours: int = 1, tie: Sequence[str] = ()) -> None:
    """Raw station rows -> derived columns -> hourly (or 3-hourly) table -> upsert by station and hour.

    The table lies in year and month folders; only the months of the new rows are rewritten.
    """
    table = observation_tables(raw, sampled, tie)[0 if hours == 1 else 1]
    keys = ["station", "valid_time", "year", "month"]
    upsert_partitions(with_calendar(table), path, keys, ["year", "month"], ["valid_time"])


def airport_observations(raw: DataFrame, stations: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    return airport_table(raw, stations, tie)


def profiler_rows(raw: DataFrame, limit: float = 5000, offset: float = KELVIN_OFFSET) -> DataFrame:
    """Profiler rows in degC and fractions up to `limit` metres, gaps as the sentinel."""
    temps = [c for c in ("temperature", "ir_temperature", "dewpoint") if c in raw.columns]
    df = below_range(raw, limit)
    df = df.withColumns({c: kelvin_to_celsius(F.col(c), offset) for c in temps})
    if "relative_humidity" in raw.columns:
        df = df.withColumn("relative_humidity", percent_to_fraction(F.col("relative_humidity")))
    df = drop_matching(df, "_qc", "surface").drop("v", "w", "u", "velocity", "direction", "cnr", "rws")
    return fill_sentinel(df)


def profiler_images(raw: DataFrame, channels: Sequence[str], limit: float = 5000) -> DataFrame:
    return profile_images(profiler_rows(raw, limit), channels)
