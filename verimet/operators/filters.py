"""Row filters.  All are plain predicates, so Catalyst pushes them to the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verimet.functions.clock import hours_interval
from verimet.functions.geo import Box


def in_box(df: DataFrame, box: Box, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Inside the box, both edges included."""
    absent = [c for c in (lat, lon) if c not in df.columns]
    if absent:
        raise KeyError(f"coordinate columns not found: {absent}")
    return df.where(
        F.col(lat).between(box.lat_min, box.lat_max) & F.col(lon).between(box.lon_min, box.lon_max)
    )


def between_dates(df: DataFrame, start, end, ts: str = "valid_time", strict: bool = True) -> DataFrame:
    """start < ts < end, or inclusive when `strict` is off."""
    low, high = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    t = F.col(ts)
    return df.where((t > low) & (t < high)) if strict else df.where(t.between(low, high))


def top_of_hour(df: DataFrame, every: int = 1, ts: str = "time_5M") -> DataFrame:
    """Rows with minute 0, at every `every`-th hour."""
    return df.where((F.minute(ts) == 0) & (F.hour(ts) % every == 0))


def error_within(df: DataFrame, error: Column, at_most: float | None = None, below: float | None = None,
                 above: float | None = None) -> DataFrame:
    """Gate on the absolute error."""
    size = F.abs(error)
    if at_most is not None:
        df = df.where(size <= at_most)
    if below is not None:
        df = df.where(size < below)
    if above is not None:
        df = df.where(size > above)
    return df


def nonzero(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) != 0)


def below_range(df: DataFrame, limit: float = 5000, column: str = "range") -> DataFrame:
    return df.where(F.col(column) <= limit)


def valid_at_lead(df: DataFrame, time: str = "time", valid_time: str = "valid_time", fh: str = "fh") -> DataFrame:
    """Keep rows whose valid time is exactly init + forecast hour."""
    return df.where(F.col(valid_time) == F.col(time) + hours_interval(F.col(fh)))


def land_only(df: DataFrame, mask: str = "lsm") -> DataFrame:
    return df.where(F.col(mask) == 1)


def exclude(df: DataFrame, ids: Sequence[str], column: str = "station") -> DataFrame:
    return df.where(~F.col(column).isin(*ids)) if ids else df


def members(df: DataFrame, ids: DataFrame, column: str = "station") -> DataFrame:
    """Rows whose key is in a table of ids."""
    return df.join(ids.select(column).distinct(), column, "left_semi")


def last_hours(df: DataFrame, back: int, ahead: int = 0, ts: str = "valid_time", now: Column | None = None) -> DataFrame:
    """Clip to [now - back h, now + ahead h].

    Without `now` it is the newest time minus `ahead` hours, read as a scalar
    subquery, so the frame is scanned once for a max and once with a range.
    """
    if now is None:
        now = df.select((F.max(ts) - F.make_dt_interval(F.lit(0), F.lit(ahead))).alias("now")).scalar()
    low = now - F.make_dt_interval(F.lit(0), F.lit(back))
    high = now + F.make_dt_interval(F.lit(0), F.lit(ahead))
    return df.where((F.col(ts) >= low) & (F.col(ts) <= high))


# Approximate (lat_min, lat_max, lon_min, lon_max) per US state.
STATE_BOXES = {
    "NY": (40.5, 45.0, -79.8, -71.8),
    "PA": (39.7, 42.3, -80.5, -74.7),
    "NJ": (38.9, 41.4, -75.6, -73.9),
    "CT": (41.0, 42.1, -73.7, -71.8),
    "MA": (41.2, 42.9, -73.5, -69.9),
    "VT": (42.7, 45.0, -73.4, -71.5),
    "NH": (42.7, 45.3, -72.6, -70.6),
    "ME": (43.1, 47.5, -71.1, -67.0),
    "RI": (41.1, 42.0, -71.9, -71.2),
    "OH": (38.4, 42.3, -84.8, -80.5),
    "MI": (41.7, 48.3, -90.4, -82.4),
    "WV": (37.2, 40.6, -82.6, -77.7),
    "MD": (37.9, 39.7, -79.5, -75.0),
    "DE": (38.4, 39.8, -75.8, -75.0),
    "VA": (36.5, 39.5, -83.7, -75.2),
}
DEFAULT_STATE = "NY"


def states_of_box(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column) -> Column:
    """Array of states whose box overlaps; the default state when none does."""
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    (lat_min <= b[1]) & (lat_max >= b[0]) & (lon_min <= b[3]) & (lon_max >= b[2]), F.lit(s)
                )
                for s, b in STATE_BOXES.items()
            ]
        )
    )
    return F.when(F.size(hits) == 0, F.array(F.lit(DEFAULT_STATE))).otherwise(hits)
