"""Irregular observations to hourly tables.

Two bin conventions exist and are never mixed:

* station network data: bins closed and labelled on the left (13:00 -> 13:00);
* airport reports: bins closed and labelled on the right (13:05 -> 14:00).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verimet.functions.units import fahrenheit_to_celsius, inches_to_mm, inhg_to_hpa, knots_to_ms
from verimet.functions.values import clip_low, null_above, to_number, to_time
from verimet.operators.sequences import previous_value

MAX_GAUGE_STEP = 500.0

METHODS = {
    "mean": F.avg,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "max": F.max,
    "min": F.min,
    "std": F.stddev_samp,
    "count": F.count,
}


def day_chunk(ts: str) -> Column:
    return F.to_date(F.col(ts))


def gauge_steps(
    df: DataFrame, gauge: str = "precip_total", ts: str = "time_5M", tie: Sequence[str] = (), station: str = "station",
    out: str = "precip_step", difference: str | None = None,
) -> DataFrame:
    """Per-station increments of a cumulative gauge; spikes -> null, resets -> 0.  `difference` keeps the raw step."""
    stepped = previous_value(df, [station], [ts, *tie], gauge, day_chunk(ts), "_before")
    step = F.col(gauge) - F.col("_before")
    raw = {difference: step} if difference else {}
    return stepped.withColumns({out: clip_low(null_above(step, MAX_GAUGE_STEP)), **raw}).drop("_before")


def left_bin(ts: str, hours: int = 1) -> Column:
    return F.window(F.col(ts), f"{hours} hours")


def precip_bins(df: DataFrame, hours: int = 1, ts: str = "time_5M", tie: Sequence[str] = (), station: str = "station") -> DataFrame:
    """Sum of gauge increments per left-labelled bin; a bin of nulls sums to 0."""
    return (
        gauge_steps(df, ts=ts, tie=tie, station=station)
        .groupBy(station, left_bin(ts, hours).alias("_w"))
        .agg(METHODS["sum"]("precip_step").alias("precip_total"))
        .select(station, F.col("_w.start").alias("valid_time"), "precip_total")
    )


def wind_bins(df: DataFrame, hours: int = 1, ts: str = "time_5M", method: str = "mean", station: str = "station") -> DataFrame:
    """Wind statistic per left-labelled bin, named wspd_sonic_{method}."""
    name = f"wspd_sonic_{method}"
    return (
        df.groupBy(station, left_bin(ts, hours).alias("_w"))
        .agg(METHODS[method]("wspd_sonic").alias(name))
        .select(station, F.col("_w.start").alias("valid_time"), name)
    )


def resample_right_label(
    df: DataFrame, values: Sequence[str], method: str, hours: int = 1, ts: str = "time_5M", station: str = "station",
    fill_gaps: bool = True,
) -> DataFrame:
    """Left-closed bins labelled by their end; gap bins are emitted by default."""
    agg = METHODS[method]
    binned = (
        df.groupBy(station, left_bin(ts, hours).alias("_w"))
        .agg(*[agg(c).alias(c) for c in values])
        .select(station, F.col("_w.end").alias("valid_time"), *values)
    )
    if not fill_gaps:
        return binned
    dense = on_spine(binned, hours=hours, station=station)
    return dense.fillna(0.0, subset=list(values)) if method in ("sum", "count") else dense


def spine(df: DataFrame, hours: int = 1, ts: str = "valid_time", station: str = "station") -> DataFrame:
    """Every bin label between a station's first and last one."""
    return (
        df.groupBy(station)
        .agg(F.min(ts).alias("_a"), F.max(ts).alias("_z"))
        .select(station, F.explode(F.sequence("_a", "_z", F.make_dt_interval(F.lit(0), F.lit(hours)))).alias(ts))
    )


def on_spine(df: DataFrame, hours: int = 1, ts: str = "valid_time", station: str = "station") -> DataFrame:
    return spine(df, hours, ts, station).join(df, [station, ts], "left")


def station_table(
    df: DataFrame, hours: int = 1, sampled: Sequence[str] = (), ts: str = "time_5M", tie: Sequence[str] = (),
    station: str = "station",
) -> DataFrame:
    """The hourly (or 3-hourly) station table in one aggregate.

    precip: sum of increments; wind: mean plus top-of-hour sample; others:
    top-of-hour sample.  One grouping replaces the per-variable frames and
    their outer joins.
    """
    on_hour = (F.minute(ts) == 0) & (F.hour(ts) % hours == 0)
    order = F.when(on_hour, F.struct(ts, *tie))
    samples = [F.min_by(F.when(on_hour, F.struct(F.col(c).alias("v"))), order)["v"].alias(c) for c in sampled]
    return (
        gauge_steps(df, ts=ts, tie=tie, station=station)
        .groupBy(station, left_bin(ts, hours).alias("_w"))
        .agg(
            METHODS["sum"]("precip_step").alias("precip_total"),
            F.avg("wspd_sonic").alias("wspd_sonic_mean"),
            *samples,
        )
        .select(station, F.col("_w.start").alias("valid_time"), *sampled, "wspd_sonic_mean", "precip_total")
    )


# Fixed fill values of the hourly airport schema; None keeps null.
AIRPORT_DEFAULTS = {
    "lat": None,
    "lon": None,
    "elev": None,
    "tair": -999.0,
    "ta9m": -999.0,
    "td": -999.0,
    "relh": -999.0,
    "srad": -999.0,
    "pres": -999.0,
    "mslp": -999.0,
    "wspd_sonic": -999.0,
    "wspd_sonic_mean": -999.0,
    "wmax_sonic": -999.0,
    "wdir_sonic": -999.0,
    "precip_total": 0.0,
    "snow_depth": -999.0,
}

_AIRPORT_UNITS = {
    "tair": ("tmpf", fahrenheit_to_celsius),
    "td": ("dwpf", fahrenheit_to_celsius),
    "wspd_sonic": ("sknt", knots_to_ms),
    "wmax_sonic": ("gust", knots_to_ms),
    "pres": ("alti", inhg_to_hpa),
    "mslp": ("mslp", lambda c: c),
    "relh": ("relh", lambda c: c),
    "wdir_sonic": ("drct", lambda c: c),
}


def airport_units(raw: DataFrame, valid: str = "valid") -> DataFrame:
    """Text columns of an airport report to metric numbers; bad text -> null, bad time -> dropped."""
    out = [F.col("station"), to_time(F.col(valid)).alias("valid_time")]
    out += [conv(to_number(F.col(src))).alias(name) for name, (src, conv) in _AIRPORT_UNITS.items() if src in raw.columns]
    if "p01i" in raw.columns:
        out.append(inches_to_mm(F.coalesce(to_number(F.col("p01i")), F.lit(0.0))).alias("precip_total"))
    keep = [F.col(c) for c in raw.columns if c.startswith("_tie")]
    return raw.select(*out, *keep).where(F.col("valid_time").isNotNull())


def airport_hours(df: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """Right-closed, right-labelled hours: last non-null value, precip sum, wind mean, gust max.

    Hours without reports inside a station's span appear with nulls and 0 precip.
    """
    # One microsecond back turns (a, b] into [a, b) without touching the label b.
    shifted = df.withColumn("_t", F.col("valid_time") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit("0.000001").cast("decimal(18,6)")))
    order = F.struct("valid_time", *tie)
    last = [c for c in ("tair", "td", "relh", "pres", "mslp", "wspd_sonic", "wdir_sonic") if c in df.columns]
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in last]
    if "wspd_sonic" in df.columns:
        aggs.append(F.avg("wspd_sonic").alias("wspd_sonic_mean"))
    if "wmax_sonic" in df.columns:
        aggs.append(F.max("wmax_sonic").alias("wmax_sonic"))
    if "precip_total" in df.columns:
        aggs.append(F.sum("precip_total").alias("precip_total"))
    hourly = (
        shifted.groupBy("station", F.window("_t", "1 hour").alias("_w"))
        .agg(*aggs)
        .withColumn("valid_time", F.col("_w.end"))
        .drop("_w")
    )
    return on_spine(hourly)


def airport_table(raw: DataFrame, stations: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """Raw reports + station list -> hourly table in the station-network schema."""
    from verimet.operators.projections import complete_schema

    hourly = airport_hours(airport_units(raw), tie)
    placed = hourly.join(stations.select("station", "lat", "lon", "elev"), "station")
    full = complete_schema(placed, AIRPORT_DEFAULTS)
    return full.select("station", "valid_time", *AIRPORT_DEFAULTS)


def availability(df: DataFrame, value: str = "tair", ts: str = "valid_time", station: str = "station", sentinel: float = -999.0) -> DataFrame:
    """Share of non-missing hours per station and day (null counts as missing)."""
    present = F.coalesce(F.col(value) != sentinel, F.lit(False)).cast("double")
    return df.groupBy(station, F.to_date(ts).alias("date")).agg(F.avg(present).alias("share"))
