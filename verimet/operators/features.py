"""From long forecasts and observations to one wide row per target and hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verimet.functions.clock import day_cycle, year_cycle
from verimet.functions.values import clip_low
from verimet.operators.setops import hash_join, union_all

# Fixed mapping: forecast variable -> observed variable.
OBSERVED_FOR = {
    "t2m": "tair",
    "mslma": "pres",
    "tp": "precip_total",
    "u_total": "wspd_sonic_mean",
}
GEO_COLUMNS = ("lulc_cat", "elev_cat", "slope_cat")


def observed_name(metvar: str) -> str:
    try:
        return OBSERVED_FOR[metvar]
    except KeyError:
        raise KeyError(f"no observed counterpart for {metvar!r}; known: {sorted(OBSERVED_FOR)}") from None


def forecast_error(metvar: str, suffix: str = "") -> Column:
    """NWP minus observation for one variable."""
    return F.col(metvar + suffix) - F.col(observed_name(metvar) + suffix)


def forecast_errors_long(df: DataFrame, metvars: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per key and variable: (keys, metvar, target_error)."""
    parts = F.array(*[F.struct(F.lit(m).alias("metvar"), forecast_error(m).alias("target_error")) for m in metvars])
    return df.select(*keys, F.explode(parts).alias("_e")).select(*keys, "_e.metvar", "_e.target_error")


def forecast_errors(df: DataFrame, metvars: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """`forecast_errors_long` before it is made long: one row per key with `error_{metvar}` of every variable."""
    return df.select(*keys, *[forecast_error(m).alias(f"error_{m}") for m in metvars])


def align(
    forecast: DataFrame, observed: DataFrame, how: str = "inner", keys: Sequence[str] = ("station", "valid_time"),
    parts: int | None = None,
) -> DataFrame:
    """Forecast rows with the observation of the same station and hour.

    'inner' for training; 'left' for inference, where future hours have none.  `parts` is that of `hash_join`.
    """
    return hash_join(forecast, observed, keys, how, parts)


def map_categories(df: DataFrame, geo: DataFrame, columns: Sequence[str] = GEO_COLUMNS) -> DataFrame:
    """Static station categories by station; unknown stations get null.

    The table grows with the station list, so the planner broadcasts it only below its
    byte threshold.
    """
    return df.join(geo.select("station", *columns), "station", "left")


def cluster_members(clusters: DataFrame) -> DataFrame:
    """(target, slot, station) rows of the cluster table."""
    return clusters.select(F.col("station").alias("target"), F.posexplode("closest_stations").alias("slot", "station"))


def closest_of(stations: DataFrame, clusters: DataFrame) -> DataFrame:
    """Neighbour list per station, empty when the station has none."""
    return stations.select("station").join(clusters, "station", "left").withColumn(
        "closest_stations", F.coalesce("closest_stations", F.array().cast("array<string>"))
    )


def cluster_rows(
    df: DataFrame, clusters: DataFrame, values: Sequence[str], time_keys: Sequence[str] = ("fh", "valid_time"),
    size: int = 4, optional: Sequence[str] = (), parts: int | None = None,
) -> DataFrame:
    """One row per (target, time): `{value}_{slot}` for every member of the cluster.

    All `size` members must be present.  `optional` values (observations at
    inference) come as a block: kept only when every member has one at that
    time, else null for all.  Slots are fixed, so no pivot discovery job runs.

    The long rows are dealt by time once, before each becomes up to `size` member rows; with a
    cluster table that the planner broadcasts, the grouping by (target, time) accepts
    that, so N rows travel instead of `size` times N.  The tasks are few then, and a time with very many stations is one
    task's; for large tables give `parts`: the member rows are dealt by target and last time key to as many tasks.
    """
    members = cluster_members(clusters)
    needed = ["station", *time_keys, *values, *optional, *(["_observed"] if optional else [])]
    rows = df.select(*needed)
    if parts is None:
        joined = rows.repartition(*time_keys).join(members, "station").drop("station")
    else:
        joined = rows.join(members, "station").drop("station").repartition(parts, "target", time_keys[-1])
    slot = F.col("slot")
    everything = [*values, *optional]
    aggs = [F.max(F.when(slot == s, F.col(v))).alias(f"{v}_{s}") for s in range(size) for v in everything]
    aggs.append(F.count(F.lit(1)).alias("_members"))
    if optional:
        aggs.append(F.count(F.when(F.col("_observed"), 1)).alias("_seen"))
    wide = joined.groupBy("target", *time_keys).agg(*aggs).where(F.col("_members") == size)
    if optional:
        whole = F.col("_seen") == size
        wide = wide.withColumns({f"{v}_{s}": F.when(whole, F.col(f"{v}_{s}")) for s in range(size) for v in optional})
    return wide.drop("_members", "_seen")


def encode_time(df: DataFrame, ts: str = "valid_time", period: int = 366) -> DataFrame:
    """Four cyclic columns: day of year and second of day."""
    ysin, ycos = year_cycle(F.col(ts), period)
    dsin, dcos = day_cycle(F.col(ts))
    return df.withColumns(
        {f"{ts}_sin": ysin, f"{ts}_cos": ycos, f"{ts}_sin_clock": dsin, f"{ts}_cos_clock": dcos}
    )


def hourly_precip_from_run_total(df: DataFrame, step: int = 1, first_fh: int = 1) -> DataFrame:
    """Replace run-total `tp` by the amount since `fh - step` of the same run.

    The first forecast hour keeps its total; a missing predecessor gives null;
    negative differences become 0.  One run of one station has at most a few
    dozen forecast hours, so a window over it is small; the range frame of
    exactly `step` hours back needs no self-join.
    """
    run = Window.partitionBy("station", "time").orderBy("fh").rangeBetween(-step, -step)
    diff = clip_low(F.col("tp") - F.max("tp").over(run))
    return df.withColumn("tp", F.when(F.col("fh") <= first_fh, F.col("tp")).otherwise(diff))


def merge_grids(frames: dict[str, DataFrame], keys: Sequence[str] = ("latitude", "longitude")) -> DataFrame:
    """Full-outer merge of one-variable grids, one row per position.

    Stacked and grouped once instead of a chain of outer joins; the smallest
    value wins when a frame repeats a position, whatever the order of rows.
    """
    names = list(frames)
    stacked = union_all([f.select(*keys, n) for n, f in frames.items()])
    return stacked.groupBy(*keys).agg(*[F.min(n).alias(n) for n in names])
