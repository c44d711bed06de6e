"""Streaming queries: each reads the events folder as a stream until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from verimet.catalog.inputs import as_reports
from verimet.catalog.observations import AIR_SQL, AIRPORT_VALUES, airport_raw, table_sql
from verimet.catalog.registry import R, R_list, query, rounded
from verimet.operators import resample
from verimet.session import stored, work_path
from verimet.sources import sinks
from verimet.streaming import increments, station_hours


def _stream(d):
    schema = d.table("events").schema
    raw = increments.read_stream(d.spark, d.folder, schema, "events.parquet")
    return as_reports(raw).select(
        "station", F.col("seen_at").alias("time_5M"), F.col("value").alias("tair"),
        F.when(F.col("event_type") != "error", F.col("value") / 10).alias("wspd_sonic"), "event_id",
    )


def _run(query):
    query.awaitTermination()


@query("stream_resample", f"""
SELECT station, time_bucket(INTERVAL 1 HOUR, time_5M) AS valid_time, {R('avg(wspd_sonic)')} AS wspd_sonic_mean, {R('avg(tair)')} AS tair, count(*) AS n
FROM raw_obs GROUP BY 1, 2
HAVING time_bucket(INTERVAL 1 HOUR, time_5M) + INTERVAL 1 HOUR <= (SELECT max(time_5M) - INTERVAL 2 HOUR FROM raw_obs)""", ("raw_obs",))
def stream_resample(d):
    path, mark = work_path(d.spark, "stream"), work_path(d.spark, "stream-mark")
    _run(increments.append_closed_bins(increments.hourly_wind(_stream(d)), path, mark))
    return rounded(d.spark.read.parquet(path), "wspd_sonic_mean", "tair")


@query("stream_upsert", """
SELECT station, time_5M, tair FROM (SELECT *, row_number() OVER (PARTITION BY station, time_5M ORDER BY event_id DESC) AS rn FROM raw_obs) WHERE rn = 1""",
       ("raw_obs",))
def stream_upsert(d):
    path, mark = work_path(d.spark, "stream-upsert"), work_path(d.spark, "stream-upsert-mark")
    _run(increments.append_batches(_stream(d), path, mark))
    return sinks.read_latest(d.spark, path, ["station", "time_5M"], ["event_id"]).select("station", "time_5M", "tair")


@query("stream_without_repeats", "SELECT event_id, station, time_5M FROM raw_obs", ("raw_obs",))
def stream_without_repeats(d):
    path, mark = work_path(d.spark, "stream-dedup"), work_path(d.spark, "stream-dedup-mark")
    twice = _stream(d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    _run(increments.append_closed_bins(increments.without_repeats(twice, ["event_id"], "time_5M"), path, mark))
    return d.spark.read.parquet(path).select("event_id", "station", "time_5M")


def _deliveries(rows, at: str, parts: int):
    """`rows` in `parts` deliveries: each row up to 90 minutes late, every fifth again in the next delivery."""
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), F.pmod(F.xxhash64("*"), F.lit(90)).cast("int"))
    come = stored(rows.withColumn("_come", F.unix_micros((F.col(at) + minutes).cast("timestamp"))), "deliveries")
    span = come.agg(F.min("_come").alias("a"), F.max("_come").alias("z")).first()
    if span.a is None:
        return
    width = (span.z - span.a) // parts + 1
    come = come.withColumn("_part", F.floor((F.col("_come") - span.a) / width))
    again = F.pmod(F.xxhash64("*"), F.lit(5)) == 0
    for k in range(parts + 1):
        yield come.where((F.col("_part") == k) | ((F.col("_part") == k - 1) & again)).drop("_come", "_part")


def _stream_in_parts(d, rows, at: str, transform, parts: int = 4):
    """The stored result of a stream that is stopped and started again after every delivery."""
    source, out, mark = (work_path(d.spark, f"stream-{n}") for n in ("source", "out", "mark"))
    for part in _deliveries(rows, at, parts):
        part.write.mode("append").parquet(source)
        _run(increments.append_closed_bins(transform(increments.read_stream(d.spark, source, rows.schema)), out, mark))
    return d.spark.read.parquet(out)


@query("stream_station_hours", f"""
SELECT * FROM ({table_sql(1)}) t WHERE valid_time + INTERVAL 1 HOUR <= (SELECT max(time_5M) - INTERVAL 2 HOUR FROM gauge)""", ("gauge",))
def stream_station_hours(d):
    """The hourly table from late, repeated and restarted deliveries: all bins that the watermark closed."""
    sampled = ["tair", "relh", "wspd_sonic"]
    out = _stream_in_parts(d, d.gauge(), "time_5M", lambda s: station_hours.station_hours(s, sampled))
    return rounded(out.select("station", "valid_time", *sampled, "wspd_sonic_mean", "precip_total"), *sampled, "wspd_sonic_mean")


@query("stream_airport_hours", f"""WITH {AIR_SQL},
c AS (SELECT * FROM b WHERE vt <= (SELECT max(valid_time) - INTERVAL 2 HOUR FROM metric)),
cs AS (SELECT station, unnest(generate_series(min(vt), max(vt), INTERVAL 1 HOUR)) AS vt FROM c GROUP BY station)
SELECT cs.station, cs.vt AS valid_time, {R_list(*AIRPORT_VALUES)} FROM cs LEFT JOIN c USING (station, vt)""", ("reports",))
def stream_airport_hours(d):
    """Right-closed airport hours of the same kind of stream, with the hours between reports."""
    reports = resample.airport_units(airport_raw(d))
    out = _stream_in_parts(d, reports, "valid_time", lambda s: station_hours.airport_hours(s, tie="_tie_event"))
    return rounded(resample.on_spine(out).select("station", "valid_time", *AIRPORT_VALUES), *AIRPORT_VALUES)
