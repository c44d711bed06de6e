"""Resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from verimet.catalog.registry import R, R_list, longs, query, r, rounded
from verimet.operators import projections, resample, setops, verify
from verimet.operators.sequences import previous_value
from verimet.session import work_path
from verimet.sources import sinks, tables

_STEP = """
steps AS (SELECT *, CASE WHEN d <= 500 THEN greatest(d, 0) END AS precip_step FROM
  (SELECT *, precip_total - lag(precip_total) OVER (PARTITION BY station ORDER BY time_5M, event_id) AS d FROM gauge))"""


@query("gauge_steps", f"WITH {_STEP} SELECT event_id, station, time_5M, d AS diff, precip_step FROM steps", ("gauge",))
def gauge_steps(d):
    rows = resample.gauge_steps(d.gauge(), tie=["event_id"], difference="diff")
    return rows.select("event_id", "station", "time_5M", "diff", "precip_step")


@query("gauge_null_keys", """
WITH g AS (SELECT CASE WHEN user_id % 4 > 0 THEN user_id END AS station, CASE WHEN event_type <> 'error' THEN ts END AS t, event_id, value
           FROM events)
SELECT station, count(*) AS n, count(p) AS n_before, """ + R("sum(p)", 3) + """ AS before_sum
FROM (SELECT *, lag(value) OVER (PARTITION BY station ORDER BY t NULLS FIRST, event_id) AS p FROM g) GROUP BY 1""")
def gauge_null_keys(d):
    """The value before, also for rows without a station or a time."""
    rows = d.table("events").select(
        F.when(F.col("user_id") % 4 > 0, F.col("user_id")).alias("station"), F.when(F.col("event_type") != "error", F.col("ts")).alias("t"), "event_id", "value")
    out = previous_value(rows, ["station"], ["t", "event_id"], "value", F.to_date("t"), "p")
    return rounded(out.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("n_before"), F.sum("p").alias("before_sum")), "before_sum", digits=3)


@query("rs_precip_1h", f"""WITH {_STEP}
SELECT station, time_bucket(INTERVAL 1 HOUR, time_5M) AS valid_time, coalesce(sum(precip_step), 0) AS precip_total
FROM steps GROUP BY 1, 2""", ("gauge",))
def rs_precip_1h(d):
    return resample.precip_bins(d.gauge(), tie=["event_id"])


@query("rs_wind_1h", f"""
SELECT station, time_bucket(INTERVAL 1 HOUR, time_5M) AS valid_time, {R('avg(wspd_sonic)')} AS wspd_sonic_mean
FROM raw_obs GROUP BY 1, 2""", ("raw_obs",))
def rs_wind_1h(d):
    return rounded(resample.wind_bins(d.raw_obs()), "wspd_sonic_mean")


_TABLE = """WITH {step}
SELECT station, time_bucket(INTERVAL {h} HOUR, time_5M, TIMESTAMP '2024-01-01') AS valid_time,
       {tair} AS tair, {relh} AS relh, {wind} AS wspd_sonic,
       {mean} AS wspd_sonic_mean, coalesce(sum(precip_step), 0) AS precip_total
FROM steps GROUP BY 1, 2"""


def table_sql(h: int) -> str:
    on = f"minute(time_5M) = 0 AND hour(time_5M) % {h} = 0"

    def first(c: str) -> str:
        return R(f"(arg_min({{'v': {c}}}, (time_5M, event_id)) FILTER (WHERE {on})).v")

    return _TABLE.format(step=_STEP, h=h, tair=first("tair"), relh=first("relh"), wind=first("wspd_sonic"), mean=R("avg(wspd_sonic)"))


def _table(d, hours):
    t = resample.station_table(d.gauge(), hours, ["tair", "relh", "wspd_sonic"], tie=["event_id"])
    return rounded(t, "tair", "relh", "wspd_sonic", "wspd_sonic_mean")


@query("rs_table_1h", table_sql(1), ("gauge",))
def rs_table_1h(d):
    return _table(d, 1)


@query("rs_table_3h", table_sql(3), ("gauge",))
def rs_table_3h(d):
    return _table(d, 3)


@query("rs_right_label", f"""
WITH b AS (SELECT station, time_bucket(INTERVAL 3 HOUR, time_5M, TIMESTAMP '2024-01-01') + INTERVAL 3 HOUR AS valid_time, max(tair) AS tair
           FROM raw_obs GROUP BY 1, 2),
s AS (SELECT station, unnest(generate_series(min(valid_time), max(valid_time), INTERVAL 3 HOUR)) AS valid_time FROM b GROUP BY station)
SELECT s.station, s.valid_time, {R('b.tair')} AS tair FROM s LEFT JOIN b USING (station, valid_time)""", ("raw_obs",))
def rs_right_label(d):
    return rounded(resample.resample_right_label(d.raw_obs(), ["tair"], "max", 3), "tair")


AIRPORT_VALUES = ("tair", "wspd_sonic", "wspd_sonic_mean", "wmax_sonic", "precip_total")
AIR_SQL = """
metric AS (SELECT station, seen_at AS valid_time, event_id,
   CASE WHEN event_type <> 'click' THEN (value - 32.0) * 5.0 / 9.0 END AS tair,
   CASE WHEN event_type <> 'error' THEN value / 10 * 0.514444 END AS wspd_sonic,
   value / 5 * 0.514444 AS wmax_sonic,
   coalesce(CASE WHEN event_type <> 'view' THEN CAST(json_extract_string(props,'$.k') AS DOUBLE) / 100 END, 0) * 25.4 AS precip_total
  FROM reports),
b AS (SELECT station, CASE WHEN date_trunc('hour', valid_time) = valid_time THEN valid_time ELSE date_trunc('hour', valid_time) + INTERVAL 1 HOUR END AS vt,
   arg_max(tair, (valid_time, event_id)) FILTER (WHERE tair IS NOT NULL) AS tair,
   arg_max(wspd_sonic, (valid_time, event_id)) FILTER (WHERE wspd_sonic IS NOT NULL) AS wspd_sonic,
   avg(wspd_sonic) AS wspd_sonic_mean, max(wmax_sonic) AS wmax_sonic, sum(precip_total) AS precip_total
  FROM metric GROUP BY 1, 2),
s AS (SELECT station, unnest(generate_series(min(vt), max(vt), INTERVAL 1 HOUR)) AS vt FROM b GROUP BY station)"""


def airport_raw(d):
    kind = F.col("event_type")
    return d.reports().select(
        "station",
        F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("valid"),
        F.when(kind != "click", F.col("value").cast("string")).otherwise("M").alias("tmpf"),
        F.when(kind != "error", (F.col("value") / 10).cast("string")).alias("sknt"),
        (F.col("value") / 5).cast("string").alias("gust"),
        F.when(kind != "view", (F.get_json_object("props", "$.k").cast("double") / 100).cast("string")).otherwise("M").alias("p01i"),
        F.col("event_id").alias("_tie_event"),
    )


@query("rs_right_closed", f"""WITH {AIR_SQL}
SELECT s.station, s.vt AS valid_time, {R_list(*AIRPORT_VALUES)}
FROM s LEFT JOIN b USING (station, vt)""", ("reports",))
def rs_right_closed(d):
    hourly = resample.airport_hours(resample.airport_units(airport_raw(d)), ["_tie_event"])
    return rounded(hourly.select("station", "valid_time", *AIRPORT_VALUES), *AIRPORT_VALUES)


@query("airport_job", f"""WITH {AIR_SQL}
SELECT s.station, s.vt AS valid_time, st.lat, st.lon, st.elev,
       coalesce({R('tair')}, -999.0) AS tair, -999.0::DOUBLE AS ta9m, -999.0::DOUBLE AS td, coalesce({R('wspd_sonic')}, -999.0) AS wspd_sonic,
       coalesce({R('wspd_sonic_mean')}, -999.0) AS wspd_sonic_mean, coalesce({R('wmax_sonic')}, -999.0) AS wmax_sonic,
       coalesce({R('precip_total')}, 0.0) AS precip_total
FROM s LEFT JOIN b USING (station, vt) JOIN stations st ON st.station = s.station""", ("stations", "reports"))
def airport_job(d):
    table = resample.airport_table(airport_raw(d), d.stations(), ["_tie_event"])
    keep = ["lat", "lon", "elev", "tair", "ta9m", "td", "wspd_sonic", "wspd_sonic_mean", "wmax_sonic", "precip_total"]
    return rounded(table.select("station", "valid_time", *keep), *[c for c in keep if c not in ("lat", "lon", "elev", "ta9m", "td")])


@query("spine_1h", f"""
WITH s AS (SELECT station, unnest(generate_series(min(valid_time), max(valid_time), INTERVAL 1 HOUR)) AS valid_time FROM hourly GROUP BY station)
SELECT s.station, s.valid_time, {R('h.tair')} AS tair FROM s LEFT JOIN hourly h USING (station, valid_time)""", ("hourly",))
def spine_1h(d):
    return rounded(resample.on_spine(d.hourly().select("station", "valid_time", "tair")), "tair")


@query("availability_daily", f"""
SELECT station, CAST(valid_time AS DATE) AS date, {R('avg(CASE WHEN tair <> -999 THEN 1.0 ELSE 0.0 END)')} AS share FROM hourly GROUP BY 1, 2""",
       ("hourly",))
def availability_daily(d):
    return rounded(resample.availability(d.hourly()), "share")


@query("availability_median", f"""
WITH daily AS (SELECT station, CAST(valid_time AS DATE) AS date, avg(CASE WHEN tair <> -999 THEN 1.0 ELSE 0.0 END) AS share FROM hourly GROUP BY 1, 2),
per AS (SELECT station, quantile_cont(share, 0.5) AS m FROM daily GROUP BY 1)
SELECT count(*) AS stations, {R('quantile_cont(m, 0.5)')} AS median FROM per""", ("hourly",))
def availability_median(d):
    from verimet.operators.verify import availability_summary

    return rounded(availability_summary(resample.availability(d.hourly())), "median")


@query("availability_wide", f"""
SELECT date, string_agg(concat(station, ':', CAST(floor(share * 1e6 + 0.5) AS BIGINT)), ',' ORDER BY station) AS shares
FROM (SELECT station, CAST(valid_time AS DATE) AS date, {R('avg(CASE WHEN tair <> -999 THEN 1.0 ELSE 0.0 END)')} AS share FROM hourly GROUP BY 1, 2)
WHERE share IS NOT NULL GROUP BY 1""", ("hourly",))
def availability_wide(d):
    """Days x stations, every station of the table: one line a day, shares in millionths."""
    lines = verify.availability_lines(rounded(resample.availability(d.hourly()), "share"))
    cell = lambda s: F.concat_ws(":", s["station"], F.floor(s["share"] * 1e6 + 0.5).cast("string"))
    return lines.select("date", F.array_join(F.transform("shares", cell), ",").alias("shares"))


@query("upsert_keep_last", """
SELECT valid_time, stid, fh, metvar, model_output, row_key, price FROM (
  SELECT *, row_number() OVER (PARTITION BY valid_time, stid, fh, metvar ORDER BY side DESC, row_key DESC, price DESC) AS rn
  FROM (SELECT *, row_key % 2 AS side FROM predictions)) WHERE rn = 1""", ("predictions",))
def upsert_keep_last(d):
    rows = d.predictions().select("valid_time", "stid", "fh", "metvar", "model_output", "row_key", "price")
    old, new = rows.where(F.col("row_key") % 2 == 0), rows.where(F.col("row_key") % 2 == 1)
    return setops.upsert(old, new, ["valid_time", "stid", "fh", "metvar"], ["row_key", "price"])


@query("first_per_station", """
SELECT station, min(valid_time) AS valid_time, arg_min(n, valid_time) AS n FROM hourly GROUP BY station""", ("hourly",))
def first_per_station(d):
    return setops.first_per_key(d.hourly().select("station", "valid_time", "n"), ["station"], ["valid_time"])


@query("union_sources", """
SELECT station, valid_time, 'obs' AS source, NULL::BIGINT AS fh FROM hourly
UNION ALL SELECT station, valid_time, 'nwp' AS source, CAST(fh AS BIGINT) FROM forecasts""", ("hourly", "forecasts"))
def union_sources(d):
    return setops.union_all([
        d.hourly().select("station", "valid_time", F.lit("obs").alias("source")),
        d.forecasts().select("station", "valid_time", "fh", F.lit("nwp").alias("source")),
    ])


@query("obs_fill_drop", f"""
SELECT station, valid_time, coalesce({R('tair')}, -999.0) AS tair, {R('wspd_sonic_mean')} AS wspd_sonic_mean, n
FROM hourly WHERE wspd_sonic_mean IS NOT NULL""", ("hourly",))
def obs_fill_drop(d):
    from verimet.sources.tables import prepare_observations

    raw = d.hourly().select("station", F.col("valid_time").alias("time_1H"), r("tair").alias("tair"), r("wspd_sonic_mean").alias("wspd_sonic_mean"), "n")
    return prepare_observations(raw, {"tair": -999.0})


def _derived_sql() -> str:
    from verimet.catalog.scalars import _N
    from verimet.functions import thermo

    e = "(CASE WHEN relh > 0 THEN relh / 100 * 6.112 * exp(17.67 * tair / (tair + 243.5)) END)"
    h = "(elev + 1.5)"
    return f"""derived AS (SELECT *, 243.5 * ln({e}/6.112) / (17.67 - ln({e}/6.112)) AS td,
  (pow(pow(pres, {_N!r}) - {(thermo.P0_HPA ** _N * thermo.LAPSE_K_PER_M / thermo.T0_K)!r} * {h}, {1 / _N!r}) + 0.3)
   * exp({h} / ({thermo.GAS_DRY!r} * (tair + 273.15) / {thermo.GRAVITY!r})) AS mslp
  FROM (SELECT *, 980 + tair / 10 AS pres, CAST(CAST(substr(station, 2) AS BIGINT) % 10 AS DOUBLE) * 30 AS elev FROM steps))"""


def _refreshed(hours: int) -> str:
    on = f"minute(time_5M) = 0 AND hour(time_5M) % {hours} = 0"
    first = lambda c: R(f"(arg_min({{'v': {c}}}, (time_5M, event_id)) FILTER (WHERE {on})).v", 4)
    return f"""WITH {_STEP}, {_derived_sql()}
SELECT station, time_bucket(INTERVAL {hours} HOUR, time_5M, TIMESTAMP '2024-01-01') AS valid_time, {first('tair')} AS tair, {first('td')} AS td,
       {first('mslp')} AS mslp, {R('avg(wspd_sonic)', 4)} AS wspd_sonic_mean, coalesce(sum(precip_step), 0) AS precip_total
FROM derived GROUP BY 1, 2"""


def _refresh(d, hours: int):
    """Two overlapping deliveries of the raw rows end in the same table as one."""
    from verimet.plans import cleaning

    raw = d.gauge().withColumns({
        "pres": 980 + F.col("tair") / 10, "elev": (F.substring("station", 2, 20).cast("long") % 10).cast("double") * 30})
    path = work_path(d.spark, "observations")
    for delivery in (raw.where(F.col("station") < "S5"), raw):
        cleaning.refresh_observations(delivery, path, ["tair", "td", "mslp"], hours, ["event_id"])
    out = d.spark.read.parquet(path).select("station", "valid_time", "tair", "td", "mslp", "wspd_sonic_mean", "precip_total")
    return rounded(out, "tair", "td", "mslp", "wspd_sonic_mean", digits=4)


@query("obs_refresh_1h", _refreshed(1), ("gauge",))
def obs_refresh_1h(d):
    return _refresh(d, 1)


@query("obs_refresh_3h", _refreshed(3), ("gauge",))
def obs_refresh_3h(d):
    return _refresh(d, 3)


@query("obs_read_filled", f"""
SELECT station, valid_time, coalesce({R('tair')}, -999.0) AS tair, {R('wspd_sonic_mean')} AS wspd_sonic_mean, n FROM hourly
WHERE year(valid_time) = 2024""", ("hourly",))
def obs_read_filled(d):
    """Observations of a year through the reader, one column filled, incomplete rows dropped."""
    path = work_path(d.spark, "hourly")
    sinks.write_partitions(sinks.with_calendar(rounded(d.hourly(), "tair", "wspd_sonic_mean")), path, ["year", "month"])
    out = tables.read_observations(d.spark, path, [2024], {"tair": -999.0})
    return out.select("station", "valid_time", "tair", "wspd_sonic_mean", "n")


@query("obs_read_all_filled", f"""
SELECT station, valid_time, coalesce({R('tair')}, -5.0) AS tair, coalesce({R('wspd_sonic_mean')}, -5.0) AS wspd_sonic_mean FROM hourly""", ("hourly",))
def obs_read_all_filled(d):
    """Every missing number becomes the given value and no row is dropped."""
    path = work_path(d.spark, "hourly-all")
    sinks.write_partitions(sinks.with_calendar(rounded(d.hourly(), "tair", "wspd_sonic_mean")), path, ["year", "month"])
    return tables.read_observations(d.spark, path, fill_all=-5.0).select("station", "valid_time", "tair", "wspd_sonic_mean")


@query("unused_dropped", f"""SELECT event_id, station, {R('tair')} AS tair FROM raw_obs""", ("raw_obs",))
def unused_dropped(d):
    """Observation columns that no model uses are dropped by the fixed list."""
    raw = d.raw_obs().withColumns({"td": F.lit(1.0), "snow_depth": F.lit(0.0), "tair": r("tair")}).drop("time_5M", "elev")
    return projections.drop_columns(raw, projections.UNUSED_OBSERVATIONS)
