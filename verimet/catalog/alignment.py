"""Forecast cleaning, alignment and feature frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from verimet.catalog.registry import R, R_list, longs, query, r, rounded
from verimet.operators import features, filters
from verimet.operators.setops import union_all
from verimet.operators.summarise import wide_by_lead
from verimet.plans import cleaning, training


@query("align_train", f"""
SELECT f.station, f.time, f.valid_time, CAST(f.fh AS BIGINT) AS fh, {R('t2m')} AS t2m, {R('tair')} AS tair, {R('t2m - tair')} AS target_error
FROM forecasts f JOIN hourly h USING (station, valid_time)""", ("forecasts", "hourly"))
def align_train(d):
    rows = features.align(d.forecasts(), d.hourly()).withColumn("target_error", features.forecast_error("t2m"))
    return rounded(rows.select("station", "time", "valid_time", "fh", "t2m", "tair", "target_error"), "t2m", "tair", "target_error")


@query("align_infer", f"""
SELECT f.station, f.time, f.valid_time, CAST(f.fh AS BIGINT) AS fh, {R('t2m')} AS t2m, {R('tair')} AS tair
FROM forecasts f LEFT JOIN hourly h USING (station, valid_time)
WHERE f.valid_time >= (SELECT max(valid_time) FROM forecasts) - INTERVAL 35 HOUR""", ("forecasts", "hourly"))
def align_infer(d):
    fc = d.forecasts()
    recent = filters.last_hours(fc, 29, 6)
    rows = features.align(recent, d.hourly(), "left")
    return rounded(rows.select("station", "time", "valid_time", "fh", "t2m", "tair"), "t2m", "tair")


@query("past_hours", """
SELECT station, valid_time, n FROM hourly WHERE valid_time IN (
  SELECT valid_time FROM forecasts WHERE valid_time >= (SELECT max(valid_time) FROM forecasts) - INTERVAL 29 HOUR)""", ("forecasts", "hourly"))
def past_hours(d):
    times = filters.last_hours(d.forecasts().select("valid_time"), 29)
    return filters.members(d.hourly(), times, "valid_time").select("station", "valid_time", "n")


@query("target_errors", f"""
SELECT station, valid_time, CAST(fh AS BIGINT) AS fh, metvar, {R('e')} AS target_error FROM (
  SELECT station, valid_time, time, fh, 't2m' AS metvar, t2m - tair AS e FROM forecasts JOIN hourly USING (station, valid_time)
  UNION ALL SELECT station, valid_time, time, fh, 'u_total', u_total - wspd_sonic_mean FROM forecasts JOIN hourly USING (station, valid_time)
  UNION ALL SELECT station, valid_time, time, fh, 'tp', tp - precip_total FROM forecasts JOIN hourly USING (station, valid_time))""",
       ("forecasts", "hourly"))
def target_errors(d):
    rows = features.align(d.forecasts(), d.hourly())
    return rounded(features.forecast_errors_long(rows, ["t2m", "u_total", "tp"], ["station", "valid_time", "fh"]), "target_error")


@query("geo_map", """
SELECT h.station, h.valid_time, g.lulc_cat, g.elev_cat, g.slope_cat FROM hourly h LEFT JOIN geo g USING (station)""", ("hourly", "geo"))
def geo_map(d):
    return features.map_categories(d.hourly().select("station", "valid_time"), d.geo())


@query("precip_interval", f"""
SELECT station, time, CAST(fh AS BIGINT) AS fh, {R('CASE WHEN fh <= 1 THEN tp ELSE greatest(tp - before, 0) END')} AS tp
FROM (SELECT *, CASE WHEN lag(fh) OVER run = fh - 1 THEN lag(tp) OVER run END AS before FROM forecasts WINDOW run AS (PARTITION BY station, time ORDER BY fh)) a""",
       ("forecasts",))
def precip_interval(d):
    return rounded(features.hourly_precip_from_run_total(d.forecasts()).select("station", "time", "fh", "tp"), "tp")


_REFORMAT = f"""SELECT latitude, longitude - 360 AS longitude, time, valid_time, CAST(fh AS BIGINT) AS fh, {R('t2m - 273.15')} AS t2m, {R('d2m - 273.15')} AS d2m,
  {R('sqrt(u10*u10 + v10*v10)')} AS u_total,
  {R('''CASE WHEN u10 = 0 AND v10 = 0 THEN 0.0 WHEN 90 - degrees(atan2(-v10, -u10)) <= 0 THEN 450 - degrees(atan2(-v10, -u10))
      ELSE 90 - degrees(atan2(-v10, -u10)) END''')} AS u_dir, date_diff('hour', time, valid_time) AS lead_time, tp
FROM grid WHERE t2m IS NOT NULL"""


@query("nwp_reformat", _REFORMAT, ("grid",))
def nwp_reformat(d):
    out = cleaning.reformat(d.grid())
    return rounded(out, "t2m", "d2m", "u_total", "u_dir").select(
        "latitude", "longitude", "time", "valid_time", "fh", "t2m", "d2m", "u_total", "u_dir", "lead_time", "tp")


@query("nwp_month_job", f"""
WITH clean AS (SELECT * FROM ({_REFORMAT}) WHERE lead_time = fh),
land AS (SELECT latitude, longitude - 360 AS longitude FROM mask WHERE lsm = 1),
placed AS (SELECT p.station, c.* FROM clean c JOIN land l USING (latitude, longitude)
           JOIN grid_places p ON c.latitude = p.lat AND c.longitude = p.lon)
SELECT a.station, a.time, a.valid_time, a.fh, a.t2m, a.u_total,
       {R('coalesce(CASE WHEN a.fh <= 1 THEN a.tp ELSE greatest(a.tp - b.tp, 0) END, 0)')} AS tp
FROM placed a LEFT JOIN placed b ON a.station = b.station AND a.time = b.time AND a.fh = b.fh + 1""", ("grid", "mask", "grid_places"))
def nwp_month_job(d):
    out = cleaning.forecasts_at_stations(d.grid(), d.grid_places(), d.mask())
    return rounded(out, "t2m", "u_total", "tp").select("station", "time", "valid_time", "fh", "t2m", "u_total", "tp")


@query("nwp_month_job_coarse", f"""
WITH clean AS (SELECT latitude, longitude - 360 AS longitude, time, valid_time, fh, d2m - 273.15 AS d2m, i, j FROM grid
               WHERE t2m IS NOT NULL AND date_diff('hour', time, valid_time) = fh),
cells AS (SELECT DISTINCT latitude, longitude FROM clean),
p AS (SELECT s.station, c.latitude, c.longitude,
        sqrt(pow(cos(radians(s.lat))*cos(radians(s.lon)) - cos(radians(c.latitude))*cos(radians(c.longitude)), 2)
           + pow(cos(radians(s.lat))*sin(radians(s.lon)) - cos(radians(c.latitude))*sin(radians(c.longitude)), 2)
           + pow(sin(radians(s.lat)) - sin(radians(c.latitude)), 2)) AS chord FROM stations s, cells c),
n AS (SELECT station, latitude, longitude FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY floor(chord*1e9), latitude, longitude) AS rn FROM p) WHERE rn = 1),
s AS (SELECT station, lat/0.25 AS fi, lon/0.25 AS fj, floor(lat/0.25 + 1e-9) AS i0, floor(lon/0.25 + 1e-9) AS j0 FROM stations),
c AS (SELECT station, i0 + a AS gi, j0 + b AS gj,
      (CASE WHEN a = 1 THEN greatest(fi - i0, 0) ELSE 1 - greatest(fi - i0, 0) END)
      * (CASE WHEN b = 1 THEN greatest(fj - j0, 0) ELSE 1 - greatest(fj - j0, 0) END) AS w
      FROM s, (VALUES (0,0),(0,1),(1,0),(1,1)) o(a, b)),
smooth AS (SELECT station, time, valid_time, fh, CASE WHEN count(d2m) = 4 THEN sum(w*d2m) END AS d2m
           FROM c JOIN clean g ON c.gi = floor(g.latitude/0.25 + 0.5) AND c.gj = floor(g.longitude/0.25 + 0.5) GROUP BY 1, 2, 3, 4)
SELECT station, time, valid_time, CAST(fh AS BIGINT) AS fh, {R('coalesce(d2m, 0)')} AS d2m FROM smooth WHERE station IN ('S1', 'S2', 'S3', 'S4')
UNION ALL
SELECT n.station, g.time, g.valid_time, CAST(g.fh AS BIGINT), {R('coalesce(g.d2m, 0)')} FROM n JOIN clean g USING (latitude, longitude)
WHERE n.station NOT IN ('S1', 'S2', 'S3', 'S4')""", ("grid", "stations"))
def nwp_month_job_coarse(d):
    out = cleaning.forecasts_at_stations(
        d.grid(), d.stations(), None, "NAM", 0.25, ["S1", "S2", "S3", "S4"], ["d2m"])
    return rounded(out.select("station", "time", "valid_time", "fh", "d2m"), "d2m")


@query("stage_nearest", f"""
WITH cells AS (SELECT DISTINCT latitude, longitude - 360 AS longitude FROM grid),
p AS (SELECT s.station, c.latitude, c.longitude,
        sqrt(pow(cos(radians(s.lat))*cos(radians(s.lon)) - cos(radians(c.latitude))*cos(radians(c.longitude)), 2)
           + pow(cos(radians(s.lat))*sin(radians(s.lon)) - cos(radians(c.latitude))*sin(radians(c.longitude)), 2)
           + pow(sin(radians(s.lat)) - sin(radians(c.latitude)), 2)) AS chord FROM stations s, cells c),
n AS (SELECT station, latitude, longitude FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY floor(chord*1e9), latitude, longitude) AS rn FROM p) WHERE rn = 1)
SELECT n.station, g.time, CAST(g.fh AS BIGINT) AS fh, coalesce({R('g.t2m - 273.15')}, -999) AS t2m, {R('sqrt(u10*u10+v10*v10)')} AS u_total,
       -999.0::DOUBLE AS cape
FROM n JOIN grid g ON g.latitude = n.latitude AND g.longitude - 360 = n.longitude""", ("grid", "stations"))
def stage_nearest(d):
    grid = d.grid().withColumn("longitude", F.col("longitude") - 360)
    out = cleaning.stage_at_nearest(grid, d.stations())
    return rounded(out, "t2m", "u_total").select("station", "time", "fh", "t2m", "u_total", "cape")


_FV, _OV, _GV = ["t2m", "u_total"], ["tair", "wspd_sonic_mean"], ["lulc_cat"]


def _slots(columns, table="x"):
    return ", ".join(f"max(CASE WHEN slot = {s} THEN {c} END) AS {c}_{s}" for c in columns for s in range(4))


_LONG = """long AS (SELECT f.station, f.fh, f.valid_time, f.t2m, f.u_total, f.tp, h.tair, h.wspd_sonic_mean, h.precip_total, h.n AS seen, g.lulc_cat
  FROM (SELECT * FROM forecasts) f {how} JOIN {obs} h ON f.station = h.station AND f.valid_time = h.valid_time LEFT JOIN geo g ON g.station = f.station)"""
_WIDE = f"""wide AS (SELECT c.target, CAST(fh AS BIGINT) AS fh, valid_time, {_slots(_FV + _GV + _OV)}, count(seen) AS seen
  FROM long JOIN clusters c ON c.station = long.station GROUP BY 1, 2, 3 HAVING count(*) = 4)"""
FRAME_SQL = f"WITH {_LONG.format(how='', obs='hourly')}, {_WIDE}"
_CYCLE = f"""{R('sin(2*pi()*dayofyear(valid_time)/366.0)')} AS valid_time_sin, {R('cos(2*pi()*dayofyear(valid_time)/366.0)')} AS valid_time_cos,
 {R('sin(2*pi()*hour(valid_time)/24.0)')} AS valid_time_sin_clock, {R('cos(2*pi()*hour(valid_time)/24.0)')} AS valid_time_cos_clock"""


def cluster_frame(d):
    return training.training_frame(d.hourly(), d.forecasts(), d.clusters(), "t2m", _FV, _OV, d.geo(), _GV, parts=d.buckets(8))


_FLOATS = [f"{c}_{s}" for c in _FV + _OV for s in range(4)]


@query("training_frame", f"""{FRAME_SQL}
SELECT target, fh, valid_time, {R_list(*_FLOATS)}, {', '.join(f'lulc_cat_{s}' for s in range(4))}, {R('t2m_0 - tair_0')} AS target_error, {_CYCLE} FROM wide""",
       ("forecasts", "hourly", "geo", "clusters"))
def training_frame(d):
    return rounded(cluster_frame(d), *_FLOATS, "target_error", "valid_time_sin", "valid_time_cos", "valid_time_sin_clock", "valid_time_cos_clock")


@query("evaluation_frame", f"""{FRAME_SQL}
SELECT target, fh, valid_time, {R('t2m_0')} AS t2m_0, {R('tair_3')} AS tair_3, {R('u_total_0 - wspd_sonic_mean_0')} AS target_error FROM wide""",
       ("forecasts", "hourly", "geo", "clusters"))
def evaluation_frame(d):
    out = training.training_frame(d.hourly(), d.forecasts(), d.clusters(), "u_total", _FV, _OV, d.geo(), _GV, encode=False, parts=d.buckets(8))
    return rounded(out.select("target", "fh", "valid_time", "t2m_0", "tair_3", "target_error"), "t2m_0", "tair_3", "target_error")


_NOW = "(SELECT max(valid_time) - INTERVAL 6 HOUR FROM forecasts)"


@query("inference_frame", f"""
WITH seenobs AS (SELECT * FROM hourly WHERE valid_time >= {_NOW} - INTERVAL 29 HOUR AND valid_time <= {_NOW}),
{_LONG.format(how='LEFT', obs='seenobs').replace('(SELECT * FROM forecasts)', f"(SELECT * FROM forecasts WHERE valid_time >= {_NOW} - INTERVAL 29 HOUR AND valid_time <= {_NOW} + to_hours(CAST(fh AS INT)))")},
{_WIDE}
SELECT target, fh, valid_time, {R('t2m_0')} AS t2m_0, {R('t2m_3')} AS t2m_3, CASE WHEN seen = 4 THEN {R('tair_0')} END AS tair_0,
       CASE WHEN seen = 4 THEN {R('wspd_sonic_mean_3')} END AS wspd_sonic_mean_3, CASE WHEN seen = 4 THEN {R('t2m_0 - tair_0')} END AS target_error
FROM wide""", ("forecasts", "hourly", "geo", "clusters"))
def inference_frame(d):
    out = training.inference_frame(
        d.hourly(), d.forecasts(), d.clusters(), "t2m", _FV, _OV, max_fh=6, geo=d.geo(), geo_values=_GV, parts=d.buckets(8))
    keep = ["t2m_0", "t2m_3", "tair_0", "wspd_sonic_mean_3", "target_error"]
    return rounded(out.select("target", "fh", "valid_time", *keep), *keep)


@query("image_frame", f"""{FRAME_SQL},
paths AS (SELECT w.target, w.fh, w.valid_time, c.slot, concat_ws('/', '/img', strftime(valid_time, '%Y'), c.station,
          c.station || '_' || strftime(valid_time, '%Y') || '_' || strftime(valid_time, '%m%d%H') || '.npy') AS path, c.station
          FROM wide w JOIN clusters c USING (target)),
have AS (SELECT DISTINCT station, valid_time FROM hourly WHERE n >= 2)
SELECT target, fh, valid_time, {", ".join(f"max(CASE WHEN slot = {k} THEN path END) AS image_path_{k}" for k in range(4))}
FROM paths LEFT JOIN (SELECT *, 1 AS ok FROM have) h USING (station, valid_time) GROUP BY 1, 2, 3 HAVING count(ok) = 4""",
       ("forecasts", "hourly", "geo", "clusters"))
def image_frame(d):
    catalog = d.hourly().where(F.col("n") >= 2)
    out = training.with_images(cluster_frame(d), d.clusters(), "/img", catalog)
    return out.select("target", "fh", "valid_time", *[f"image_path_{k}" for k in range(4)])


@query("wide_by_lead", """
SELECT valid_time, stid, metvar, """ + ", ".join(f"coalesce(max(CASE WHEN fh = {i} THEN {R('difference')} END), -999) AS diff_{i}" for i in range(1, 8)) + """
FROM evaluated GROUP BY 1, 2, 3""", ("evaluated",))
def wide_leads(d):
    rows = rounded(d.evaluated(), "difference")
    return wide_by_lead(rows, range(1, 8), ["valid_time", "stid", "metvar"])


@query("join_conditions", f"""
SELECT e.stid, e.valid_time, CAST(e.fh AS BIGINT) AS fh, {R('e.difference')} AS difference, e.n
FROM (SELECT station AS stid, valid_time, fh, t2m - tair AS difference, n FROM forecasts LEFT JOIN hourly USING (station, valid_time)) e""",
       ("forecasts", "hourly"))
def join_conditions(d):
    rows = features.align(d.forecasts(), d.hourly(), "left")
    return rows.select(F.col("station").alias("stid"), "valid_time", "fh", r(features.forecast_error("t2m")).alias("difference"), "n")


@query("sources_stacked", """
SELECT station, valid_time, 0::BIGINT AS fh FROM hourly UNION ALL SELECT station, valid_time, CAST(fh AS BIGINT) FROM forecasts""",
       ("hourly", "forecasts"))
def sources_stacked(d):
    return union_all([d.hourly().select("station", "valid_time"), d.forecasts().select("station", "valid_time", "fh")]).fillna(0, ["fh"])
