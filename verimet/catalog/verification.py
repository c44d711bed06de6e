"""Verification and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from verimet.catalog.registry import R, R_list, longs, query, r, rounded
from verimet.operators import features, summarise, verify
from verimet.plans import reports, training

_DIFF = "(SELECT *, model_output - actual AS difference FROM predictions)"


def _scores(d):
    return verify.station_scores(d.predictions())


@query("verify_station_fh", f"""
SELECT station, CAST(fh AS BIGINT) AS fh, {R('avg(abs(t2m - tair))')} AS mae, {R('sqrt(avg(pow(t2m - tair, 2)))')} AS rmse,
       {R('avg(t2m - tair)')} AS bias, count(*) AS n
FROM forecasts JOIN hourly USING (station, valid_time) WHERE tair IS NOT NULL GROUP BY 1, 2""", ("forecasts", "hourly"))
def verify_station_fh(d):
    rows = features.align(d.forecasts(), d.hourly())
    scored = verify.station_scores(rows.withColumns({"model_output": F.col("t2m"), "actual": F.col("tair")}), ["station", "fh"])
    return rounded(scored, "mae", "rmse", "bias")


_SCORES = f"""
SELECT stid, CAST(fh AS BIGINT) AS fh, metvar, avg(abs(model_output - actual)) AS mae, sqrt(avg(pow(model_output - actual, 2))) AS rmse,
       avg(model_output - actual) AS bias, count(*) AS n FROM predictions GROUP BY 1, 2, 3"""


@query("station_scores", f"SELECT stid, fh, metvar, {R_list('mae', 'rmse', 'bias')}, n FROM ({_SCORES})", ("predictions",))
def station_scores(d):
    return rounded(_scores(d), "mae", "rmse", "bias")


@query("mean_scores", f"SELECT fh, metvar, {R('avg(mae)')} AS mae, {R('avg(rmse)')} AS rmse, {R('avg(bias)')} AS bias FROM ({_SCORES}) GROUP BY 1, 2",
       ("predictions",))
def mean_scores(d):
    return rounded(verify.mean_scores(_scores(d)), "mae", "rmse", "bias")


@query("top30_worst", f"SELECT stid, fh, metvar, {R('mae')} AS mae, n FROM ({_SCORES}) ORDER BY {R('mae')} DESC, stid, fh, metvar LIMIT 30", ("predictions",))
def top30_worst(d):
    return verify.worst(rounded(_scores(d), "mae")).select("stid", "fh", "metvar", "mae", "n")


@query("eval_rows", f"""
SELECT valid_time, stid, CAST(fh AS BIGINT) AS fh, metvar, {R('model_output')} AS model_output, {R('actual')} AS actual, {R('model_output - actual')} AS difference
FROM evaluated WHERE actual <> 0""", ("evaluated",))
def eval_rows(d):
    ev = d.evaluated()
    out = verify.evaluation_rows(ev.select(*verify.KEYS, "model_output"), ev.where(F.col("actual") != 0).select(*verify.KEYS, "actual"))
    return rounded(out, "model_output", "actual", "difference")


@query("eval_rows_left", f"""
SELECT valid_time, stid, CAST(fh AS BIGINT) AS fh, metvar, {R('model_output')} AS model_output, CASE WHEN fh > 2 THEN {R('actual')} END AS actual
FROM evaluated""", ("evaluated",))
def eval_rows_left(d):
    ev = d.evaluated()
    out = verify.evaluation_rows(ev, ev.where(F.col("fh") > 2), "left")
    return rounded(out.drop("difference"), "model_output", "actual")


@query("verification_run", f"""
SELECT f.valid_time, f.station AS stid, CAST(f.fh AS BIGINT) AS fh, m.metvar, {R('f.t2m / 4')} AS model_output,
       {R("CASE m.metvar WHEN 't2m' THEN f.t2m - h.tair WHEN 'u_total' THEN f.u_total - h.wspd_sonic_mean ELSE f.tp - h.precip_total END")} AS actual,
       {R("f.t2m / 4 - CASE m.metvar WHEN 't2m' THEN f.t2m - h.tair WHEN 'u_total' THEN f.u_total - h.wspd_sonic_mean ELSE f.tp - h.precip_total END")} AS difference
FROM forecasts f JOIN hourly h USING (station, valid_time), (VALUES ('t2m'), ('u_total'), ('tp')) m(metvar)
WHERE NOT (m.metvar = 't2m' AND h.tair IS NULL)""", ("forecasts", "hourly"))
def verification_run(d):
    fc = d.forecasts()
    names = F.explode(F.array(*[F.lit(m) for m in ("t2m", "u_total", "tp")]))
    preds = fc.select("valid_time", F.col("station").alias("stid"), "fh", names.alias("metvar"), (F.col("t2m") / 4).alias("model_output"))
    return rounded(training.verify(preds, fc, d.hourly(), ["t2m", "u_total", "tp"], d.buckets(8)), "model_output", "actual", "difference")


@query("mae_mse_division", f"""
SELECT climate_division_name, stid AS station, CAST(fh AS BIGINT) AS fh, {R('avg(abs(model_output - actual))')} AS mae, {R('avg(pow(model_output - actual, 2))')} AS mse
FROM predictions JOIN stations s ON s.station = stid WHERE actual <> 0 AND abs(model_output - actual) <= 200 GROUP BY 1, 2, 3
ORDER BY station, fh""", ("predictions", "stations"))
def mae_mse_division(d):
    return rounded(verify.division_scores(d.predictions(), d.stations()), "mae", "mse").orderBy("station", "fh")


_CONFUSION = """SELECT metvar, count(*) FILTER (WHERE t > 0 AND p > 0) AS hit, count(*) FILTER (WHERE t > 0 AND p < 0) AS miss,
 count(*) FILTER (WHERE t < 0 AND p > 0) AS false_alarm, count(*) FILTER (WHERE t < 0 AND p < 0) AS correct_negative
FROM (SELECT metvar, model_output AS t, actual AS p FROM predictions WHERE valid_time >= TIMESTAMP '1996-01-01'
      AND abs(round(model_output - actual, 6)) > 1 AND abs(round(model_output - actual, 6)) <= 200) GROUP BY 1"""


@query("confusion_sign", f"""
SELECT *, {R('hit * 100.0 / (hit + miss)')} AS hit_pct, {R('miss * 100.0 / (hit + miss)')} AS miss_pct,
       {R('false_alarm * 100.0 / (false_alarm + correct_negative)')} AS false_alarm_pct,
       {R('correct_negative * 100.0 / (false_alarm + correct_negative)')} AS correct_negative_pct FROM ({_CONFUSION})""", ("predictions",))
def confusion_sign(d):
    rows = d.predictions().withColumns({"target": F.col("model_output"), "prediction": F.col("actual")})
    return rounded(verify.sign_confusion(rows, ["metvar"], "1996-01-01"), "hit_pct", "miss_pct", "false_alarm_pct", "correct_negative_pct")


@query("hour_metvar_table", "SELECT metvar, " + ", ".join(
    f"{R(f'avg(CASE WHEN hour(valid_time) = {h} THEN abs(model_output - actual) END)')} AS h{h:02d}" for h in range(24)) + " FROM predictions GROUP BY 1",
       ("predictions",))
def hour_metvar_table(d):
    return rounded(verify.hour_metvar_table(d.predictions()), *[f"h{h:02d}" for h in range(24)])


def _macro(period: str, statistic: str) -> str:
    inner = {"mean": "avg(difference)", "abs": "avg(abs(difference))", "std": "stddev_samp(difference)"}[statistic]
    return f"""SELECT {period}, {R('avg(s)')} AS error FROM (
 SELECT CAST({period}(valid_time) AS BIGINT) AS {period}, fh, {inner} AS s FROM {_DIFF} WHERE abs(difference) < 100 GROUP BY 1, 2) GROUP BY 1"""


def _register_macro(name, period, statistic):
    @query(name, _macro(period, statistic), ("predictions",))
    def run(d):
        return rounded(summarise.error_by_period(d.compared(), period, statistic, limit=100.0), "error")


for _name, _period, _stat in (
    ("month_bias", "month", "mean"), ("month_std", "month", "std"), ("month_mae", "month", "abs"),
    ("hour_mae", "hour", "abs"), ("hour_bias", "hour", "mean"), ("hour_std", "hour", "std"),
):
    _register_macro(_name, _period, _stat)


@query("month_labels", f"""
SELECT m.month, error, monthname(make_date(2024, m.month::INT, 1)) AS label FROM ({_macro('month', 'abs')}) m""", ("predictions",))
def month_labels(d):
    return rounded(summarise.labelled(summarise.error_by_period(d.compared(), "month", "abs", limit=100.0), "month"), "error")


def _box(period: str, source: str | None = None) -> str:
    return f"""
WITH x AS (SELECT CAST({period}(valid_time) AS BIGINT) AS {period}, difference AS v FROM {source or f'{_DIFF} WHERE abs(difference) < 100'}),
q AS (SELECT {period}, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY 1)
SELECT {period}, n, {R('q1')} AS q1, {R('median')} AS median, {R('q3')} AS q3,
       {R('min(v) FILTER (WHERE v BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1))')} AS whisker_low,
       {R('max(v) FILTER (WHERE v BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1))')} AS whisker_high,
       count(*) FILTER (WHERE NOT v BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1)) AS outliers
FROM x JOIN q USING ({period}) GROUP BY {period}, n, q1, median, q3"""


_BOX_COLS = ("q1", "median", "q3", "whisker_low", "whisker_high")


@query("box_month", _box("month"), ("predictions",))
def box_month(d):
    return rounded(summarise.box_statistics(d.compared(), "month", limit=100.0), *_BOX_COLS)


@query("box_hour", _box("hour"), ("predictions",))
def box_hour(d):
    return rounded(summarise.box_statistics(d.compared(), "hour", limit=100.0), *_BOX_COLS)


@query("fh_drift", f"""
SELECT CAST(fh AS BIGINT) AS fh, {R('avg(abs(difference))')} AS mae, {R('avg(difference * difference)')} AS mse FROM {_DIFF} WHERE abs(difference) < 100 GROUP BY 1""",
       ("predictions",))
def fh_drift(d):
    return rounded(verify.drift_by_lead(d.compared()), "mae", "mse")


@query("r2_fh", f"""
SELECT CAST(fh AS BIGINT) AS fh, {R('greatest(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 0)')} AS r2, count(*) AS n
FROM (SELECT fh, model_output AS y, actual AS p FROM predictions WHERE abs(model_output) < 100 AND abs(actual) < 100) GROUP BY 1""", ("predictions",))
def r2_fh(d):
    return rounded(verify.r2_by_lead(d.predictions()), "r2")


_COND = "(SELECT f.station, f.valid_time, f.fh, f.t2m - h.tair AS difference, h.wspd_sonic_mean AS w FROM forecasts f JOIN hourly h USING (station, valid_time))"


@query("bucket_err", f"""
SELECT bucket, {R('sum(m)')} AS error_sum, sum(n)::BIGINT AS instances, {R('sum(m) / sum(n)')} AS average FROM (
  SELECT station, valid_time, round_even(w / 2.0, 0) * 2.0 AS bucket, avg(abs(difference)) FILTER (WHERE difference > -100) AS m,
         count(difference) FILTER (WHERE difference > -100) AS n FROM {_COND} GROUP BY 1, 2, 3) WHERE n > 0 GROUP BY 1""", ("forecasts", "hourly"))
def bucket_err(d):
    rows = features.align(d.forecasts(), d.hourly()).withColumn("difference", features.forecast_error("t2m"))
    return rounded(summarise.error_by_bucket(rows, "wspd_sonic_mean", 2.0, ["station", "valid_time"], missing=-100.0), "error_sum", "average")


@query("bucket_fine", f"""
SELECT bucket, {R('sum(m)')} AS error_sum, sum(n)::BIGINT AS instances, {R('sum(m) / sum(n)')} AS average FROM (
  SELECT station, valid_time, CASE WHEN w/4 >= 0 AND w/4 < 1 THEN round_even(w/4 * 10.0, 0) / 10.0 ELSE round_even(w/4, 0) END AS bucket,
         avg(abs(difference)) FILTER (WHERE abs(difference) < 100) AS m,
         count(difference) FILTER (WHERE abs(difference) < 100) AS n FROM {_COND} GROUP BY 1, 2, 3) WHERE n > 0 GROUP BY 1""", ("forecasts", "hourly"))
def bucket_fine(d):
    rows = features.align(d.forecasts(), d.hourly()).withColumns(
        {"difference": features.forecast_error("t2m"), "w4": F.col("wspd_sonic_mean") / 4})
    return rounded(summarise.error_by_fine_bucket(rows, "w4", 1, ["station", "valid_time"], limit=100.0), "error_sum", "average")


def _bin(v: str, n: int) -> str:
    return f"least(CAST(floor(({v} - lo_{v}) / (hi_{v} - lo_{v}) * {n}) AS BIGINT) + 1, {n})"


@query("hist2d", f"""
WITH l AS (SELECT min(price) AS lo_price, max(price) AS hi_price, min(model_output) AS lo_model_output, max(model_output) AS hi_model_output FROM predictions)
SELECT xb, yb, count(*) AS count FROM (SELECT {_bin('model_output', 60)} AS xb, {_bin('price', 60)} AS yb FROM predictions, l) GROUP BY 1, 2""", ("predictions",))
def hist2d(d):
    return summarise.histogram_2d(d.predictions(), "model_output", "price", 60)


@query("point_density", f"""
WITH l AS (SELECT min(price) AS lo_price, max(price) AS hi_price, min(model_output) AS lo_model_output, max(model_output) AS hi_model_output FROM predictions),
b AS (SELECT row_key, fh, price, model_output, {_bin('model_output', 300)} AS xb, {_bin('price', 300)} AS yb,
      price >= hi_price OR model_output >= hi_model_output AS edge FROM predictions, l),
c AS (SELECT xb, yb, count(*) AS density FROM b GROUP BY 1, 2)
SELECT b.row_key, CAST(b.fh AS BIGINT) AS fh, b.price, c.density FROM b JOIN c USING (xb, yb) WHERE NOT edge""", ("predictions",))
def point_density(d):
    return longs(summarise.point_density(d.predictions(), "model_output", "price", 300), "fh").select("row_key", "fh", "price", "density")


_SCATTER = """(SELECT * FROM predictions WHERE valid_time > TIMESTAMP '1996-01-01' AND valid_time < TIMESTAMP '2000-12-31 23:59:59'
 AND CASE WHEN metvar = 'tp' THEN abs(actual) > 0.15 AND abs(model_output) > 0.15 ELSE abs(actual) < 100 AND abs(model_output) < 100 END)"""


@query("scatter_diag", f"""
SELECT metvar, count(*) AS points, {R("avg(CASE WHEN abs(round(model_output - actual, 6)) <= CASE WHEN metvar = 'tp' THEN 5 ELSE 2 END THEN 100.0 ELSE 0 END)")} AS near,
  {R('avg(CASE WHEN actual > 0 AND model_output > 0 THEN 100.0 ELSE 0 END)')} AS q1, {R('avg(CASE WHEN actual < 0 AND model_output > 0 THEN 100.0 ELSE 0 END)')} AS q2,
  {R('avg(CASE WHEN actual < 0 AND model_output < 0 THEN 100.0 ELSE 0 END)')} AS q3, {R('avg(CASE WHEN actual > 0 AND model_output < 0 THEN 100.0 ELSE 0 END)')} AS q4,
  {R("100 - avg(CASE WHEN abs(round(model_output - actual, 6)) <= CASE WHEN metvar = 'tp' THEN 5 ELSE 2 END THEN 100.0 ELSE 0 END)")} AS far
FROM {_SCATTER} GROUP BY 1""", ("predictions",))
def scatter_diag(d):
    return rounded(reports.scatter_report(d.predictions(), "1996-01-01", "2000-12-31 23:59:59"), "near", "q1", "q2", "q3", "q4", "far")


@query("scatter_points", f"""
WITH p AS (SELECT * FROM {_SCATTER}),
l AS (SELECT metvar, min(actual) AS lo_actual, max(actual) AS hi_actual, min(model_output) AS lo_model_output, max(model_output) AS hi_model_output FROM p GROUP BY 1),
b AS (SELECT metvar, row_key, fh, price, {_bin('actual', 300)} AS xb, {_bin('model_output', 300)} AS yb, actual >= hi_actual OR model_output >= hi_model_output AS edge FROM p JOIN l USING (metvar)),
c AS (SELECT metvar, xb, yb, count(*) AS density FROM b GROUP BY 1, 2, 3)
SELECT b.metvar, b.row_key, CAST(b.fh AS BIGINT) AS fh, b.price, c.density FROM b JOIN c USING (metvar, xb, yb) WHERE NOT edge""", ("predictions",))
def scatter_points(d):
    out = reports.scatter_points(d.predictions(), "1996-01-01", "2000-12-31 23:59:59")
    return longs(out, "fh").select("metvar", "row_key", "fh", "price", "density")


def _div(period: str, source: str = _DIFF) -> str:
    return f"""SELECT climate_division_name, {period}, avg(s) AS error FROM (
 SELECT climate_division_name, CAST({period}(valid_time) AS BIGINT) AS {period}, fh, avg(abs(difference)) AS s
 FROM {source} JOIN stations ON station = stid WHERE abs(difference) < 100 GROUP BY 1, 2, 3) GROUP BY 1, 2"""


_BASE = "(SELECT *, actual AS difference FROM predictions)"


def _division(d, period, base=False):
    rows = d.predictions().withColumn("difference", F.col("actual")) if base else d.compared()
    return reports.division_period_errors(rows, d.stations(), period)


@query("pivot_division_hour", "SELECT climate_division_name, " + ", ".join(
    f"{R(f'max(CASE WHEN hour = {h} THEN error END)')} AS p{h:02d}" for h in range(24)) + f" FROM ({_div('hour')}) GROUP BY 1", ("predictions", "stations"))
def pivot_division_hour(d):
    return rounded(summarise.division_table(_division(d, "hour"), "hour", range(24)), *[f"p{h:02d}" for h in range(24)])


@query("pivot_division_month", "SELECT climate_division_name, " + ", ".join(
    f"{R(f'max(CASE WHEN month = {m} THEN error END)')} AS p{m:02d}" for m in range(1, 13)) + f" FROM ({_div('month')}) GROUP BY 1", ("predictions", "stations"))
def pivot_division_month(d):
    return rounded(summarise.division_table(_division(d, "month"), "month", range(1, 13)), *[f"p{m:02d}" for m in range(1, 13)])


_W = "(SELECT climate_division_name, count(DISTINCT station) AS w FROM stations GROUP BY 1)"


def _weighted(period: str, source: str = _DIFF) -> str:
    return f"""SELECT {period}, CASE WHEN count(error) = count(*) THEN sum(error * w) / sum(w) END AS error
FROM ({_div(period, source)}) JOIN {_W} USING (climate_division_name) GROUP BY 1"""


@query("station_counts", f"SELECT climate_division_name, w AS stations FROM {_W}", ("stations",))
def station_counts(d):
    return summarise.station_counts(d.stations())


@query("weighted_mean", f"SELECT hour, {R('error')} AS error FROM ({_weighted('hour')})", ("predictions", "stations"))
def weighted_mean(d):
    return rounded(summarise.weighted_mean(_division(d, "hour"), summarise.station_counts(d.stations()), "hour"), "error")


@query("skill", f"""
SELECT b.climate_division_name, b.hour, {R('b.error')} AS base, {R('c.error')} AS candidate, {R('b.error - c.error')} AS gain,
       {R('(b.error - c.error) / b.error * 100')} AS gain_pct
FROM ({_div('hour', _BASE)}) b JOIN ({_div('hour')}) c USING (climate_division_name, hour)""", ("predictions", "stations"))
def skill(d):
    out = summarise.skill(_division(d, "hour", True), _division(d, "hour"), ["climate_division_name", "hour"])
    return rounded(out, "base", "candidate", "gain", "gain_pct")


def _comparison(period: str) -> str:
    return f"""WITH b AS ({_weighted(period, _BASE)}), c AS ({_weighted(period)})
SELECT 'base' AS row_label, {period}, {R('error')} AS error FROM b
UNION ALL SELECT 'candidate', {period}, {R('error')} FROM c
UNION ALL SELECT 'improvement_pct', {period}, {R('(b.error - c.error) / b.error * 100')} FROM b JOIN c USING ({period})
UNION ALL SELECT climate_division_name, {period}, {R('error')} FROM ({_div(period)})
UNION ALL SELECT 'All Stations', {period}, {R('error')} FROM c"""


@query("comparison_hour", _comparison("hour"), ("predictions", "stations"))
def comparison_hour(d):
    return rounded(reports.comparison_table(_division(d, "hour", True), _division(d, "hour"), d.stations(), "hour"), "error")


@query("comparison_month", _comparison("month"), ("predictions", "stations"))
def comparison_month(d):
    return rounded(reports.comparison_table(_division(d, "month", True), _division(d, "month"), d.stations(), "month"), "error")


@query("bulk_errors", f"""
SELECT stid, CAST(fh AS BIGINT) AS fh, count(*) AS n, {R('avg(abs(difference))')} AS mae FROM {_DIFF}
WHERE abs(round(difference, 6)) > 1 AND valid_time > TIMESTAMP '1996-01-01' AND valid_time < TIMESTAMP '2000-12-31 23:59:59' GROUP BY 1, 2""", ("predictions",))
def bulk_errors(d):
    rows = reports.bulk_errors(d.compared(), "1996-01-01", "2000-12-31 23:59:59")
    return rows.groupBy("stid", "fh").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.abs("difference"))).alias("mae"))


@query("marker_scaling", f"""
WITH s AS ({_SCORES}), l AS (SELECT min(mae) AS lo, max(mae) AS hi FROM s)
SELECT stid, fh, metvar, {R('300 + (mae - lo) / (hi - lo) * 1200')} AS marker, {R('mae / hi')} AS shade FROM s, l""", ("predictions",))
def marker_scaling(d):
    return rounded(verify.marker_scaling(_scores(d)), "marker", "shade").select("stid", "fh", "metvar", "marker", "shade")


@query("scores_with_place", f"""
SELECT s.stid, s.fh, s.metvar, {R('s.mae')} AS mae, t.lat, t.lon, t.climate_division_name FROM ({_SCORES}) s LEFT JOIN stations t ON t.station = s.stid""",
       ("predictions", "stations"))
def scores_with_place(d):
    out = verify.with_station_info(_scores(d), d.stations(), ["lat", "lon", "climate_division_name"])
    return rounded(out, "mae").select("stid", "fh", "metvar", "mae", "lat", "lon", "climate_division_name")


@query("missing_outputs", """
SELECT fh, metvar FROM (SELECT DISTINCT CAST(l_linenumber + k AS BIGINT) AS fh FROM lineitem, (VALUES (0), (3)) v(k)), (VALUES ('t2m'), ('u_total'), ('tp')) m(metvar)
EXCEPT SELECT CAST(fh AS BIGINT), metvar FROM predictions""", ("predictions",))
def missing_outputs(d):
    leads = d.table("lineitem").select(F.explode(F.array(F.col("l_linenumber").cast("long"), (F.col("l_linenumber") + 3).cast("long"))).alias("fh")).distinct()
    expected = leads.select("fh", F.explode(F.array(*[F.lit(m) for m in ("t2m", "u_total", "tp")])).alias("metvar"))
    return verify.missing_outputs(expected, d.predictions())


_GATED = f"(SELECT * FROM {_DIFF} WHERE abs(round(difference, 6)) > 1 AND valid_time > TIMESTAMP '1996-01-01' AND valid_time < TIMESTAMP '2000-12-31 23:59:59')"


def _period_sql(period: str, name: str, statistic: str) -> str:
    return f"""SELECT '{period}_{name}' AS "table", CAST(k AS BIGINT) AS key, {R('avg(s)')} AS value FROM (
  SELECT {period}(valid_time) AS k, fh, {statistic} AS s FROM {_GATED} WHERE abs(difference) < 100 GROUP BY 1, 2) GROUP BY 2"""


@query("bulk_report", f"""
SELECT 'drift_mae' AS "table", CAST(fh AS BIGINT) AS key, {R('avg(abs(difference))')} AS value FROM {_GATED} WHERE abs(difference) < 100 GROUP BY 2
UNION ALL SELECT 'drift_mse', CAST(fh AS BIGINT), {R('avg(difference * difference)')} FROM {_GATED} WHERE abs(difference) < 100 GROUP BY 2
UNION ALL SELECT 'r2', CAST(fh AS BIGINT), {R('greatest(1 - sum(pow(model_output - actual, 2)) / (var_pop(model_output) * count(*)), 0)')} FROM {_GATED}
  WHERE abs(model_output) < 100 AND abs(actual) < 100 GROUP BY 2
UNION ALL """ + "\nUNION ALL ".join(
    _period_sql(p, n, q) for p in ("month", "hour")
    for n, q in (("mean", "avg(difference)"), ("std", "stddev_samp(difference)"), ("abs", "avg(abs(difference))"))), ("predictions",))
def bulk_report(d):
    """All tables of the bulk error report over the gated rows."""
    return rounded(reports.bulk_report(d.compared(), "1996-01-01", "2000-12-31 23:59:59", limit=100.0), "value")


def _bulk_tables(d):
    conditions = d.predictions().groupBy("stid", "valid_time").agg((F.max("price") / 1000).alias("wind"))
    return reports.bulk_tables(d.compared(), conditions, "1996-01-01", "2000-12-31 23:59:59", "wind", 2.0, range(1, 8))


@query("bulk_boxes", f"""
SELECT 'month' AS period, month AS key, * EXCLUDE (month) FROM ({_box('month', _GATED)}) a
UNION ALL SELECT 'hour', hour, * EXCLUDE (hour) FROM ({_box('hour', _GATED)}) b""", ("predictions",))
def bulk_boxes(d):
    """Box statistics of the bulk report, from the rows all its tables share."""
    return rounded(longs(_bulk_tables(d)["boxes"], "n", "outliers"), *_BOX_COLS)


@query("bulk_conditions", f"""
WITH w AS (SELECT stid, valid_time, max(price) / 1000 AS wind FROM predictions GROUP BY 1, 2)
SELECT bucket, {R('sum(m)')} AS error_sum, sum(n)::BIGINT AS instances, {R('sum(m) / sum(n)')} AS average FROM (
  SELECT stid, valid_time, metvar, round_even(wind / 2.0, 0) * 2.0 AS bucket, avg(abs(difference)) AS m, count(difference) AS n
  FROM {_GATED} g JOIN w USING (stid, valid_time) GROUP BY 1, 2, 3, 4) WHERE n > 0 GROUP BY 1""", ("predictions",))
def bulk_conditions(d):
    """Error per bucket of a condition at the station and hour, over the gated rows."""
    return rounded(_bulk_tables(d)["conditions"], "error_sum", "average")


@query("bulk_wide", """
SELECT valid_time, stid, metvar, """ + ", ".join(f"{R(f'coalesce(max(CASE WHEN fh = {i} THEN difference END), -999)')} AS diff_{i}" for i in range(1, 8)) + f"""
FROM {_GATED} GROUP BY 1, 2, 3""", ("predictions",))
def bulk_wide(d):
    """The gated rows with one column per forecast hour."""
    return rounded(_bulk_tables(d)["wide"], *[f"diff_{i}" for i in range(1, 8)])
