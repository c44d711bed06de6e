"""Window datasets and profiler images."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from verimet.catalog.registry import R, longs, query, r, rounded
from verimet.operators import features, projections, scoring, windows
from verimet.plans import cleaning
from verimet.session import stored, work_path

PAST = windows.PAST
_FEATURES = ["t2m", "u_total", "lat_c", "tair"]
_MASKED = ["t2m", "u_total", "tair"]


def _series(d):
    """One row per (station, fh, valid_time): forecast, observation, error, and a raw-scale column."""
    rows = features.align(d.forecasts(), d.hourly(), "left")
    return rows.select(
        "station", "fh", "valid_time", "t2m", "u_total", (F.col("n") / 10.0).alias("lat_c"), "tair",
        features.forecast_error("t2m").alias("target_error"),
    )


def _windows(d, **options):
    # An hour has one observation at most, so the series has the rows of the forecasts.
    return windows.build_windows(
        _series(d), ["station", "fh"], _FEATURES, ["tair"], past=PAST, steps=F.col("fh"), max_steps=6, normalise=_MASKED,
        counted=d.forecasts(), **options
    )


def all_windows(d):
    """Windows of the errors of temperature and wind, with the variable as a key, as a series from a stored layout."""
    rows = features.align(d.forecasts(), d.hourly(), "left")
    errors = F.array(*[F.struct(F.lit(n).alias("metvar"), e.alias("target_error")) for n, e in (
        ("t2m", F.col("t2m") - F.col("tair")), ("u_total", F.col("u_total") - F.col("wspd_sonic_mean")))])
    series = rows.select("station", "fh", "valid_time", "t2m", F.explode(errors).alias("v")).select("station", "fh", "valid_time", "t2m", "v.*")
    both = d.forecasts().withColumn("metvar", F.explode(F.array(F.lit("t2m"), F.lit("u_total"))))
    keys, name = ["station", "metvar", "fh"], f"trained_{uuid.uuid4().hex}"
    table = windows.store_layout(series, keys, name, work_path(d.spark, name), past=PAST, max_steps=6, buckets=d.buckets(16), counted=both)
    return windows.window_series(table, keys, ["t2m"], past=PAST, steps=F.col("fh"), max_steps=6, normalise=["t2m"], laid_out=True)


# The SQL form follows the definition literally: append zero rows, take frames, fill nulls with the mean.
WINDOWS_SQL = f"""
series AS (SELECT f.station, f.fh, f.valid_time, t2m, u_total, h.n / 10.0 AS lat_c, tair, t2m - tair AS e
           FROM forecasts f LEFT JOIN hourly h ON f.station = h.station AND f.valid_time = h.valid_time),
numbered AS (SELECT *, row_number() OVER (PARTITION BY station, fh ORDER BY valid_time) - 1 AS pos FROM series),
tails AS (SELECT station, fh, max(pos) + 1 AS n FROM numbered GROUP BY 1, 2),
padded AS (SELECT station, fh, pos, valid_time, t2m, u_total, lat_c, tair, e, epoch_us(valid_time) * 1000 AS ns FROM numbered
           UNION ALL SELECT station, fh, n + k, NULL, 0, 0, 0, 0, 0, 0 FROM tails, (SELECT unnest(generate_series(0, 35)) AS k) g),
stats AS (SELECT *, {', '.join(f'avg({c}) OVER past AS m_{c}' for c in _MASKED)},
          {', '.join(f'stddev_pop({c}) OVER past * sqrt(count({c}) OVER past / {PAST}.0) AS d_{c}' for c in _MASKED)},
          list({{'t2m': t2m, 'u_total': u_total, 'lat_c': lat_c, 'tair': tair, 'e': e, 'ns': ns, 'vt': valid_time}}) OVER span AS w
          FROM padded WINDOW past AS (PARTITION BY station, fh ORDER BY pos ROWS BETWEEN CURRENT ROW AND {PAST - 1} FOLLOWING),
                             span AS (PARTITION BY station, fh ORDER BY pos ROWS BETWEEN CURRENT ROW AND {PAST + 5} FOLLOWING)),
win AS (SELECT station, CAST(fh AS BIGINT) AS fh, valid_time, pos AS start, w, {', '.join(f'm_{c}' for c in _MASKED)},
        {', '.join(f'CASE WHEN d_{c} < 1e-8 THEN 1 ELSE d_{c} END AS d_{c}' for c in _MASKED)} FROM stats WHERE valid_time IS NOT NULL)"""


def _z(c: str, i) -> str:
    return f"(w[{i}].{c} - m_{c}) / d_{c}"


def _checks(win):
    """Scalars that pin down the window arrays: sums over all rows and single cells."""
    x = F.col("x")

    def total(field):
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + F.coalesce(v[field], F.lit(0.0)))

    return win.select(
        "station", "fh", "valid_time", F.col("start").cast("long").alias("start"), "init_time",
        F.size("x").cast("long").alias("rows"),
        r(total("t2m"), 4).alias("t2m_sum"), r(total("tair"), 4).alias("tair_sum"), r(total("lat_c"), 4).alias("raw_sum"),
        r(x[0]["t2m"], 5).alias("t2m_first"), r(F.element_at(x, -1)["t2m"], 5).alias("t2m_end"),
        r(x[PAST]["u_total"], 5).alias("u_first_future"), r(x[PAST - 1]["tair"], 5).alias("tair_last"),
    )


def _sum(c: str, hi: str) -> str:
    return f"coalesce(list_sum([{_z(c, 'i')} FOR i IN range(1, {hi} + 1)]), 0)"


_ARRAYS = f"""WITH {WINDOWS_SQL}
SELECT station, fh, valid_time, start, w[{PAST}].vt AS init_time, {PAST} + fh AS rows,
       {R(_sum('t2m', f'{PAST} + fh'), 4)} AS t2m_sum,
       {R(_sum('tair', str(PAST)) + f" + fh * coalesce({_z('tair', PAST)}, 0)", 4)} AS tair_sum,
       {R(f'coalesce(list_sum([w[i].lat_c FOR i IN range(1, {PAST} + fh + 1)]), 0)', 4)} AS raw_sum,
       {R(_z('t2m', 1), 5)} AS t2m_first, {R(_z('t2m', f'{PAST} + fh'), 5)} AS t2m_end,
       {R(_z('u_total', PAST + 1), 5)} AS u_first_future, {R(_z('tair', PAST), 5)} AS tair_last
FROM win"""


@query("win_arrays", _ARRAYS, ("forecasts", "hourly"))
def win_arrays(d):
    return _checks(_windows(d))


@query("win_arrays_laid_out", _ARRAYS, ("forecasts", "hourly"))
def win_arrays_laid_out(d):
    """Windows from a table that was numbered and dealt when it was written; reading it needs no exchange."""
    name = f"series_{uuid.uuid4().hex}"
    table = windows.store_layout(_series(d), ["station", "fh"], name, work_path(d.spark, name), past=PAST, max_steps=6, buckets=d.buckets(16), counted=d.forecasts())
    return _checks(windows.build_windows(
        table, ["station", "fh"], _FEATURES, ["tair"], past=PAST, steps=F.col("fh"), max_steps=6, normalise=_MASKED, laid_out=True))


@query("win_persist", f"""WITH {WINDOWS_SQL}
SELECT station, fh, start, {R(_z('tair', PAST), 5)} AS first_future, {R(_z('tair', PAST), 5)} AS last_future FROM win""", ("forecasts", "hourly"))
def win_persist(d):
    x = F.col("x")
    return _windows(d).select(
        "station", "fh", F.col("start").cast("long").alias("start"), r(x[PAST]["tair"], 5).alias("first_future"),
        r(F.element_at(x, -1)["tair"], 5).alias("last_future"))


@query("win_persist_last_valid", f"""WITH {WINDOWS_SQL}
SELECT station, fh, start,
       {R(f"(list_filter([s.tair FOR s IN w[1:{PAST}]], lambda v: v IS NOT NULL)[-1] - m_tair) / d_tair", 5)} AS held
FROM win WHERE start + {PAST} <= (SELECT n FROM tails t WHERE t.station = win.station AND t.fh = win.fh)""", ("forecasts", "hourly"))
def win_persist_last_valid(d):
    rows = _windows(d, last_valid=True).where(F.col("init_time").isNotNull())
    return rows.select("station", "fh", F.col("start").cast("long").alias("start"), r(F.col("x")[PAST]["tair"], 5).alias("held"))


@query("win_targets", f"""WITH {WINDOWS_SQL}
SELECT station, fh, start, {R(f'w[{PAST + 1}].e')} AS first_y, {R(f'w[{PAST} + fh].e')} AS last_y,
       CAST(w[{PAST + 1}].ns AS BIGINT) AS first_t, CAST(w[{PAST} + fh].ns AS BIGINT) AS last_t FROM win""", ("forecasts", "hourly"))
def win_targets(d):
    return _windows(d, with_x=False).select(
        "station", "fh", F.col("start").cast("long").alias("start"), r(F.col("y")[0]).alias("first_y"), r(F.element_at("y", -1)).alias("last_y"),
        F.col("future_times")[0].alias("first_t"), F.element_at("future_times", -1).alias("last_t"))


@query("win_small_blocks", _ARRAYS, ("forecasts", "hourly"))
def win_small_blocks(d):
    return _checks(_windows(d, block_rows=40))


@query("win_steps_model", """
SELECT station, time, CAST(fh AS BIGINT) AS fh, CAST(fh AS BIGINT) AS hrrr, CAST(floor(fh/3) AS BIGINT) AS gfs, CAST(floor((fh+2)/3) AS BIGINT) AS nam
FROM forecasts""", ("forecasts",))
def win_steps_model(d):
    fh = F.col("fh")
    return d.forecasts().select(
        "station", "time", "fh", *[windows.future_steps_column(m, fh).cast("long").alias(m.lower()) for m in ("HRRR", "GFS", "NAM")])


_IMAGES = """
prof AS (SELECT station, time, "range", temperature - 273.15 AS temperature, relative_humidity / 100 AS relative_humidity
         FROM profiles WHERE "range" <= 5000),
hours AS (SELECT *, time_bucket(INTERVAL 1 HOUR, time) AS hr FROM prof),
cell AS (SELECT station, hr, "range" AS rg, time, max(temperature) AS temperature, max(relative_humidity) AS rh FROM hours GROUP BY 1, 2, 3, 4),
heights AS (SELECT station, hr, rg, row_number() OVER (PARTITION BY station, hr ORDER BY rg) - 1 AS h FROM (SELECT DISTINCT station, hr, rg FROM cell)),
times AS (SELECT station, hr, time, row_number() OVER (PARTITION BY station, hr ORDER BY time) - 1 AS t FROM (SELECT DISTINCT station, hr, time FROM cell)),
cells AS (SELECT a.station, a.hr AS valid_time, h, t, c.temperature, c.rh FROM heights a JOIN times b USING (station, hr)
          LEFT JOIN cell c ON c.station = a.station AND c.hr = a.hr AND c.rg = a.rg AND c.time = b.time)"""


def _images(d):
    return cleaning.profiler_images(d.profiles(), ["temperature", "relative_humidity"])


@query("profiler_rows", f"""
SELECT station, time, CAST("range" AS BIGINT) AS height, {R('temperature - 273.15')} AS temperature, {R('dewpoint - 273.15')} AS dewpoint,
       {R('relative_humidity / 100')} AS relative_humidity FROM profiles WHERE "range" <= 5000""", ("profiles",))
def profiler_rows(d):
    raw = d.profiles().withColumn("temperature_qc", F.lit(1)).withColumn("surface_pressure", F.lit(1))
    return rounded(cleaning.profiler_rows(raw), "temperature", "dewpoint", "relative_humidity").withColumn(
        "height", F.col("range").cast("long")).drop("range")


@query("profiler_cube", f"""WITH {_IMAGES}
SELECT station, valid_time, h, t, 0::BIGINT AS channel, {R('temperature')} AS value FROM cells
UNION ALL SELECT station, valid_time, h, t, 1::BIGINT, {R('rh')} FROM cells""", ("profiles",))
def profiler_cube(d):
    return rounded(longs(windows.profile_cells(_images(d)), "h", "t", "channel"), "value")


@query("channel_scaling", f"""WITH {_IMAGES}
SELECT 0::BIGINT AS channel, {R('avg(temperature)')} AS mean, {R('stddev_samp(temperature)')} AS sd FROM cells
UNION ALL SELECT 1::BIGINT, {R('avg(rh)')}, {R('stddev_samp(rh)')} FROM cells""", ("profiles",))
def channel_scaling(d):
    return rounded(longs(windows.channel_scaling(_images(d)), "channel"), "mean", "sd")


@query("scaled_images", f"""WITH {_IMAGES}, v AS (SELECT station, valid_time, c.channel, c.value FROM (
  SELECT station, valid_time, unnest([{{'channel': 0, 'value': temperature}}, {{'channel': 1, 'value': rh}}]) AS c FROM cells) u),
m AS (SELECT channel, avg(value) AS m, stddev_samp(value) AS s FROM v GROUP BY 1)
SELECT station, valid_time, channel::BIGINT AS channel, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END)::BIGINT AS empty, {R('sum((value - m) / s)', 5)} AS total
FROM v JOIN m USING (channel) GROUP BY 1, 2, 3""", ("profiles",))
def scaled_images(d):
    images = _images(d)
    scaled = windows.profile_cells(windows.scale_channels(images, windows.channel_scaling(images)))
    return longs(scaled, "channel").groupBy("station", "valid_time", "channel").agg(
        F.count(F.when(F.col("value").isNull(), 1)).alias("empty"), r(F.sum("value"), 5).alias("total"))


@query("window_images", """
WITH s AS (SELECT station, valid_time, n, precip_total, row_number() OVER (PARTITION BY station ORDER BY valid_time) - 1 AS start,
           count(*) OVER (PARTITION BY station) AS len FROM hourly)
SELECT a.station, a.valid_time, a.start, CASE WHEN b.n = 1 THEN 0.0 ELSE floor(b.precip_total * 1e6 + 0.5001) / 1e6 END AS first_image, floor(b.precip_total * 1e6 + 0.5001) / 1e6 AS second_image
FROM s a JOIN s b ON a.station = b.station AND b.start = least(a.start + 30, a.len - 1)""", ("hourly",))
def window_images(d):
    image = F.array(F.col("precip_total"))
    rows = d.hourly().withColumn("images", F.array(F.when(F.col("n") > 1, image), image))
    out = windows.window_images(rows, ["station"], "images")
    return out.select("station", "valid_time", F.col("start").cast("long").alias("start"),
                      r(F.col("images")[0][0]).alias("first_image"), r(F.col("images")[1][0]).alias("second_image"))


@query("latest_snapshot", f"""
SELECT station, valid_time, {R('tair')} AS tair FROM hourly WHERE valid_time = (SELECT max(valid_time) FROM hourly)""", ("hourly",))
def latest_snapshot(d):
    return rounded(windows.latest_snapshot(d.hourly(), "2031-01-01 00:00:00").select("station", "valid_time", "tair"), "tair")


# Missing cells count as 0 in these models.
def _cell_models(d):
    return d.forecasts().select("station", "fh").distinct().select(
        "station", "fh", F.array(F.lit(0.5), F.col("fh") / 10.0, F.lit(-0.25), F.lit(0.125), F.lit(1.5)).alias("params"))


def mean_sql(c: str) -> str:
    cell = f"w[i].{c}" if c == "lat_c" else _z(c, "i")
    if c == "tair":
        return f"((coalesce(list_sum([coalesce({cell}, 0) FOR i IN range(1, {PAST} + 1)]), 0) + fh * coalesce({_z(c, PAST)}, 0)) / ({PAST} + fh))"
    return f"(list_sum([coalesce({cell}, 0) FOR i IN range(1, {PAST} + fh + 1)]) / ({PAST} + fh))"


_SCORED = f"""WITH {WINDOWS_SQL}
SELECT station, fh, start, w[{PAST}].vt AS init_time,
       {R(f"0.5 + fh / 10.0 * {mean_sql('t2m')} - 0.25 * {mean_sql('u_total')} + 0.125 * {mean_sql('lat_c')} + 1.5 * {mean_sql('tair')}", 4)} AS model_output
FROM win"""


def _score_windows(d, models):
    from pyspark.sql import types as T

    outputs = T.StructType([T.StructField("model_output", T.DoubleType())])
    out = scoring.score_windows(_windows(d, per_key=models), None, ["station", "fh"], scoring.predict_cells(_FEATURES), outputs, _FEATURES)
    return rounded(longs(out, "start"), "model_output", digits=4)


@query("score_windows_all_leads", _SCORED, ("forecasts", "hourly"))
@query("score_windows", _SCORED, ("forecasts", "hourly"))
def score_windows(d):
    """A model for every lead over every cell of the window, past and future."""
    return _score_windows(d, _cell_models(d))


_UNCERTAIN = f"""WITH {WINDOWS_SQL},
steps AS (SELECT station, fh, start, k, coalesce({_z('t2m', f'{PAST} + k')}, 0) AS a, coalesce({_z('u_total', f'{PAST} + k')}, 0) AS b
          FROM win, (SELECT unnest(range(1, 7)) AS k) g WHERE k <= fh),
members AS (SELECT *, a * 0.5 + b * fh / 10.0 AS g1, a * 0.75 - b AS g2 FROM steps)
SELECT station, fh, start, k AS step, {R('(g1 + g2) / 2', 4)} AS mu, {R('pow((g1 - g2) / 2, 2)', 4)} AS epistemic_var,
       {R('(exp(-1) + exp(-2)) / 2', 4)} AS aleatoric_var, {R('pow((g1 - g2) / 2, 2) + (exp(-1) + exp(-2)) / 2', 4)} AS total_var FROM members"""


def _score_uncertain(d):
    from pyspark.sql import types as T

    from verimet.schemas import UNCERTAIN_PREDICTION

    names = ("mu", "epistemic_var", "aleatoric_var", "total_var")
    outputs = T.StructType([UNCERTAIN_PREDICTION[n] for n in names])
    pair = F.array(F.lit(0.5), F.col("fh") / 10.0, F.lit(-1.0), F.lit(0.75), F.lit(-1.0), F.lit(-2.0))
    models = d.forecasts().select("station", "fh").distinct().select("station", "fh", pair.alias("params"))
    out = scoring.score_windows(_windows(d, per_key=models), None, ["station", "fh"], scoring.predict_ensemble(PAST, 2), outputs, ["t2m", "u_total"])
    steps = out.select("station", "fh", "start", F.posexplode(F.arrays_zip(*names)).alias("step", "v"))
    return rounded(longs(steps.select("station", "fh", "start", (F.col("step") + 1).alias("step"), "v.*"), "start", "step"), *names, digits=4)


@query("score_uncertain_all_leads", _UNCERTAIN, ("forecasts", "hourly"))
@query("score_uncertain", _UNCERTAIN, ("forecasts", "hourly"))
def score_uncertain(d):
    """Two models per group; mean, spread and noise per future step as lists, unpacked here."""
    return _score_uncertain(d)


_CELLS = f"""WITH {WINDOWS_SQL}
SELECT station, fh, start, i AS slot, {R(_z('t2m', 'i'), 5)} AS t2m, {R(_z('u_total', 'i'), 5)} AS u_total, {R('w[i].lat_c', 5)} AS lat_c,
       {R(f"CASE WHEN i <= {PAST} THEN {_z('tair', 'i')} ELSE {_z('tair', PAST)} END", 5)} AS tair
FROM win, (SELECT unnest(range(1, {PAST} + 7)) AS i) s WHERE i <= {PAST} + fh"""


def _cells(win):
    cells = win.select(
        "station", "fh", "start", F.posexplode("x").alias("slot", "c")).select("station", "fh", "start", (F.col("slot") + 1).alias("slot"), "c.*")
    return rounded(longs(cells, "start", "slot"), *_FEATURES, digits=5)


@query("win_cells_all_leads", _CELLS, ("forecasts", "hourly"))
@query("win_cells", _CELLS, ("forecasts", "hourly"))
def win_cells(d):
    """Every cell of all windows, by position."""
    return _cells(_windows(d))


@query("win_null_keys", f"""
WITH s AS (SELECT CASE WHEN l_suppkey % 3 > 0 THEN concat('S', l_suppkey) END AS station, CAST(l_quantity AS DOUBLE) AS q,
                  CASE WHEN l_linenumber < 7 THEN CAST(l_shipdate AS TIMESTAMP) END AS valid_time, l_orderkey * 10 + l_linenumber AS k FROM lineitem),
n AS (SELECT *, row_number() OVER p - 1 AS start, count(*) OVER (PARTITION BY station) AS total,
             sum(q) OVER (p ROWS BETWEEN 2 FOLLOWING AND 3 FOLLOWING) AS ahead FROM s WINDOW p AS (PARTITION BY station ORDER BY valid_time NULLS FIRST, k))
SELECT station, count(*) AS windows, {R('sum(ahead)')} AS y_sum, count(valid_time) AS timed FROM n GROUP BY 1""")
def win_null_keys(d):
    """Rows without a station are a series of their own and rows without a time come first; none is lost."""
    rows = d.table("lineitem").select(
        F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("S"), "l_suppkey")).alias("station"), F.col("l_quantity").cast("double").alias("q"),
        F.when(F.col("l_linenumber") < 7, F.col("l_shipdate").cast("timestamp_ntz")).alias("valid_time"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    win = windows.build_windows(rows, ["station"], ["q"], target="q", past=2, steps=2, max_steps=2, normalise=[], ties=["k"], block_rows=64)
    total = F.aggregate("y", F.lit(0.0), lambda s, v: s + v)
    return rounded(win.groupBy("station").agg(
        F.count(F.lit(1)).alias("windows"), F.sum(total).alias("y_sum"), F.count("valid_time").alias("timed")), "y_sum")


def _model_steps_sql(steps: str) -> str:
    return f"""WITH r AS (SELECT station, fh, time, t2m, row_number() OVER (PARTITION BY station, fh ORDER BY time) - 1 AS start FROM forecasts),
s AS (SELECT *, {steps} AS k FROM r),
v AS (SELECT *, list(t2m) OVER (PARTITION BY station, fh ORDER BY start ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS w FROM s)
SELECT station, CAST(fh AS BIGINT) AS fh, start, 5 + k AS rows, CAST(k AS BIGINT) AS steps,
       {R('coalesce(list_sum(w[6:5 + k]), 0)')} AS y_sum, {R('coalesce(w[5], 0)')} AS held FROM v"""


def _model_steps(rows, model: str):
    """Windows of a 3-hourly model: 5 past rows, the future rows that cover the lead, the last value held."""
    win = windows.build_windows(
        rows, ["station", "fh"], ["t2m"], ["t2m"], target="t2m", order="time", past=5, steps=windows.future_steps_column(model, F.col("fh")),
        max_steps=3, normalise=[])
    total = F.aggregate("y", F.lit(0.0), lambda s, v: s + v)
    out = win.select("station", "fh", "start", F.size("x").alias("rows"), F.size("y").alias("steps"), total.alias("y_sum"),
                     F.element_at("x", -1)["t2m"].alias("held"))
    return rounded(longs(out, "start", "rows", "steps"), "y_sum", "held")


_GFS, _NAM = "CAST(floor(fh / 3) AS BIGINT)", "CAST(floor((fh + 2) / 3) AS BIGINT)"


@query("win_gfs_all_leads", _model_steps_sql(_GFS), ("forecasts",))
@query("win_gfs", _model_steps_sql(_GFS), ("forecasts",))
def win_gfs(d):
    """Leads before the first output of the model have no future rows."""
    return _model_steps(d.forecasts(), "GFS")


@query("win_nam_all_leads", _model_steps_sql(_NAM), ("forecasts",))
@query("win_nam", _model_steps_sql(_NAM), ("forecasts",))
def win_nam(d):
    return _model_steps(d.forecasts(), "NAM")


@query("win_default_mask", f"""WITH {WINDOWS_SQL}
SELECT station, fh, start, {', '.join(f"{R(_z(c, PAST), 5)} AS {c}" for c in _MASKED)}, {R(f'w[{PAST}].lat_c', 5)} AS lat_c
FROM win WHERE w[{PAST}].vt IS NOT NULL""", ("forecasts", "hourly"))
def win_default_mask(d):
    """Features and their normalisation by the name rules alone: keys, time, target and images are no features, places keep their scale."""
    series = _series(d).withColumn("images_0", F.lit("none"))
    names = [c for c in projections.feature_names(series.columns) if c not in ("station", "fh")]
    win = windows.build_windows(series, ["station", "fh"], names, past=PAST, steps=F.col("fh"), max_steps=6, with_x=False, counted=d.forecasts())
    out = win.where(F.col("init_time").isNotNull()).select("station", "fh", F.col("start").cast("long").alias("start"), *[F.col("last")[c].alias(c) for c in names])
    return rounded(out, *names, digits=5)


@query("windows_with_data", """
SELECT station, CAST(fh AS BIGINT) AS fh, count(*) AS n FROM forecasts WHERE fh NOT IN (2, 4) GROUP BY 1, 2""", ("forecasts",))
def windows_with_data(d):
    """Windows of two leads have no data, one as null and one as an empty list; they are dropped."""
    win = windows.build_windows(d.forecasts(), ["station", "fh"], ["t2m"], target="t2m", order="time", past=2, steps=1, max_steps=1, normalise=[])
    holes = win.withColumn("x", F.when(F.col("fh") == 4, F.slice("x", 1, 0)).when(F.col("fh") != 2, F.col("x")))
    return windows.with_data(holes).groupBy("station", "fh").agg(F.count(F.lit(1)).alias("n"))


_WIDE = 90


def _held_sql(model: str) -> str:
    held = windows.CLUSTER_STATIONS[model] * windows.OBSERVED_COLUMNS
    own = _WIDE - held
    return f"""SELECT '{model}' AS model, station, fh, start, coalesce({own} * b + {sum(range(own))}, 0) + coalesce({held} * a + {sum(range(own, _WIDE))}, 0) AS total FROM s"""


@query("win_persisted_width", f"""
WITH s AS (SELECT station, CAST(fh AS BIGINT) AS fh, row_number() OVER p - 1 AS start, lead(t2m, 1) OVER p AS a, lead(t2m, 2) OVER p AS b
           FROM forecasts WINDOW p AS (PARTITION BY station, fh ORDER BY time))
SELECT model, station, fh, start, {R('total', 4)} AS total FROM ({' UNION ALL '.join(map(_held_sql, windows.CLUSTER_STATIONS))}) t""", ("forecasts",))
def win_persisted_width(d):
    """The future row of 90 features per model: the observations of 4 or 5 stations are held, the others are known."""
    names = [f"f{i:02d}" for i in range(_WIDE)]
    rows = stored(d.forecasts().select("station", "fh", "time", "t2m"), "wide-series").withColumns({n: F.col("t2m") + i for i, n in enumerate(names)})
    parts = []
    for model in windows.CLUSTER_STATIONS:
        win = windows.build_windows(
            rows, ["station", "fh"], names, windows.persisted_features(model, names), target="t2m", order="time", past=2, steps=1, max_steps=1, normalise=[])
        last = F.element_at("x", -1)
        parts.append(longs(win.select(F.lit(model).alias("model"), "station", "fh", "start", sum((last[n] for n in names), F.lit(0.0)).alias("total")), "start"))
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "total", digits=4)
