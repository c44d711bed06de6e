"""Scalar functions, filters and projections over the derived inputs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from verimet.catalog.registry import R, longs, query, r
from verimet.config import SplitConfig
from verimet.functions import clock, geo, thermo, units, values, wind
from verimet.operators import filters, projections


@query("fn_wind", f"""
SELECT latitude, longitude, time, fh, {R('sqrt(u10*u10 + v10*v10)')} AS u_total,
       {R('''CASE WHEN u10 = 0 AND v10 = 0 THEN 0.0
            WHEN 90 - degrees(atan2(-v10, -u10)) <= 0 THEN 450 - degrees(atan2(-v10, -u10))
            ELSE 90 - degrees(atan2(-v10, -u10)) END''')} AS u_dir
FROM grid""", ("grid",))
def fn_wind(d):
    u, v = F.col("u10"), F.col("v10")
    return d.grid().select("latitude", "longitude", "time", "fh", r(wind.wind_speed(u, v)).alias("u_total"),
                           r(wind.wind_direction(u, v)).alias("u_dir"))


@query("fn_units", f"""
SELECT event_id, {R('tair - 273.15')} AS kelvin, {R('tair - 273.13')} AS kelvin_shifted, {R('(tair - 32.0) * 5.0 / 9.0')} AS fahrenheit,
       {R('tair * 0.514444')} AS knots, {R('tair * 33.8639')} AS inhg, {R('tair * 25.4')} AS inches, {R('relh / 100.0')} AS fraction
FROM raw_obs""", ("raw_obs",))
def fn_units(d):
    t = F.col("tair")
    return d.raw_obs().select(
        "event_id", r(units.kelvin_to_celsius(t)).alias("kelvin"), r(units.kelvin_to_celsius(t, 273.13)).alias("kelvin_shifted"),
        r(units.fahrenheit_to_celsius(t)).alias("fahrenheit"), r(units.knots_to_ms(t)).alias("knots"),
        r(units.inhg_to_hpa(t)).alias("inhg"), r(units.inches_to_mm(t)).alias("inches"),
        r(units.percent_to_fraction(F.col("relh"))).alias("fraction"),
    )


_N = thermo.GAS_DRY * thermo.LAPSE_K_PER_M / thermo.GRAVITY


@query("fn_thermo", f"""
SELECT event_id, {R('243.5 * ln(e/6.112) / (17.67 - ln(e/6.112))')} AS td,
       {R(f'''(pow(pow(pres, {_N!r}) - {(thermo.P0_HPA ** _N * thermo.LAPSE_K_PER_M / thermo.T0_K)!r} * h, {1 / _N!r}) + 0.3)
              * exp(h / ({thermo.GAS_DRY!r} * (tair + 273.15) / {thermo.GRAVITY!r}))''')} AS mslp
FROM (SELECT event_id, tair, pres, elev + 1.5 AS h,
             CASE WHEN relh > 0 THEN relh / 100 * 6.112 * exp(17.67 * tair / (tair + 243.5)) END AS e
      FROM raw_obs)""", ("raw_obs",))
def fn_thermo(d):
    from verimet.plans.cleaning import with_derived

    return with_derived(d.raw_obs()).select("event_id", r("td").alias("td"), r("mslp").alias("mslp"))


@query("fn_lon_wrap", f"""
SELECT DISTINCT longitude, {R('((longitude + 180) - 360 * floor((longitude + 180) / 360)) - 180')} AS wrapped,
       CAST(floor(longitude * 10000 + 0.5) AS BIGINT) AS lon_key
FROM grid""", ("grid",))
def fn_lon_wrap(d):
    lon = F.col("longitude")
    return d.grid().select("longitude", r(geo.wrap_longitude(lon)).alias("wrapped"), geo.coordinate_key(lon).alias("lon_key")).distinct()


@query("fn_lead_time", """
SELECT station, time, valid_time, CAST(date_diff('hour', time, valid_time) AS BIGINT) AS lead_time FROM forecasts""", ("forecasts",))
def fn_lead_time(d):
    return d.forecasts().select("station", "time", "valid_time", clock.lead_hours(F.col("time"), F.col("valid_time")).alias("lead_time"))


@query("fn_cyclic", f"""
SELECT event_id, {R('sin(2*pi()*dayofyear(time_5M)/366.0)')} AS year_sin, {R('cos(2*pi()*dayofyear(time_5M)/366.0)')} AS year_cos,
       {R('sin(2*pi()*s/86400.0)')} AS day_sin, {R('cos(2*pi()*s/86400.0)')} AS day_cos
FROM (SELECT *, hour(time_5M)*3600 + minute(time_5M)*60 + second(time_5M) AS s FROM raw_obs)""", ("raw_obs",))
def fn_cyclic(d):
    ts = F.col("time_5M")
    (ys, yc), (ds, dc) = clock.year_cycle(ts), clock.day_cycle(ts)
    return d.raw_obs().select("event_id", r(ys).alias("year_sin"), r(yc).alias("year_cos"), r(ds).alias("day_sin"), r(dc).alias("day_cos"))


@query("fn_time_labels", """
SELECT event_id, monthname(ts) AS month_label, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':00' AS hour_label,
       CAST(hour(ts) AS BIGINT) AS hour_number, hour(ts) BETWEEN 6 AND 17 AS is_day,
       CAST(epoch_us(ts) * 1000 AS BIGINT) AS ns, ts AS back
FROM events""")
def fn_time_labels(d):
    ts = F.col("ts")
    label = clock.hour_label(F.hour(ts))
    return d.table("events").select(
        "event_id", clock.month_label(ts).alias("month_label"), label.alias("hour_label"), clock.hour_from_label(label).alias("hour_number"),
        clock.is_day(ts).alias("is_day"), clock.to_epoch_ns(ts).alias("ns"), clock.from_epoch_ns(clock.to_epoch_ns(ts)).alias("back"),
    )


@query("fn_rounding", f"""
SELECT event_id, {R('round_even(value / 5.0, 0) * 5.0')} AS by_five, {R('round_even(value / 0.5, 0) * 0.5')} AS by_half,
       {R('CASE WHEN value/100 >= 0 AND value/100 < 1 THEN round_even(value/100 * 10, 0) / 10 ELSE round_even(value/100, 0) END')} AS fine,
       {R('greatest(value - 50, 0)')} AS clipped, CASE WHEN value <= 100 THEN {R('value')} END AS despiked,
       nullif(CAST(event_id % 7 - 999 AS DOUBLE), -999.0) AS unsentinel
FROM events""")
def fn_rounding(d):
    v = F.col("value")
    return d.table("events").select(
        "event_id", r(values.round_to_multiple(v, 5)).alias("by_five"), r(values.round_to_multiple(v, 0.5)).alias("by_half"),
        r(values.round_fine_below_one(v / 100, 1)).alias("fine"), r(values.clip_low(v - 50)).alias("clipped"),
        r(values.null_above(v, 100)).alias("despiked"),
        values.sentinel_to_null((F.col("event_id") % 7 - 999).cast("double")).alias("unsentinel"),
    )


@query("fn_parse", """
SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'M' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS number,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE date_trunc('minute', ts) END AS moment
FROM events""")
def fn_parse(d):
    text = F.when(F.col("event_id") % 3 == 0, "M").otherwise(F.col("event_id").cast("string"))
    moment = F.when(F.col("event_id") % 4 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    return d.table("events").select("event_id", values.to_number(text).alias("number"), values.to_time(moment, "yyyy-MM-dd HH:mm").alias("moment"))


@query("fn_haversine", f"""
SELECT DISTINCT p.lat, p.lon,
       {R('2*6371.0*asin(sqrt(least(1.0, pow(sin(radians(42.75-p.lat)/2),2) + cos(radians(p.lat))*cos(radians(42.75))*pow(sin(radians(-73.8-p.lon)/2),2))))', 3)} AS km
FROM stations p""", ("stations",))
def fn_haversine(d):
    return d.stations().select(
        "lat", "lon", r(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(42.75), F.lit(-73.8)), 3).alias("km")
    ).distinct()


@query("fn_box", """
SELECT station, printf('lat=[%.2f, %.2f] lon=[%.2f, %.2f]', lat, lat + 1, lon, lon + 2) AS box,
       CAST(5 AS BIGINT) AS corners, lat + 1 AS north_east_lat, lon + 2 AS north_east_lon FROM stations""", ("stations",))
def fn_box(d):
    lat, lon = F.col("lat"), F.col("lon")
    ring = geo.box_polygon(lat, lat + 1, lon, lon + 2)
    return d.stations().select(
        "station", geo.box_text(lat, lat + 1, lon, lon + 2).alias("box"), F.size(ring).cast("long").alias("corners"),
        ring[2]["lat"].alias("north_east_lat"), ring[2]["lon"].alias("north_east_lon"),
    )


@query("fn_interval95", f"""
SELECT vec_id, {R('CAST(embedding[1] AS DOUBLE)')} AS first_mu,
       {R('CAST(embedding[1] AS DOUBLE) - 1.96 * sqrt(exp(CAST(embedding[33] AS DOUBLE)))')} AS low,
       {R('CAST(embedding[1] AS DOUBLE) + 1.96 * sqrt(exp(CAST(embedding[33] AS DOUBLE)))')} AS high
FROM embeddings""")
def fn_interval95(d):
    rows = d.samples().select(
        "vec_id", F.transform("mu", lambda v: v.cast("double")).alias("m"), F.transform("logvar", lambda v: F.exp(v.cast("double"))).alias("v")
    )
    low, high = values.interval_95_arrays(F.col("m"), F.col("v"))
    return rows.select(
        "vec_id", r(values.first_element(F.col("m"))).alias("first_mu"), r(values.first_element(low)).alias("low"),
        r(values.first_element(high)).alias("high"),
    )


@query("fn_cleaning_window", """
SELECT DISTINCT CAST(l_shipdate AS DATE) AS day,
       CAST(date_trunc('month', l_shipdate) - INTERVAL 1 MONTH AS TIMESTAMP) AS window_start,
       CAST(least(CAST(l_shipdate AS DATE) + 1, last_day(l_shipdate)) AS TIMESTAMP) + INTERVAL '23 hours 59 minutes 59 seconds' AS window_end
FROM lineitem""")
def fn_cleaning_window(d):
    day = F.to_date("l_shipdate")
    start, end = clock.cleaning_window(day)
    return d.table("lineitem").select(day.alias("day"), start.alias("window_start"), end.alias("window_end")).distinct()


_SPLIT = SplitConfig(date(1996, 1, 1), date(2001, 6, 30))


@query("split_label", f"""
SELECT l_orderkey, l_linenumber, l_shipdate,
       CASE WHEN l_shipdate < DATE '{_SPLIT.start}' THEN NULL WHEN l_shipdate < DATE '{_SPLIT.train_end}' THEN 'train'
            WHEN l_shipdate < DATE '{_SPLIT.val_end}' THEN 'val' WHEN l_shipdate < DATE '{_SPLIT.end}' + 1 THEN 'test' END AS split
FROM lineitem""")
def split_label(d):
    return d.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", _SPLIT.label(F.col("l_shipdate")).alias("split"))


@query("flt_bbox", "SELECT station, lat, lon FROM stations WHERE lat BETWEEN 40.5 AND 45 AND lon BETWEEN -79.8 AND -71.8", ("stations",))
def flt_bbox(d):
    return filters.in_box(d.stations(), geo.Box(40.5, 45.0, -79.8, -71.8)).select("station", "lat", "lon")


@query("flt_dates", """
SELECT valid_time, stid, fh, metvar, row_key FROM predictions
WHERE valid_time > TIMESTAMP '1996-01-01' AND valid_time < TIMESTAMP '1997-01-01'""", ("predictions",))
def flt_dates(d):
    return longs(filters.between_dates(d.predictions(), "1996-01-01", "1997-01-01"), "fh").select("valid_time", "stid", "fh", "metvar", "row_key")


@query("flt_test_period", """
SELECT valid_time, stid, fh, metvar, row_key FROM predictions
WHERE valid_time BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2001-06-30'""", ("predictions",))
def flt_test_period(d):
    return longs(filters.between_dates(d.predictions(), "2000-01-01", "2001-06-30", strict=False), "fh").select(
        "valid_time", "stid", "fh", "metvar", "row_key")


@query("flt_top_of_hour", """
SELECT event_id, station, time_5M, hour(time_5M) % 3 = 0 AS third
FROM raw_obs WHERE minute(time_5M) = 0""", ("raw_obs",))
def flt_top_of_hour(d):
    obs = d.raw_obs()
    return filters.top_of_hour(obs).select("event_id", "station", "time_5M", (F.hour("time_5M") % 3 == 0).alias("third"))


@query("flt_outlier", """
SELECT row_key, fh, stid, price FROM predictions
WHERE abs(round(model_output - actual, 6)) <= 4 AND abs(round(model_output - actual, 6)) > 1 AND actual <> 0""", ("predictions",))
def flt_outlier(d):
    rows = filters.nonzero(d.predictions(), "actual")
    return longs(filters.error_within(rows, F.round(F.col("model_output") - F.col("actual"), 6), at_most=4, above=1), "fh").select(
        "row_key", "fh", "stid", "price")


@query("flt_range", "SELECT station, time, CAST(\"range\" AS BIGINT) AS height FROM profiles WHERE \"range\" <= 5000", ("profiles",))
def flt_range(d):
    return filters.below_range(d.profiles()).select("station", "time", F.col("range").cast("long").alias("height"))


@query("flt_states", """
SELECT station, count(*) AS states, string_agg(state, ',' ORDER BY state) AS names FROM (
  SELECT station, COALESCE(b.s, 'NY') AS state FROM stations LEFT JOIN (VALUES
   """ + ",".join(f"('{s}',{b[0]},{b[1]},{b[2]},{b[3]})" for s, b in filters.STATE_BOXES.items()) + """
  ) b(s, a, z, w, e) ON lat <= z AND lat + 0.5 >= a AND lon <= e AND lon + 0.5 >= w) GROUP BY station""", ("stations",))
def flt_states(d):
    lat, lon = F.col("lat"), F.col("lon")
    states = filters.states_of_box(lat, lat + 0.5, lon, lon + 0.5)
    return d.stations().select("station", F.size(states).cast("long").alias("states"), F.concat_ws(",", F.array_sort(states)).alias("names"))


@query("stitch_valid_time", """
SELECT latitude, longitude, time, fh, valid_time FROM grid WHERE valid_time = time + to_hours(CAST(fh AS INT))""", ("grid",))
def stitch_valid_time(d):
    return longs(filters.valid_at_lead(d.grid()), "fh").select("latitude", "longitude", "time", "fh", "valid_time")


@query("station_filters", """
SELECT station, valid_time FROM hourly WHERE station NOT IN ('S1', 'S2', 'S3')
  AND station IN (SELECT station FROM stations WHERE elev > 0)""", ("hourly", "stations"))
def station_filters(d):
    rows = filters.exclude(d.hourly(), ["S1", "S2", "S3"])
    return filters.members(rows, d.stations().where(F.col("elev") > 0)).select("station", "valid_time")


@query("project_columns", f"""
SELECT valid_time, {R('t2m')} AS t2m_a, {R('u_total')} AS u_total_a, {R('tp')} AS tp_a, fh AS fh_a, station AS station_a,
       -999.0::DOUBLE AS cape, 0.0::DOUBLE AS snow
FROM forecasts""", ("forecasts",))
def project_columns(d):
    df = d.forecasts().withColumns({c: r(c) for c in ("t2m", "u_total", "tp")})
    slim = projections.drop_columns(df, projections.FORECAST_BOOKKEEPING)
    named = projections.add_suffix(slim, "a")
    full = projections.complete_schema(named, {"cape": -999.0, "snow": 0.0, "old_qc": None})
    return projections.drop_matching(full, "_qc$")


@query("keep_columns", f"""
SELECT time, valid_time, latitude, longitude, {R('t2m')} AS t2m, {R('d2m')} AS d2m, {R('u10')} AS u10, {R('v10')} AS v10, {R('tp')} AS tp
FROM grid""", ("grid",))
def keep_columns(d):
    kept = projections.keep_model_columns(d.grid(), "HRRR")
    return kept.withColumns({c: r(c) for c in ("t2m", "d2m", "u10", "v10", "tp")})


@query("image_path", """
SELECT station, valid_time, concat_ws('/', '/images', strftime(valid_time, '%Y'), station,
       station || '_' || strftime(valid_time, '%Y') || '_' || strftime(valid_time, '%m%d%H') || '.npy') AS path
FROM hourly""", ("hourly",))
def image_path(d):
    return d.hourly().select("station", "valid_time", projections.image_path("/images").alias("path"))


@query("loss_weighted_mae", f"""
SELECT fh, metvar, {R('avg(pow(abs(actual - model_output) + 1, 2) * abs(actual - model_output))')} AS loss FROM predictions GROUP BY 1, 2""",
       ("predictions",))
def loss_weighted_mae(d):
    from verimet.operators.uncertainty import outlier_weighted_mae

    return d.predictions().groupBy("fh", "metvar").agg(
        r(outlier_weighted_mae(F.col("actual") - F.col("model_output"))).alias("loss"))


