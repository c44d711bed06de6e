"""Round trips through the readers and writers (files go to the shared work folder)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verimet.catalog.registry import R, longs, query, r, rounded
from verimet.operators import setops
from verimet.sources import lookups, sinks, tables
from verimet.session import work_path


@query("read_forecasts", f"""
SELECT station, time, CAST(fh AS BIGINT) AS fh, {R('t2m')} AS t2m, coalesce(CASE WHEN fh <> 3 OR u_total > 2 THEN {R('u_total')} END, -999) AS u_total
FROM forecasts WHERE fh = 3 AND month(valid_time) = 1""", ("forecasts",))
def read_forecasts(d):
    path = work_path(d.spark, "forecasts")
    sinks.write_forecasts(d.forecasts().withColumn("u_total", F.when((F.col("fh") != 3) | (F.col("u_total") > 2), F.col("u_total"))), path)
    out = tables.read_forecasts(d.spark, path, fh=3, months=[1])
    return rounded(longs(out, "fh"), "t2m", "u_total").select("station", "time", "fh", "t2m", "u_total")


@query("read_columns", f"""
SELECT station, valid_time, {R('coalesce(t2m, -999)')} AS t2m FROM forecasts WHERE fh IN (2, 5)""", ("forecasts",))
def read_columns(d):
    """Five columns of the stored forecasts; no other column is read."""
    path = work_path(d.spark, "forecast-columns")
    sinks.write_forecasts(d.forecasts(), path)
    parts = [tables.read_forecasts(d.spark, path, fh=fh, columns=["station", "valid_time", "t2m", "fh", "time"]) for fh in (2, 5)]
    return rounded(parts[0].unionByName(parts[1]).select("station", "valid_time", "t2m"), "t2m")


@query("write_daily", """
SELECT CAST(fh AS BIGINT) AS fh, CAST(valid_time AS DATE) AS date, count(*) AS n FROM grid
WHERE valid_time = time + to_hours(CAST(fh AS INT)) GROUP BY 1, 2""", ("grid",))
def write_daily(d):
    from verimet.operators.filters import valid_at_lead

    path = work_path(d.spark, "daily")
    sinks.write_daily(valid_at_lead(d.grid()), path)
    return longs(d.spark.read.parquet(path).groupBy("fh", "date").agg(F.count(F.lit(1)).alias("n")), "fh")


@query("daily_sorted", """
SELECT CAST(fh AS BIGINT) AS fh, CAST(valid_time AS DATE) AS date, count(*) AS n, CAST(0 AS BIGINT) AS out_of_order FROM grid GROUP BY 1, 2""", ("grid",))
def daily_sorted(d):
    """Rows of each daily file in the order they lie there: none comes before its predecessor."""
    from pyspark.sql.window import Window

    path = work_path(d.spark, "daily-sorted")
    sinks.write_daily(d.grid(), path)
    rows = d.spark.read.parquet(path).select("fh", "date", F.struct("valid_time", "latitude", "longitude").alias("k"),
                                             F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("i"))
    before = F.lag("k").over(Window.partitionBy("fh", "date", "file").orderBy("i"))
    marked = rows.withColumn("bad", F.coalesce(before > F.col("k"), F.lit(False)).cast("long"))
    return longs(marked.groupBy("fh", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("out_of_order")), "fh")


@query("partition_status", """
WITH w AS (SELECT CAST(fh AS BIGINT) AS fh, CAST(year(valid_time) AS BIGINT) AS year, CAST(month(valid_time) AS BIGINT) AS month, count(*) AS c FROM predictions GROUP BY 1, 2, 3)
SELECT fh, year, month, CASE WHEN fh <= 3 AND year < 1999 THEN c ELSE 0 END AS rows, CASE WHEN fh <= 3 AND year < 1999 THEN 'done' ELSE 'pending' END AS status FROM w""",
       ("predictions",))
def partition_status(d):
    path = work_path(d.spark, "status")
    by = ["fh", "year", "month"]
    work = longs(sinks.with_calendar(d.predictions()).select(*by).distinct(), "year", "month")
    finished = d.predictions().where((F.col("fh") <= 3) & (F.year("valid_time") < 1999))
    sinks.write_partitions(sinks.with_calendar(finished).select("stid", *by), path, by)
    return longs(sinks.partition_status(d.spark, work, path, by), "rows")


@query("airport_text", """
SELECT concat('S', user_id) AS station, event_id, CASE WHEN event_type <> 'click' THEN value END AS tmpf,
       date_trunc('minute', ts) AS valid FROM events""")
def airport_text(d):
    path = work_path(d.spark, "airport")
    kind = F.col("event_type")
    line = F.concat_ws(
        ",", F.concat(F.lit("S"), "user_id"), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("1"), F.lit("2"), F.col("event_id"),
        F.when(kind != "click", F.col("value").cast("string")).otherwise("M"), *[F.lit("M")] * 10, F.lit("0.0001"),
    )
    lines = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("# note\n"), line)).otherwise(line)
    d.table("events").select(lines.alias("value")).write.text(path)
    rows = lookups.read_airport_text(d.spark, path)
    return rows.select("station", F.col("elevation").cast("long").alias("event_id"), F.col("tmpf").cast("double").alias("tmpf"),
                       F.to_timestamp_ntz("valid", F.lit("yyyy-MM-dd HH:mm")).alias("valid"))


@query("airport_lines", """
SELECT concat('S', user_id) AS station, event_id, CASE WHEN event_type <> 'click' THEN value END AS tmpf FROM events WHERE event_id % 50 <> 0""")
def airport_lines(d):
    line = F.concat_ws(
        ",", F.concat(F.lit("S"), "user_id"), F.date_format("ts", "yyyy-MM-dd HH:mm"), *[F.lit("M")] * 3,
        F.when(F.col("event_type") != "click", F.col("value").cast("string")).otherwise("M"), *[F.lit("M")] * 11,
    )
    text = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("#"), line)).otherwise(line)
    return lookups.parse_airport_lines(d.table("events").select("event_id", text.alias("value"))).select(
        "station", "event_id", F.col("tmpf").cast("double").alias("tmpf"))


@query("station_csv", "SELECT station, lat, lon, elev FROM stations", ("stations",))
def station_csv(d):
    from verimet.schemas import STATION

    path = work_path(d.spark, "stations")
    d.stations().select(F.col("station").alias("stid"), F.col("lat").alias("lat [degrees]"), F.col("lon").alias("lon [degrees]"), "elev").write.csv(path, header=True)
    return lookups.read_csv(d.spark, path, STATION, {"stid": "station", "lat [degrees]": "lat", "lon [degrees]": "lon"})


@query("tagged_predictions", f"""
SELECT stid, CAST(fh AS BIGINT) AS fh, metvar, count(*) AS n, {R('avg(model_output)')} AS model_output FROM predictions GROUP BY 1, 2, 3""", ("predictions",))
def tagged_predictions(d):
    path = work_path(d.spark, "outputs")
    rows = d.predictions().withColumn("series", F.concat_ws("_", F.concat(F.lit("fh"), "fh"), "metvar", F.lit("inference_out")))
    sinks.write_partitions(rows.select("stid", "valid_time", "model_output", "series"), path, ["series"])
    stored = d.spark.read.parquet(path).withColumn("_path", F.col("_metadata.file_path"))
    tagged = tables.tag_from_path(stored, "_path")
    return tagged.groupBy("stid", "fh", "metvar").agg(F.count(F.lit(1)).alias("n"), r(F.avg("model_output")).alias("model_output"))


@query("station_outputs", f"""
SELECT stid, CAST(fh AS BIGINT) AS fh, count(*) AS n, {R('avg(actual)')} AS target_error FROM predictions WHERE metvar = 't2m' GROUP BY 1, 2""", ("predictions",))
def station_outputs(d):
    path = work_path(d.spark, "station-outputs")
    kinds = F.explode(F.array(F.lit("linear"), F.lit("linear_normal"), F.lit("raw")))
    rows = d.predictions().withColumn("kind", kinds).withColumn(
        "series", F.concat_ws("_", F.lit("S"), F.concat(F.lit("fh"), "fh"), "metvar", F.lit("HRRR_ml_output"), "kind"))
    sinks.write_partitions(rows.select("stid", F.col("actual").alias("target_error_lead_0"), "series"), path, ["series"])
    out = tables.read_station_outputs(d.spark, path, "t2m")
    return out.groupBy("stid", "fh").agg(F.count(F.lit(1)).alias("n"), r(F.avg("target_error")).alias("target_error"))


_LAST = """SELECT valid_time, stid, CAST(fh AS BIGINT) AS fh, metvar, row_key, price FROM (
  SELECT *, row_number() OVER (PARTITION BY valid_time, stid, fh, metvar ORDER BY side DESC, row_key DESC, price DESC) AS rn
  FROM (SELECT *, row_key % 2 AS side FROM predictions)) WHERE rn = 1"""
_KEYS = ["valid_time", "stid", "fh", "metvar"]


def _two_batches(d):
    rows = d.predictions().select(*_KEYS, "row_key", "price")
    return rows.where(F.col("row_key") % 2 == 0), rows.where(F.col("row_key") % 2 == 1)


@query("upsert_table", _LAST, ("predictions",))
def upsert_table(d):
    path = work_path(d.spark, "upsert")
    first, second = _two_batches(d)
    by = ["fh", "metvar"]
    for batch in (first, second, second):  # the repeat must not change anything
        sinks.upsert_partitions(batch, path, _KEYS, by, ["row_key", "price"])
    return longs(d.spark.read.parquet(path), "fh").select(*_KEYS, "row_key", "price")


@query("append_batches", _LAST, ("predictions",))
def append_batches(d):
    path = work_path(d.spark, "batches")
    for number, batch in enumerate(_two_batches(d)):
        sinks.append_batch(batch, path, number)
    sinks.append_batch(_two_batches(d)[1], path, 1)  # retried batch replaces itself
    return sinks.read_latest(d.spark, path, _KEYS, ["row_key", "price"]).select(*_KEYS, "row_key", "price")


@query("resume_work", """
SELECT fh, year, month FROM (SELECT DISTINCT CAST(fh AS BIGINT) AS fh, CAST(year(valid_time) AS BIGINT) AS year, CAST(month(valid_time) AS BIGINT) AS month FROM predictions)
WHERE NOT (fh <= 3 AND year < 1999)""", ("predictions",))
def resume_work(d):
    path = work_path(d.spark, "done")
    work = longs(sinks.with_calendar(d.predictions()).select("fh", "year", "month").distinct(), "year", "month")
    finished = d.predictions().where((F.col("fh") <= 3) & (F.year("valid_time") < 1999))
    sinks.write_partitions(sinks.with_calendar(finished).select("stid", "fh", "year", "month"), path, ["fh", "year", "month"])
    done = sinks.done_partitions(d.spark, path, ["fh", "year", "month"], work.schema)
    return setops.pending_work(work, longs(done, "fh", "year", "month"), ["fh", "year", "month"])


@query("month_list", """
SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS month FROM lineitem""")
def month_list(d):
    span = d.table("lineitem").agg(F.min("l_shipdate").cast("date").alias("start"), F.max("l_shipdate").cast("date").alias("end"))
    return tables.months_of(span, "start", "end").select("month")


@query("request_chunks", """
WITH s AS (SELECT l_suppkey AS station, CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS z FROM lineitem GROUP BY 1)
SELECT station, CAST(f AS DATE) AS "from", least(CAST(f AS DATE) + 30, z + 1) AS "to" FROM (SELECT *, unnest(generate_series(a, z, INTERVAL 30 DAY)) AS f FROM s)""")
def request_chunks(d):
    spans = d.table("lineitem").groupBy(F.col("l_suppkey").alias("station")).agg(
        F.min("l_shipdate").cast("date").alias("a"), F.max("l_shipdate").cast("date").alias("z"))
    return tables.request_chunks(spans, "a", "z").select("station", "from", "to")


@query("division_files", f"""
SELECT climate_division_name, stid AS station, CAST(fh AS BIGINT) AS fh, {R('avg(abs(model_output - actual))')} AS mae
FROM predictions JOIN stations s ON s.station = stid WHERE actual <> 0 GROUP BY 1, 2, 3""", ("predictions", "stations"))
def division_files(d):
    from verimet.operators.verify import division_scores

    path = work_path(d.spark, "divisions")
    sinks.write_divisions(division_scores(d.predictions(), d.stations()), path)
    return rounded(d.spark.read.parquet(path), "mae").select("climate_division_name", "station", "fh", "mae")


@query("summary_csv", f"""
SELECT month, {R('avg(s)')} AS error FROM (SELECT CAST(month(valid_time) AS BIGINT) AS month, fh, avg(abs(model_output - actual)) AS s FROM predictions GROUP BY 1, 2) GROUP BY 1""",
       ("predictions",))
def summary_csv(d):
    from verimet.operators.summarise import error_by_period

    path = work_path(d.spark, "summary")
    sinks.write_summary_csv(error_by_period(d.compared(), "month", "abs", limit=100.0), path)
    return rounded(d.spark.read.csv(path, schema="month long, error double", header=True), "error")


@query("image_files", """
SELECT station, CAST(year(time) AS BIGINT) AS year, count(DISTINCT date_trunc('hour', time)) AS images FROM profiles WHERE "range" <= 5000 GROUP BY 1, 2""", ("profiles",))
def image_files(d):
    from verimet.plans.cleaning import profiler_images

    path = work_path(d.spark, "images")
    sinks.write_images(profiler_images(d.profiles(), ["temperature"]), path)
    return longs(d.spark.read.parquet(path).groupBy("station", "year").agg(F.count(F.lit(1)).alias("images")), "year")
