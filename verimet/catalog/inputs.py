"""Weather-shaped inputs derived from the driver tables, in Spark and in SQL.

Every input is computed from the tables it reads, so its size grows with them.
Stations come from suppliers, hourly observations, forecasts, grids and
predictions from line items, raw reports and profiles from events, sampled
predictions from embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verimet.functions.clock import hours_interval
from verimet.operators.sequences import running_total

EPOCH = "2024-01-01 00:00:00"
HOURS = 240
RUN_LEADS = 6
GRID_STEP = 0.25
GRID_LEADS = 3
#: Line items whose rows share a bucket, about.
BUCKET_ITEMS = 500_000

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    VIEWS[name] = (needs, sql)


def with_views(sql: str, names: tuple[str, ...]) -> str:
    """Put the CTEs of `names` (and of what they need) in front of `sql`."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for n in VIEWS[name][0]:
            add(n)
        order.append(name)

    for name in names:
        add(name)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


_view("stations", """
SELECT concat('S', s_suppkey) AS station,
       CAST(38 + ((s_suppkey*37)%100)/10.0 AS DOUBLE) AS lat,
       CAST(-80 + ((s_suppkey*53)%100)/10.0 AS DOUBLE) AS lon,
       s_acctbal AS elev, concat('DIV_', n_regionkey) AS climate_division_name, s_suppkey
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")

_view("geo", """
SELECT station, s_suppkey%5 AS lulc_cat, s_suppkey%4 AS elev_cat, s_suppkey%3 AS slope_cat FROM stations""", ("stations",))

_view("calibration", """
SELECT station, CAST(f.fh AS BIGINT) AS forecast_hour, CAST(1 + f.fh/100.0 AS DOUBLE) AS alpha, CAST((s_suppkey%7)/10.0 AS DOUBLE) AS diff
FROM stations, (SELECT unnest([1,2,3,4,5,6,7]) AS fh) f WHERE s_suppkey % 2 = 0""", ("stations",))

# One station per user; times run ten times faster, so station-hours hold several reports.
_view("reports", """
SELECT concat('S', user_id) AS station,
       TIMESTAMP '2024-01-01' + to_microseconds((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 10) AS seen_at, events.*
FROM events""")

_view("raw_obs", """
SELECT station, seen_at AS time_5M, value AS tair,
       CASE WHEN event_type='error' THEN NULL ELSE value/10 END AS wspd_sonic,
       CAST(json_extract_string(props,'$.k') AS DOUBLE) AS relh,
       980 + value/10 AS pres, CAST(user_id%10 AS DOUBLE) * 30 AS elev, event_id
FROM reports""", ("reports",))

_view("gauge", """
SELECT station, seen_at AS time_5M, event_id,
       CASE WHEN event_type='error' THEN NULL ELSE value/10 END AS wspd_sonic, value AS tair,
       CAST(json_extract_string(props,'$.k') AS DOUBLE) AS relh,
       CAST(sum(CAST(json_extract_string(props,'$.k') AS INT)) OVER
            (PARTITION BY station ORDER BY seen_at, event_id ROWS UNBOUNDED PRECEDING) % 1000 AS DOUBLE) AS precip_total
FROM reports""", ("reports",))

_view("hourly", """
SELECT concat('S', l_suppkey) AS station,
       TIMESTAMP '2024-01-01' + to_hours(CAST((l_orderkey*7 + l_partkey*3 + l_linenumber) % 240 AS INT)) AS valid_time,
       CASE WHEN min(l_linenumber) = 7 THEN NULL ELSE avg(l_quantity) / 2 END AS tair,
       avg(round(l_discount * 100)) AS wspd_sonic_mean, avg(round(l_tax * 100)) AS precip_total, count(*) AS n
FROM lineitem GROUP BY 1, 2""")

_view("runs", """
SELECT l_suppkey, TIMESTAMP '2024-01-01' + to_hours(CAST((l_orderkey*5 + l_partkey + l_linenumber*11) % 240 AS INT)) AS time,
       max(l_quantity) AS q, max(l_linenumber) AS ln, min(l_partkey) AS pk
FROM lineitem GROUP BY 1, 2""")

_view("forecasts", """
SELECT concat('S', l_suppkey) AS station, time, CAST(f.fh AS BIGINT) AS fh, time + to_hours(CAST(f.fh AS INT)) AS valid_time,
       q / 2 + f.fh * 0.5 AS t2m, (pk % 11) / 2.0 + f.fh * 0.25 AS u_total,
       CAST(ln * f.fh * 0.5 - CASE WHEN f.fh = 4 AND ln > 4 THEN 8 ELSE 0 END AS DOUBLE) AS tp
FROM runs, (SELECT unnest([1,2,3,4,5,6]) AS fh) f""", ("runs",))

_view("predictions", """
SELECT l_shipdate + to_hours(CAST(l_orderkey%24 AS INT)) AS valid_time,
       concat('S', l_suppkey) AS stid, CAST(l_linenumber AS BIGINT) AS fh,
       CASE l_returnflag WHEN 'A' THEN 't2m' WHEN 'N' THEN 'u_total' ELSE 'tp' END AS metvar,
       (l_quantity-25)/5 AS model_output,
       (l_quantity-25)/5 + l_discount*100 - 5 AS actual, l_orderkey AS row_key, l_extendedprice AS price
FROM lineitem""")

_view("evaluated", """
SELECT valid_time, stid, fh, metvar, max(model_output) AS model_output, max(actual) AS actual,
       max(model_output) - max(actual) AS difference
FROM predictions GROUP BY 1, 2, 3, 4""", ("predictions",))

_view("samples", """
SELECT vec_id, label, embedding[1:32] AS mu, embedding[33:64] AS logvar, (label-4.5)/20 AS y_true FROM embeddings""")

_view("profiles", """
SELECT station, seen_at AS time, 100*CAST(json_extract_string(props,'$.k') AS INT) AS "range",
       200 + value AS temperature, 190 + value/2 AS dewpoint, value/2 AS relative_humidity
FROM reports""", ("reports",))

_view("grid", """
SELECT CAST(38 + i * 0.25 AS DOUBLE) AS latitude, CAST(280 + j * 0.25 AS DOUBLE) AS longitude, i, j,
       TIMESTAMP '2024-01-01' + to_hours(CAST(run AS INT)) AS time, CAST(f.fh AS BIGINT) AS fh,
       TIMESTAMP '2024-01-01' + to_hours(CAST(run + f.fh + CASE WHEN (i + j) % 50 = 0 AND f.fh = 2 THEN 1 ELSE 0 END AS INT)) AS valid_time,
       CASE WHEN (i * j) % 97 = 96 THEN NULL ELSE 250 + q + f.fh END AS t2m, 245 + q AS d2m,
       (q - 25) / 5 AS u10, CAST(pk % 7 - 3 AS DOUBLE) AS v10, CAST(f.fh * ln * 0.5 AS DOUBLE) AS tp
FROM (SELECT l_partkey % least(m, 200) AS i, l_orderkey % least(m, 1400) AS j, l_linenumber - 1 + 7 * (l_suppkey % layers) AS run, max(l_quantity) AS q,
             max(l_suppkey) % 5 AS ln, min(l_partkey) AS pk
      FROM lineitem, (SELECT greatest(41, CAST(floor(sqrt(max(l_partkey))) AS BIGINT)) AS m, 1 + max(l_partkey) // 40000 AS layers FROM lineitem) e GROUP BY 1, 2, 3) g, (SELECT unnest([1,2,3]) AS fh) f""")

_view("mask", """
SELECT DISTINCT latitude, longitude, CASE WHEN (i*j)%3 > 0 THEN 1 ELSE 0 END AS lsm FROM grid""", ("grid",))

_view("grid_places", """
SELECT station, floor(lat/0.25 + 0.5) * 0.25 AS lat, floor(lon/0.25 + 0.5) * 0.25 AS lon FROM stations""", ("stations",))

_view("neighbours", """
SELECT station, rank, neighbour, km FROM (
  SELECT a.station, b.station AS neighbour, a.chord,
         2 * 6371.0 * asin(least(1.0, a.chord / 2)) AS km,
         row_number() OVER (PARTITION BY a.station ORDER BY CASE WHEN a.station = b.station THEN 0 ELSE 1 END,
                            floor(a.chord * 1e9), b.station) AS rank
  FROM (SELECT p.station, q.station AS other,
               sqrt(pow(cos(radians(p.lat))*cos(radians(p.lon)) - cos(radians(q.lat))*cos(radians(q.lon)), 2)
                  + pow(cos(radians(p.lat))*sin(radians(p.lon)) - cos(radians(q.lat))*sin(radians(q.lon)), 2)
                  + pow(sin(radians(p.lat)) - sin(radians(q.lat)), 2)) AS chord
        FROM stations p, stations q) a JOIN stations b ON a.other = b.station) WHERE rank <= 4""", ("stations",))

_view("clusters", """
SELECT station AS target, rank - 1 AS slot, neighbour AS station FROM neighbours""", ("neighbours",))


def as_reports(events: DataFrame) -> DataFrame:
    """Events with their station and report time."""
    epoch = F.lit(EPOCH).cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col("ts"))
    seconds = (micros - micros % 10).cast("decimal(20,0)") / F.lit(10_000_000)
    at = epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return events.withColumns({"station": F.concat(F.lit("S"), "user_id"), "seen_at": at})


def _leads(n: int):
    return F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))


class Inputs:
    """The same inputs as DataFrames over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def buckets(self, least: int) -> int:
        """Buckets for tables made from line items, so that one bucket holds as much at every scale (a count from footers)."""
        return max(least, -(-self.table("lineitem").count() // BUCKET_ITEMS))

    def stations(self) -> DataFrame:
        key = F.col("s_suppkey")
        return (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.concat(F.lit("S"), key).alias("station"),
                (F.lit(38) + (key * 37 % 100) / 10.0).alias("lat"),
                (F.lit(-80) + (key * 53 % 100) / 10.0).alias("lon"),
                F.col("s_acctbal").alias("elev"),
                F.concat(F.lit("DIV_"), "n_regionkey").alias("climate_division_name"),
                "s_suppkey",
            )
        )

    def geo(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.stations().select(
            "station", (key % 5).alias("lulc_cat"), (key % 4).alias("elev_cat"), (key % 3).alias("slope_cat")
        )

    def calibration(self) -> DataFrame:
        fh = F.col("forecast_hour")
        return (
            self.stations().where(F.col("s_suppkey") % 2 == 0)
            .select("station", (F.col("s_suppkey") % 7 / 10.0).alias("diff"), F.explode(_leads(7)).alias("forecast_hour"))
            .select("station", fh, (1 + fh / 100.0).alias("alpha"), "diff")
        )

    def _events(self, *columns) -> DataFrame:
        return self.reports().select("station", *columns)

    def reports(self) -> DataFrame:
        return as_reports(self.table("events"))

    def raw_obs(self) -> DataFrame:
        return self._events(
            F.col("seen_at").alias("time_5M"), F.col("value").alias("tair"),
            F.when(F.col("event_type") != "error", F.col("value") / 10).alias("wspd_sonic"),
            F.get_json_object("props", "$.k").cast("double").alias("relh"),
            (980 + F.col("value") / 10).alias("pres"), ((F.col("user_id") % 10).cast("double") * 30).alias("elev"), "event_id",
        )

    def gauge(self) -> DataFrame:
        steps = self._events(
            F.col("seen_at").alias("time_5M"), "event_id",
            F.when(F.col("event_type") != "error", F.col("value") / 10).alias("wspd_sonic"), F.col("value").alias("tair"),
            F.get_json_object("props", "$.k").cast("int").alias("step"),
        )
        total = running_total(steps, ["station"], ["time_5M", "event_id"], "step", F.to_date("time_5M"), "total")
        return total.select(
            "station", "time_5M", "event_id", "wspd_sonic", "tair", F.col("step").cast("double").alias("relh"),
            (F.col("total") % 1000).cast("double").alias("precip_total"),
        )

    def hourly(self) -> DataFrame:
        hour = (F.col("l_orderkey") * 7 + F.col("l_partkey") * 3 + F.col("l_linenumber")) % HOURS
        return (
            self.table("lineitem")
            .groupBy(F.concat(F.lit("S"), "l_suppkey").alias("station"), hour.alias("_h"))
            .agg(
                F.when(F.min("l_linenumber") != 7, F.avg("l_quantity") / 2).alias("tair"),
                F.avg(F.round(F.col("l_discount") * 100)).alias("wspd_sonic_mean"),
                F.avg(F.round(F.col("l_tax") * 100)).alias("precip_total"),
                F.count(F.lit(1)).alias("n"),
            )
            .select("station", (F.lit(EPOCH).cast("timestamp_ntz") + hours_interval(F.col("_h"))).alias("valid_time"),
                    "tair", "wspd_sonic_mean", "precip_total", "n")
        )

    def forecasts(self) -> DataFrame:
        hour = (F.col("l_orderkey") * 5 + F.col("l_partkey") + F.col("l_linenumber") * 11) % HOURS
        runs = (
            self.table("lineitem")
            .groupBy(F.concat(F.lit("S"), "l_suppkey").alias("station"), hour.alias("_h"))
            .agg(F.max("l_quantity").alias("q"), F.max("l_linenumber").alias("ln"), F.min("l_partkey").alias("pk"))
        )
        fh = F.col("fh")
        return (
            runs.withColumn("fh", F.explode(_leads(RUN_LEADS)))
            .withColumn("time", F.lit(EPOCH).cast("timestamp_ntz") + hours_interval(F.col("_h")))
            .select(
                "station", "time", fh, (F.col("time") + hours_interval(fh)).alias("valid_time"),
                (F.col("q") / 2 + fh * 0.5).alias("t2m"),
                (F.col("pk") % 11 / 2.0 + fh * 0.25).alias("u_total"),
                (F.col("ln") * fh * 0.5 - F.when((fh == 4) & (F.col("ln") > 4), 8.0).otherwise(0.0)).alias("tp"),
            )
        )

    def predictions(self) -> DataFrame:
        out = (F.col("l_quantity") - 25) / 5
        return self.table("lineitem").select(
            (F.col("l_shipdate") + hours_interval(F.col("l_orderkey") % 24)).alias("valid_time"),
            F.concat(F.lit("S"), "l_suppkey").alias("stid"), F.col("l_linenumber").cast("long").alias("fh"),
            F.when(F.col("l_returnflag") == "A", "t2m").when(F.col("l_returnflag") == "N", "u_total").otherwise("tp").alias("metvar"),
            out.alias("model_output"), (out + F.col("l_discount") * 100 - 5).alias("actual"),
            F.col("l_orderkey").alias("row_key"), F.col("l_extendedprice").alias("price"),
        )

    def evaluated(self) -> DataFrame:
        """Predictions with one row per key."""
        return self.predictions().groupBy("valid_time", "stid", "fh", "metvar").agg(
            F.max("model_output").alias("model_output"), F.max("actual").alias("actual")
        ).withColumn("difference", F.col("model_output") - F.col("actual"))

    def compared(self) -> DataFrame:
        """All prediction rows with their difference."""
        return self.predictions().withColumn("difference", F.col("model_output") - F.col("actual"))

    def samples(self) -> DataFrame:
        return self.table("embeddings").select(
            "vec_id", "label", F.slice("embedding", 1, 32).alias("mu"), F.slice("embedding", 33, 32).alias("logvar"),
            ((F.col("label") - 4.5) / 20).alias("y_true"),
        )

    def profiles(self) -> DataFrame:
        return self._events(
            F.col("seen_at").alias("time"), (F.get_json_object("props", "$.k").cast("int") * 100).alias("range"),
            (200 + F.col("value")).alias("temperature"), (190 + F.col("value") / 2).alias("dewpoint"),
            (F.col("value") / 2).alias("relative_humidity"),
        )

    def grid(self) -> DataFrame:
        # The extent follows the parts: about four line items a cell at every scale, then more runs.
        items = self.table("lineitem")
        most = items.agg(F.max("l_partkey").alias("p")).scalar()
        side = F.greatest(F.lit(41), F.floor(F.sqrt("_p")).cast("long"))
        layers = 1 + F.floor(F.col("_p") / 40000).cast("long")
        cells = (
            items.withColumn("_p", most)
            .groupBy((F.col("l_partkey") % F.least(side, F.lit(200))).alias("i"), (F.col("l_orderkey") % F.least(side, F.lit(1400))).alias("j"),
                     (F.col("l_linenumber") - 1 + 7 * (F.col("l_suppkey") % layers)).alias("run"))
            .agg(F.max("l_quantity").alias("q"), (F.max("l_suppkey") % 5).alias("ln"), F.min("l_partkey").alias("pk"))
        )
        i, j, fh = F.col("i"), F.col("j"), F.col("fh")
        start = F.lit(EPOCH).cast("timestamp_ntz")
        slip = F.when(((i + j) % 50 == 0) & (fh == 2), 1).otherwise(0)
        return cells.withColumn("fh", F.explode(_leads(GRID_LEADS))).select(
            (38 + i * GRID_STEP).alias("latitude"), (280 + j * GRID_STEP).alias("longitude"), i, j,
            (start + hours_interval(F.col("run"))).alias("time"), fh,
            (start + hours_interval(F.col("run") + fh + slip)).alias("valid_time"),
            F.when((i * j) % 97 != 96, 250 + F.col("q") + fh).alias("t2m"), (245 + F.col("q")).alias("d2m"),
            ((F.col("q") - 25) / 5).alias("u10"), (F.col("pk") % 7 - 3.0).alias("v10"), (fh * F.col("ln") * 0.5).alias("tp"),
        )

    def mask(self) -> DataFrame:
        return self.grid().select(
            "latitude", "longitude", F.when(F.col("i") * F.col("j") % 3 > 0, 1).otherwise(0).alias("lsm")
        ).distinct()

    def grid_places(self) -> DataFrame:
        return self.stations().select(
            "station", *[(F.floor(F.col(c) / 0.25 + 0.5) * 0.25).alias(c) for c in ("lat", "lon")]
        )

    def clusters(self) -> DataFrame:
        from verimet.operators.spatial import station_clusters

        return station_clusters(self.stations())
