"""Tables that are kept up: versions, running scores, failed work, footers, buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from verimet.catalog.registry import R, longs, query, r, rounded
from verimet.operators import features, isolation, running_scores, scoring, verify
from verimet.session import work_path
from verimet.sources import sinks, snapshots, tables

_KEYS = ["valid_time", "stid", "fh", "metvar"]


@query("snapshot_upsert", """
SELECT valid_time, stid, CAST(fh AS BIGINT) AS fh, metvar, row_key, price FROM (
  SELECT *, row_number() OVER (PARTITION BY valid_time, stid, fh, metvar ORDER BY row_key % 2 DESC, row_key DESC, price DESC) AS rn FROM predictions) WHERE rn = 1""",
       ("predictions",))
def snapshot_upsert(d):
    """Two batches merged into a table whose versions change at once; a writer from the first version loses and starts over."""
    path = work_path(d.spark, "versions")
    rows = d.predictions().select(*_KEYS, "row_key", "price")
    put = lambda batch, base=None: snapshots.upsert_version(batch, path, _KEYS, ["fh", "metvar"], ["row_key", "price"], base)
    first = put(rows.where(F.col("row_key") % 2 == 0))
    odd = rows.where(F.col("row_key") % 2 == 1)
    put(odd.where(F.col("fh") <= 3), first)
    try:
        put(odd.where(F.col("fh") > 3), first)
    except snapshots.VersionConflict:
        put(odd.where(F.col("fh") > 3))
    return longs(snapshots.read_version(d.spark, path), "fh").select(*_KEYS, "row_key", "price")


_CORRECTED = "(SELECT *, difference + CASE WHEN day(valid_time) % 5 = 0 THEN 0.5 ELSE 0 END AS e FROM evaluated)"


@query("running_scores", f"""
SELECT stid, CAST(fh AS BIGINT) AS fh, metvar, {R('avg(abs(e))', 5)} AS mae, {R('sqrt(avg(e * e))', 5)} AS rmse, {R('avg(e)', 5)} AS bias, count(*) AS n
FROM {_CORRECTED} GROUP BY 1, 2, 3""", ("evaluated",))
def running_scores_(d):
    """Scores from ten appended batches of some months each, the last of which comes twice and corrects rows of all others."""
    path, by = work_path(d.spark, "scores"), ["stid", "fh", "metvar"]
    part = F.pmod(F.floor((F.year("valid_time") * 12 + F.month("valid_time")) / 10), F.lit(9)).cast("int")
    rows, source = d.evaluated().select(*_KEYS, "model_output", "actual").withColumn("part", part), work_path(d.spark, "score-source")
    rows.write.partitionBy("part").parquet(source)  # a batch reads its own rows alone
    rows = d.spark.read.schema(rows.schema).parquet(source)
    for number in range(9):
        running_scores.add_batch(rows.where(F.col("part") == number), path, number, by)
    late = rows.where(F.dayofmonth("valid_time") % 5 == 0).withColumn("model_output", F.col("model_output") + 0.5)
    for _ in range(2):
        running_scores.add_batch(late, path, 9, by)
    scores = running_scores.current_scores(d.spark, path, by)
    return longs(rounded(scores, "mae", "rmse", "bias", digits=5), "fh", "n")


@query("failure_status", """
SELECT CAST(fh AS BIGINT) AS fh, metvar, CASE WHEN fh = 7 OR fh = 3 AND metvar = 'tp' THEN 0 ELSE count(*) END AS rows,
       CASE WHEN fh = 7 THEN 'pending' WHEN fh = 3 AND metvar = 'tp' THEN 'failed' ELSE 'done' END AS status,
       CASE WHEN fh = 3 AND metvar = 'tp' THEN 'ValueError: no model for tp at 3' END AS message FROM predictions GROUP BY fh, metvar""", ("predictions",))
def failure_status(d):
    """Work by (fh, metvar): some keys fail at first, one fails again, and one isn't tried."""
    path, by = work_path(d.spark, "guarded"), ["fh", "metvar"]
    rows = d.predictions().select("fh", "metvar", "stid", "model_output")
    schema = T.StructType([T.StructField("stid", T.StringType()), T.StructField("scored", T.DoubleType())])

    def step(broken):
        def run(part):
            fh, metvar = part["fh"].iloc[0], part["metvar"].iloc[0]
            if (fh, metvar) in broken:
                raise ValueError(f"no model for {metvar} at {fh}")
            return part.assign(scored=part["model_output"] * 2)
        return run

    tried = rows.where(F.col("fh") < 7)
    isolation.run_guarded(tried, path, by, step({(3, "tp"), (5, "t2m"), (5, "u_total")}), schema)
    isolation.run_guarded(isolation.open_rows(tried, path, by), path, by, step({(3, "tp")}), schema)
    return longs(isolation.work_status(d.spark, rows.select(*by).distinct(), path, by), "fh", "rows")


@query("unreadable_files", "SELECT DISTINCT concat('cut-', l_linenumber, '.parquet') AS file FROM lineitem")
def unreadable_files(d):
    """A folder with good files and, for every line number, one that lost its end."""
    path = work_path(d.spark, "footers")
    rows = d.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    sinks.write_partitions(rows, path, ["l_linenumber"])
    cuts = d.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    first = cuts.groupBy(F.regexp_extract("path", r"l_linenumber=(\d+)", 1).alias("k")).agg(F.min_by("content", "path").alias("content"))

    def cut(batches):
        from verimet.sources.footers import local_store

        store, root = local_store(path)
        for batch in batches:
            for k, content in zip(batch["k"], batch["content"], strict=True):
                with store.open_output_stream(f"{root}/cut-{k}.parquet") as out:
                    out.write(content[:-int(k) - 3])
            yield batch[["k"]]

    first.mapInPandas(cut, "k string").count()
    return tables.unreadable_files(d.spark, path).select(F.element_at(F.split("path", "/"), -1).alias("file"))


def _bucketed(d, frame, keys):
    """`frame` written as a table of 8 buckets or, for larger tables, more, and read back."""
    name = f"buckets_{uuid.uuid4().hex}"
    sinks.write_bucketed(frame, name, work_path(d.spark, name), keys, d.buckets(8))
    return d.spark.table(name)


@query("align_bucketed", f"""
SELECT f.station, f.time, f.valid_time, CAST(f.fh AS BIGINT) AS fh, {R('t2m')} AS t2m, {R('tair')} AS tair, {R('t2m - tair')} AS target_error
FROM forecasts f JOIN hourly h USING (station, valid_time)""", ("forecasts", "hourly"))
def align_bucketed(d):
    """Alignment of tables that lie in buckets of (station, valid_time)."""
    keys = ["station", "valid_time"]
    rows = features.align(_bucketed(d, d.forecasts(), keys).hint("merge"), _bucketed(d, d.hourly(), keys)).withColumn("target_error", features.forecast_error("t2m"))
    return rounded(rows.select("station", "time", "valid_time", "fh", "t2m", "tair", "target_error"), "t2m", "tair", "target_error")


@query("eval_rows_bucketed", f"""
SELECT valid_time, stid, CAST(fh AS BIGINT) AS fh, metvar, {R('model_output')} AS model_output, {R('actual')} AS actual, {R('model_output - actual')} AS difference
FROM evaluated WHERE actual <> 0""", ("evaluated",))
def eval_rows_bucketed(d):
    """Predictions and realised errors that lie in buckets of all four keys."""
    ev, keys = d.evaluated(), list(verify.KEYS)
    guesses = _bucketed(d, ev.select(*keys, "model_output"), keys)
    realised = _bucketed(d, ev.where(F.col("actual") != 0).select(*keys, "actual"), keys)
    return rounded(verify.evaluation_rows(guesses.hint("merge"), realised), "model_output", "actual", "difference")


@query("fit_many_features", f"""
WITH s AS (SELECT stid, fh, count(*) AS n, var_pop(model_output) AS v1, var_pop(row_key % 7) AS v2, covar_pop(model_output, row_key % 7) AS c,
           covar_pop(model_output, actual) AS a1, covar_pop(row_key % 7, actual) AS a2, avg(model_output) AS m1, avg(row_key % 7) AS m2, avg(actual) AS m
           FROM predictions GROUP BY 1, 2),
b AS (SELECT *, (a1 * v2 - a2 * c) / (v1 * v2 - c * c) AS b1, (a2 * v1 - a1 * c) / (v1 * v2 - c * c) AS b2 FROM s WHERE n >= 5 AND v1 * v2 - c * c > 0.01)
SELECT stid, CAST(fh AS BIGINT) AS fh, {R('m - b1 * m1 - b2 * m2', 4)} AS intercept, {R('b1', 4)} AS first_slope, {R('b2', 4)} AS second_slope FROM b""", ("predictions",))
def fit_many_features(d):
    """Least squares from packed triangles of products; groups whose features don't vary are left out of the comparison."""
    p = d.predictions().withColumn("second", (F.col("row_key") % 7).cast("double"))
    models = scoring.fit_many_features(p.select("stid", "fh", F.array("model_output", "second").alias("x"), "actual"), ["stid", "fh"], "x", "actual")
    spread = p.groupBy("stid", "fh").agg(
        F.count(F.lit(1)).alias("n"), (F.var_pop("model_output") * F.var_pop("second") - F.pow(F.covar_pop("model_output", "second"), 2.0)).alias("det"))
    known = models.join(spread.where("n >= 5 AND det > 0.01"), ["stid", "fh"])
    return known.select("stid", "fh", *[r(F.col("params")[i], 4).alias(n) for i, n in enumerate(("intercept", "first_slope", "second_slope"))])
