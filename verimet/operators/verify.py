"""Predictions against realised errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verimet.operators.filters import error_within, exclude, nonzero
from verimet.operators.quantiles import exact_quantiles
from verimet.operators.setops import hash_join

KEYS = ("valid_time", "stid", "fh", "metvar")


def evaluation_rows(
    predictions: DataFrame, realised: DataFrame, how: str = "inner", metvars: Sequence[str] | None = None, parts: int | None = None
) -> DataFrame:
    """Prediction joined with the realised error on all four keys.

    With `metvars`, `realised` has one row for all of these variables, as `forecast_errors` makes it: the rows
    meet on the other three keys and the prediction picks its variable's error.  That is the inner join with the
    errors that are not null, with fewer rows to deal.  `parts` is that of `hash_join`.
    """
    guesses = predictions.select(*KEYS, "model_output")
    if metvars is None:
        joined = hash_join(guesses, realised.select(*KEYS, "actual"), KEYS, how, parts)
    elif how != "inner":
        raise ValueError("rows with the errors of all variables are joined 'inner' only")
    else:
        rest = [k for k in KEYS if k != "metvar"]
        errors = realised.select(*rest, *[f"error_{m}" for m in metvars])
        actual = F.coalesce(*[F.when(F.col("metvar") == m, F.col(f"error_{m}")) for m in metvars])
        joined = hash_join(guesses, errors, rest, parts=parts).select(*KEYS, "model_output", actual.alias("actual"))
        joined = joined.where(F.col("actual").isNotNull())
    return joined.withColumn("difference", F.col("model_output") - F.col("actual"))


def station_scores(df: DataFrame, keys: Sequence[str] = ("stid", "fh", "metvar")) -> DataFrame:
    """MAE, RMSE, bias and count; rows lacking either side are left out."""
    e = F.col("model_output") - F.col("actual")
    return (
        df.where(e.isNotNull())
        .groupBy(*keys)
        .agg(
            F.avg(F.abs(e)).alias("mae"),
            F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(e).alias("bias"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def mean_scores(scores: DataFrame, keys: Sequence[str] = ("fh", "metvar")) -> DataFrame:
    """Mean of the station scores (each station counts once)."""
    return scores.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("mae", "rmse", "bias")])


def worst(scores: DataFrame, n: int = 30, ties: Sequence[str] = ("stid", "fh", "metvar")) -> DataFrame:
    return scores.orderBy(F.col("mae").desc(), *ties).limit(n)


def division_scores(
    df: DataFrame, divisions: DataFrame, filter_column: str | None = "actual", excluded: Sequence[str] = ()
) -> DataFrame:
    """MAE and MSE per (division, station, fh) behind the outlier gate, without the `excluded` stations."""
    e = F.col("model_output") - F.col("actual")
    rows = exclude(df, excluded, "stid")
    if filter_column:
        rows = nonzero(rows, filter_column)
    per_station = (
        error_within(rows, e, at_most=200)
        .groupBy("stid", "fh")
        .agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))
    )
    # Aggregate first, look the division up afterwards: the join sees one row per station and fh.
    places = divisions.select(F.col("station").alias("stid"), "climate_division_name")
    return per_station.join(places, "stid").select("climate_division_name", F.col("stid").alias("station"), "fh", "mae", "mse")


def sign_confusion(df: DataFrame, keys: Sequence[str], since: str, low: float = 1.0, high: float = 200.0) -> DataFrame:
    """Hits, misses, false alarms and correct negatives of the error's sign, with row percentages."""
    t, p = F.col("target"), F.col("prediction")
    size = F.abs(F.round(t - p, 6))
    rows = df.where((F.col("valid_time") >= F.lit(since).cast("timestamp_ntz")) & (size > low) & (size <= high))
    cells = {
        "hit": (t > 0) & (p > 0),
        "miss": (t > 0) & (p < 0),
        "false_alarm": (t < 0) & (p > 0),
        "correct_negative": (t < 0) & (p < 0),
    }
    counts = rows.groupBy(*keys).agg(*[F.count(F.when(c, 1)).alias(n) for n, c in cells.items()])

    def percent(part: str, other: str) -> Column:
        total = F.col(part) + F.col(other)
        return F.when(total > 0, F.col(part) * 100.0 / total)

    return counts.withColumns(
        {
            "hit_pct": percent("hit", "miss"),
            "miss_pct": percent("miss", "hit"),
            "false_alarm_pct": percent("false_alarm", "correct_negative"),
            "correct_negative_pct": percent("correct_negative", "false_alarm"),
        }
    )


def hour_metvar_table(df: DataFrame) -> DataFrame:
    """MAE per variable with one column per hour of day."""
    e = F.abs(F.col("model_output") - F.col("actual"))
    h = F.hour("valid_time")
    return df.groupBy("metvar").agg(*[F.avg(F.when(h == i, e)).alias(f"h{i:02d}") for i in range(24)])


def drift_by_lead(df: DataFrame, limit: float | None = 100.0) -> DataFrame:
    """MAE and MSE per forecast hour over |difference| < limit (all without one)."""
    d = F.col("difference")
    return error_within(df, d, below=limit).groupBy("fh").agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"))


def r2_by_lead(df: DataFrame, keys: Sequence[str] = ("fh",), truth: str = "model_output", guess: str = "actual", limit: float | None = 100.0) -> DataFrame:
    """1 - SSres/SStot, floored at 0; 0 for a group with no usable row.

    The forecast column plays the truth.  `regr_r2` is the squared correlation
    and would be a different number.
    """
    known = F.col(truth).isNotNull() & F.col(guess).isNotNull()
    ok = known if limit is None else (F.abs(truth) < limit) & (F.abs(guess) < limit)
    y, p = F.when(ok, F.col(truth)), F.when(ok, F.col(guess))
    sums = df.groupBy(*keys).agg(
        F.sum(F.pow(y - p, 2.0)).alias("_res"), (F.var_pop(y) * F.count(y)).alias("_tot"), F.count(y).alias("n")
    )
    # A constant truth scores 1 for a perfect guess and 0 otherwise.
    r2 = F.when(F.col("_tot") > 0, 1.0 - F.col("_res") / F.col("_tot")).otherwise(F.when(F.col("_res") == 0, 1.0).otherwise(0.0))
    return sums.select(*keys, F.when(F.col("n") == 0, 0.0).otherwise(F.greatest(r2, F.lit(0.0))).alias("r2"), "n")


def availability_summary(daily: DataFrame, station: str = "station") -> DataFrame:
    """Median over stations of each station's median daily share.

    A station has one share per calendar day, a bounded group; the number of
    stations is not bounded, so their median takes the distributed way.
    """
    per_station = daily.groupBy(station).agg(F.percentile("share", F.lit(0.5)).alias("median"))
    return exact_quantiles(per_station, [], "median", [0.5]).select(
        F.col("n").alias("stations"), F.col("quantiles")[0].alias("median")
    )


def availability_lines(daily: DataFrame, station: str = "station") -> DataFrame:
    """(date, shares): one line per day with every station that has a share, in order of the stations."""
    return daily.groupBy("date").agg(F.sort_array(F.collect_list(F.struct(station, "share"))).alias("shares"))


def availability_wide(daily: DataFrame, stations: Sequence[str]) -> DataFrame:
    """Days x stations table for a given station list (a display form)."""
    return daily.groupBy("date").agg(*[F.max(F.when(F.col("station") == s, F.col("share"))).alias(s) for s in stations])


def calibrate(df: DataFrame, table: DataFrame, value: str = "model_output", out: str = "calibrated") -> DataFrame:
    """(value - diff) * alpha where the table has the (station, fh); unchanged elsewhere."""
    lookup = table.select(F.col("station").alias("stid"), F.col("forecast_hour").alias("fh"), "alpha", "diff")
    return (
        df.join(lookup, ["stid", "fh"], "left")
        .withColumn(out, F.coalesce((F.col(value) - F.col("diff")) * F.col("alpha"), F.col(value)))
        .drop("alpha", "diff")
    )


def with_station_info(scores: DataFrame, stations: DataFrame, columns: Sequence[str], key: str = "stid") -> DataFrame:
    return scores.join(stations.select(F.col("station").alias(key), *columns), key, "left")


def marker_scaling(scores: DataFrame, metric: str = "mae", low: float = 300.0, high: float = 1500.0) -> DataFrame:
    """Marker size by min-max and colour share by maximum, over a small score table."""
    span = scores.agg(F.struct(F.min(metric).alias("lo"), F.max(metric).alias("hi")).alias("s")).scalar()
    s = F.col("_s")
    width = s["hi"] - s["lo"]
    return scores.withColumn("_s", span).withColumns(
        {
            "marker": F.when(width > 0, low + (F.col(metric) - s["lo"]) / width * (high - low)).otherwise(F.lit(low)),
            "shade": F.when(s["hi"] > 0, F.col(metric) / s["hi"]).otherwise(F.lit(0.0)),
        }
    ).drop("_s")


def missing_outputs(expected: DataFrame, predictions: DataFrame) -> DataFrame:
    """(fh, metvar) pairs that should have predictions and have none."""
    found = predictions.select("fh", "metvar").distinct()
    return expected.select("fh", "metvar").distinct().join(found, ["fh", "metvar"], "left_anti")


def patience_stop(history: DataFrame, keys: Sequence[str], patience: int, min_delta: float = 0.0, epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """First epoch at which `patience` epochs since the last best exceeded best + min_delta.

    One series is a training log (bounded by the epochs of one run), so a plain
    window per run is safe.
    """
    run = Window.partitionBy(*keys).orderBy(epoch)
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    best_before = F.min(loss).over(run.rowsBetween(Window.unboundedPreceding, -1))
    marked = history.withColumn("_better", best_before.isNull() | (F.col(loss) < best_before)).withColumn(
        "_bad", ~F.col("_better") & (F.col(loss) > best_before + min_delta)
    )
    phase = marked.withColumn("_phase", F.sum(F.col("_better").cast("int")).over(upto))
    within = Window.partitionBy(*keys, "_phase").orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    counted = phase.withColumn("_count", F.sum(F.col("_bad").cast("int")).over(within))
    return counted.where(F.col("_bad") & (F.col("_count") >= patience)).groupBy(*keys).agg(F.min(epoch).alias("stop_epoch"))
