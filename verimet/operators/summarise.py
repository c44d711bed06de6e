"""Error summaries by month, hour, bucket, division and density bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verimet.functions.clock import hour_label
from verimet.functions.values import round_fine_below_one, round_to_multiple
from verimet.operators.filters import error_within
from verimet.operators.quantiles import exact_quantiles
from verimet.session import shared_dir

STATISTICS = {
    "mean": lambda d: F.avg(d),
    "abs": lambda d: F.avg(F.abs(d)),
    "std": lambda d: F.stddev_samp(d),
}


def period_column(period: str, ts: str = "valid_time") -> Column:
    if period == "month":
        return F.month(ts).cast("long")
    if period == "hour":
        return F.hour(ts).cast("long")
    raise ValueError(f"period must be 'month' or 'hour', not {period!r}")


def error_by_period(df: DataFrame, period: str, statistic: str, keys: Sequence[str] = (), value: str = "difference", lead: str = "fh", limit: float | None = None) -> DataFrame:
    """Statistic per forecast hour first, then the mean over forecast hours.

    Every forecast hour weighs the same, however many rows it has.  Periods
    without data are absent.  `limit` leaves out rows with |value| at or above it.
    """
    d = F.col(value)
    per_lead = (
        _below(df, d, limit)
        .groupBy(*keys, period_column(period).alias(period), lead)
        .agg(STATISTICS[statistic](d).alias("_s"))
    )
    return per_lead.groupBy(*keys, period).agg(F.avg("_s").alias("error"))


def _below(df: DataFrame, value: Column, limit: float | None) -> DataFrame:
    return df if limit is None else error_within(df, value, below=limit)


def labelled(summary: DataFrame, period: str) -> DataFrame:
    """Add the printed label (month name or HH:00) of a summary."""
    if period == "month":
        first = F.make_date(F.lit(2024), F.col("month").cast("int"), F.lit(1))
        return summary.withColumn("label", F.date_format(first, "MMMM"))
    return summary.withColumn("label", hour_label(F.col("hour")))


def box_statistics(df: DataFrame, period: str, value: str = "difference", limit: float | None = None) -> DataFrame:
    """Quartiles, whiskers (extreme rows within 1.5 IQR) and outlier count per period."""
    shared_dir(df.sparkSession)
    rows = _below(df, F.col(value), limit).select(period_column(period).alias(period), F.col(value).alias("_d")).checkpoint()
    quart = exact_quantiles(rows, [period], "_d", [0.25, 0.5, 0.75], few_groups=True, cheap=True).select(
        period, "n", *[F.col("quantiles")[i].alias(q) for i, q in enumerate(("q1", "median", "q3"))]
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    near = F.col("_d").between(F.col("q1") - reach, F.col("q3") + reach)
    # At most 24 quartile rows, so the rows meet them in place and fold before the shuffle.
    return (
        rows.join(F.broadcast(quart), period)
        .groupBy(period, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(near, F.col("_d"))).alias("whisker_low"),
            F.max(F.when(near, F.col("_d"))).alias("whisker_high"),
            F.count(F.when(~near, 1)).alias("outliers"),
        )
    )


def error_by_bucket(df: DataFrame, condition: str, base: float, row_keys: Sequence[str], value: str = "difference", floor: float = -200.0, missing: float | None = None) -> DataFrame:
    """Error per condition bucket: sum of per-row MAE over sum of usable differences.

    A row is one (station, hour) with one difference per forecast hour;
    differences at or below `missing`, if given, stand for none.
    """
    bucket = round_to_multiple(F.col(condition), base)
    usable = F.abs(value) if missing is None else F.when(F.col(value) > missing, F.abs(value))
    return _bucketed(df.withColumn("bucket", bucket).where(F.col("bucket") >= floor), usable, row_keys)


def error_by_fine_bucket(df: DataFrame, condition: str, digits: int, row_keys: Sequence[str], value: str = "difference", limit: float | None = None) -> DataFrame:
    """Buckets with `digits` decimals in [0, 1) and whole numbers elsewhere."""
    usable = F.abs(value) if limit is None else F.when(F.abs(value) < limit, F.abs(value))
    return _bucketed(df.withColumn("bucket", round_fine_below_one(F.col(condition), digits)), usable, row_keys)


def _bucketed(df: DataFrame, usable: Column, row_keys: Sequence[str]) -> DataFrame:
    per_row = df.groupBy(*row_keys, "bucket").agg(F.avg(usable).alias("_mae"), F.count(usable).alias("_n"))
    return (
        per_row.where(F.col("_n") > 0)
        .groupBy("bucket")
        .agg(F.sum("_mae").alias("error_sum"), F.sum("_n").alias("instances"))
        .withColumn("average", F.col("error_sum") / F.col("instances"))
    )


def wide_by_lead(df: DataFrame, leads: Sequence[int], keys: Sequence[str], value: str = "difference", fill: float = -999.0) -> DataFrame:
    """One column per forecast hour on request; absent combinations hold the sentinel."""
    return df.groupBy(*keys).agg(
        *[F.coalesce(F.max(F.when(F.col("fh") == i, F.col(value))), F.lit(fill)).alias(f"diff_{i}") for i in leads]
    )


def division_table(summary: DataFrame, period: str, values: Sequence[int], division: str = "climate_division_name") -> DataFrame:
    """Divisions x hours (or months) with explicit columns."""
    return summary.groupBy(division).agg(
        *[F.avg(F.when(F.col(period) == v, F.col("error"))).alias(f"p{v:02d}") for v in values]
    )


def station_counts(stations: DataFrame, division: str = "climate_division_name") -> DataFrame:
    return stations.groupBy(division).agg(F.countDistinct("station").alias("stations"))


def weighted_mean(summary: DataFrame, counts: DataFrame, period: str, division: str = "climate_division_name", error: str = "error") -> DataFrame:
    """Mean over divisions weighted by their station count; a null in any makes it null."""
    x, w = F.col(error), F.col("stations")
    return (
        summary.join(counts, division)
        .groupBy(period)
        .agg(F.when(F.count(x) == F.count(F.lit(1)), F.sum(x * w) / F.sum(w)).alias(error))
    )


def skill(base: DataFrame, candidate: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Absolute and percent improvement of `candidate` over `base`."""
    joined = base.withColumnRenamed("error", "base").join(candidate.withColumnRenamed("error", "candidate"), list(keys))
    gain = F.col("base") - F.col("candidate")
    return joined.withColumns(
        {"gain": gain, "gain_pct": F.when(F.col("base") != 0, gain / F.col("base") * 100.0)}
    )


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 300) -> DataFrame:
    """Equal bins between min and max per axis: (xb, yb, count), bins 1..n.

    The top edge counts in the last bin.
    """
    return _binned(df, x, y, bins).groupBy("xb", "yb").count()


def _binned(df: DataFrame, x: str, y: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    ends = F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).alias("_s")
    if keys:
        limited = df.join(df.groupBy(*keys).agg(ends), list(keys))
    else:
        limited = df.withColumn("_s", df.agg(ends).scalar())

    def edge(v: str, lo: Column, hi: Column) -> Column:
        return F.least(F.width_bucket(F.col(v), lo, hi, F.lit(bins)), F.lit(bins)).cast("long")

    s = F.col("_s")
    return (
        limited
        .withColumns({"xb": edge(x, s["x0"], s["x1"]), "yb": edge(y, s["y0"], s["y1"])})
        .withColumn("_edge", (F.col(x) >= s["x1"]) | (F.col(y) >= s["y1"]))
        .drop("_s")
    )


MAX_BROADCAST_BINS = 1_000_000


def point_density(df: DataFrame, x: str, y: str, bins: int = 300, keys: Sequence[str] = ()) -> DataFrame:
    """Each point with the count of its bin; points on the top edge are dropped.  Every key has bins of its own."""
    points = _binned(df, x, y, bins, keys)
    counts = points.groupBy(*keys, "xb", "yb").agg(F.count(F.lit(1)).alias("density"))
    # Without keys at most bins * bins rows: a bound that does not grow with the data.
    side = F.broadcast(counts) if not keys and bins * bins <= MAX_BROADCAST_BINS else counts
    return points.where(~F.col("_edge")).join(side, [*keys, "xb", "yb"]).drop("_edge")


def histogram_1d(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    rows = df.select(value.alias("v")).where(F.col("v").isNotNull())
    limits = rows.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("s")).scalar()
    bucket = F.least(F.width_bucket(F.col("v"), F.col("_s")["lo"], F.col("_s")["hi"], F.lit(bins)), F.lit(bins))
    return rows.withColumn("_s", limits).groupBy(bucket.cast("long").alias("bin")).count()


def scatter_diagnostics(df: DataFrame, x: str, y: str, tolerance: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Share near the 1:1 line and share per quadrant, in percent."""
    a, b = F.col(x), F.col(y)

    def share(c: Column) -> Column:
        return F.avg(F.when(c, 100.0).otherwise(0.0))

    # Rounded, so a difference that is exactly the tolerance does not hang on the last bit.
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        share(F.abs(F.round(b - a, 6)) <= tolerance).alias("near"),
        share((a > 0) & (b > 0)).alias("q1"),
        share((a < 0) & (b > 0)).alias("q2"),
        share((a < 0) & (b < 0)).alias("q3"),
        share((a > 0) & (b < 0)).alias("q4"),
    ).withColumn("far", 100.0 - F.col("near"))
