"""Scores that grow with appended batches.

A score is kept as sums that can be added and taken back.  A batch adds the sums of its rows and takes back those of
the rows it replaces, which are looked up by key in the months the batch touches; what other months hold is never read
again.  Every batch writes its own folder of differences, so repeating the last batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verimet.operators.setops import latest_per_key
from verimet.operators.verify import KEYS
from verimet.sources.sinks import BATCH

MONTH = "month"
#: Width of the bins of the absolute error; the last one is open.
BIN_WIDTH, BINS = 0.5, 40
_SUMS = ("n", "sum_error", "sum_abs", "sum_square")


def error_sums(rows: DataFrame, by: Sequence[str], sign: int = 1) -> DataFrame:
    """by, n and the sums of error, absolute and squared error and counts per error bin, each times `sign`."""
    e = F.col("model_output") - F.col("actual")
    known = rows.where(e.isNotNull())
    place = F.least(F.floor(F.abs(e) / BIN_WIDTH).cast("int"), F.lit(BINS - 1))
    per_bin = known.groupBy(*by, place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e).alias("sum_error"), F.sum(F.abs(e)).alias("sum_abs"), F.sum(e * e).alias("sum_square"))
    return per_bin.select(*by, "bin", *[(F.col(c) * sign).alias(c) for c in _SUMS])


def add_batch(new: DataFrame, path: str, batch: int, by: Sequence[str], keys: Sequence[str] = KEYS, order: Sequence[str] = (), ts: str = "valid_time") -> None:
    """Add prediction rows (keys, model_output, actual); rows with a known key replace the former ones.

    Batches come in ascending order; the last one may come again.  Within a batch the last row per key by `order` counts.
    """
    spark = new.sparkSession
    rows = latest_per_key(new, keys, list(order) or list(keys)).select(*keys, "model_output", "actual", F.trunc(ts, "MM").alias(MONTH))
    logged = T.StructType([*rows.schema.fields, T.StructField(BATCH, T.LongType())])
    # The batch's folder is written once and read again: one file a month, more only for large ones.
    rows.hint("rebalance", MONTH).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(MONTH).parquet(f"{path}/rows/{BATCH}={batch}")
    log = spark.read.schema(logged).parquet(f"{path}/rows")
    rows = log.where(F.col(BATCH) == batch)
    added = error_sums(rows, by)
    months = [r[0] for r in rows.select(MONTH).distinct().collect()]  # calendar months of one batch
    touched = F.col(MONTH).isin([m for m in months if m is not None])
    former = log.where((touched | F.col(MONTH).isNull()) & (F.col(BATCH) < batch))
    if not former.isEmpty():
        if ts in keys:  # rows of other days than the batch's (calendar days, so few) meet no exchange
            days = rows.select(F.to_date(ts).alias("_day")).distinct()
            former = former.join(F.broadcast(days), F.to_date(ts).eqNullSafe(F.col("_day")), "left_semi")
        former = former.join(rows.select(*keys), list(keys), "left_semi")
        former = latest_per_key(former.select(*keys, "model_output", "actual", BATCH), keys, [BATCH])
        added = added.unionByName(error_sums(former, by, -1)).groupBy(*by, "bin").agg(*[F.sum(c).alias(c) for c in _SUMS])
    out = added.withColumn(BATCH, F.lit(batch).cast("long"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(f"{path}/sums")


def current_sums(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """by, bin and the sums over all batches."""
    return spark.read.parquet(f"{path}/sums").groupBy(*by, "bin").agg(*[F.sum(c).alias(c) for c in _SUMS])


def current_scores(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """by, mae, rmse, bias, n: the scores of all rows that count now, from the sums alone."""
    total = current_sums(spark, path, by).groupBy(*by).agg(*[F.sum(c).alias(c) for c in _SUMS]).where("n > 0")
    mean = lambda c: F.col(c) / F.col("n")
    return total.select(*by, mean("sum_abs").alias("mae"), F.sqrt(F.greatest(mean("sum_square"), F.lit(0.0))).alias("rmse"), mean("sum_error").alias("bias"), "n")


def share_below(sums: DataFrame, by: Sequence[str], limit: float) -> DataFrame:
    """by, share: the part of the rows whose absolute error is below `limit`, a multiple of the bin width."""
    if limit % BIN_WIDTH or limit >= BIN_WIDTH * BINS:
        raise ValueError(f"limit must be a multiple of {BIN_WIDTH} below {BIN_WIDTH * BINS}")
    inside: Column = F.when(F.col("bin") < int(limit / BIN_WIDTH), F.col("n")).otherwise(0)
    return sums.groupBy(*by).agg((F.sum(inside) / F.sum("n")).alias("share"))
