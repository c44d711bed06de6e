"""Statistics of sampled predictions and loss functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _doubles(a: Column) -> Column:
    return F.transform(a, lambda v: v.cast("double"))


def array_mean(a: Column) -> Column:
    return F.aggregate(_doubles(a), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def array_var_pop(a: Column) -> Column:
    mean = array_mean(a)
    return F.aggregate(_doubles(a), F.lit(0.0), lambda s, v: s + F.pow(v - mean, 2.0)) / F.size(a)


def split_uncertainty(df: DataFrame, mu: str = "mu", logvar: str = "logvar") -> DataFrame:
    """Model spread, data noise and their sum from Monte-Carlo samples.

    Samples sit in an array per row (a fixed sample count), so this is a pure
    projection: no explode, no shuffle.
    """
    noise = F.aggregate(_doubles(F.col(logvar)), F.lit(0.0), lambda s, v: s + F.exp(v)) / F.size(logvar)
    return (
        df.withColumns({"mu_mean": array_mean(F.col(mu)), "epistemic_var": array_var_pop(F.col(mu)), "aleatoric_var": noise})
        .withColumn("total_var", F.col("epistemic_var") + F.col("aleatoric_var"))
    )


def array_quantile(a: Column, q: float) -> Column:
    """Quantile of one array with linear interpolation."""
    ordered = F.array_sort(_doubles(a))
    rank = F.lit(q) * (F.size(a) - 1)
    low, high = F.floor(rank).cast("int"), F.ceil(rank).cast("int")
    lo, hi = F.get(ordered, low), F.get(ordered, high)
    return lo + (hi - lo) * (rank - low)


def interval_coverage(df: DataFrame, samples: str = "mu", truth: str = "y_true", alpha: float = 0.9, keys: Sequence[str] = ()) -> DataFrame:
    """Share of truths inside the central `alpha` interval of their samples."""
    low_q = (1.0 - alpha) / 2.0
    low, high = array_quantile(F.col(samples), low_q), array_quantile(F.col(samples), 1.0 - low_q)
    inside = F.col(truth).between(low, high).cast("double")
    return df.groupBy(*keys).agg(F.avg(inside).alias("coverage"), F.count(F.lit(1)).alias("n"))


def gaussian_nll(mu: Column, logvar: Column, truth: Column) -> Column:
    se = F.pow(truth - mu, 2.0)
    return 0.5 * (logvar + se / (F.exp(logvar) + 1e-12)) + 0.5 * math.log(2.0 * math.pi)


def window_nll(df: DataFrame, mu: str = "mu", logvar: str = "logvar", truth: str = "y_true") -> DataFrame:
    """Negative log-likelihood summed over the steps of each row's arrays."""
    steps = F.zip_with(F.col(mu), F.col(logvar), lambda m, v: gaussian_nll(m.cast("double"), v.cast("double"), F.col(truth)))
    return df.withColumn("nll", F.aggregate(steps, F.lit(0.0), lambda s, v: s + v))


def reduce_loss(df: DataFrame, reduction: str | None = "mean", keys: Sequence[str] = ()) -> DataFrame:
    if reduction is None:
        return df
    how = {"mean": F.avg, "sum": F.sum}[reduction]
    return df.groupBy(*keys).agg(how("nll").alias("nll"))


def outlier_weighted_mae(error: Column, alpha: float = 2.0) -> Column:
    size = F.abs(error)
    return F.avg(F.pow(size + 1.0, alpha) * size)
