"""Unions, joins, keyed upserts, de-duplication and work lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by name; columns one of them lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def hash_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", parts: int | None = None) -> DataFrame:
    """Equi-join whose tasks hold their rows of `right` in memory, so that neither side is sorted.

    Without `parts` the planner chooses the join.  `parts` follows the size of `right`, so that one task's share fits at every
    scale: both sides are dealt by all keys to as many tasks where the session's number, which joins have at least, is smaller.
    """
    if parts is None:
        return left.join(right, list(keys), how)
    if parts > int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        left, right = left.repartition(parts, *keys), right.repartition(parts, *keys)
    return left.join(right.hint("shuffle_hash"), list(keys), how)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Last row per key.

    An aggregate, not a ranking window: equal keys fold before the shuffle, so
    a key with very many versions costs one row per map task.
    """
    return _pick(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return _pick(df, keys, order, F.min_by)


def _pick(df, keys, order, pick):
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return chosen.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """existing + new, one row per key, new rows win; `order` ranks rows of one side."""
    both = existing.withColumn("_side", F.lit(0)).unionByName(
        new.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    return latest_per_key(both, keys, ["_side", *order]).drop("_side")


def pending_work(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items whose output partition is not there yet (resume)."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def split_union(exact: DataFrame, nearest: DataFrame, ids: Sequence[str], key: str = "station") -> DataFrame:
    """Rows of `exact` for the listed ids, rows of `nearest` for the rest."""
    return exact.where(F.col(key).isin(*ids)).unionByName(nearest.where(~F.col(key).isin(*ids)), True)
