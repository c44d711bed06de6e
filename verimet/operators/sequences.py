"""Ordered work inside one key without putting the whole key in one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, so a
key with a third of the rows stalls the job.  The helpers here cut a key into
bounded pieces first:

* a *chunk* is a calendar piece of the key (a day, a month), so its size is
  bounded by the sampling rate, not by the length of the record;
* what must cross a chunk border (last value, running total, row count) is
  reduced to one row per chunk before it is carried over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
BLOCK = "_block"
CORE = "_core"


def _tagged(df: DataFrame, chunk: Column) -> DataFrame:
    return df.withColumn(CHUNK, chunk)


def _with_chunk_rows(df: DataFrame, per_chunk: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join one row per (key, chunk); null keys and null chunks find theirs too."""
    columns = [*keys, CHUNK]
    named = per_chunk.withColumnsRenamed({c: f"_k_{c}" for c in columns})
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in columns]
    return df.join(named, same, how).drop(*(f"_k_{c}" for c in columns))


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, chunk: Column, out: str
) -> DataFrame:
    """`lag(value)` per key, exact across chunk borders; null keys are a key, null chunks come first.

    The input is read and dealt to its chunks once.  Only the first row of each chunk is sent on, to meet
    the other chunks' first rows of its key; all further rows stay where they are.
    """
    df = _tagged(df, chunk)
    inner = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    whole = inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = df.withColumns({
        "_first": F.row_number().over(inner) == 1, "_prev": F.lag(value).over(inner), "_last": F.last(value).over(whole)})
    firsts = marked.where("_first").withColumn(out, F.lag("_last").over(Window.partitionBy(*keys).orderBy(CHUNK)))
    others = marked.where("not _first").withColumn(out, F.col("_prev"))
    return firsts.unionByName(others).drop(CHUNK, "_first", "_prev", "_last")


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, chunk: Column, out: str
) -> DataFrame:
    """Cumulative sum per key, exact across chunk borders; null keys are a key, null chunks come first.

    The input is read twice (chunk sums, then rows).
    """
    df = _tagged(df, chunk)
    inner = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, CHUNK)
        .agg(F.sum(value).alias("_sum"))
        .select(*keys, CHUNK, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        _with_chunk_rows(df.withColumn("_inner", F.sum(value).over(inner)), offsets, keys)
        .withColumn(out, F.col("_inner") + F.col("_offset"))
        .drop(CHUNK, "_inner", "_offset")
    )


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, reach: int = 0, per_key: DataFrame | None = None,
    counted: DataFrame | None = None, parts: int | None = None,
) -> DataFrame:
    """Rows with their place: `_chunk`, `_rank` in it, `_pos` in the key (both zero-based), and `_of`, what is known of the chunk.

    `_of` holds `first` (its first position), `rows`, `final` (no chunk of the key follows) and `homes`: former chunks whose
    last row has this chunk's first one among the `reach` rows that follow it, with `first` and `end`.  Null keys are a key,
    null chunks come first.

    Chunks are counted, and each sends one row ahead of its own rows, so the rows travel once, by key and chunk, and meet no
    join.  `per_key` has one row per key; its further columns are in `_of` too.  Keys it lacks, and null keys, are left out then.
    The rows of a chunk are counted in `counted` if it is given: the same rows as `df` by keys and `chunk`, but cheaper to
    make.  `parts` deals the rows to so many tasks by key and chunk.
    """
    df, counted = _tagged(df, chunk), _tagged(df if counted is None else counted, chunk)
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    chunks = (
        counted.groupBy(*keys, CHUNK)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumns({
            "_first": F.coalesce(F.sum("_rows").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_final": F.lead(F.lit(True)).over(by_chunk).isNull()})
    )
    known = [F.col("_first").alias("first"), F.col("_rows").alias("rows"), F.col("_final").alias("final")]
    if reach:
        former = F.struct(F.col(CHUNK).alias("chunk"), F.col("_first").alias("first"), (F.col("_first") + F.col("_rows")).alias("end"))
        chunks = chunks.withColumn("_homes", F.collect_list(former).over(by_chunk.rowsBetween(-reach, -1)))
        known.append(F.filter("_homes", lambda h: h["end"] + reach > F.col("_first")).alias("homes"))
    if per_key is not None:
        chunks = chunks.join(per_key, list(keys))
        known += [F.col(c) for c in per_key.columns if c not in keys]
    heads = chunks.select(*keys, CHUNK, F.struct(*known).alias("_head"))
    both = df.withColumn("_head", F.lit(None).cast(heads.schema["_head"].dataType)).unionByName(heads, allowMissingColumns=True)
    if parts is not None:
        both = both.repartition(parts, *keys, CHUNK)
    inner = Window.partitionBy(*keys, CHUNK).orderBy(F.col("_head").isNull(), *order)
    rows = both.withColumns({
        "_rank": F.row_number().over(inner) - 2, "_of": F.first("_head").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    }).where(F.col("_head").isNull())
    if per_key is not None:
        rows = rows.where(F.col("_of").isNotNull())
    counted_so = F.col("_rank") < F.col("_of.rows")
    place = F.when(counted_so, F.col("_of.first") + F.col("_rank")).otherwise(F.raise_error(F.lit("a chunk has more rows than were counted")))
    return rows.drop("_head").withColumn("_pos", place)


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, out: str = "_pos") -> DataFrame:
    """Zero-based row number per key, counted chunk by chunk; null keys are a key, null chunks come first.

    The input is read twice (chunk counts, then rows).
    """
    return numbered(df, keys, order, chunk).withColumnRenamed("_pos", out).drop(CHUNK, "_rank", "_of")


def overlapping_blocks(df: DataFrame, position: str, rows: int, ahead: int) -> DataFrame:
    """Cut positions into blocks of `rows`, each with the next `ahead` rows copied in.

    A frame of up to `ahead` following rows computed inside (key, block) then
    equals the frame over the whole key for every row marked as core.
    """
    if ahead > rows:
        raise ValueError("a block must hold at least as many rows as it looks ahead")
    own = F.floor(F.col(position) / rows)
    copied = (own > 0) & (F.col(position) % rows < ahead)
    blocks = F.when(copied, F.array(own, own - 1)).otherwise(F.array(own))
    return (
        df.withColumn(BLOCK, F.explode(blocks))
        .withColumn(CORE, F.floor(F.col(position) / rows) == F.col(BLOCK))
    )
