"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from verimet.session import work_path

#: ASCII white space that separates words.
BLANK = r"[\x20\x09-\x0D]"

#: Stands for a null key; how many values a tie has.
LEAST, TIES = -(1 << 63), 4096

_PRIME = 0x9E3779B97F4A7C15 | 1
_BITS = (1 << 64) - 1
_powers: list[np.ndarray] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One given table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_at(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files below `path`, also when nothing was written there."""
    return spark.read.schema(schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written below the shared folder and read again: later passes survive lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bound the Arrow batches that reach Python, as single texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def annotate(df: DataFrame, text: str, fields: list[tuple[str, str]], step, keep: list[str] | None = None, piece: int = 1 << 20, join: bool = False) -> DataFrame:
    """`df` with new columns that `step(texts)` computes from column `text`, batch by batch.

    `step` gets an Arrow string array of about `piece` bytes (null texts as empty) and
    returns one Arrow array per field.  It is made in each task by calling `step()`
    when it is a class, so that tables are built once a task.  Only the columns `keep`
    (all by default) and the text travel to Python.  With `join`, small batches are put together up to `piece`.
    """
    keep = df.columns if keep is None else keep
    source = df.select(*keep, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    spec = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))
    schema = T.StructType([source.schema[c] for c in keep] + list(spec))
    width = len(keep)

    def run(batches):
        work = step() if isinstance(step, type) else step
        for batch in regrouped(batches, width, piece) if join else batches:
            at = 0
            texts = batch.column(width)
            if pa.types.is_large_string(texts.type):
                texts = texts.cast(pa.string())
            ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
            while at < len(texts):
                stop = int(np.searchsorted(ends, int(ends[at]) + piece, "right")) - 1
                stop = min(max(stop, at + 1), len(texts))
                part = batch.slice(at, stop - at)
                made = work(part.column(width))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(width)), *made], names=schema.names)
                at = stop
        trim()

    return source.mapInArrow(run, schema)


def trim() -> None:
    """Give memory that numpy and Arrow have freed back to the system, so that a worker's next task starts small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def regrouped(batches, column: int, size: int):
    """Record batches with about `size` bytes in the string column `column`: small ones are joined, large ones cut between rows."""
    held, total = [], 0
    for batch in batches:
        texts = batch.column(column)
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(False).astype(np.int64)
        ends, at = np.concatenate([[0], np.cumsum(lengths)]), 0
        while at < len(batch):
            stop = int(np.searchsorted(ends, ends[at] + size - total, "right")) - 1
            stop = min(max(stop, at + 1), len(batch))
            held.append(batch.slice(at, stop - at))
            total += int(ends[stop] - ends[at])
            at = stop
            if total >= size or at < len(batch):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts behind each other, and the n + 1 byte offsets."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _PRIME, np.uint64), np.full(size, pow(_PRIME, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Words:
    """Words of many texts: byte ranges in `low`, and for text i words `of[i]:of[i + 1]`."""

    def __init__(self, texts: pa.Array, inside: np.ndarray) -> None:
        data, bounds = raw(texts)
        self.low = LOWER[data]
        word = inside[self.low]
        start, end = word.copy(), word.copy()
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        edges = bounds[(bounds > 0) & (bounds < len(data))]
        start[edges] = word[edges]
        end[edges - 1] = word[edges - 1]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.of = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.of)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        up, down = powers(len(self.low) + 1)
        total = np.zeros(len(self.low) + 1, np.uint64)
        np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * up[:len(self.low)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes inside words: letters, digits and everything beyond ASCII / everything but blanks.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False


def range_splits(df: DataFrame, key: str, weight: str, target: int, tie: str | None = None) -> list[tuple[int, int]]:
    """Ascending cuts (key, tie) into ranges of about `target` weight; a range that starts at a cut holds it.

    A pure function of the rows: a range sort of the summed weights gives every key the weight before it, and
    the key that passes a multiple of `target` starts a new range. A range so holds at most `target` and one key more.
    Only a key that outweighs `target` alone is cut inside, by the integer column `tie` (0 to TIES - 1) if there is one.
    One cut for each range reaches the driver. Null keys come first.
    """
    spark = df.sparkSession
    narrow = df.select(
        F.coalesce(F.col(key).cast("long"), F.lit(LEAST)).alias("k"), (F.col(tie).cast("int") if tie else F.lit(0)).alias("t"), F.col(weight).cast("long").alias("w"))
    of_key = Window.partitionBy("k")
    units = narrow.groupBy("k", "t").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w")).select(
        "k", "t", "w", F.sum("w").over(of_key).alias("whole"),
        F.coalesce(F.sum("w").over(of_key.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inside"))
    dealt = stored(units.repartitionByRange("k", "t").withColumn("part", F.spark_partition_id()), "weights")
    parts = dealt.groupBy("part").agg(F.sum("w").alias("sum"))
    parts = parts.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = F.coalesce(F.sum("w").over(Window.partitionBy("part").orderBy("k", "t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = dealt.withColumn("before", before).join(F.broadcast(parts), "part").withColumn("before", F.col("before") + F.col("base"))  # a row a partition
    heavy = F.col("whole") > target
    place = F.when(heavy, F.col("before")).otherwise(F.col("before") - F.col("inside"))
    starts = at.select(F.floor(place / target).alias("shard"), F.struct("k", F.when(heavy, F.col("t")).otherwise(0).alias("t")).alias("cut"))
    rows = starts.groupBy("shard").agg(F.min("cut").alias("cut")).orderBy("shard").collect()
    return [(r.cut.k, r.cut.t) for r in rows[1:]]


def range_of(key: str, cuts: list[tuple[int, int]], tie: str | None = None):
    """Number of the range of `range_splits` that a row falls in; null keys come first."""
    if not cuts:
        return F.lit(0)
    limits, ties = (np.array(c, np.int64) for c in zip(*cuts, strict=True))

    @F.pandas_udf("int")
    def place(keys: pd.Series, within: pd.Series) -> pd.Series:
        k, t = keys.to_numpy(np.int64), within.to_numpy(np.int64)
        low, high = np.searchsorted(limits, k, "left"), np.searchsorted(limits, k, "right")
        for v in np.unique(k[low < high]):  # keys with cuts of their own
            rows = np.flatnonzero(k == v)
            a, b = low[rows[0]], high[rows[0]]
            high[rows] = a + np.searchsorted(ties[a:b], t[rows], "right")
        return pd.Series(high.astype(np.int32))

    return place(F.coalesce(F.col(key).cast("long"), F.lit(LEAST)), F.col(tie).cast("int") if tie else F.lit(0))
