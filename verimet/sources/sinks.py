"""Writers.  Re-running any of them with the same input changes nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from verimet.operators.setops import latest_per_key, upsert
from verimet.session import stored

BATCH = "batch_id"
#: Folders that the images of a year lie in, whatever the number of stations.
IMAGE_PARTS = 64


def write_partitions(df: DataFrame, path: str, by: Sequence[str], order: Sequence[str] = ()) -> None:
    """Overwrite the partitions present in `df`, leave the others; `order` sorts the rows inside each file.

    The rebalance hint brings the rows of a partition value together and lets
    adaptive execution split a value that is too large for one task, so files
    are neither tiny nor written by one task each.
    """
    dealt = df.hint("rebalance", *[F.col(c) for c in by])
    (
        (dealt.sortWithinPartitions(*by, *order) if order else dealt)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def with_calendar(df: DataFrame, ts: str = "valid_time") -> DataFrame:
    return df.withColumns({"year": F.year(ts), "month": F.month(ts)})


def write_forecasts(df: DataFrame, path: str) -> None:
    write_partitions(with_calendar(df), path, ["fh", "year", "month"])


def write_daily(df: DataFrame, path: str, ts: str = "valid_time") -> None:
    """Stitched forecasts, one folder per forecast hour and day, rows by time and place."""
    write_partitions(df.withColumn("date", F.to_date(ts)), path, ["fh", "date"], [ts, "latitude", "longitude"])


def write_divisions(df: DataFrame, path: str) -> None:
    write_partitions(df, path, ["climate_division_name"])


def write_images(df: DataFrame, path: str, ts: str = "valid_time") -> None:
    """Replace the images of the years and stations present in `df`, leave the others.

    A year has IMAGE_PARTS folders (`part`, a hash of the station), so folders and files don't multiply with the
    stations; inside a file rows go by station and time.  Only the parts that `df` touches are rewritten.
    """
    by = ["year", "part"]
    new = df.withColumns({"year": F.year(ts), "part": F.pmod(F.xxhash64("station"), F.lit(IMAGE_PARTS)).cast("int")})
    old = read_if_there(df.sparkSession, path, new.schema)
    if old is not None:
        new = stored(new, "images")

        def present(columns):
            named = new.select(*[F.col(c).alias(f"_{c}") for c in columns]).distinct()
            return named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]

        others = old.join(*present(by), "left_semi").join(*present([*by, "station"]), "left_anti")
        new = new.unionByName(others)
    write_partitions(new, path, by, ["station", ts])


def write_summary_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_if_there(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The table at `path`, None if there is none; with a schema no file is opened to infer one."""
    try:
        return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def upsert_partitions(new: DataFrame, path: str, keys: Sequence[str], by: Sequence[str], order: Sequence[str] = ()) -> None:
    """Merge rows into a partitioned table, the new row wins per key.

    Only partitions the new rows touch are read and rewritten, so a key must name its partition.
    """
    if not set(by) <= set(keys):
        raise ValueError(f"partition columns {list(by)} must be among the keys {list(keys)}")
    old = read_if_there(new.sparkSession, path)
    if old is None:
        merged = latest_per_key(new, keys, list(order) or list(keys))
    else:
        touched = new.select(*by).distinct()
        merged = upsert(old.join(touched, list(by), "left_semi").select(*new.columns), new, keys, order)
    write_partitions(merged, path, by)


def write_bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int, order: Sequence[str] = ()) -> None:
    """Save table `name` with its files at `path`, in `buckets` by the hash of `keys`, each sorted by `order` (the keys by default).

    Tables with the same keys and number of buckets join on these keys without an exchange.  Take keys that many
    rows don't share (a station and an hour, not a station alone), so that no bucket is hot.
    """
    dealt = df.repartition(buckets, *[F.col(k) for k in keys])
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*(order or keys)).saveAsTable(name)


def append_batch(new: DataFrame, path: str, batch: int) -> None:
    """Add one batch as its own folder; a repeated batch replaces itself."""
    new.withColumn(BATCH, F.lit(batch).cast("long")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(BATCH).parquet(path)


def read_latest(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Current state of a table written by `append_batch`: last batch wins per key."""
    return latest_per_key(spark.read.parquet(path), keys, [BATCH, *order]).drop(BATCH)


def done_partitions(spark: SparkSession, path: str, by: Sequence[str], schema) -> DataFrame:
    """Partition values that already have output (none when the table is absent).

    Only partition columns are read, so this touches the listing and footers.
    """
    existing = read_if_there(spark, path)
    return existing.select(*by).distinct() if existing is not None else spark.createDataFrame([], schema)


def partition_status(spark: SparkSession, work: DataFrame, path: str, by: Sequence[str]) -> DataFrame:
    """`work` (partition values) with `rows` found in the table and `status`: done or pending."""
    existing = read_if_there(spark, path)
    if existing is None:
        return work.select(*by, F.lit(0).cast("long").alias("rows"), F.lit("pending").alias("status"))
    kinds = {f.name: f.dataType for f in work.schema}
    found = existing.groupBy(*[F.col(c).cast(kinds[c]).alias(c) for c in by]).agg(F.count(F.lit(1)).alias("rows"))
    return work.select(*by).distinct().join(found, list(by), "left").select(
        *by, F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.col("rows").isNull(), "pending").otherwise("done").alias("status"))
