"""Forecast, observation and prediction tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from verimet.functions.values import fill_sentinel
from verimet.sources.footers import read_footers


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, skip_corrupt: bool = False, **options: str
) -> DataFrame:
    reader = spark.read.options(**options)
    if skip_corrupt:
        reader = reader.option("ignoreCorruptFiles", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def read_forecasts(
    spark: SparkSession, root: str, fh: int | None = None, years: Iterable[int] | None = None, months: Iterable[int] | None = None,
    columns: Sequence[str] | None = None, fill: float | None = -999.0, schema: T.StructType | None = None,
    skip_corrupt: bool = False,
) -> DataFrame:
    """Station forecasts under fh=/year=/month= folders.

    The filters name partition columns, so other folders are not listed as
    input.  With a schema, an absent root gives an empty frame.  Unreadable files fail
    the job; with `skip_corrupt` they are left out, and `unreadable_files` names them.
    """
    try:
        df = read_table(spark, root, schema, skip_corrupt)
    except AnalysisException as error:
        if schema is None or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if fh is not None:
        df = df.where(F.col("fh") == fh)
    if years is not None:
        df = df.where(F.col("year").isin(*years))
    if months is not None:
        df = df.where(F.col("month").isin(*months))
    df = df.drop("new_tp")
    if columns is not None:
        df = df.select(*columns)
    return fill_sentinel(df, value=fill) if fill is not None else df


def unreadable_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, error) of the Parquet files below `root` without a readable footer; only footers are read."""
    return read_footers(spark, root).where(F.col("error").isNotNull()).select("path", "length", "error")


def read_observations(
    spark: SparkSession, root: str, years: Iterable[int] | None = None, fills: Mapping[str, float] | None = None,
    fill_all: float | None = None, drop_incomplete: bool = True,
) -> DataFrame:
    """Hourly observations: fill the named columns, then drop rows with any other null."""
    return prepare_observations(
        read_table(spark, root) if years is None else read_table(spark, root).where(F.col("year").isin(*years)),
        fills, fill_all, drop_incomplete,
    )


def prepare_observations(
    df: DataFrame, fills: Mapping[str, float] | None = None, fill_all: float | None = None, drop_incomplete: bool = True
) -> DataFrame:
    if "time_1H" in df.columns:
        df = df.withColumnRenamed("time_1H", "valid_time")
    if fill_all is not None:
        return fill_sentinel(df, value=fill_all)
    if fills:
        df = df.fillna(dict(fills))
    return df.dropna() if drop_incomplete else df


def tag_from_path(df: DataFrame, path: str) -> DataFrame:
    """fh and metvar from a file name such as .../fh3_u_total_inference_out."""
    return df.withColumns(
        {
            "fh": F.regexp_extract(path, r"fh(\d+)_", 1).cast("long"),
            "metvar": F.regexp_extract(path, r"fh\d+_(t2m|u_total|tp)", 1),
        }
    )


def read_station_outputs(
    spark: SparkSession, root: str, metvar: str, must_have: str = "linear", must_not_have: str = "normal"
) -> DataFrame:
    """Per-station output files, chosen by name; fh comes from the name.

    File names are matched on the listing column, so files that fail the test
    are skipped before they are read.
    """
    df = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(root)
    df = df.withColumn("_path", F.col("_metadata.file_path"))
    df = df.where(
        F.col("_path").contains(f"{metvar}_") & F.col("_path").contains(must_have) & ~F.col("_path").contains(must_not_have)
    )
    out = df.withColumn("fh", F.regexp_extract("_path", r"_fh(\d+)_", 1).cast("long")).drop("_path")
    return out.withColumnRenamed("target_error_lead_0", "target_error")


def months_of(spans: DataFrame, start: str, end: str) -> DataFrame:
    """`spans` with one row per `month` (its first day) that touches [start, end]."""
    first = [F.trunc(F.col(c).cast("date"), "MM") for c in (start, end)]
    return spans.withColumn("month", F.explode(F.sequence(*first, F.expr("interval 1 month"))))


def month_list(spark: SparkSession, start, end) -> DataFrame:
    """First day of every month that touches [start, end]."""
    return months_of(spark.range(1).select(F.lit(start).alias("start"), F.lit(end).alias("end")), "start", "end").select("month")


def request_chunks(df: DataFrame, start: str, end: str, days: int = 30) -> DataFrame:
    """Half-open [from, to) day ranges that cover start..end without holes."""
    first = F.sequence(F.col(start), F.col(end), F.expr(f"interval {days} days"))
    return df.withColumn("from", F.explode(first)).withColumn(
        "to", F.least(F.date_add("from", days), F.date_add(end, 1))
    )
