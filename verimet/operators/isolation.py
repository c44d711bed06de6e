"""Steps that may fail for some keys.

A step runs on the rows of one key in one batch.  If it raises, that key yields an error row and all others go on;
a key with an error in any batch has no output.  Failed keys are kept beside the table with their message, so a later
run takes up the failed and the new ones only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verimet.operators.setops import pending_work
from verimet.session import stored
from verimet.sources.sinks import partition_status, read_if_there, write_partitions

ERROR = "_error"


def guarded(df: DataFrame, keys: Sequence[str], step: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType) -> DataFrame:
    """keys, the columns of `schema` and _error: the step's rows, or one row with the message.

    Batches of rows are split by key inside tasks; a key's rows need not meet, so the step must work on any part of them.
    """
    names = list(keys)
    full = T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in names], *schema.fields, T.StructField(ERROR, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, rows in batch.groupby(names, dropna=False, sort=False):
                try:
                    made = step(rows.reset_index(drop=True))[schema.names].reset_index(drop=True)
                    made[ERROR] = None
                except Exception as error:
                    made = pd.DataFrame([{**dict.fromkeys(schema.names), ERROR: f"{type(error).__name__}: {error}"[:1000]}])
                for name, value in zip(names, key, strict=True):
                    made[name] = [None if value != value else value] * len(made)
                yield made[full.names]

    return df.mapInPandas(run, full)


def failed_path(path: str) -> str:
    return f"{path.rstrip('/')}_failed"


def run_guarded(df: DataFrame, path: str, keys: Sequence[str], step: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType) -> DataFrame:
    """Write the output of all keys that succeed as partitions of `path`; returns the failed ones (keys, message).

    Keys that succeed now leave the list of failed ones; those not in `df` stay on it.
    """
    spark, names = df.sparkSession, list(keys)
    made = stored(guarded(df, keys, step, schema), "guarded")
    failed = stored(made.where(F.col(ERROR).isNotNull()).groupBy(*names).agg(F.min(ERROR).alias("message")), "failed")
    write_partitions(pending_work(made.where(F.col(ERROR).isNull()).drop(ERROR), failed, names), path, names)
    before = read_if_there(spark, failed_path(path))
    if before is not None:
        before = before.select(*[F.col(k).cast(failed.schema[k].dataType).alias(k) for k in names], "message")
        failed = stored(failed.unionByName(pending_work(before, made, names)), "failed")
    failed.write.mode("overwrite").parquet(failed_path(path))
    return failed


def work_status(spark: SparkSession, work: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """`work` with rows, status (done, pending or failed) and the message of a failed key."""
    status = partition_status(spark, work, path, keys)
    failed = read_if_there(spark, failed_path(path))
    if failed is None:
        return status.withColumn("message", F.lit(None).cast("string"))
    kinds = {f.name: f.dataType for f in work.schema}
    failed = failed.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], "message")
    return status.join(failed, list(keys), "left").withColumn("status", F.when(F.col("message").isNotNull(), "failed").otherwise(F.col("status")))


def open_rows(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Rows of keys that aren't done yet: new ones and those that failed."""
    work = df.select(*keys).distinct()
    todo = work_status(df.sparkSession, work, path, keys).where("status <> 'done'")
    return df.join(todo.select(*keys), list(keys), "left_semi")
