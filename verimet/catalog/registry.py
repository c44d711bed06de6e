"""Registration of queries and small helpers shared by their two forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verimet.catalog import inputs
from verimet.functions.values import stable_round

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register `fn(spark, folder)`; `sql` gets the CTEs of the named views in front."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(inputs.Inputs(spark, folder))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = inputs.with_views(sql, views)
        return fn

    return register


def r(column: Column | str, digits: int = 6) -> Column:
    """Stable rounding of a float result."""
    return stable_round(F.col(column) if isinstance(column, str) else column, digits)


def R(expr: str, digits: int = 6) -> str:
    """SQL twin of `r`."""
    scale = f"1e{digits}"
    return f"(floor(({expr}) * {scale} + 0.5001) / {scale})"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def R_list(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"{R(c, digits)} AS {c}" for c in columns)


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})
