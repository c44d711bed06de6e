"""Rounding, clipping, missing values and tolerant parsing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how input files mark a missing number.
SENTINEL = -999.0


def round_to_multiple(x: Column, base: float) -> Column:
    """Nearest multiple of `base`; halves go to the even multiple."""
    return F.rint(x / F.lit(float(base))) * F.lit(float(base))


def round_fine_below_one(x: Column, digits: int) -> Column:
    """`digits` decimals for 0 <= x < 1, whole numbers elsewhere (half-even)."""
    scale = float(10**digits)
    return F.when((x >= 0) & (x < 1), F.rint(x * scale) / scale).otherwise(F.rint(x))


def clip_low(x: Column, low: float = 0.0) -> Column:
    """Lower clip that keeps null (``greatest`` alone would replace it)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def null_above(x: Column, limit: float) -> Column:
    return F.when(x <= limit, x)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def sentinel_to_null(x: Column, sentinel: float = SENTINEL) -> Column:
    return F.nullif(x, F.lit(sentinel))


def fill_sentinel(df: DataFrame, columns: Iterable[str] | None = None, value: float = SENTINEL) -> DataFrame:
    """Fill all numeric columns, or the named ones."""
    return df.fillna(value, subset=list(columns) if columns is not None else None)


def clear_sentinel(df: DataFrame, columns: Iterable[str], value: float = SENTINEL) -> DataFrame:
    return df.withColumns({c: sentinel_to_null(F.col(c), value) for c in columns})


def to_number(text: Column) -> Column:
    """Number, or null when the text is not one."""
    return F.try_cast(text, "double") if hasattr(F, "try_cast") else text.try_cast("double")


def to_time(text: Column, fmt: str | None = None) -> Column:
    """Naive timestamp, or null when the text is not one."""
    parsed = F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)
    return parsed.cast("timestamp_ntz")


def first_element(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def interval_95(mu: Column, variance: Column) -> tuple[Column, Column]:
    half = F.lit(1.96) * F.sqrt(variance)
    return mu - half, mu + half


def interval_95_arrays(mu: Column, variance: Column) -> tuple[Column, Column]:
    low = F.zip_with(mu, variance, lambda m, v: m - F.lit(1.96) * F.sqrt(v))
    high = F.zip_with(mu, variance, lambda m, v: m + F.lit(1.96) * F.sqrt(v))
    return low, high


def stable_round(x: Column, digits: int = 6) -> Column:
    """Decimal rounding whose ties do not hang on the last bit of a sum."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5001) / scale
