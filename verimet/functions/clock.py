"""Time functions.  Inputs are TIMESTAMP_NTZ (naive UTC) unless stated."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_interval(hours: Column) -> Column:
    return F.make_dt_interval(F.lit(0), hours.cast("int"))


def floor_hour(ts: Column, hours: int = 1) -> Column:
    """Start of the 1 h (or every-`hours`) bin of the day, kept as NTZ."""
    return ts - F.make_dt_interval(
        F.lit(0), (F.hour(ts) % hours).cast("int"), F.minute(ts), F.expr("0").cast("decimal(18,6)")
    ) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.extract(F.lit("SECOND"), ts).cast("decimal(18,6)"))


def lead_hours(init: Column, valid: Column) -> Column:
    """Whole hours from model start to valid time."""
    return F.timestamp_diff("HOUR", init, valid).cast("long")


def year_cycle(ts: Column, period: int = 366) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * F.dayofyear(ts) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def day_cycle(ts: Column) -> tuple[Column, Column]:
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    angle = F.lit(2.0) * F.pi() * seconds / F.lit(86400.0)
    return F.sin(angle), F.cos(angle)


def from_epoch_ns(ns: Column) -> Column:
    """Nanoseconds since 1970 -> naive UTC timestamp, row by row."""
    micros = (ns - F.pmod(ns, F.lit(1000))).cast("decimal(20,0)") / F.lit(1_000_000_000)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), micros.cast("decimal(18,6)")
    )


def to_epoch_ns(ts: Column) -> Column:
    """Naive UTC timestamp -> nanoseconds since 1970."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts) * F.lit(1000)


def is_day(ts: Column) -> Column:
    """Hours 6..17 count as day."""
    return F.hour(ts).between(6, 17)


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "MMMM")


def hour_label(hour: Column) -> Column:
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))


def hour_from_label(label: Column) -> Column:
    return F.substring(label, 1, 2).cast("long")


def cleaning_window(day: Column) -> tuple[Column, Column]:
    """First day of the previous month .. end of min(next day, month end)."""
    start = F.trunc(F.add_months(day, -1), "MM").cast("timestamp_ntz")
    last = F.least(F.date_add(day, 1), F.last_day(day)).cast("timestamp_ntz")
    return start, last + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59), F.lit(59).cast("decimal(18,6)"))


def cleaning_window_dates(day: date) -> tuple[date, date]:
    """The same rule for one known day, on the driver."""
    start = (day.replace(day=1) - timedelta(days=1)).replace(day=1)
    next_month = (day.replace(day=28) + timedelta(days=4)).replace(day=1)
    return start, min(day + timedelta(days=1), next_month - timedelta(days=1))
