"""Report tables built from evaluation rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verimet.operators.filters import between_dates, error_within
from verimet.operators.setops import union_all
from verimet.operators.summarise import (
    box_statistics, error_by_bucket, error_by_period, point_density, scatter_diagnostics, skill, station_counts, weighted_mean, wide_by_lead,
)
from verimet.operators.verify import drift_by_lead, r2_by_lead
from verimet.session import stored

BOX = ("n", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers")


def comparison_table(base: DataFrame, candidate: DataFrame, stations: DataFrame, period: str) -> DataFrame:
    """Rows for base, candidate, % improvement, each division and all stations.

    Long form: (row_label, period, error).  Inputs: division, period, error.
    """
    counts = station_counts(stations)
    b, c = weighted_mean(base, counts, period), weighted_mean(candidate, counts, period)
    gain = skill(b, c, [period]).select(F.lit("improvement_pct").alias("row_label"), period, F.col("gain_pct").alias("error"))
    rows = [
        b.select(F.lit("base").alias("row_label"), period, "error"),
        c.select(F.lit("candidate").alias("row_label"), period, "error"),
        gain,
        candidate.select(F.col("climate_division_name").alias("row_label"), period, "error"),
        c.select(F.lit("All Stations").alias("row_label"), period, "error"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def division_period_errors(df: DataFrame, stations: DataFrame, period: str, statistic: str = "abs", value: str = "difference", limit: float | None = None) -> DataFrame:
    """Error per division and period, from evaluation rows."""
    places = stations.select(F.col("station").alias("stid"), "climate_division_name")
    placed = df.join(places, "stid")
    return error_by_period(placed, period, statistic, ["climate_division_name"], value, limit=limit)


def _tolerance() -> Column:
    # Fixed tolerance: 5 for precipitation, 2 for the other variables.
    return F.when(F.col("metvar") == "tp", 5.0).otherwise(2.0)


def scatter_rows(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of the scatter report: strict dates, then the per-variable size gates."""
    x, y = F.abs("actual"), F.abs("model_output")
    gate = F.when(F.col("metvar") == "tp", (x > 0.15) & (y > 0.15)).otherwise((x < 100) & (y < 100))
    return between_dates(df, start, end).where(gate)


def scatter_report(df: DataFrame, start: str, end: str, keys: Sequence[str] = ("metvar",)) -> DataFrame:
    return scatter_diagnostics(scatter_rows(df, start, end), "actual", "model_output", _tolerance(), keys)


def scatter_points(df: DataFrame, start: str, end: str, bins: int = 300) -> DataFrame:
    """Points of the scatter plots of all variables, each with bins of its own."""
    return point_density(scatter_rows(df, start, end), "actual", "model_output", bins, ["metvar"])


def bulk_errors(df: DataFrame, start: str, end: str, at_least: float = 1.0) -> DataFrame:
    """Evaluation rows of the bulk report: |difference| above the gate, strict dates."""
    return between_dates(error_within(df, F.round("difference", 6), above=at_least), start, end)


def bulk_tables(
    df: DataFrame, conditions: DataFrame, start: str, end: str, condition: str, base: float, leads: Sequence[int],
    at_least: float = 1.0, limit: float | None = None,
) -> dict[str, DataFrame]:
    """Every table of the bulk report from the gated rows, which are stored once: `report` (the long table of
    `bulk_report`), `boxes` (per month and hour of day), `conditions` (error per bucket of a condition, which
    `conditions` has per stid and valid_time) and `wide` (one column per forecast hour).
    """
    rows = stored(bulk_errors(df, start, end, at_least), "bulk-rows")
    boxes = [box_statistics(rows, period, limit=limit).select(F.lit(period).alias("period"), F.col(period).cast("long").alias("key"), *BOX)
             for period in ("month", "hour")]
    placed = rows.join(conditions.select("stid", "valid_time", condition), ["stid", "valid_time"], "left")
    return {
        "report": _bulk_report(rows, limit), "boxes": union_all(boxes),
        "conditions": error_by_bucket(placed, condition, base, ["stid", "valid_time", "metvar"]),
        "wide": wide_by_lead(rows, leads, ["valid_time", "stid", "metvar"]),
    }


def bulk_report(df: DataFrame, start: str, end: str, at_least: float = 1.0, limit: float | None = None) -> DataFrame:
    """The report tables of the gated rows as one long table: (table, key, value).

    Drift (MAE, MSE) and R2 per forecast hour; bias, spread and MAE per month and per hour of day.
    """
    return _bulk_report(bulk_errors(df, start, end, at_least), limit)


def _bulk_report(rows: DataFrame, limit: float | None) -> DataFrame:
    drift = drift_by_lead(rows, limit)
    parts = [drift.select(F.lit(f"drift_{m}").alias("table"), F.col("fh").cast("long").alias("key"), F.col(m).alias("value")) for m in ("mae", "mse")]
    parts.append(r2_by_lead(rows, limit=limit).select(F.lit("r2").alias("table"), F.col("fh").cast("long").alias("key"), F.col("r2").alias("value")))
    for period in ("month", "hour"):
        for statistic in ("mean", "std", "abs"):
            table = error_by_period(rows, period, statistic, limit=limit)
            parts.append(table.select(F.lit(f"{period}_{statistic}").alias("table"), F.col(period).alias("key"), F.col("error").alias("value")))
    return union_all(parts)
