import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from verimet.config import DataConfig, RunConfig, SplitConfig
from verimet.functions import clock, geo, thermo, units, values, wind
from verimet.functions.geo import Box
from verimet.operators import filters, projections


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def test_wind_direction_cases(spark):
    rows = spark.createDataFrame([(0.0, -1.0), (1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (None, 1.0)], "u double, v double")
    got = [r.d for r in rows.select(wind.wind_direction(F.col("u"), F.col("v")).alias("d")).collect()]
    assert got == [360.0, 270.0, 0.0, 90.0, None]


def test_half_even_buckets(spark):
    rows = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r.b for r in rows.select(values.round_to_multiple(F.col("x"), 1).alias("b")).collect()] == [0, 2, 2, 0]


def test_clip_keeps_null_and_sentinel(spark):
    got = one(spark, a=values.clip_low(F.lit(None).cast("double")), b=values.clip_low(F.lit(-3.0)),
              c=values.sentinel_to_null(F.lit(-999.0)), d=values.null_above(F.lit(600.0), 500.0))
    assert got == {"a": None, "b": 0.0, "c": None, "d": None}


def test_cycles_hit_the_unit_circle_on_leap_days(spark):
    rows = spark.createDataFrame([(datetime(2024, 2, 29, 6),), (datetime(2023, 12, 31, 23, 59, 59),)], "t timestamp_ntz")
    s, c = clock.year_cycle(F.col("t"))
    ds, dc = clock.day_cycle(F.col("t"))
    for row in rows.select((s * s + c * c).alias("y"), (ds * ds + dc * dc).alias("d")).collect():
        assert row.y == pytest.approx(1) and row.d == pytest.approx(1)
    assert rows.select(ds.alias("v")).first().v == pytest.approx(1.0)


def test_epoch_round_trip_and_lead(spark):
    t = F.lit("2024-01-02 03:04:05.678901").cast("timestamp_ntz")
    got = one(spark, back=clock.from_epoch_ns(clock.to_epoch_ns(t)),
              lead=clock.lead_hours(F.lit("2024-01-01 22:00:00").cast("timestamp_ntz"), F.lit("2024-01-02 04:30:00").cast("timestamp_ntz")))
    assert got["back"] == datetime(2024, 1, 2, 3, 4, 5, 678901) and got["lead"] == 6


def test_cleaning_window_in_january(spark):
    start, end = clock.cleaning_window(F.lit(date(2025, 1, 31)))
    got = one(spark, a=start, z=end)
    assert got["a"] == datetime(2024, 12, 1) and got["z"] == datetime(2025, 1, 31, 23, 59, 59)
    assert clock.cleaning_window_dates(date(2025, 1, 31)) == (date(2024, 12, 1), date(2025, 1, 31))


def test_floor_hour_keeps_naive_type(spark):
    t = F.lit("2024-05-01 13:47:12.5").cast("timestamp_ntz")
    df = spark.range(1).select(clock.floor_hour(t).alias("h"), clock.floor_hour(t, 3).alias("h3"))
    assert dict(df.dtypes) == {"h": "timestamp_ntz", "h3": "timestamp_ntz"}
    assert df.first().asDict() == {"h": datetime(2024, 5, 1, 13), "h3": datetime(2024, 5, 1, 12)}


def test_dewpoint_and_pressure(spark):
    got = one(spark, td=thermo.dewpoint(F.lit(20.0), F.lit(1.0)), dry=thermo.dewpoint(F.lit(20.0), F.lit(0.0)),
              p=thermo.altimeter_to_sea_level_pressure(F.lit(1000.0), F.lit(0.0), F.lit(15.0)))
    assert got["td"] == pytest.approx(20.0) and got["dry"] is None and got["p"] == pytest.approx(1000.3)


def test_units_and_wrap(spark):
    got = one(spark, f=units.fahrenheit_to_celsius(F.lit(212.0)), w=geo.wrap_longitude(F.lit(-190.0)), e=geo.wrap_longitude(F.lit(180.0)))
    assert got == {"f": 100.0, "w": 170.0, "e": -180.0}


def test_haversine_quarter_circle(spark):
    km = one(spark, d=geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))["d"]
    assert km == pytest.approx(6371.0 * math.pi / 2)


def test_box_checks(spark):
    with pytest.raises(ValueError):
        Box(2, 1, 0, 1)
    with pytest.raises(KeyError):
        filters.in_box(spark.range(1), Box(0, 1, 0, 1))
    assert Box(0, 1, 0, 1).corners()[0] == Box(0, 1, 0, 1).corners()[-1]


def test_config_rules(spark):
    with pytest.raises(ValueError):
        SplitConfig(date(2024, 1, 1), date(2024, 2, 1), 0.5, 0.1, 0.1)
    with pytest.raises(ValueError):
        DataConfig(observation_source="local")
    split = SplitConfig(date(2024, 1, 1), date(2024, 4, 10), 0.7, 0.2, 0.1)
    with pytest.raises(ValueError):
        RunConfig(Box(0, 1, 0, 1), split, model="tree")
    days = spark.sql("SELECT explode(sequence(date'2023-12-31', date'2024-04-11', interval 1 day)) AS d")
    labels = {str(r.l): r.n for r in days.groupBy(split.label(F.col("d")).alias("l")).agg(F.count("*").alias("n")).collect()}
    assert labels == {"None": 2, "train": 70, "val": 20, "test": 11}


def test_feature_name_rules():
    names = ["t2m_0", "lat_0", "valid_time_sin", "elev_cat_1", "target_error", "images_0", "tair_3"]
    assert projections.normalised_features(names) == ["t2m_0", "tair_3"]
    assert projections.feature_names(names) == ["t2m_0", "lat_0", "valid_time_sin", "elev_cat_1", "tair_3"]
