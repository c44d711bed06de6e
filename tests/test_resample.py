from datetime import datetime, timedelta

from pyspark.sql import functions as F

from verimet.operators import resample


def T(h, m=0, d=1):
    return datetime(2024, 1, d, h, m)


def test_left_bins_gauge_reset_spike_and_null_bin(spark):
    rows = [("a", T(13, 0), 0.0), ("a", T(13, 5), 2.0), ("a", T(14, 0), 5.0), ("a", T(14, 5), 1.0), ("a", T(15, 0), 700.0), ("a", T(17, 0), 701.0)]
    df = spark.createDataFrame(rows, "station string, time_5M timestamp_ntz, precip_total double")
    got = {r.valid_time: r.precip_total for r in resample.precip_bins(df).collect()}
    # 13:00 is in the 13:00 bin; the reset gives 0, the spike null (sums to 0), 16:00 has no row.
    assert got == {T(13): 2.0, T(14): 3.0, T(15): 0.0, T(17): 1.0}


def test_station_table_samples_top_of_hour(spark):
    rows = [("a", T(3, 0), 1.0, 10.0, 0.0), ("a", T(3, 5), 3.0, 11.0, 1.0), ("a", T(4, 0), 5.0, 12.0, 1.0), ("a", T(5, 30), 7.0, 13.0, 4.0)]
    df = spark.createDataFrame(rows, "station string, time_5M timestamp_ntz, wspd_sonic double, tair double, precip_total double")
    hourly = {r.valid_time.hour: r for r in resample.station_table(df, 1, ["tair", "wspd_sonic"]).collect()}
    assert (hourly[3].tair, hourly[3].wspd_sonic, hourly[3].wspd_sonic_mean, hourly[3].precip_total) == (10.0, 1.0, 2.0, 1.0)
    assert hourly[5].tair is None and hourly[5].precip_total == 3.0
    three = resample.station_table(df, 3, ["tair"]).collect()
    assert [(r.valid_time, r.tair, r.wspd_sonic_mean, r.precip_total) for r in three] == [(T(3), 10.0, 4.0, 4.0)]


def airport(spark, rows):
    return spark.createDataFrame(rows, "station string, valid string, tmpf string, sknt string, gust string, p01i string")


def test_airport_hours_right_closed_with_gap(spark):
    raw = airport(spark, [
        ("a", "2024-01-01 13:00", "50", "10", "20", "0.1"), ("a", "2024-01-01 13:05", "M", "20", "M", "M"),
        ("a", "2024-01-01 13:55", "59", "M", "M", "0.2"), ("a", "2024-01-01 15:30", "32", "10", "30", "bad"), ("a", "junk", "1", "1", "1", "1"),
    ])
    got = {r.valid_time: r for r in resample.airport_hours(resample.airport_units(raw)).collect()}
    assert sorted(got) == [T(13), T(14), T(15), T(16)]
    assert got[T(13)].tair == 10.0 and got[T(14)].tair == 15.0
    assert abs(got[T(14)].precip_total - 5.08) < 1e-9 and got[T(15)].tair is None
    stations = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "station string, lat double, lon double, elev double")
    table = {r.valid_time: r for r in resample.airport_table(raw, stations).collect()}
    assert table[T(15)].tair == -999.0 and table[T(15)].precip_total == 0.0 and table[T(16)].precip_total == 0.0
    assert table[T(14)].snow_depth == -999.0 and table[T(14)].elev == 3.0


def test_right_label_fills_gaps(spark):
    df = spark.createDataFrame([("a", T(0, 10), 1.0), ("a", T(3, 10), 5.0)], "station string, time_5M timestamp_ntz, tair double")
    got = {r.valid_time.hour: r.tair for r in resample.resample_right_label(df, ["tair"], "mean").collect()}
    assert got == {1: 1.0, 2: None, 3: None, 4: 5.0}
    assert resample.resample_right_label(df, ["tair"], "sum").where(F.col("tair") == 0).count() == 2


def test_availability_counts_sentinel_and_null(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", start + timedelta(hours=i), v) for i, v in enumerate([1.0, -999.0, None, 2.0])], "station string, valid_time timestamp_ntz, tair double")
    assert resample.availability(df).first().share == 0.5
