from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from verimet.operators import windows

PAST, FH = 30, 6


def reference(x, y, masked, persisted, i):
    """Independent numpy form of one window."""
    n, width = PAST + FH, x.shape[1]
    w = np.zeros((n, width))
    part = x[i : i + n]
    w[: len(part)] = part
    t = np.zeros(FH)
    tail = y[i + PAST : i + n]
    t[: len(tail)] = tail
    past = w[:PAST]
    mean = np.nanmean(past, axis=0)
    filled = np.where(np.isnan(past), mean, past)
    sd = filled.std(axis=0)
    sd = np.where(sd < 1e-8, 1, sd)
    out = np.where(masked, (w - mean) / sd, w)
    out[PAST:, persisted] = out[PAST - 1, persisted]
    return out, t


@pytest.mark.parametrize("block_rows", [2048, 35])
def test_windows_equal_numpy(spark, block_rows):
    rng = np.random.default_rng(0)
    n = 90
    data = rng.normal(5, 2, (n, 3))
    data[:, 1] = 4.2  # constant column: spread below the floor
    data[[3, 29, 40, 50], 2] = np.nan  # nulls in past rows and in a last past row
    y = rng.normal(size=n)
    start = datetime(2024, 1, 20)
    rows = [
        ("a", start + timedelta(hours=int(i) + (5 if i > 20 else 0)), *[None if np.isnan(v) else float(v) for v in data[i]], float(y[i]))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "k string, valid_time timestamp_ntz, f double, c double, o double, target_error double")
    out = windows.build_windows(df, ["k"], ["f", "c", "o"], ["o"], steps=FH, max_steps=FH, normalise=["f", "o"], block_rows=block_rows)
    got = out.orderBy("start").collect()
    assert len(got) == n  # one window per row
    for i, row in enumerate(got):
        want, target = reference(data, y, np.array([True, False, True]), [2], i)
        x = np.array([[np.nan if v is None else v for v in r] for r in row.x], dtype=float)
        assert np.allclose(x, want, equal_nan=True, atol=1e-9), i
        assert np.allclose(row.y, target)
        assert (row.init_time is None) == (i + PAST > n)
        if i + PAST + FH > n:
            assert row.future_times[-1] == 0
    full = np.array([r.f for r in got[0].x[:PAST]])
    assert full.mean() == pytest.approx(0, abs=1e-9) and full.std() == pytest.approx(1)


def test_steps_by_model():
    assert [windows.future_steps(m, 7) for m in ("HRRR", "GFS", "NAM")] == [7, 2, 3]
    with pytest.raises(KeyError):
        windows.future_steps("XYZ", 1)


def test_all_images_missing_is_an_error(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1), [None, None])], "k string, valid_time timestamp_ntz, im array<array<double>>")
    with pytest.raises(Exception, match="no image"):
        windows.window_images(df, ["k"], "im").collect()


def test_profile_image_missing_cell_is_null(spark):
    t0, t1 = datetime(2024, 1, 1, 5, 0), datetime(2024, 1, 1, 5, 10)
    df = spark.createDataFrame([("a", t0, 100, 1.0), ("a", t0, 200, 2.0), ("a", t1, 100, 3.0)], "station string, time timestamp_ntz, range int, temperature double")
    row = windows.profile_images(df, ["temperature"]).first()
    assert row.image == [[[1.0], [3.0]], [[2.0], [None]]]


def test_latest_snapshot_prefers_now(spark):
    times = [datetime(2024, 1, 1, h) for h in range(3)]
    df = spark.createDataFrame([(t,) for t in times], "valid_time timestamp_ntz")
    assert windows.latest_snapshot(df, times[1]).first()[0] == times[1]
    assert windows.latest_snapshot(df, datetime(2030, 1, 1)).first()[0] == times[2]
    assert windows.latest_snapshot(df).first()[0] == times[2]
    assert windows.with_data(spark.createDataFrame([([1],), ([],), (None,)], "x array<int>")).count() == 1


def test_clusters_need_all_members(spark):
    from verimet.operators import features

    t = datetime(2024, 1, 1)
    long = spark.createDataFrame([(s, 1, t + timedelta(hours=h), float(ord(s)), None if (s, h) == ("d", 0) else 1.0)
                                  for s in "abcd" for h in (0, 1) if (s, h) != ("c", 1)],
                                 "station string, fh int, valid_time timestamp_ntz, v double, o double")
    clusters = spark.createDataFrame([("a", ["a", "b", "c", "d"])], "station string, closest_stations array<string>")
    got = features.cluster_rows(long, clusters, ["v"]).collect()
    assert len(got) == 1 and (got[0].v_0, got[0].v_3) == (97.0, 100.0)
    seen = long.withColumn("_observed", F.col("o").isNotNull())
    wide = features.cluster_rows(seen, clusters, ["v"], optional=["o"]).first()
    assert wide.o_0 is None and wide.v_0 == 97.0


def test_stored_layout_is_read_without_exchange(spark):
    """Two uses of one layout; both equal the windows made from the rows, and neither shuffles."""
    from verimet.session import work_path

    rows = spark.range(900).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise("b").alias("k"), F.expr("TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, cast(id as int))").alias("valid_time"),
        (F.col("id") % 13).cast("double").alias("t2m"), (F.col("id") % 7).cast("double").alias("e"))
    table = windows.store_layout(rows, ["k"], "layout_test", work_path(spark, "layout"), past=5, max_steps=4, block_rows=64, buckets=4)
    for past, steps, names in ((5, 4, ["t2m", "e"]), (3, 1, ["t2m"])):
        options = dict(past=past, steps=steps, max_steps=steps, target="e", normalise=["t2m"], block_rows=64)
        stored = windows.build_windows(table, ["k"], names, laid_out=True, **options)
        assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString()
        plain = windows.build_windows(rows, ["k"], names, **options)
        pick = lambda df: sorted((r.k, r.start, r.x, r.y, r.future_times) for r in df.collect())
        assert pick(stored) == pick(plain) and len(pick(plain)) == 900
