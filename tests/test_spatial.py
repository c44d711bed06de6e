import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verimet.operators import spatial


def brute(pdf, k):
    lat, lon = np.radians(pdf["lat"].to_numpy()), np.radians(pdf["lon"].to_numpy())
    p = np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
    ids = pdf["station"].to_numpy()
    out = {}
    for i, s in enumerate(ids):
        chord = np.floor(np.sqrt(((p - p[i]) ** 2).sum(1)) * spatial.TIE_SCALE)
        rest = sorted((c, o) for j, (c, o) in enumerate(zip(chord, ids)) if j != i)
        out[s] = [s, *[o for _, o in rest[: k - 1]]]
    return out


@pytest.fixture(scope="module")
def stations():
    rng = np.random.default_rng(3)
    dense = np.column_stack([rng.normal(42, 0.02, 120), rng.normal(-74, 0.02, 120)])  # a tight cluster
    wide = np.column_stack([rng.uniform(-89, 89, 60), rng.uniform(-180, 180, 60)])
    polar = np.array([[89.9, 0], [89.9, 180], [-89.95, 30], [0, 179.99], [0, -179.99]])
    same = np.tile([[10.0, 10.0]], (40, 1))  # many stations on one spot
    pos = np.vstack([dense, wide, polar, same])
    return pd.DataFrame({"station": [f"S{i:03d}" for i in range(len(pos))], "lat": pos[:, 0], "lon": pos[:, 1]})


def test_nearest_stations_equal_brute_force(spark, stations):
    got = spatial.station_clusters(spark.createDataFrame(stations), 4).collect()
    assert {r.station: list(r.closest_stations) for r in got} == brute(stations, 4)


def test_too_few_stations(spark, stations):
    with pytest.raises(ValueError):
        spatial.station_clusters(spark.createDataFrame(stations.head(3)), 4)


def test_nearest_grid_point(spark, stations):
    rng = np.random.default_rng(9)
    grid = pd.DataFrame({"latitude": rng.uniform(30, 50, 400).round(4), "longitude": rng.uniform(-90, -60, 400).round(4)})
    near = spatial.nearest_grid_points(spark.createDataFrame(stations), spark.createDataFrame(grid), 2).toPandas()

    def sphere(la, lo):
        la, lo = np.radians(la), np.radians(lo)
        return np.column_stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])

    g = sphere(grid["latitude"], grid["longitude"])
    for _, s in stations.iterrows():
        order = np.argsort(((g - sphere([s.lat], [s.lon])) ** 2).sum(1))[:2]
        mine = near[near["station"] == s.station].sort_values("rank")
        assert np.allclose(mine["gla"] / 1e4, grid["latitude"].iloc[order], atol=1e-6)


def test_bilinear_reproduces_a_plane_and_marks_missing(spark):
    grid = spark.range(0, 5).crossJoin(spark.range(0, 5).withColumnRenamed("id", "j")).select(
        (40 + F.col("id") * 0.5).alias("latitude"), (-75 + F.col("j") * 0.5).alias("longitude"))
    grid = grid.withColumn("v", 2 * F.col("latitude") - 3 * F.col("longitude")).withColumn("t", F.lit(1))
    st = spark.createDataFrame([("a", 40.7, -74.1), ("b", 41.0, -74.5), ("out", 45.0, -74.0), ("edge", 42.3, -74.1)], "station string, lat double, lon double")
    got = {r.station: r.v for r in spatial.interpolate_bilinear(st, grid, ["v"], 0.5, ["t"]).collect()}
    assert got["a"] == pytest.approx(2 * 40.7 + 3 * 74.1) and got["b"] == pytest.approx(2 * 41 + 3 * 74.5)
    assert "out" not in got and got.get("edge") is None


def test_inverse_distance_on_the_point(spark):
    grid = spark.createDataFrame([(40.0, -75.0, 1, 7.0), (40.1, -75.0, 1, 9.0), (40.0, -75.1, 1, 11.0)], "latitude double, longitude double, t int, v double")
    st = spark.createDataFrame([("a", 40.0, -75.0)], "station string, lat double, lon double")
    assert spatial.interpolate_inverse_distance(st, grid, ["v"], ["t"]).first().v == pytest.approx(7.0, abs=1e-6)


def test_bilinear_folds_boxes_not_stations(spark):
    """Many stations of a box take their values from one row of it; a station listed twice counts eight corners."""
    cells = [(38.0 + i * 0.5, -80.0 + j * 0.5, t, float(i * 7 + j * j + t)) for i in range(3) for j in range(3) for t in (0, 1) if (i, j, t) != (2, 2, 1)]
    grid = spark.createDataFrame(cells, "latitude double, longitude double, t int, v double")
    places = [(f"S{k}", 38.0 + k % 19 / 20, -80.0 + k % 17 / 20) for k in range(300)]
    st = spark.createDataFrame([*places, ("S3", 38.1, -79.9), ("gone", 10.0, 10.0), ("none", None, None)], "station string, lat double, lon double")
    out = spatial.interpolate_bilinear(st, grid, ["v"], 0.5, ["t"])
    got = {(r.station, r.t): r.v for r in out.collect()}
    value = {(round((a - 38) * 2), round((b + 80) * 2), t): v for a, b, t, v in cells}
    assert len(got) == out.count() == 600
    for name, lat, lon in places:
        x, y = (lat - 38) * 2, (lon + 80) * 2
        i, j = int(x + 1e-9), int(y + 1e-9)
        for t in (0, 1):
            want = [value.get((i + a, j + b, t)) for a in (0, 1) for b in (0, 1)]
            if name == "S3" or None in want:
                assert got[name, t] is None
            else:
                w = [(x - i if a else 1 - x + i) * (y - j if b else 1 - y + j) for a in (0, 1) for b in (0, 1)]
                assert got[name, t] == pytest.approx(sum(p * q for p, q in zip(w, want, strict=True)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_i0" in plan
