import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from verimet.functions.geo import Box
from verimet.operators import filters
from verimet.schemas import FORECAST
from verimet.session import work_path
from verimet.sources import lookups, sinks, tables


def frame(spark, rows):
    return spark.createDataFrame(rows, "valid_time timestamp_ntz, stid string, v double, fh int")


def test_upsert_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    t = datetime(2024, 1, 1)
    sinks.upsert_partitions(frame(spark, [(t, "a", 1.0, 1), (t, "a", 2.0, 2)]), path, ["valid_time", "stid", "fh"], ["fh"])
    before = {p.name for p in (tmp_path / "t" / "fh=2").glob("*.parquet")}
    for _ in range(2):
        sinks.upsert_partitions(frame(spark, [(t, "a", 9.0, 1), (t, "b", 3.0, 1)]), path, ["valid_time", "stid", "fh"], ["fh"])
    assert {p.name for p in (tmp_path / "t" / "fh=2").glob("*.parquet")} == before
    assert {(r.stid, r.v, r.fh) for r in spark.read.parquet(path).collect()} == {("a", 9.0, 1), ("b", 3.0, 1), ("a", 2.0, 2)}


def test_batches_replace_themselves(spark, tmp_path):
    path, t = str(tmp_path / "b"), datetime(2024, 1, 1)
    sinks.append_batch(frame(spark, [(t, "a", 1.0, 1)]), path, 0)
    sinks.append_batch(frame(spark, [(t, "a", 2.0, 1)]), path, 1)
    sinks.append_batch(frame(spark, [(t, "a", 3.0, 1)]), path, 1)
    assert spark.read.parquet(path).count() == 2
    assert sinks.read_latest(spark, path, ["valid_time", "stid", "fh"]).first().v == 3.0


def test_partition_filters_reach_the_scan(spark, tmp_path):
    path, t = str(tmp_path / "f"), datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", t, 1, 1.0, 2.0), ("a", t, 2, None, 2.0)], "station string, valid_time timestamp_ntz, fh int, t2m double, new_tp double")
    sinks.write_forecasts(rows, path)
    out = tables.read_forecasts(spark, path, fh=2, years=[2024], columns=["station", "t2m"])
    assert out.first().t2m == -999.0
    plan = out._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "PartitionFilters" in line][0]
    assert "fh" in scan.split("PartitionFilters")[1].split("]")[0] and "new_tp" not in scan.split("ReadSchema")[1]
    assert tables.read_forecasts(spark, str(tmp_path / "absent"), schema=FORECAST).count() == 0
    with pytest.raises(Exception):
        tables.read_forecasts(spark, str(tmp_path / "absent"))


def test_airport_file_with_header(spark, tmp_path):
    file = tmp_path / "a.txt"
    head = "station,valid,lat,lon,elevation,tmpf,dwpf,relh,drct,sknt,gust,p01i,alti,mslp,vsby,skyc1,skyl1"
    file.write_text("#DEBUG: note\n" + head + "\nKAAA,2024-01-01 00:51,1,2,3,50,M,M,M,M,M,0.0001,29.9,M,M,M,M\n")
    row = lookups.read_airport_text(spark, str(file)).first()
    assert (row.station, row.tmpf, row.dwpf, row.p01i) == ("KAAA", "50", None, "0.0001")


def test_inventory_file_and_box(spark, tmp_path):
    file = tmp_path / "n.json"
    file.write_text(json.dumps({"features": [
        {"properties": {"sid": "B", "sname": "Bee", "elevation": 5.0}, "geometry": {"coordinates": [-75.0, 41.0]}},
        {"properties": {"sid": "A", "sname": "Ay", "elevation": 6.0}, "geometry": {"coordinates": [-75.0, 43.0]}},
        {"properties": {"sid": "X", "sname": "No place", "elevation": None}, "geometry": {"coordinates": []}},
    ]}))
    rows = lookups.read_inventory(spark, str(file), "NY_ASOS")
    assert rows.count() == 3
    got = lookups.stations_in_box(rows.unionByName(rows), Box(40, 43, -76, -74)).collect()
    assert [r.station for r in got] == ["A", "B"]


def test_state_default(spark):
    got = spark.range(1).select(filters.states_of_box(*[F.lit(v) for v in (-10.0, -9.0, 10.0, 11.0)]).alias("s")).first().s
    assert got == ["NY"]


def test_missing_stage_folder_is_created(spark):
    path = work_path(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_stream_twice_writes_once(spark, tmp_path):
    from verimet.sources.sinks import read_latest
    from verimet.streaming import increments

    src = str(tmp_path / "in")
    schema = "station string, time_5M timestamp_ntz, tair double, wspd_sonic double"
    rows = [("a", datetime(2024, 1, 1, h, 10), float(h), float(h)) for h in range(6)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    from pyspark.sql import types as T

    typed = T._parse_datatype_string(schema)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):
        increments.append_batches(increments.read_stream(spark, src, typed), out, mark).awaitTermination()
    assert read_latest(spark, out, ["station", "time_5M"]).count() == 6
    bins, bmark = str(tmp_path / "bins"), str(tmp_path / "bmark")
    for _ in range(2):
        increments.append_closed_bins(increments.hourly_wind(increments.read_stream(spark, src, typed)), bins, bmark).awaitTermination()
    got = sorted((r.valid_time.hour, r.n) for r in spark.read.parquet(bins).collect())
    assert got == [(0, 1), (1, 1), (2, 1)]  # watermark 03:10 closes bins that end by 03:00


def test_image_folders_follow_years_not_stations(spark, tmp_path):
    """Many stations share the folders of a year; a station's images are replaced and no other station's."""
    path = str(tmp_path / "images")

    def images(stations, value):
        rows = [(s, datetime(y, 1, 1, h), value) for s in stations for y in (2023, 2024) for h in (0, 1)]
        return spark.createDataFrame(rows, "station string, valid_time timestamp_ntz, v double")

    names = [*[f"S{i}" for i in range(300)], None]
    sinks.write_images(images(names, 1.0), path)
    folders = {p.parent for p in (tmp_path / "images").rglob("*.parquet")}
    assert len(folders) <= 2 * sinks.IMAGE_PARTS < 2 * len(names)
    for _ in range(2):
        sinks.write_images(images(["S7", None, "new"], 2.0), path)
    got = sorted((str(r.station), r.valid_time, r.v) for r in spark.read.parquet(path).collect())
    want = [(str(s), datetime(y, 1, 1, h), 2.0 if s in ("S7", None, "new") else 1.0) for s in [*names, "new"] for y in (2023, 2024) for h in (0, 1)]
    assert got == sorted(want)
