"""Versions of a partitioned table: all or nothing, one winner."""

import pytest

from verimet.session import work_path
from verimet.sources import snapshots

KEYS = ["fh", "metvar", "station"]
SCHEMA = "fh long, metvar string, station string, v double"


def rows(spark, *data):
    return spark.createDataFrame([(int(f), m, s, float(v)) for f, m, s, v in data], SCHEMA)


def held(spark, path, version=None):
    return sorted(tuple(r) for r in snapshots.read_version(spark, path, version).select("fh", "metvar", "station", "v").collect())


def put(frame, path, **options):
    return snapshots.upsert_version(frame, path, KEYS, ["fh", "metvar"], ["v"], **options)


def test_versions(spark):
    path = work_path(spark, "versions")
    assert snapshots.read_version(spark, path) is None
    put(rows(spark, (1, "tp", "a", 1), (2, "tp", "a", 2), (2, "a b/c", "a", 3)), path)
    second = put(rows(spark, (2, "tp", "a", 5), (2, "tp", "b", 6), (3, "tp", "a", 7)), path)
    assert second.number == 1 and len(second.parts) == 4
    assert held(spark, path) == [(1, "tp", "a", 1.0), (2, "a b/c", "a", 3.0), (2, "tp", "a", 5.0), (2, "tp", "b", 6.0), (3, "tp", "a", 7.0)]
    assert held(spark, path, 0) == [(1, "tp", "a", 1.0), (2, "a b/c", "a", 3.0), (2, "tp", "a", 2.0)]
    with pytest.raises(ValueError):
        snapshots.current_version(spark, path, 9)
    with pytest.raises(ValueError):
        snapshots.upsert_version(rows(spark, (1, "tp", "a", 1)), path, ["station"], ["fh"])


def test_a_write_that_stops_leaves_the_old_version(spark, monkeypatch):
    """Stopped after some partitions were written, and stopped just before the commit."""
    path = work_path(spark, "stopped")
    put(rows(spark, (1, "tp", "a", 1), (2, "tp", "a", 2)), path)
    before = held(spark, path)
    real = snapshots.write_partitions

    def half(frame, target, by):
        real(frame.where("fh = 1"), target, by)
        raise RuntimeError("lost")

    for name, broken in (("write_partitions", half), ("_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))):
        with monkeypatch.context() as patch:
            patch.setattr(snapshots, name, broken)
            with pytest.raises(RuntimeError, match="lost"):
                put(rows(spark, (1, "tp", "a", 10), (2, "tp", "a", 20)), path)
        assert held(spark, path) == before
    assert put(rows(spark, (1, "tp", "a", 10), (2, "tp", "a", 20)), path).number == 1
    assert held(spark, path) == [(1, "tp", "a", 10.0), (2, "tp", "a", 20.0)]


def test_two_writers_cannot_both_win(spark):
    path = work_path(spark, "two")
    base = put(rows(spark, (1, "tp", "a", 1)), path)
    put(rows(spark, (1, "tp", "b", 2)), path, base=base)
    with pytest.raises(snapshots.VersionConflict):
        put(rows(spark, (1, "tp", "c", 3)), path, base=base)
    assert held(spark, path) == [(1, "tp", "a", 1.0), (1, "tp", "b", 2.0)]
    put(rows(spark, (1, "tp", "c", 3)), path)  # the loser starts over
    assert held(spark, path) == [(1, "tp", "a", 1.0), (1, "tp", "b", 2.0), (1, "tp", "c", 3.0)]
