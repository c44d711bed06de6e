"""Running scores, isolated failures, footers, buckets, many features."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verimet.catalog import QUERIES
from verimet.operators import isolation, running_scores, scoring, verify
from verimet.session import work_path
from verimet.sources import footers, sinks, tables

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "valid_time timestamp_ntz, stid string, fh long, metvar string, model_output double, actual double"


def predictions(seed, n=300, days=12):
    rng = np.random.default_rng(seed)
    hours = rng.integers(0, days * 24, n)
    return [((pd.Timestamp("2024-01-01") + pd.Timedelta(hours=int(h))).to_pydatetime(), f"S{rng.integers(3)}", int(rng.integers(1, 3)), "t2m",
             float(rng.normal()), None if rng.random() < 0.1 else float(rng.normal())) for h in hours]


def test_running_scores(spark):
    """Ten batches with corrections, rows that lose their truth, and a repeated batch equal the recomputed scores."""
    path, by, state = work_path(spark, "scores"), ["stid", "fh"], {}
    for batch in range(10):
        rows = list({r[:4]: r for r in predictions(batch, 120)}.values())
        state.update({r[:4]: r for r in rows})
        for _ in range(2 if batch == 9 else 1):
            running_scores.add_batch(spark.createDataFrame(rows, SCHEMA), path, batch, by)
    want = {(r.stid, r.fh): r for r in verify.station_scores(spark.createDataFrame(list(state.values()), SCHEMA), by).collect()}
    got = {(r.stid, r.fh): r for r in running_scores.current_scores(spark, path, by).collect()}
    assert set(got) == set(want)
    for key, r in want.items():
        assert got[key].n == r.n and got[key].mae == pytest.approx(r.mae) and got[key].rmse == pytest.approx(r.rmse) and got[key].bias == pytest.approx(r.bias)
    errors = pd.DataFrame([(r[1], r[2], abs(r[4] - r[5])) for r in state.values() if r[5] is not None], columns=["stid", "fh", "e"])
    share = {(r.stid, r.fh): r.share for r in running_scores.share_below(running_scores.current_sums(spark, path, by), by, 1.0).collect()}
    for key, part in errors.groupby(["stid", "fh"]):
        assert share[key] == pytest.approx((part.e < 1.0).mean())


def test_old_months_are_not_read(spark):
    """A batch looks up former rows in its own months alone."""
    path = work_path(spark, "months")
    rows = predictions(1, 200, 100)
    running_scores.add_batch(spark.createDataFrame(rows, SCHEMA), path, 0, ["fh"])
    files = spark.read.parquet(f"{path}/rows").where(F.col("month") != "2024-02-01").select("_metadata.file_path").distinct().collect()
    assert len(files) >= 2
    for file in files:  # unreadable from now on
        open(file[0].removeprefix("file://").removeprefix("file:"), "wb").write(b"broken")
    late = [r for r in rows if r[0].month == 2]
    running_scores.add_batch(spark.createDataFrame(late, SCHEMA), path, 1, ["fh"])
    assert running_scores.current_scores(spark, path, ["fh"]).agg(F.sum("n")).first()[0] == len({r[:4] for r in rows if r[5] is not None})


def test_failures_stay_alone(spark):
    path = work_path(spark, "guarded")
    rows = spark.range(1000).select((F.col("id") % 5).alias("k"), F.when(F.col("id") % 7 > 0, F.lit("x")).alias("g"), F.col("id").cast("double").alias("v")).repartition(6)
    schema = T.StructType([T.StructField("w", T.DoubleType())])

    def step(bad):
        def run(part):
            if part["v"].isin(bad).any():  # one row of one batch
                raise RuntimeError("bad row")
            return pd.DataFrame({"w": part["v"] + 1})
        return run

    failed = isolation.run_guarded(rows, path, ["k", "g"], step([12.0, 14.0]), schema)
    assert {tuple(r) for r in failed.collect()} == {(2, "x", "RuntimeError: bad row"), (4, None, "RuntimeError: bad row")}
    work = rows.select("k", "g").distinct()
    status = {(r.k, r.g): (r.status, r.message) for r in isolation.work_status(spark, work.where("g is not null"), path, ["k", "g"]).collect()}
    assert status[(2, "x")] == ("failed", "RuntimeError: bad row") and status[(1, "x")] == ("done", None)
    again = isolation.open_rows(rows.where("g is not null"), path, ["k", "g"])
    assert {tuple(r) for r in again.select("k", "g").distinct().collect()} == {(2, "x")}
    isolation.run_guarded(again, path, ["k", "g"], step([]), schema)
    left = {(r.k, r.g) for r in spark.read.parquet(isolation.failed_path(path)).collect()}
    assert left == {(4, None)}
    assert spark.read.parquet(path).where("g = 'x'").count() == rows.where("g = 'x'").count()


def test_footers(spark, tmp_path):
    good = str(tmp_path / "t")
    spark.range(5000).repartition(3).write.parquet(good)
    names = {"short.parquet": b"PAR1", "text.parquet": b"hello world, hello world", "end.parquet": b"PAR1" + b"x" * 40, "long.parquet": b"PAR1" + b"x" * 40 + (10**6).to_bytes(4, "little") + b"PAR1",
             "junk.parquet": b"PAR1" + b"x" * 40 + (20).to_bytes(4, "little") + b"PAR1"}
    for name, data in names.items():
        (tmp_path / "t" / name).write_bytes(data)
    rows = footers.read_footers(spark, good).collect()
    assert sum(r.rows or 0 for r in rows) == 5000 and {r.path.split("/")[-1] for r in rows if r.error} == set(names)
    assert {r.path.split("/")[-1]: r.error for r in tables.unreadable_files(spark, good).collect()}["short.parquet"] == "too short"


class Counted:
    """A store that counts the bytes read."""

    def __init__(self):
        self.read = 0

    def open_input_file(self, path):
        import io
        from pyarrow import PythonFile

        outer = self

        class File(io.FileIO):
            def readinto(self, into):
                n = super().readinto(into)
                outer.read += n
                return n

            def read(self, size=-1):
                data = super().read(size)
                outer.read += len(data)
                return data

        return PythonFile(File(path), mode="r")


def test_footers_cost_the_same_for_large_files(spark, tmp_path):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    costs = []
    for k, n in enumerate((1000, 1_000_000)):
        name = str(tmp_path / f"{k}.parquet")
        pq.write_table(pa.table({"x": np.random.default_rng(k).normal(size=n)}), name, row_group_size=n)
        store = Counted()
        assert footers.look(store, name, os.path.getsize(name)) == (n, 1, None)
        costs.append(store.read)
    assert max(costs) <= (64 << 10) + 100  # at most one block of 64 kB and the ends


@pytest.mark.parametrize("name", ["align_bucketed", "eval_rows_bucketed"])
def test_bucketed_joins_need_no_exchange(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_buckets_are_even(spark):
    """A hot station is spread, as buckets go by station and hour."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("S"), F.col("id"))).alias("station"), F.col("id").alias("valid_time"))
    path = work_path(spark, "even")
    sinks.write_bucketed(rows, "even_buckets", path, ["station", "valid_time"], 8)
    counts = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert len(counts) == 8 and max(counts) < 1.2 * 2500


def test_many_features(spark):
    """144 features in one aggregate column, and the same result as the plain form for two."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 144))
    truth = rng.normal(size=144)
    y = x @ truth + 3
    rows = [(k % 2, x[k].tolist(), float(y[k])) for k in range(1500)] + [(0, [None] * 144, 1.0), (0, x[0].tolist(), None)]
    got = scoring.fit_many_features(spark.createDataFrame(rows, "g int, x array<double>, y double").repartition(5), ["g"], "x", "y", held=1 << 18).collect()
    assert len(got) == 2
    for r in got:
        assert np.allclose(r.params, [3, *truth], atol=1e-8)
    two = spark.createDataFrame([(k % 3, *x[k, :2].tolist(), float(y[k])) for k in range(1500)], "g int, a double, b double, y double")
    plain = {r.g: r.params for r in scoring.fit_least_squares(two, ["g"], ["a", "b"], "y", 0.5).collect()}
    packed = {r.g: r.params for r in scoring.fit_many_features(two.withColumn("x", F.array("a", "b")), ["g"], "x", "y", 0.5).collect()}
    for g, params in plain.items():
        assert np.allclose(params, packed[g], atol=1e-8)


def test_a_repeated_batch_replaces_all_its_months(spark):
    """What a batch held before it came again is not taken back later."""
    path = work_path(spark, "again")
    rows = list({r[:4]: r for r in predictions(3, 200, 60)}.values())
    first = [r for r in rows if r[0].month == 1]
    running_scores.add_batch(spark.createDataFrame(rows, SCHEMA), path, 0, ["fh"])
    running_scores.add_batch(spark.createDataFrame(first, SCHEMA), path, 0, ["fh"])
    assert spark.read.parquet(f"{path}/rows").count() == len(first)
    running_scores.add_batch(spark.createDataFrame(rows, SCHEMA), path, 1, ["fh"])
    assert running_scores.current_scores(spark, path, ["fh"]).agg(F.sum("n")).first()[0] == sum(r[5] is not None for r in rows)
