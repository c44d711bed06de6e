"""Training in rounds on windows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verimet.operators import descent

SCHEMA = "g string, fh long, start long, init_time timestamp_ntz, x array<struct<a:double,b:double>>, y array<double>, future_times array<bigint>"


def windows(groups=3, n=60, seed=0, curve=None):
    rng, rows, truth = np.random.default_rng(seed), [], {}
    for g in range(groups):
        for fh in (1, 2):
            cells = rng.normal(size=(n, 4 + fh, 2)) * [1.0, 30.0]
            mean = cells.mean(axis=1)
            y = mean @ rng.normal(size=2) + g if curve is None else curve(mean, cells)
            y = y + rng.normal(size=n) * 0.1
            truth[(f"g{g}", fh)] = (mean, y)
            for k in range(n):
                rows.append((f"g{g}", fh, k, pd.Timestamp("2024-01-01").to_pydatetime(), [tuple(map(float, c)) for c in cells[k]], [0.0] * (fh - 1) + [float(y[k])], [1] * fh))
    return rows, truth


def test_quadratic_loss_matches_the_closed_form(spark):
    rows, truth = windows()
    extra = [("unknown", 1, 0, None, [(1.0, 1.0)], [1.0], [5]), ("unknown", 1, 1, rows[0][3], [(1.0, 1.0)], [None], [5]), ("unknown", 1, 2, rows[0][3], [(1.0, 1.0)], [1.0], [0]),
             (None, 1, 3, rows[0][3], [(1.0, 1.0)], [1.0], [5])]
    frame = spark.createDataFrame(rows + extra, SCHEMA).repartition(5)
    got = {(r.g, r.fh): r for r in descent.fit_windows(frame, ["g", "fh"], ["a", "b"], descent.linear_model(2)).collect()}
    assert set(got) == set(truth)
    for key, (mean, y) in truth.items():
        terms = np.column_stack([np.ones(len(mean)), mean])
        want = np.linalg.lstsq(terms, y, rcond=None)[0]
        assert np.allclose(got[key].params, want, atol=1e-6) and got[key].reason == "converged"
        assert got[key].loss == pytest.approx(((terms @ want - y) ** 2).mean() / 2)


def test_converged_groups_leave(spark, monkeypatch):
    """A group that is solved at once isn't touched by later rounds."""
    rows, _ = windows(2)
    still = [("still", 1, k, rows[0][3], [(0.0, 0.0)] * 5, [0.0], [1]) for k in range(10)]
    seen = []
    real = descent._round_sums
    monkeypatch.setattr(descent, "_round_sums", lambda data, active, *rest: (seen.append({r.g for r in active.collect()}), real(data, active, *rest))[1])
    got = {(r.g, r.fh): r for r in descent.fit_windows(spark.createDataFrame(rows + still, SCHEMA), ["g", "fh"], ["a", "b"], descent.linear_model(2)).collect()}
    assert got[("still", 1)].rounds == 1 and "still" in seen[0] and all("still" not in s for s in seen[1:])


def test_hidden_layer_learns_a_curve(spark, monkeypatch):
    rows, truth = windows(1, 200, curve=lambda mean, cells: np.tanh(2 * cells[:, -1, 0]))
    monkeypatch.setattr(descent, "SMALL", 0)  # parameters are shuffled
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.transform("x", lambda c: F.struct(c["a"].alias("a"), (c["b"] / 30).alias("b"))))
    got = descent.fit_windows(frame, ["g", "fh"], ["a", "b"], descent.hidden_model(2, 3), rounds=30).collect()
    assert len(got) == 2
    for r in got:
        y = truth[(r.g, r.fh)][1]
        assert r.loss < 0.2 * y.var() / 2


def test_patience_on_held_out_windows(spark):
    """Training goes on improving, but not on windows that follow another law."""
    rows, _ = windows(1, 80)
    turned = [(g, fh, k, t, x, [-v for v in y] if k % 4 == 0 else y, f) for g, fh, k, t, x, y, f in rows]
    got = descent.fit_windows(spark.createDataFrame(turned, SCHEMA), ["g", "fh"], ["a", "b"], descent.linear_model(2), patience=1, held_out=F.col("start") % 4 == 0).collect()
    assert {r.reason for r in got} <= {"patience", "converged"} and any(r.reason == "patience" for r in got)
    few = descent.fit_windows(spark.createDataFrame(rows, SCHEMA), ["g", "fh"], ["a", "b"], descent.linear_model(2), rounds=2).collect()
    assert {r.reason for r in few} == {"rounds"} and {r.rounds for r in few} == {2}


@pytest.mark.parametrize("small", [True, False])
def test_series_of_a_layout_equal_stored_windows(spark, monkeypatch, small):
    """Windows made anew in every round give the models of stored ones, and only rows are written."""
    from verimet.operators.windows import build_windows, store_layout, window_series
    from verimet.session import work_path

    rng = np.random.default_rng(4)
    rows = [(None if g == 5 else f"g{g}", 1 + g % 2, None if i == 0 and g == 2 else pd.Timestamp("2024-01-20").to_pydatetime() + pd.Timedelta(hours=13 * i),
             None if rng.random() < 0.1 else float(rng.normal() + i % 5), None if rng.random() < 0.1 else float(rng.normal() + g))
            for g in range(6) for i in range(3 if g == 4 else 60)]
    frame = spark.createDataFrame(rows, "k string, fh long, valid_time timestamp_ntz, a double, target_error double").repartition(3)
    options = dict(past=4, steps=F.col("fh"), max_steps=3, normalise=[])
    table = store_layout(frame, ["k", "fh"], f"descent_layout_{small}", work_path(spark, "descent"), past=4, max_steps=3, buckets=3)
    stores = []
    monkeypatch.setattr(descent, "stored", lambda df, name, real=descent.stored: (stores.append(name), real(df, name))[1])
    if not small:
        monkeypatch.setattr(descent, "SMALL", 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        series = window_series(table, ["k", "fh"], ["a"], laid_out=True, **options)
        found = descent.fit_windows(series, ["k", "fh"], ["a"], descent.linear_model(1))
        got = {(r.k, r.fh): r for r in found.collect()}
        plan = series.per_key(found.select("k", "fh", "params")).rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "packed-windows" not in stores
    if not small:  # only the models travel
        above = plan.split("ShuffledHashJoin", 1)[1].split("FileScan", 1)[0]
        assert "Exchange" not in above
    want = {(r.k, r.fh): r for r in descent.fit_windows(build_windows(frame, ["k", "fh"], ["a"], **options), ["k", "fh"], ["a"], descent.linear_model(1)).collect()}
    assert set(got) == set(want) and len(want) == 4
    for key, r in want.items():
        assert np.allclose(got[key].params, r.params, atol=1e-8) and got[key].loss == pytest.approx(r.loss) and got[key].reason == r.reason


def test_gradients():
    rng = np.random.default_rng(5)
    cells, y = rng.normal(size=(4, 6, 2)), rng.normal(size=(4, 2))
    for model in (descent.linear_model(2), descent.hidden_model(2, 3)):
        p = rng.normal(size=len(model.start()))
        _, grad = model.losses(cells, y, p)
        for i in range(len(p)):
            e = np.zeros(len(p))
            e[i] = 1e-6
            numeric = (model.losses(cells, y, p + e)[0] - model.losses(cells, y, p - e)[0]) / 2e-6
            assert np.allclose(numeric, grad[:, i], atol=1e-6)
