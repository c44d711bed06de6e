from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from verimet.operators import scoring, summarise, uncertainty, verify
from verimet.plans import training

T0 = datetime(2024, 3, 1, 5)


def test_confusion_ignores_zero_signs_and_gates(spark):
    rows = [(T0, 3.0, 1.0), (T0, 3.0, -1.0), (T0, -3.0, 1.0), (T0, -3.0, -1.0), (T0, 0.0, 3.0), (T0, 1.5, 1.0), (T0, 400.0, 1.0),
            (datetime(2023, 1, 1), 3.0, 1.0)]
    df = spark.createDataFrame(rows, "valid_time timestamp_ntz, target double, prediction double")
    got = verify.sign_confusion(df, [], "2024-01-01").first()
    assert (got.hit, got.miss, got.false_alarm, got.correct_negative) == (1, 1, 1, 1) and got.hit_pct == 50.0
    empty = verify.sign_confusion(df.where("target > 1000"), [], "2024-01-01").first()
    assert empty.hit == 0 and empty.hit_pct is None


def test_r2_is_floored_and_not_correlation(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (1, 3.0, 6.0), (2, 1.0, 1.0), (2, 2.0, 2.5), (3, 500.0, 1.0)], "fh int, model_output double, actual double")
    got = {r.fh: r.r2 for r in verify.r2_by_lead(df).collect()}
    assert got[1] == 0.0 and got[2] == pytest.approx(1 - 0.25 / 0.5) and got[3] == 0.0


def test_patience_rule(spark):
    losses = [5.0, 4.0, 4.05, 4.2, 4.3, 3.9, 4.0, 4.1, 4.2]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(losses)] + [("s", 0, 1.0), ("s", 1, 0.5)], "run string, epoch int, loss double")

    def plain(patience, delta):
        best, bad = float("inf"), 0
        for i, v in enumerate(losses):
            if v < best:
                best, bad = v, 0
            elif v > best + delta:
                bad += 1
                if bad >= patience:
                    return i
        return None

    for patience, delta in ((2, 0.0), (3, 0.0), (2, 0.15), (9, 0.0)):
        got = {r.run: r.stop_epoch for r in verify.patience_stop(df, ["run"], patience, delta).collect()}
        assert got.get("r") == plain(patience, delta) and "s" not in got


def test_calibration_passes_through(spark):
    p = spark.createDataFrame([("a", 1, 10.0), ("b", 1, 10.0)], "stid string, fh int, model_output double")
    table = spark.createDataFrame([("a", 1, 2.0, 1.0)], "station string, forecast_hour int, alpha double, diff double")
    assert {r.stid: r.calibrated for r in verify.calibrate(p, table).collect()} == {"a": 18.0, "b": 10.0}


def test_histogram_top_edge(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.5, 0.5)], "x double, y double")
    cells = {(r.xb, r.yb): r["count"] for r in summarise.histogram_2d(df, "x", "y", 2).collect()}
    assert cells == {(1, 1): 1, (2, 2): 2}
    assert summarise.point_density(df, "x", "y", 2).count() == 2


def test_macro_mean_differs_from_plain_mean(spark):
    df = spark.createDataFrame([(T0, 1, 1.0)] * 3 + [(T0, 2, 5.0), (T0, 2, 500.0)], "valid_time timestamp_ntz, fh int, difference double")
    assert summarise.error_by_period(df, "month", "mean", limit=100.0).first().error == 3.0


def test_weighted_mean_null_rule(spark):
    s = spark.createDataFrame([("A", 1, 2.0), ("B", 1, 4.0), ("A", 2, 2.0), ("B", 2, None)], "climate_division_name string, hour int, error double")
    w = spark.createDataFrame([("A", 1), ("B", 3)], "climate_division_name string, stations int")
    assert {r.hour: r.error for r in summarise.weighted_mean(s, w, "hour").collect()} == {1: 3.5, 2: None}


def test_score_order_and_uncertainty_sum(spark):
    rng = np.random.default_rng(2)
    pdf = [("a", float(m), float(a)) for m, a in rng.normal(size=(50, 2))]
    row = verify.station_scores(spark.createDataFrame(pdf, "stid string, model_output double, actual double"), ["stid"]).first()
    assert row.rmse >= row.mae >= abs(row.bias) and row.n == 50
    mc = spark.createDataFrame([([1.0, 2.0, 4.0], [0.0, 0.5, 1.0])], "mu array<double>, logvar array<double>")
    u = uncertainty.split_uncertainty(mc).first()
    assert u.total_var == pytest.approx(u.epistemic_var + u.aleatoric_var)
    assert u.epistemic_var == pytest.approx(np.var([1, 2, 4]))
    q = spark.range(1).select(uncertainty.array_quantile(F.array(*[F.lit(float(v)) for v in (4, 1, 3, 2)]), 0.4).alias("q")).first().q
    assert q == pytest.approx(np.quantile([1, 2, 3, 4], 0.4))


def test_fits_agree_and_skip_missing_models(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(a), float(b), float(2 * a - b + i)) for i, g in enumerate("xy") for a, b in rng.normal(size=(200, 2))]
    df = spark.createDataFrame(rows, "g string, a double, b double, y double").repartition(5)
    built_in = scoring.fit_least_squares(df, ["g"], ["a", "b"], "y")
    stat, solve = scoring.least_squares(["a", "b"], "y")
    plug_in = scoring.fit_additive(df, ["g"], ["a", "b", "y"], stat, solve)
    for fits in (built_in, plug_in):
        got = {r.g: r.params for r in fits.collect()}
        assert np.allclose(got["x"], [0, 2, -1], atol=1e-9) and np.allclose(got["y"], [1, 2, -1], atol=1e-9)
    only_x = built_in.where("g = 'x'")
    a = scoring.apply_linear(df, only_x, ["g"], ["a", "b"])
    b = scoring.score_batches(df, only_x, ["g"], scoring.predict_linear(["a", "b"]), ["g", "y"], ["a", "b"])
    assert a.count() == b.count() == 200
    assert b.agg(F.max(F.abs(F.col("model_output") - F.col("y")))).first()[0] < 1e-9


@pytest.mark.parametrize("parts", [None, 3, 11])
def test_verification_pairs_every_prediction_with_its_variable(spark, parts):
    """Null keys and errors, repeated rows on all sides, variables without forecast and stations without observation."""
    def at(h):
        return None if h is None else datetime(2024, 3, 1, h)

    fc = [("a", 1, 5, 1.0, 10.0), ("a", 1, 5, 2.0, None), ("a", 2, 5, 3.0, 30.0), ("b", 1, 6, None, 40.0), (None, 1, 5, 1.0, 1.0), ("a", 1, None, 1.0, 1.0),
          ("a", None, 5, 1.0, 1.0), ("c", 1, 5, 1.0, 1.0), ("d", 1, 5, float("nan"), 0.0)]
    obs = [("a", 5, 0.5, 4.0), ("a", 5, None, 5.0), ("b", 6, 2.0, 6.0), (None, 5, 1.0, 1.0), ("a", None, 1.0, 1.0), ("d", 5, 1.0, 0.0)]
    keys = [(h, s, f) for h in (5, 6, None) for s in ("a", "b", "c", "d", None) for f in (1, 2, None)]
    preds = [(*k, m, v) for k in [*keys, (5, "a", 1)] for m, v in (("t2m", 1.5), ("u_total", 2.5), ("tp", 3.5), (None, 4.5), ("u_total", None))]
    forecast = spark.createDataFrame([(s, f, at(h), t, u) for s, f, h, t, u in fc], "station string, fh bigint, valid_time timestamp_ntz, t2m double, u_total double")
    observed = spark.createDataFrame([(s, at(h), t, w) for s, h, t, w in obs], "station string, valid_time timestamp_ntz, tair double, wspd_sonic_mean double")
    predictions = spark.createDataFrame([(at(h), *rest) for h, *rest in preds], "valid_time timestamp_ntz, stid string, fh bigint, metvar string, model_output double")
    want = []
    for h, s, f, m, v in preds:
        for fs, ff, fh, *values in fc:
            for os, oh, *seen in obs:
                if None not in (h, s, f) and (h, s, f) == (fh, fs, ff) and (s, h) == (os, oh) and m in ("t2m", "u_total"):
                    i = ("t2m", "u_total").index(m)
                    if values[i] is not None and seen[i] is not None:
                        e = values[i] - seen[i]
                        want.append((at(h), s, f, m, v, e, None if v is None else v - e))
    got = training.verify(predictions, forecast, observed, ["t2m", "u_total"], parts=parts)
    assert got.columns == [*verify.KEYS, "model_output", "actual", "difference"]
    assert len(want) > 10 and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    with pytest.raises(ValueError):
        verify.evaluation_rows(predictions, forecast, "left", metvars=["t2m"])
