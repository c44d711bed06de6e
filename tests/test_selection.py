"""Distributed selection: heavy ties, one group, misses of the sketch, rounds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verimet.operators import quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def check(spark, pdf, keys, **options):
    frame = spark.createDataFrame(pdf)
    got = {tuple(r[k] for k in keys): r for r in quantiles.exact_quantiles(frame, keys, "x", PROBS, **options).collect()}
    groups = pdf.groupby(keys, dropna=False) if keys else [((), pdf)]
    n = 0
    for key, part in groups:
        key = tuple(None if k != k else k for k in (key if isinstance(key, tuple) else (key,)))
        x = part["x"].dropna().to_numpy()
        if len(x):
            n += 1
            assert got[key].n == len(x)
            assert np.allclose(got[key].quantiles, np.quantile(x, PROBS), rtol=1e-12, atol=1e-12)
    assert n == len(got)


@pytest.fixture
def rounds(monkeypatch):
    """Every group is large and little may be left, so all goes through the rounds."""
    monkeypatch.setattr(quantiles, "SMALL_GROUP", 0)
    monkeypatch.setattr(quantiles, "REST", 8)
    monkeypatch.setattr(quantiles, "PARTS", 8)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    monkeypatch.setattr(quantiles, "MARGIN", 0.01)


def shapes():
    rng = np.random.default_rng(1)
    yield rng.normal(size=4000)
    yield np.r_[np.zeros(3000), rng.normal(size=40) * 1e-9, np.ones(3000)]  # few values between heavy ties
    yield np.r_[np.full(2000, -1.0), np.full(2000, 1.0)]
    yield 10.0 ** rng.uniform(-300, 300, 3000)
    yield np.full(500, 7.0)
    yield np.array([3.0])
    yield np.r_[rng.integers(0, 3, 3000).astype(float), rng.normal(size=100)]


def test_rounds_settle_every_rank(spark, rounds):
    parts = [pd.DataFrame({"g": k, "x": x}) for k, x in enumerate(shapes())]
    check(spark, pd.concat(parts), ["g"])


def test_all_rows_in_one_group(spark, rounds):
    check(spark, pd.DataFrame({"x": np.random.default_rng(2).gamma(0.3, size=20_000)}), [])


def test_null_keys_and_values(spark):
    pdf = pd.DataFrame({"g": ["a", None, "a", "b", None], "x": [1.0, 5.0, None, None, 6.0]})
    check(spark, pdf, ["g"])


def test_groups_that_are_not_broadcast(spark, rounds, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW_GROUPS", 0)
    rng = np.random.default_rng(3)
    check(spark, pd.DataFrame({"g": rng.integers(0, 40, 6000), "h": rng.integers(0, 2, 6000), "x": rng.normal(size=6000).round(2)}), ["g", "h"])


def test_a_wrong_sketch_is_noticed(spark, monkeypatch):
    """Brackets that miss their ranks are seen by the counts and searched anew."""
    right = quantiles._first_brackets

    def wrong(rows, keys, probs):
        shifted = F.transform("_t", lambda t: F.struct(t["rank"].alias("rank"), (t["hi"] + 5).alias("lo"), (t["hi"] + 6).alias("hi"), F.lit(False).alias("settled")))
        return right(rows, keys, probs).withColumn("_t", shifted.cast(quantiles._TARGET))

    monkeypatch.setattr(quantiles, "_first_brackets", wrong)
    check(spark, pd.DataFrame({"g": [1, 2] * 500, "x": np.random.default_rng(4).normal(size=1000)}), ["g"])


def test_no_rows(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "g int, x double"), ["g"], "x", [0.5]).count() == 0
    assert quantiles.exact_quantiles(spark.createDataFrame([], "g int, x double"), [], "x", [0.5]).count() == 0
