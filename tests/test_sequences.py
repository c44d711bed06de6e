import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verimet.operators import setops
from verimet.operators.quantiles import exact_quantiles
from verimet.operators.sequences import overlapping_blocks, previous_value, running_total, with_position


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    n = 600
    # One key holds most rows; some days are empty, one value is null.
    pdf = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.8, "hot", "cold"),
        "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(60 * 24 * 40, n, replace=False)), unit="min"),
        "v": rng.integers(0, 50, n).astype(float),
    })
    pdf.loc[17, "v"] = None
    df = spark.createDataFrame(pdf).withColumns({"t": F.col("t").cast("timestamp_ntz"), "v": F.nanvl("v", F.lit(None).cast("double"))})
    return pdf, df


def test_previous_value_crosses_days(series):
    pdf, df = series
    got = previous_value(df, ["k"], ["t"], "v", F.to_date("t"), "p").orderBy("t").toPandas()
    want = pdf.groupby("k")["v"].shift()
    assert np.allclose(got["p"].astype(float), want, equal_nan=True)


def test_running_total_and_position(series):
    pdf, df = series
    got = running_total(df.fillna(0.0, ["v"]), ["k"], ["t"], "v", F.to_date("t"), "s").orderBy("t").toPandas()
    assert np.allclose(got["s"], pdf.fillna({"v": 0}).groupby("k")["v"].cumsum())
    pos = with_position(df, ["k"], ["t"], F.to_date("t"), "p").orderBy("t").toPandas()
    assert (pos["p"].to_numpy() == pdf.groupby("k").cumcount().to_numpy()).all()


def test_blocks_hold_every_row_once_as_core_and_bounded(series):
    _, df = series
    blocks = overlapping_blocks(with_position(df, ["k"], ["t"], F.to_date("t"), "p"), "p", 50, 20)
    assert blocks.where("_core").count() == df.count()
    assert blocks.groupBy("k", "_block").count().agg(F.max("count")).first()[0] <= 70
    with pytest.raises(ValueError):
        overlapping_blocks(blocks, "p", 10, 20)


@pytest.mark.parametrize("few", [True, False])
def test_exact_quantiles_large_skewed_group(spark, few):
    rng = np.random.default_rng(1)
    big = np.concatenate([rng.normal(size=30_000), np.full(15_000, 0.25), [1e9, -1e9]])
    small = rng.normal(size=7)
    pdf = pd.DataFrame({"g": ["a"] * len(big) + ["b"] * len(small) + ["c"], "x": np.concatenate([big, small, [3.0]])})
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 1.0]
    got = {r.g: r for r in exact_quantiles(spark.createDataFrame(pdf), ["g"], "x", probs, few).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g].n == len(part)
        assert np.allclose(got[g].quantiles, np.quantile(part["x"], probs), rtol=0, atol=1e-9)


def test_exact_quantiles_without_keys(spark):
    df = spark.range(1, 12).select(F.col("id").cast("double").alias("x"))
    assert exact_quantiles(df, [], "x", [0.5, 0.25]).first().asDict() == {"n": 11, "quantiles": [6.0, 3.5]}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 1, 20)], "k string, t int, v int")
    new = spark.createDataFrame([("a", 1, 11), ("c", 1, 30)], "k string, t int, v int")
    once = setops.upsert(old, new, ["k", "t"])
    twice = setops.upsert(once, new, ["k", "t"])
    want = {("a", 1, 11), ("b", 1, 20), ("c", 1, 30)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}
