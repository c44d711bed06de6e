"""Work that grows with the tables: buckets, many small groups, rounds of few open groups."""

import time

import numpy as np
import pyarrow as pa
import pytest

from verimet.catalog import QUERIES, inputs
from verimet.operators import descent, scoring

from test_descent import SCHEMA, windows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["align_bucketed", "eval_rows_bucketed"])
def test_buckets_grow_with_the_rows(spark, monkeypatch, name):
    monkeypatch.setattr(inputs, "BUCKET_ITEMS", 500)
    want = -(-spark.read.parquet(f"{FOLDER}/lineitem.parquet").count() // 500)
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert want > 8 and f"{want} out of {want}" in plan and "Exchange" not in plan


def test_many_small_groups_are_folded_together(spark):
    """Nearly as many groups as rows, null keys among them, and one large group."""
    rng = np.random.default_rng(2)
    rows = [(None if g % 7 == 0 else f"g{g}", g % 3, rng.normal(size=2).tolist(), float(rng.normal())) for g in np.r_[np.arange(3000), np.arange(3000), np.full(4000, 5)].tolist()]
    got = scoring.fit_many_features(spark.createDataFrame(rows, "k string, n int, x array<double>, y double").repartition(3), ["k", "n"], "x", "y", 0.1, held=1 << 14).collect()
    groups: dict[tuple, list] = {}
    for k, n, x, y in rows:
        groups.setdefault((k, n), []).append(([1.0, *x], y))
    assert {(r.k, r.n) for r in got} == set(groups) and len(got) == len(groups)
    for r in got:
        a, y = (np.array(v) for v in zip(*groups[r.k, r.n], strict=True))
        want = np.linalg.lstsq(a.T @ a + np.diag([0, 0.1, 0.1]), a.T @ y, rcond=None)[0]
        assert np.allclose(a.T @ a @ r.params + np.array([0, *r.params[1:]]) * 0.1, a.T @ y, atol=1e-6) and np.allclose(want, r.params, atol=1e-6)
    n = 200_000
    keys = pa.RecordBatch.from_arrays([pa.array(np.arange(n) // 2)], ["k"])
    x = rng.normal(size=(n, 3))
    began = time.process_time()
    found, packed = scoring._triangles(keys, x)
    assert time.process_time() - began < 5 and found.num_rows == n // 2
    assert np.allclose(packed[7], (x[14:16].T @ x[14:16])[np.triu_indices(3)])


def test_later_rounds_read_open_groups_only(spark, monkeypatch):
    rows, _ = windows(2)
    still = [(f"still{g}", 1, k, rows[0][3], [(0.0, 0.0)] * 5, [0.0], [1]) for k in range(10) for g in range(9)]
    read = []
    real = descent._round_sums
    monkeypatch.setattr(descent, "_round_sums", lambda data, *rest: (read.append(data.count()), real(data, *rest))[1])
    got = descent.fit_windows(spark.createDataFrame(rows + still, SCHEMA), ["g", "fh"], ["a", "b"], descent.linear_model(2)).collect()
    assert len(got) == 13 and {r.reason for r in got} == {"converged"}
    assert read[0] == len(rows) + 90 and read[1] == len(rows)


@pytest.mark.parametrize("name", ["training_frame", "image_frame", "inference_frame"])
def test_cluster_frames_grow_with_the_rows(spark, monkeypatch, name):
    """Tasks that group member rows follow the line items; targets of one hour are in many of them."""
    monkeypatch.setattr(inputs, "BUCKET_ITEMS", 500)
    want = -(-spark.read.parquet(f"{FOLDER}/lineitem.parquet").count() // 500)
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert want > 8 and any("hashpartitioning(target" in line and f", {want})" in line for line in dealt)


def test_verification_deals_one_row_for_all_variables(spark, monkeypatch):
    """Realised errors are not made long before they travel, nothing is sorted, and a task's share is bounded."""
    monkeypatch.setattr(inputs, "BUCKET_ITEMS", 500)
    want = -(-spark.read.parquet(f"{FOLDER}/lineitem.parquet").count() // 500)
    plan = QUERIES["verification_run"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert want > 8 and len(dealt) == 4 and all(f", {want})" in line and "metvar" not in line for line in dealt)
    assert plan.count("ShuffledHashJoin") == 2 and "Sort" not in plan
    monkeypatch.setattr(inputs, "BUCKET_ITEMS", 500_000)
    plan = QUERIES["verification_run"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "REPARTITION_BY_NUM" not in plan
