"""Windows made as arrays: odd rows against a plain form, models that come with the rows."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verimet.operators import scoring, windows

SCHEMA = "k string, fh long, valid_time timestamp_ntz, a double, b int, target_error double"
PAST = 4


def _rows():
    rng, out = np.random.default_rng(3), []
    for key, fh, n in (("p", 1, 23), ("q", 3, 2), ("q", 2, 7), (None, 2, 9)):
        for i in range(n):
            a, b = (None if rng.random() < 0.4 else float(rng.integers(9))), (None if i < 5 else int(rng.integers(5)))
            out.append((key, fh, datetime(2024, 1, 28) + timedelta(hours=7 * i), a, b, None if i % 4 == 1 else float(i)))
    return out


def _plain(series, i, steps, last_valid):
    """One window by the definition, with None for nulls: features a (scaled, kept) and b (raw)."""
    own = series[i:i + PAST + steps]
    rows = [(a, b) for _, _, _, a, b, _ in own] + [(0.0, 0.0)] * (PAST + steps - len(own))
    past = [a for a, _ in rows[:PAST] if a is not None]
    mean = sum(past) / len(past) if past else None
    sd = None if mean is None else (sum((v - mean) ** 2 for v in past) / PAST) ** 0.5
    sd = sd if sd is None or sd >= 1e-8 else 1.0
    z = [None if a is None or mean is None else (a - mean) / sd for a, _ in rows]
    held = z[PAST - 1]
    if last_valid:
        seen = [z[j] for j in range(min(PAST, len(own))) if own[j][3] is not None]
        held = seen[-1] if seen else None
    x = list(zip(z[:PAST] + [held] * steps, [None if b is None else float(b) for _, b in rows], strict=True))
    y = [r[5] for r in own[PAST:]] + [0.0] * (steps - len(own[PAST:]))
    return x, y


def _near(got, want):
    return (got is None) == (want is None) and (got is None or got == pytest.approx(want, abs=1e-9))


@pytest.mark.parametrize("last_valid", [False, True])
@pytest.mark.parametrize("block_rows", [2048, 6])
def test_windows_equal_the_definition(spark, block_rows, last_valid):
    rows = _rows()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    win = windows.build_windows(
        frame, ["k", "fh"], ["a", "b"], ["a"], past=PAST, steps=F.col("fh"), max_steps=3, normalise=["a"], block_rows=block_rows,
        last_valid=last_valid, counted=frame.select("k", "fh", "valid_time"))
    narrow = windows.build_windows(
        frame, ["k", "fh"], ["a", "b"], ["a"], past=PAST, steps=F.col("fh"), max_steps=3, normalise=["a"], block_rows=block_rows, with_x=False)
    got, slim = ({(r.k, r.fh, r.start): r for r in w.collect()} for w in (win, narrow))
    assert len(got) == len(slim) == len(rows)
    for (key, fh, i), row in got.items():
        series = [r for r in rows if r[:2] == (key, fh)]
        x, y = _plain(series, i, fh, last_valid)
        assert len(row.x) == len(x) and all(_near(c.a, a) and _near(c.b, b) for c, (a, b) in zip(row.x, x, strict=True)), (key, fh, i)
        assert len(row.y) == fh and all(map(_near, row.y, y))
        assert row.init_time == (series[i + PAST - 1][2] if i + PAST <= len(series) else None)
        assert [t > 0 for t in row.future_times] == [i + PAST + s < len(series) for s in range(fh)]
        assert all(map(_near, row.last, x[PAST - 1]))
        assert (slim[key, fh, i].last, slim[key, fh, i].y, slim[key, fh, i].future_times) == (row.last, row.y, row.future_times)


def test_models_come_with_the_rows(spark, capsys):
    """Groups without a model are skipped, and no whole window is joined or shuffled."""
    frame = spark.createDataFrame(_rows(), SCHEMA)
    models = spark.createDataFrame([("p", 1, [1.0, 2.0, 3.0]), ("q", 2, [0.5, 0.0, 1.0]), ("other", 1, [0.0, 0.0, 0.0])], "k string, fh long, params array<double>")
    options = dict(past=PAST, steps=F.col("fh"), max_steps=3, normalise=["a"], block_rows=6)
    outputs = T.StructType([T.StructField("model_output", T.DoubleType())])
    plain = windows.build_windows(frame, ["k", "fh"], ["a", "b"], **options)
    joined = scoring.score_windows(plain, models, ["k", "fh"], scoring.predict_cells(["a", "b"]), outputs, ["a", "b"])
    carried = windows.build_windows(frame, ["k", "fh"], ["a", "b"], per_key=models, **options)
    out = scoring.score_windows(carried, None, ["k", "fh"], scoring.predict_cells(["a", "b"]), outputs, ["a", "b"])
    capsys.readouterr()
    out.explain()
    above = capsys.readouterr().out.split("MapInArrow")
    want = {(r.k, r.fh, r.start): r.model_output for r in joined.collect()}
    assert {(r.k, r.fh, r.start): r.model_output for r in out.collect()} == want
    assert len(want) == 30 and {k[:2] for k in want} == {("p", 1), ("q", 2)}
    assert len(above) == 3 and not any(word in part for part in above[:2] for word in ("Join", "Exchange"))


def test_ensemble_equals_single_windows():
    rng = np.random.default_rng(1)
    cells = [rng.normal(size=(PAST + s, 2)) for s in (1, 3, 2)]
    cells[1][PAST, 0] = np.nan
    params = rng.normal(size=(3, 6))
    got = scoring.predict_ensemble(PAST, 2)(cells, params)
    for i, window in enumerate(cells):
        weights = params[i].reshape(2, 3)
        guess = np.nan_to_num(window[PAST:]) @ weights[:, :2].T
        assert np.allclose(got["mu"][i], guess.mean(axis=1)) and np.allclose(got["epistemic_var"][i], guess.var(axis=1))
        assert np.allclose(got["total_var"][i], guess.var(axis=1) + np.exp(weights[:, 2]).mean())


def test_windows_over_many_short_chunks(spark):
    """Two or three rows a month, so a window spans up to five chunks; equal times; the same from a stored layout."""
    from verimet.session import work_path

    steps, rows = 3, []
    for key, n in (("p", 40), (None, 11), ("q", 1)):
        for i in range(n):
            rows.append((key, 1, datetime(2023, 11, 3) + timedelta(days=12 * (i - i % 9 // 8)), float(i % 7), i, float(i)))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    options = dict(past=PAST, steps=steps, max_steps=steps, normalise=[], ties=["b"])
    table = windows.store_layout(
        frame, ["k", "fh"], "short_chunks", work_path(spark, "short"), past=PAST, max_steps=steps, block_rows=1, ties=["b"], buckets=3)
    options.update(block_rows=1)
    for win in (windows.build_windows(frame, ["k", "fh"], ["a", "b"], **options),
                windows.build_windows(table, ["k", "fh"], ["a", "b"], laid_out=True, **{**options, "ties": []})):
        got = {(r.k, r.start): r for r in win.collect()}
        assert len(got) == len(rows) == win.count()
        for (key, start), row in got.items():
            series = [r for r in rows if r[0] == key]
            want = [(r[3], float(r[4])) for r in series[start:start + PAST + steps]]
            assert [(c.a, c.b) for c in row.x] == want + [(0.0, 0.0)] * (PAST + steps - len(want)), (key, start)
            ahead = [r[5] for r in series[start + PAST:start + PAST + steps]]
            assert row.y == ahead + [0.0] * (steps - len(ahead)) and row.valid_time == series[start][2]


def test_rows_travel_once(spark):
    """Numbering deals the rows by key and chunk; neither a join with the chunks' counts nor blocks deal them again."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = spark.createDataFrame(_rows(), SCHEMA)
        win = windows.build_windows(frame, ["k", "fh"], ["a", "b"], past=PAST, steps=F.col("fh"), max_steps=3, normalise=["a"], counted=frame)
        inside = win._jdf.queryExecution().executedPlan().toString().split("Union", 1)[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Join" not in inside and "_block" not in inside
    assert {line.split("Exchange ")[1].split("#")[0] for line in inside.splitlines() if "Exchange " in line} == {"hashpartitioning(k"}
    assert inside.count("Exchange ") <= 7  # twice the same rows and counts, and the border's


def test_chunks_must_be_counted_whole(spark):
    frame = spark.createDataFrame(_rows(), SCHEMA)
    with pytest.raises(Exception, match="more rows than were counted"):
        windows.build_windows(frame, ["k", "fh"], ["a"], past=PAST, max_steps=1, counted=frame.where("a is not null")).collect()
