"""Quality by co-training: a text-content and a metadata classifier teach each other.

Both are logistic regressions fitted by distributed Newton steps: tasks add up gradients and
Hessians over all documents, Spark adds those of the tasks, the driver solves a small system.
From the second round on, a document without a label counts for one view with the label
that the other view is sure of.  Labels set aside calibrate each view; the calibrated log odds are added.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verimet.llm.common import SOLID, Words, annotate, raw, stored

SURE = 0.98
PSEUDO_WEIGHT = 0.25
SOURCES, LANGS = 64, 16
#: Byte classes: other, lower, upper, digit, blank, line end, sentence mark, mark within words, symbol, beyond ASCII.
KINDS = 10
KIND = np.zeros(256, np.int64)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[32], KIND[9], KIND[10], KIND[13] = 1, 2, 3, 4, 4, 5, 5
KIND[[ord(c) for c in ".,;:?"]] = 6
KIND[[ord(c) for c in "'\"-()"]] = 7
KIND[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 8
KIND[128:] = 9
LINE = np.ones(256, bool)
LINE[[10, 13]] = False
TEXT_SIZE = 20
META_SIZE = 3 + SOURCES + LANGS


def _repeats(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: distinct words, copies of the most frequent one, words equal to the last, to the one before it."""
    h = words.hashes()
    n = len(words.counts)
    doc = np.repeat(np.arange(n), words.counts)
    order = np.lexsort((h, doc))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    spot = np.flatnonzero(first)
    runs = np.diff(np.append(spot, len(h)))
    owner = doc[order][spot]
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, runs)
    again = [np.bincount(doc[k:][(h[k:] == h[:-k]) & (doc[k:] == doc[:-k])], minlength=n) for k in (1, 2)]
    return np.bincount(owner, minlength=n), most, *again


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of TEXT_SIZE numbers a text; the last is its number of words."""
    data, bounds = raw(texts)
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    kinds = np.bincount(doc * KINDS + KIND[data], minlength=n * KINDS).reshape(n, KINDS).astype(float)
    words, lines = Words(texts, SOLID), Words(texts, LINE)
    distinct, most, same1, same2 = _repeats(words)
    line_distinct, line_most, _, _ = _repeats(lines)
    w, ln, size = np.maximum(words.counts, 1), np.maximum(lines.counts, 1), np.maximum(kinds.sum(axis=1), 1)
    lasts = np.bincount(np.repeat(np.arange(n), words.counts)[KIND[words.low[words.ends - 1]] == 8], minlength=n)
    cased = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
    bare = np.bincount(np.repeat(np.arange(n), lines.counts)[KIND[lines.low[lines.ends - 1]] != 6], minlength=n)
    out = np.column_stack([
        kinds[:, 2] / cased, np.minimum(kinds[:, 2] / cased, 0.2), kinds[:, 3] / size, kinds[:, 6] / size, kinds[:, 7] / size,
        kinds[:, 8] / size, np.minimum(kinds[:, 8] / size, 0.05), kinds[:, 9] / size, kinds[:, 0] / size, np.log(size / w),
        lasts / w, same1 / w, np.minimum(same1 / w, 0.2), same2 / w, most / w, np.log(distinct + 1.0) / np.log(w + 2.0),
        1 - line_distinct / ln, line_most / ln * (lines.counts > 3), bare / ln, words.counts,
    ])
    return np.where(words.counts[:, None] > 0, out, 0.0)


def _view_text(rows: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(rows)), np.clip((rows[:, :-1] - scale[0, :-1]) / scale[1, :-1], -8, 8)])


def _view_meta(source: np.ndarray, lang: np.ndarray, chars: np.ndarray) -> np.ndarray:
    n = len(source)
    known = chars >= 0
    out = np.zeros((n, META_SIZE))
    out[:, 0] = 1
    out[:, 1] = np.where(known, np.log1p(np.maximum(chars, 0)) / 10, 0)
    out[:, 2] = ~known
    out[np.arange(n), 3 + source] = 1
    out[np.arange(n), 3 + SOURCES + lang] = 1
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model(NamedTuple):
    scale: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    text_line: np.ndarray
    meta_line: np.ndarray
    prior: float

    def scores(self, features: np.ndarray, source, lang, chars):
        """Calibrated probabilities of good quality: text view, metadata view, both."""
        a = _view_text(features, self.scale) @ self.text * self.text_line[0] + self.text_line[1]
        b = _view_meta(source, lang, chars) @ self.meta * self.meta_line[0] + self.meta_line[1]
        both = np.where(features[:, -1] > 0, sigmoid(a + b - self.prior), 0.0)
        return np.round(sigmoid(a), 9), np.round(sigmoid(b), 9), np.round(both, 9)


def _described(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` with __text (features) and the metadata __source, __lang, __chars as numbers."""
    bucket = lambda c, n: F.pmod(F.xxhash64(F.lit(5), F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(n)).cast("int")
    rows = docs.withColumns({
        "__source": bucket("source", SOURCES), "__lang": bucket("lang", LANGS), "__chars": F.coalesce(F.col("n_chars").cast("long"), F.lit(-1).cast("long"))})

    def describe(texts):
        flat = text_features(texts).astype(np.float32)
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * TEXT_SIZE), pa.array(flat.reshape(-1)))]

    return annotate(rows, "text", [("__text", "array<float>")], describe, [*keep, "__source", "__lang", "__chars"])


def _arrays(batch: pa.RecordBatch, at: int):
    rows = batch.column(at + 3).flatten().to_numpy().reshape(-1, TEXT_SIZE).astype(float)
    return rows, *(batch.column(at + k).to_numpy() for k in range(3))


def _added(df: DataFrame, make, size: int) -> np.ndarray:
    """Sum of the vectors that `make(batch)` returns; one vector a task, added by Spark."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += make(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["i", "v"])

    out = np.zeros(size)
    for i, v in df.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[i] = v
    return out


def _step(x, y, weight, w):
    """Gradient and Hessian of the weighted log loss, as one vector."""
    p = sigmoid(x @ w)
    return np.concatenate([x.T @ (weight * (p - y)), ((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x).reshape(-1)])


def _solve(total: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    k = len(w)
    hold = np.full(k, ridge)
    hold[0] = 1e-6
    return w - np.linalg.solve(total[k:].reshape(k, k) + np.diag(hold), total[:k] + hold * w)


def train(docs: DataFrame, labels: DataFrame, rounds: int = 3, steps: int = 4, ridge: float = 1.0) -> tuple[Model, DataFrame]:
    """The model, and the described rows it was fitted on (doc_id, label, metadata, features).

    Every document takes part in every pass; a fifth of the labels (by a hash of the id) is
    set aside for calibration.  Without both kinds of labels the model scores by the prior alone.
    """
    given = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("q"))
    given = given.select("doc_id", F.when(F.col("q") >= 0.5, 1.0).otherwise(0.0).alias("label"))
    rows = stored(_described(docs.select("doc_id", "text", "source", "lang", "n_chars"), ["doc_id"]), "described")
    rows = stored(rows.join(given, "doc_id", "left").select(
        "doc_id", F.coalesce("label", F.lit(-1.0)).alias("label"),
        (F.pmod(F.xxhash64(F.lit(55), F.col("doc_id")), F.lit(5)) == 0).alias("aside"), "__source", "__lang", "__chars", "__text"), "labelled")

    def moments(batch):
        x = _arrays(batch, 3)[0]
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    m = _added(rows, moments, 1 + 2 * TEXT_SIZE)
    mean = m[1:1 + TEXT_SIZE] / max(m[0], 1)
    scale = np.stack([mean, np.sqrt(np.maximum(m[1 + TEXT_SIZE:] / max(m[0], 1) - mean**2, 1e-10))])
    text, meta = np.zeros(TEXT_SIZE), np.zeros(META_SIZE)

    def views(batch):
        features, *rest = _arrays(batch, 3)
        return _view_text(features, scale), _view_meta(*rest), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)

    for turn in range(rounds):
        old_text, old_meta = text, meta
        for _ in range(steps):

            def both(batch, text=text, meta=meta, teach=turn > 0):
                a, b, y, aside = views(batch)
                made = []
                for x, w, other in ((a, text, sigmoid(b @ old_meta)), (b, meta, sigmoid(a @ old_text))):
                    weight = ((y >= 0) & ~aside).astype(float)
                    if teach:
                        weight = np.where((y < 0) & (np.abs(other - 0.5) >= SURE - 0.5), PSEUDO_WEIGHT, weight)
                    made.append(_step(x, np.where(y >= 0, y, (other > 0.5).astype(float)), weight, w))
                return np.concatenate(made)

            cut = TEXT_SIZE * (TEXT_SIZE + 1)
            total = _added(rows, both, cut + META_SIZE * (META_SIZE + 1))
            text, meta = _solve(total[:cut], text, ridge), _solve(total[cut:], meta, ridge)

    lines = [np.array([0.0, 1.0]), np.array([0.0, 1.0])]  # intercept, slope
    prior = np.zeros(2)
    for _ in range(steps):

        def calibrate(batch, lines=lines):
            a, b, y, aside = views(batch)
            use = (aside & (y >= 0)).astype(float)
            made = [_step(np.column_stack([np.ones(len(y)), x @ w]), y, use, line) for x, w, line in ((a, text, lines[0]), (b, meta, lines[1]))]
            return np.concatenate([*made, [use.sum(), (use * (y > 0)).sum()]])

        total = _added(rows, calibrate, 14)
        lines = [_solve(total[:6], lines[0], 1e-3), _solve(total[6:12], lines[1], 1e-3)]
        prior = total[12:]
    odds = float(np.log((prior[1] + 1) / (prior[0] - prior[1] + 1)))
    return Model(scale, text, meta, lines[0][::-1], lines[1][::-1], odds), rows


def _scored(df: DataFrame, model: Model, keep: int) -> DataFrame:
    """The first `keep` columns with text_score, meta_score and score, computed from the four described ones behind them."""
    names = ["__text_score", "__meta_score", "__score"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:keep]), *(f"{n} double" for n in names)])

    def run(batches):
        for batch in batches:
            features, *rest = _arrays(batch, keep)
            made = model.scores(features, *rest)
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *(pa.array(x) for x in made)], names=[*batch.schema.names[:keep], *names])

    return df.mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """doc_id, text_score, meta_score, score, kept; one row per row of `docs`.

    Cases: null texts and texts without words have score 0 and are not kept; null metadata is a value of
    its own; of several labels of a document the mean counts; rows that repeat a doc_id share
    its label; no rows give no rows; further columns are ignored.
    """
    model, rows = train(docs, labels)
    out = _scored(rows.select("doc_id", "__source", "__lang", "__chars", "__text"), model, 1)
    return out.select(
        "doc_id", F.col("__text_score").alias("text_score"), F.col("__meta_score").alias("meta_score"), F.col("__score").alias("score"),
        (F.col("__score") >= limit).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """Rows of `docs` that are kept; texts are described once more instead of travelling."""
    model, _ = train(docs, labels)
    columns = docs.columns
    return _scored(_described(docs, columns), model, len(columns)).where(F.col("__score") >= limit).select(*columns)
