"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (per-coordinate, L1 and L2), calibrated by one temperature.
"""

from __future__ import annotations

import sys
import unicodedata
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verimet.llm.common import annotate, mix, stored

BITS = 16
ORDERS = (1, 2, 3)
#: Labelled rows a language gives to the fit, about; a fifth of them set the temperature.
ROWS_PER_LABEL = 1500
SHARES = 8
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


class Grams:
    """Distinct (text, bucket) pairs of some texts with counts; `lettered` tells which texts have a letter.

    Texts are lower-cased and runs of other characters become one space; n-grams stay within a text.
    """

    def __init__(self, texts: list[str]) -> None:
        low = [f" {t.lower()} " for t in texts]
        sizes = np.array([len(t) for t in low], np.int64)
        codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        text = np.repeat(np.arange(len(low), dtype=np.int64), sizes)
        is_letter = letters()[codes]
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        if len(keep):
            keep[0] = True
        keep[np.cumsum(sizes)[:-1]] = True
        self.lettered = np.bincount(text[is_letter], minlength=len(low)) > 0
        codes = np.where(is_letter, codes, 32)[keep].astype(np.uint64)
        text = text[keep]
        pairs = []
        rolled = np.zeros(len(codes), np.uint64)
        for n in ORDERS:
            m = len(codes) - n + 1
            if m <= 0:
                break
            rolled = rolled[:m] * np.uint64(0x100000001B3) + codes[n - 1:n - 1 + m] + np.uint64(n)
            inside = text[:m] == text[n - 1:n - 1 + m]
            bucket = (mix(rolled) >> np.uint64(64 - BITS)).astype(np.int64)
            pairs.append((text[:m][inside] << BITS) | bucket[inside])
        flat = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
        flat.sort()
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        self.counts = np.diff(np.concatenate([first, [len(flat)]]))
        self.text, self.bucket = flat[first] >> BITS, flat[first] & ((1 << BITS) - 1)
        self.n = len(low)

    def weights(self, idf: np.ndarray) -> np.ndarray:
        """(1 + log tf) * idf, each text to length 1."""
        value = (1 + np.log(self.counts)) * idf[self.bucket]
        norm = np.sqrt(np.bincount(self.text, value * value, self.n))
        return value / np.maximum(norm, 1e-12)[self.text]


class Model(NamedTuple):
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def held_out(doc_id):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def _sum_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Texts with each n-gram bucket, over all rows: one vector a task, added up before it reaches the driver."""

    def count(batches):
        total, rows = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 128):
                grams = Grams(texts[at:at + 128])
                total += np.bincount(grams.bucket, minlength=1 << BITS)
                rows += grams.n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(total[some], rows), pa.int64())], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    frequency, rows = np.zeros(1 << BITS), 0
    for bucket, n in found:
        if bucket < 0:
            rows = n
        else:
            frequency[bucket] = n
    return frequency, rows


def softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


class Leader:
    """Per-coordinate follow-the-regularised-leader with elastic net: state z and squared gradients n."""

    def __init__(self, z, n, alpha=1.0, beta=0.1, l1=0.02, l2=0.02) -> None:
        self.z, self.n, self.alpha, self.beta, self.l1, self.l2 = z, n, alpha, beta, l1, l2

    def at(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, rows, values, label) -> None:
        w = self.at(rows)
        p = softmax((values @ w)[None, :])[0]
        p[label] -= 1
        g = values[:, None] * p[None, :]
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = n + g * g


def _learner(state):
    def learn_share(part: pd.DataFrame) -> pd.DataFrame:
        own = Leader(state.value[0].copy(), state.value[1].copy())
        for row in part.sort_values("at").itertuples():
            own.learn(row.rows, row.vals.astype(float), row.label)
        touched = np.unique(np.concatenate(part["rows"].to_list())).astype("<i4")
        return pd.DataFrame({"share": [int(part["slot"].iloc[0]) % SHARES], "rows": [touched.tobytes()],
                             "z": [own.z[touched].astype("<f8").tobytes()], "n": [own.n[touched].astype("<f8").tobytes()]})

    return learn_share


def fit(docs: DataFrame, rows_per_label: int = ROWS_PER_LABEL, rounds: int = 3) -> Model:
    """Learn from the rows of `docs` (doc_id, text, lang) that are not held out and have a text and a lang.

    Document frequencies count all those rows.  The weights see about `rows_per_label` rows of
    each language, chosen by a hash of the id; in each round the shares of that sample
    learn one after another inside, side by side outside, and their states are averaged.  A share sends the
    rows of the state that it has touched; the driver holds the state and one share at a time.
    """
    spark = docs.sparkSession
    letters()  # made once here, and sent along
    known = docs.where(~held_out("doc_id") & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").count().orderBy("lang").collect()
    langs = [r.lang for r in counts]
    if not langs:
        return Model([], np.ones(1 << BITS), np.zeros((1 << BITS, 1)), 1.0)
    frequency, total = _sum_frequencies(known)
    idf = np.log((1 + total) / (1 + frequency)) + 1

    part = F.pmod(F.xxhash64(F.lit(2), F.col("doc_id")), F.lit(1 << 30))
    chosen = F.lit(False)
    label = F.lit(-1)
    for k, r in enumerate(counts):
        share = min(1.0, rows_per_label / r["count"])
        chosen = chosen | ((F.col("lang") == r.lang) & (part < int(share * (1 << 30))))
        label = F.when(F.col("lang") == r.lang, k).otherwise(label)
    sample = known.where(chosen).select(
        F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), F.lit(SHARES * 5)).cast("int").alias("slot"), label.cast("int").alias("label"),
        F.xxhash64("doc_id", "text").alias("at"), "text")
    small = idf.astype(np.float64)

    def sparse(texts):
        grams = Grams(texts.to_pylist())
        of = np.searchsorted(grams.text, np.arange(grams.n + 1)).astype(np.int32)
        value = grams.weights(small)
        return [pa.ListArray.from_arrays(pa.array(of), pa.array(grams.bucket, pa.int32())), pa.ListArray.from_arrays(pa.array(of), pa.array(value, pa.float32()))]

    rows = stored(annotate(sample, "text", [("rows", "array<int>"), ("vals", "array<float>")], sparse, ["slot", "label", "at"], piece=1 << 20), "lang-sample")
    learn, check = rows.where(F.col("slot") < SHARES * 4), rows.where(F.col("slot") >= SHARES * 4)
    k = len(langs)
    z, n = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((z, n))

        made = learn.groupBy((F.col("slot") % SHARES).alias("s")).applyInPandas(_learner(state), "share int, rows binary, z binary, n binary")
        shares, moved = 0, (np.zeros_like(z), np.zeros_like(n))
        for r in stored(made, "lang-shares").repartitionByRange(SHARES, "share").toLocalIterator():
            touched = np.frombuffer(r.rows, "<i4")
            for total, old, new in zip(moved, (z, n), (r.z, r.n), strict=True):
                total[touched] += np.frombuffer(new, "<f8").reshape(-1, k) - old[touched]
            shares += 1
        state.unpersist()
        if shares:
            z, n = z + moved[0] / shares, n + moved[1] / shares
    weights = Leader(z, n).at()

    def logits(batches):
        for batch in batches:
            got = [values.astype(float) @ weights[rows_] for rows_, values in zip(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)), strict=True)]
            flat = np.array(got).reshape(-1)
            of = np.arange(len(got) + 1, dtype=np.int32) * k
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(of), pa.array(flat))], names=["label", "logits"])

    judged = check.select("label", "rows", "vals").mapInArrow(logits, "label int, logits array<double>").collect()
    return Model(langs, idf, weights, _temperature(np.array([r.logits for r in judged]).reshape(-1, k), np.array([r.label for r in judged], int)))


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature with the least log loss, by golden section on its logarithm."""
    if not len(labels) or logits.shape[1] < 2:
        return 1.0

    def loss(log_t):
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    a, b, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of `docs` with __lang and __score; only the text is looked at.

    Cases: a null text and one without a letter are ``und`` with score 0, and so is every text if nothing
    was learnt; a tie goes to the first language in order; no rows give no rows;
    further columns are kept as they are.
    """
    letters()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts):
        langs, idf, weights, temperature = held.value
        names, scores = [], []
        values = texts.to_pylist()
        for at in range(0, len(values), 128):
            grams = Grams(values[at:at + 128])
            if langs:
                value = grams.weights(idf)
                logits = np.column_stack([np.bincount(grams.text, value * weights[grams.bucket, k], grams.n) for k in range(len(langs))])
                p = softmax(logits / temperature)
                best = p.argmax(axis=1)
            for i in range(grams.n):
                known = bool(langs) and bool(grams.lettered[i])
                names.append(langs[best[i]] if known else UNKNOWN)
                scores.append(float(p[i, best[i]]) if known else 0.0)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return annotate(docs, "text", [("__lang", "string"), ("__score", "double")], predict, keep, piece=1 << 20)
