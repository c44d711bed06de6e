"""Language identification against a plain per-row follow-the-regularised-leader."""

import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from verimet.llm import language
from verimet.llm.common import mix

FOLDER = "/root/testdata/sf0.001"


def buckets(text):
    """{n-gram bucket: count} of one text."""
    kept, blank = [], False
    for c in text.lower():
        letter = unicodedata.category(c)[0] == "L"
        if letter or not blank:
            kept.append(c if letter else " ")
        blank = not letter
    kept = list(" " + "".join(kept).strip() + " ") if any(c != " " for c in kept) else [" "]
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(kept) - n + 1):
            h = 0
            for k in range(n):
                h = (h * 0x100000001B3 + ord(kept[i + k]) + k + 1) % (1 << 64)
            out[int(mix(np.array([h], np.uint64))[0] >> np.uint64(48))] += 1
    return out


def features(text, idf):
    raw = {b: (1 + math.log(c)) * idf(b) for b, c in buckets(text).items()}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    return {b: float(np.float32(v / norm)) for b, v in raw.items()}


def softmax(scores):
    top = max(scores)
    e = [math.exp(s - top) for s in scores]
    return [x / sum(e) for x in e]


class Plain:
    """One weight at a time."""

    def __init__(self, k):
        self.k, self.z, self.n = k, defaultdict(float), defaultdict(float)

    def weight(self, b, j):
        z = self.z[b, j]
        if abs(z) <= 0.02:
            return 0.0
        return -(z - math.copysign(0.02, z)) / (0.1 + math.sqrt(self.n[b, j]) + 0.02)

    def scores(self, x):
        return [sum(v * self.weight(b, j) for b, v in x.items()) for j in range(self.k)]

    def learn(self, x, label):
        p = softmax(self.scores(x))
        for j in range(self.k):
            for b, v in x.items():
                g = v * (p[j] - (j == label))
                w = self.weight(b, j)
                self.z[b, j] += g - (math.sqrt(self.n[b, j] + g * g) - math.sqrt(self.n[b, j])) * w
                self.n[b, j] += g * g


@pytest.mark.parametrize("shares", [1, 2])
def test_fit_equals_a_plain_learner(spark, monkeypatch, shares):
    """Same rows in the same order: with one share the same weights; with two the mean of both shares' states."""
    monkeypatch.setattr(language, "SHARES", shares)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) < 400")
    rows = docs.withColumn("at", F.xxhash64("doc_id", "text")).withColumn("slot", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(shares * 5))).collect()
    rows = [r for r in rows if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    langs = sorted({r.lang for r in rows})
    frequency = Counter(b for r in rows for b in buckets(r.text))
    idf = lambda b: math.log((1 + len(rows)) / (1 + frequency[b])) + 1
    x = {r.at: features(r.text, idf) for r in rows}
    learners = [Plain(len(langs)) for _ in range(shares)]
    for s, own in enumerate(learners):
        for r in sorted((r for r in rows if r.slot < shares * 4 and r.slot % shares == s), key=lambda r: r.at):
            own.learn(x[r.at], langs.index(r.lang))
    mean = Plain(len(langs))
    for own in learners:
        for key in list(own.z):
            mean.z[key] += own.z[key] / shares
            mean.n[key] += own.n[key] / shares
    model = language.fit(docs, rows_per_label=10**9, rounds=1)
    assert model.langs == langs
    got = model.weights
    for (b, j) in list(mean.z):
        assert got[b, j] == pytest.approx(mean.weight(b, j), abs=1e-6)
    assert np.count_nonzero(got) == sum(mean.weight(b, j) != 0 for b, j in list(mean.z))
    found = {(r.doc_id, r.text): r for r in language.identify(docs, model).collect()}
    for r in rows[:60]:
        scores = [s / model.temperature for s in mean.scores(x[r.at])]
        p = softmax(scores)
        one = found[r.doc_id, r.text]
        if one["__lang"] != "und":
            assert one["__score"] == pytest.approx(max(p), abs=1e-5) and p[langs.index(one["__lang"])] == pytest.approx(max(p), abs=1e-5)


def test_a_tie_goes_to_the_first_language(spark):
    """Nothing learnt tells the languages apart."""
    docs = spark.createDataFrame([(1, "abc", "xx"), (2, "abc", "aa")], "doc_id long, text string, lang string")
    model = language.Model(["aa", "xx"], np.ones(1 << language.BITS), np.zeros((1 << language.BITS, 2)), 1.0)
    assert {(r["__lang"], r["__score"]) for r in language.identify(docs, model).collect()} == {("aa", 0.5)}
