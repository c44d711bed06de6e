"""Longest verbatim matches, from one word on, and large benchmarks in separate passes."""

import random

import brute

from verimet.llm import contamination


def longest(text, items):
    words, best = brute.words(text, brute.ALNUM), 0
    for item in items:
        other = brute.words(item, brute.ALNUM)
        row = [0] * (len(other) + 1)
        for w in words:
            row = [0] + [row[j] + 1 if w == other[j] else 0 for j in range(len(other))]
            best = max(best, max(row))
    return best


def made(seed, docs=60, items=25):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(rnd.choice([6, 60, 4000]))}"
    bench = [(k, " ".join(word() for _ in range(rnd.choice([1, 2, 5, 9, 10, 11, 40])))) for k in range(items)]
    texts = []
    for k in range(docs):
        parts = [word() for _ in range(rnd.randrange(60))]
        for _ in range(rnd.randrange(3)):
            other = rnd.choice(bench)[1].split()
            a = rnd.randrange(len(other))
            at = rnd.randrange(len(parts) + 1)
            parts[at:at] = other[a:a + rnd.randrange(1, 15)]
        texts.append((k, " ".join(parts)))
    return bench, [*texts, (1000, None), (1001, ""), (1002, "zzz yyy")]


def test_longest_matches(spark):
    seen = set()
    for seed in range(3):
        bench, texts = made(seed)
        frame, items = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string")
        got = {r.doc_id: r for r in contamination.contamination(frame, items).collect()}
        want = {d: longest(t, [i for _, i in bench]) for d, t in texts}
        assert {d: r.longest for d, r in got.items()} == want
        seen |= set(want.values())
        for d, n, h, k, _, c in brute.contamination(texts, bench):
            assert (got[d].n_words, got[d].n_hit, got[d].n_items, got[d].contaminated) == (n, h, k, c)
    assert {0, 1, 2, 9} <= seen and max(seen) >= 10


def test_blocks_are_separate_passes(spark, docs, monkeypatch):
    """Many blocks give the rows of one, repeated and null documents included, and each pass ends before the next one."""
    bench, texts = made(7)
    frame = spark.createDataFrame(texts + texts[:9] + [(None, texts[3][1])], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame(bench, "item_id long, text string")
    show = lambda df: sorted((str(r.doc_id), r["__n_words"], sorted(r["__items"]), r["__longest"], r.hit) for r in df.withColumn(
        "hit", contamination.hit_words(contamination.F.col("__spans"))).collect())
    whole = contamination.scan(frame, items, ["doc_id"])
    parts = contamination.scan(frame, items, ["doc_id"], block_chars=300)
    assert show(whole) == show(parts)
    assert "MapInArrow" not in parts._jdf.queryExecution().executedPlan().toString()
    left = contamination.decontaminate(docs, items)
    assert left.columns == docs.columns
