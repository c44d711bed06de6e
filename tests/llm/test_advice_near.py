"""The index follows the threshold."""

import random

import brute
import numpy as np
import pytest

from verimet.llm import near


def _families(seed):
    rnd, rows = random.Random(seed), []
    for _ in range(10):
        base = [f"w{rnd.randrange(3000)}" for _ in range(120)]
        for _ in range(rnd.choice([2, 5, 30])):
            text = list(base)
            for _ in range(rnd.randrange(0, 8)):
                text[rnd.randrange(len(text))] = f"e{rnd.randrange(9999)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def test_near_at_80(spark):
    rows = _families(9)
    want = brute.near(rows, 80)
    assert want != brute.near(rows, 85)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in near.near_duplicates(frame, 80).collect()} == want


def test_near_at_80_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept = {d for d, w in brute.near(rows, 80).items() if w[2]}
    assert kept < {d for d, w in brute.near(rows, 85).items() if w[2]}
    assert {r.doc_id for r in near.without_near_duplicates(docs, 80).collect()} == kept


def test_percent_that_no_index_covers(no_docs):
    with pytest.raises(ValueError, match="covers 80"):
        near.near_duplicates(no_docs, 79)


@pytest.mark.parametrize("percent", [85, 80])
def test_pairs_at_the_guaranteed_distance(percent):
    """Signatures that differ in all the places which the chunks allow, of similar sets."""
    index = near.index_for(percent)
    distance = 2 * (len(index.borders) - 1) - 1
    starts = index.borders[:-1]
    differing = sorted([*starts, *(starts + 1)])[:distance]
    sig = np.zeros((2, near.PLACES), np.int16)
    sig[1, differing] = 1
    place = near._first_shared(sig[:1], sig[1:], index)[0]
    rep, n, sets = np.array([1, 2]), np.array([20, 20]), np.tile(np.arange(20), 2)
    found = near.links_in_group(rep, rep, n, place, sig, sets, np.array([0, 20, 40]), percent, index)
    assert [sorted(pair) for pair in found] == [[0, 1]]
