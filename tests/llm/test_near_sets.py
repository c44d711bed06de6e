"""Near-duplicates with repeated and null ids, in any row order."""

import random
from collections import Counter, defaultdict

import brute

from verimet.llm import near


def by_rows(rows, percent=85):
    """(doc_id, shingles, component, kept) of each row, rows being the nodes."""
    found = brute.near(list(enumerate(r[1] for r in rows)), percent)
    groups = defaultdict(list)
    for k, (_, comp, _) in found.items():
        groups[comp].append(rows[k][0])
    least = {comp: min((d for d in ids if d is not None), default=None) for comp, ids in groups.items()}
    return Counter((rows[k][0], n, least[comp] if n else rows[k][0], rows[k][0] == (least[comp] if n else rows[k][0])) for k, (n, comp, _) in found.items())


def families():
    rnd, rows = random.Random(3), []
    for _ in range(16):
        base = [f"w{rnd.randrange(3000)}" for _ in range(100)]
        for _ in range(rnd.choice([2, 4, 9])):
            text = list(base)
            for _ in range(rnd.randrange(0, 5)):
                text[rnd.randrange(len(text))] = f"e{rnd.randrange(9999)}"
            rows.append((rnd.choice([None, rnd.randrange(12), rnd.randrange(100)]), " ".join(text)))
    return [*rows, (3, None), (None, None), (3, ""), (None, "two words"), (7, "two words"), (None, "alone here"), *rows[:5]]


def test_repeated_and_null_ids_in_any_order(spark):
    rows = families()
    want = by_rows(rows)
    assert sum(1 for r in want if r[0] is not None and r[2] != r[0]) > 5
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(seed + 1)
        got = Counter(tuple(r) for r in near.near_duplicates(frame).collect())
        assert got == want


def test_one_id_for_two_families(spark):
    """Documents 5 and 6 are near copies of two texts that share the id 1."""
    long = lambda k: " ".join(f"{k}{i}" for i in range(80))
    rows = [(1, long("a")), (1, long("b")), (5, long("a") + " x"), (6, long("b") + " x"), (None, long("c")), (9, long("c") + " x")]
    for order in (rows, rows[::-1]):
        got = {(r.doc_id, r.component_id) for r in near.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()}
        assert got == {(1, 1), (5, 1), (6, 1), (None, 9), (9, 9)}
