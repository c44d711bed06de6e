"""Merkle proofs, prefix trie and personal data against plain Python versions, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import ROWS, SCHEMA
from pyspark.sql import functions as F

from verimet.llm import merkle, prefix_trie, private_data
from verimet.llm.catalog import QUERIES
from verimet.session import work_path

FOLDER = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- manifest


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def route(tree, i):
    for nodes in tree[:-1]:
        run = i // 3 * 3
        yield nodes[run:i], nodes[i + 1:run + 3]
        i //= 3


def climb(digest, steps):
    for before, after in steps:
        digest = sha("".join([*before, digest, *after]))
    return digest


def brute_manifest(rows):
    """Rows (doc_id, text, lang, source, n_chars) → Counter of the query's rows."""
    groups = defaultdict(list)
    for d, text, lang, source, n in rows:
        cut = text.replace("\n", "") if text is not None and d is not None and zlib.crc32(str(d).encode()) % 2 == 0 else text
        groups[source].append((d, leaf((d, source, lang, n, text)), leaf((d, source, lang, n, cut))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = [levels([r[1] for r in groups[s]]) for s in order]
    top = levels([t[-1][0] for t in trees])
    out = Counter()
    for j, s in enumerate(order):
        for i, (d, whole, cut) in enumerate(groups[s]):
            steps = [*route(trees[j], i), *route(top, j)]
            folded = climb(cut, steps)
            proof = sha("".join(x for before, after in steps for x in [*before, *after]))
            out[(d, whole, trees[j][-1][0], top[-1][0], proof, folded, folded == top[-1][0])] += 1
    return out


def proofs(frame):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = {"text": F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in merkle.manifest(frame, changed).select(names).collect())


def test_manifest(docs, no_docs):
    assert proofs(docs) == brute_manifest(ROWS)
    assert not proofs(no_docs)


@pytest.mark.parametrize("sizes", [[1], [2], [3, 1], [28, 1, 27, 9], [83, 82, 1, 1], [1] * 30, [250, 4, 1, None, 10]])
def test_manifest_shapes(spark, sizes, monkeypatch):
    """Lone rows, full and ragged runs, one and many trees; the ancestors broadcast and shuffled."""
    rows = [(100 * j + i if n else None, f"t{j}\n{i}" if i % 3 else None, "en", None if j == 1 else f"s{j}", i) for j, n in enumerate(sizes) for i in range(n or 2)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    want = brute_manifest(rows)
    assert proofs(frame) == want
    monkeypatch.setattr(merkle, "SMALL", 0)
    assert proofs(frame) == want


def test_manifest_finds_changes(docs):
    """Without changed values all rows prove; a changed value never does."""
    assert merkle.manifest(docs).where("not verified").count() == 0
    other = merkle.manifest(docs, {"n_chars": F.lit(-1)})
    assert other.where("verified").count() == 0


# ---- trie


def brute_trie(sequences):
    """{conv_id: [(role, text), ...]} → Counter of the query's rows."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for key, ids in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += kids[key] == 0
            saved[key[:d]] += (len(ids) - 1) * len(key[-1][1]) if key else 0
    out = Counter()
    for key, ids in members.items():
        stop = ",".join(str(c) for c in sorted(c for c in ids if len(sequences[c]) == len(key)))
        out[(min(ids), len(key), min(members[key[:-1]]) if key else None, len(ids), kids[key], leaves[key], saved[key], sha(stop))] += 1
    return out


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).withColumns(
        {c: F.lit(1) for c in ("keys", "depth", "key", "n_convs", "digest", "size")})
    return Counter(tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.turn_lists(frame)).select(NODE).collect())


def in_order(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            out[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    return {c: [x[3:] for x in sorted(t)] for c, t in out.items()}


def test_trie(spark):
    rnd = random.Random(3)
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", rnd.choice("ab") * rnd.randrange(3)) for c in range(60) for k in range(rnd.randrange(7))]
    rows += [(100, 0, None, None), (100, None, "user", "é日"), (101, 0, "", ""), (101, None, "user", "é日"), (None, 0, "user", "x"), (-5, 1, "user", "a"), (-5, 1, "user", "b"), (-5, 1, "user", "b")]
    assert trie(spark, rows) == brute_trie(in_order(rows))
    assert not trie(spark, [(None, 1, "a", "b")])


def test_trie_of_long_conversations(spark, monkeypatch):
    """Bare paths below the deepest shared turn, for equal, forking and single long conversations."""
    monkeypatch.setattr(prefix_trie, "SHALLOW", 2)
    line = lambda c, n, fork=None: [(c, k, "user", f"t{k}" + ("x" if fork is not None and k >= fork else "")) for k in range(n)]
    rows = [*line(1, 40), *line(2, 40), *line(3, 9), *line(4, 30, 8), *line(5, 33, 9), *line(6, 2), *line(7, 3), *line(8, 60, 0), *line(9, 4, 0), *line(10, 1)]
    assert trie(spark, rows) == brute_trie(in_order(rows))


def test_trie_without_turns(spark):
    frame = spark.createDataFrame([(4, []), (2, []), (3, [(b"d" * 32, 5)])], f"conv_id long, turns {prefix_trie.TURNS}")
    got = prefix_trie.prefix_trie(frame).select(NODE).orderBy("depth").collect()
    assert [tuple(r) for r in got] == [(2, 0, None, 3, 1, 1, 0, sha("2,4")), (3, 1, 2, 1, 0, 1, 0, sha("3"))]


def test_trie_streams_many_ends(spark):
    """One node on which ids of several blocks end."""
    ids = [*range(-70_000, 70_000, 7), 2**40, -2**40]
    frame = spark.createDataFrame([(c, [(b"d" * 32, 5)]) for c in ids], f"conv_id long, turns {prefix_trie.TURNS}")
    got = prefix_trie.prefix_trie(frame).where("depth = 1").first()
    assert got.ends_sha256 == sha(",".join(map(str, sorted(ids)))) and got.saved_tokens == 5 * (len(ids) - 1)


# ---- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_private(text):
    """(counts, base spans) of one text."""
    text, found = text or "", []
    found += [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1]))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, "card", m.end()))
    found += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    counts = Counter(f[2] for f in found)
    return (*(counts[k] for k in private_data.BASE), ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found)))


def check_private(frame, query=False):
    got = frame.collect()
    for r in got:
        base = [s for s in r["__spans"] if s.kind < len(private_data.BASE)]
        counts = Counter(private_data.BASE[s.kind] for s in base)
        spans = ",".join(f"{private_data.BASE[s.kind]}:{s.start}:{s.end}" for s in base)
        assert (*(counts[k] for k in private_data.BASE), spans) == brute_private(r.text), r.text
    return len(got)


def test_private_fuzzed(spark):
    rnd = random.Random(9)
    parts = ["a", "B.c", "@", "@x.yz", "a@b.co", ".", "..", "1.2.3.4", "0255.1.1.256", "4111 1111 1111 1111", "4111-1111", "-", " ", "+", "+1 (555) 010-9999",
             "+49", "12", "007", "é", "日本", "%", "_", "\n", "5500005555555559", "(", ")", "9", "00000000000000", "://u:p@h", "IBAN ", "ssn "]
    rows = [(k, "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25)))) for k in range(3000)]
    rows += [(-1, None), (-2, ""), (-3, "1." * 40_000 + "1"), (-4, "a." * 50_000 + "@" * 50 + "b.c"), (-5, "4111 1111 1111 1111 " * 2000), (-6, "+1" * 30_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    joined = private_data.find_private(frame, ["doc_id", "text"])
    assert check_private(joined) == len(rows)


def test_private_rows(spark, docs, no_docs):
    assert private_data.find_private(docs).columns == [*docs.columns, "__spans"]
    assert check_private(private_data.find_private(docs)) == len(ROWS)
    assert private_data.find_private(no_docs).count() == 0


def test_private_kinds(spark):
    """What the cues and schemes add: only valid accounts and addresses with a user."""
    texts = ["see https://joe:pw@host.example/x", "see https://host.example/@joe", "IBAN: DE89 3704 0044 0532 0130 00.", "IBAN: DE88 3704 0044 0532 0130 00",
             "SSN 123-45-6789", "ssn 000-45-6789", "Account number: 12345678", "account of 12 people", "socialite 123-45-6789"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    more = {r.doc_id: [(private_data.KINDS[s.kind], texts[r.doc_id][s.start:s.end]) for s in r["__spans"] if s.kind >= 4] for r in private_data.find_private(frame).collect()}
    assert more == {0: [("login", "https://joe:pw@host.example")], 1: [], 2: [("iban", "DE89 3704 0044 0532 0130 00")], 3: [], 4: [("ssn", "123-45-6789")], 5: [],
                    6: [("account", "12345678")], 7: [], 8: []}


def test_private_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = QUERIES["op13_private_data"](spark, FOLDER).collect()
    assert len(got) == len(texts) and sum(r.n_email + r.n_phone for r in got) > 0
    for r in got:
        *counts, spans = brute_private(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (*counts, sha(spans))


def test_query_on_odd_conversations(spark):
    """The rebuilt conversations of the query, with missing first ones and negative ids."""
    folder = work_path(spark, "odd")
    rnd = random.Random(4)
    rows = [(c, k if k else None, "user", rnd.choice(["a", "bb", None])) for c in [*range(0, 30), *range(105, 120), *range(-40, -20), 200, 250] for k in range(rnd.randrange(1, 9))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    own = in_order(rows)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = (abs(c) // 100 * 100) * (1 if c > 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    assert Counter(tuple(r) for r in QUERIES["op12_prefix_trie"](spark, folder).select(NODE).collect()) == brute_trie(rebuilt)
