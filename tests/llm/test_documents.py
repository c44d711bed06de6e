"""Operators on documents: odd rows, empty tables and brute-force results."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import brute
import pytest
from conftest import ROWS

from verimet.llm import contamination, exact, language, mixing, near, quality, secret_scan, tokens
from verimet.llm.catalog import QUERIES
from verimet.session import work_path

FOLDER = "/root/testdata/sf0.001"


def given(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").select(*columns).collect()]


def test_exact(docs, no_docs):
    got = Counter(tuple(r) for r in exact.exact_duplicates(docs).collect())
    fold = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in ROWS:
        groups[fold(r[1])].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids)
    assert got == want
    assert exact.exact_duplicates(no_docs).count() == 0


def test_exact_without_heavy_digests(docs):
    """The two ways give the same rows."""
    a, b = (Counter(tuple(r) for r in exact.exact_duplicates(docs, counters=c, winners=w).collect()) for c, w in ((4096, 1024), (64, 1)))
    assert a == b


def test_contamination(spark, docs, no_docs):
    items = [(1, BASE_PART), (2, "one two"), (3, None), (4, ""), (5, BASE_PART), (None, "no id here"), (6, "Ünïcode TOKEN"), (7, "word5x5 " * 3)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "contaminated"]
    got = Counter(tuple(r) for r in contamination.contamination(docs, bench).select(*cols).collect())
    want = Counter((d, n, h, k, c) for d, n, h, k, _, c in brute.contamination([r[:2] for r in ROWS], [i for i in items if i[0] and i[1]]))
    assert got == want
    assert contamination.contamination(no_docs, bench).count() == 0
    assert contamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    left = contamination.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(n for r, n in want.items() if not r[4])


BASE_PART = " ".join(f"term{i}" for i in range(5, 25))


def test_contamination_in_blocks(spark, docs):
    """Items that arrive in several passes give the same rows."""
    bench = spark.createDataFrame([(k, " ".join(f"term{i}" for i in range(k, k + 12))) for k in range(40)], "item_id long, text string")
    whole = contamination.scan(docs.select("doc_id", "text"), bench, ["doc_id"])
    parts = contamination.scan(docs.select("doc_id", "text"), bench, ["doc_id"], block_chars=400)
    pick = lambda df: Counter((r[0], r[1], r[2], frozenset(r[3]), r[4]) for r in df.select(
        "doc_id", "__n_words", contamination.hit_words(contamination.F.col("__spans")), "__items", "__longest").collect())
    assert pick(whole) == pick(parts)


def test_contamination_query(spark):
    got = {r.doc_id: tuple(r) for r in QUERIES["op3_suffix_decontamination"](spark, FOLDER).collect()}
    for row in brute.contamination(given(spark, "documents", "doc_id", "text"), given(spark, "benchmark", "item_id", "text")):
        assert got[row[0]] == row


def test_near(spark, docs, no_docs):
    want = brute.near([r[:2] for r in ROWS if r[0] is not None])
    got = near.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]
    assert near.near_duplicates(no_docs).count() == 0
    assert sorted(r.doc_id for r in near.without_near_duplicates(docs.where("doc_id is not null")).select("doc_id").distinct().collect()) == sorted(
        d for d, w in want.items() if w[2])


def test_near_families(spark, monkeypatch):
    """Groups of edited copies around the threshold, in blocks smaller than a group."""
    rnd = random.Random(5)
    rows = []
    for family in range(12):
        base = [f"w{rnd.randrange(3000)}" for _ in range(120)]
        for _ in range(rnd.choice([2, 5, 30])):
            text = list(base)
            for _ in range(rnd.randrange(0, 6)):
                text[rnd.randrange(len(text))] = f"e{rnd.randrange(9999)}"
            rows.append((len(rows), " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near(rows)
    assert len({w[1] for w in want.values()}) < len(rows)
    for together in (4096, 8):
        monkeypatch.setattr(near, "TOGETHER", together)
        assert {r.doc_id: tuple(r)[1:] for r in near.near_duplicates(frame).collect()} == want


def test_near_query(spark):
    want = brute.near(given(spark, "documents", "doc_id", "text"))
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op6_minhash_hamming"](spark, FOLDER).collect()} == want


def test_components(spark):
    """Chains, stars and repeated links."""
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 30)] + [(8, 7), (7, 8), (200, 150)]
    got = {r.rep: r.comp for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 7 for k in range(7, 30)}, **{k: 100 for k in range(100, 161)}, 200: 100}


def test_secrets(spark, docs, no_docs):
    for row in QUERIES["op8_secret_scan"](spark, FOLDER).collect():
        text = TEXTS.setdefault(FOLDER, dict(given(spark, "documents", "doc_id", "text")))[row.doc_id]
        base = brute.secrets(text, 3)
        assert row.spans == brute.secrets(text)
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(base.count(k) for k in ("assign:", "access:", "hex:"))
    found = secret_scan.find_secrets(docs)
    assert found.columns == [*docs.columns, "__spans"] and found.count() == len(ROWS)
    assert found.where("doc_id = 14 and size(__spans) = 2").count() == 1
    assert secret_scan.find_secrets(no_docs).count() == 0


TEXTS: dict = {}


def test_secrets_against_expressions():
    """Random strings from pieces of secrets, lanes that begin inside matches, very long matches."""
    import pyarrow as pa

    rnd = random.Random(8)
    bits = ["password", "Token", "api_key", "APIkey", "secret", "=", ":", " ", '"', "'", "abc", "é", "AKIA", "AKIAABCDEFGHIJ1234",
            "0123456789abcdef", "f", "Z9+/", "_.", "=-", "日本", "\n", "token=", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18, "a" * 40, ""]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.choice([0, 4, 12, 80]))) for _ in range(2500)] + ["a" * 30_000, "token=" * 3000]
    scanner = secret_scan.Scanner()
    kinds = [r.kind for r in scanner.rules]
    for text, spans in zip(texts, scanner(pa.array(texts))[0].to_pylist(), strict=True):
        assert ",".join(f"{kinds[s['kind']]}:{s['start']}:{s['end']}" for s in spans) == brute.secrets(text)


def test_tokens(spark, docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    ordered = sorted(given(spark, "documents", "doc_id", "text"))
    got = sorted(tuple(r) for r in QUERIES["op9_token_orc"](spark, FOLDER).collect())
    assert got == brute.token_rows(ordered, tokenizer)

    folder = work_path(spark, "odd-tokens")
    tokens.write_tokens(docs, folder, path, shard_bytes=20_000)
    want = brute.token_rows(sorted([r[:2] for r in ROWS], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), tokenizer)
    assert Counter(tuple(r) for r in tokens.token_summary(spark, folder).collect()) == Counter(want)
    some = tokens.read_tokens(spark, folder, [14])
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", some._jdf.queryExecution().toString())[1]
    assert set(pushed.split(", ")) == {"IsNotNull(doc_id)", "EqualTo(doc_id,14)"}
    assert [list(r.ids) for r in some.collect()] == [[*tokenizer.encode(ROWS[13][1]).ids, 2]]
    nothing = work_path(spark, "none")
    tokens.write_tokens(no_docs, nothing, path)
    assert tokens.token_summary(spark, nothing).count() == 0 and tokens.read_tokens(spark, nothing, [1]).count() == 0


def test_pieces_equal_whole_texts():
    """Splitting into remembered pieces gives the ids of the whole text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rnd = random.Random(2)
    known = [chr(c) for c in (*range(0x250), *range(0x2000, 0x20D0))] + list("日ñ 'st re\n\n  ")
    texts = ["".join(rnd.choice(known) for _ in range(rnd.randrange(30))) for _ in range(3000)] + ["", "日本語 text", "it's  we'll \n x"]
    import numpy as np

    for text, data in zip(texts, tokens.Encoder(path)(texts), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_mixture(spark, docs, no_docs):
    for frame in (docs, spark.read.parquet(f"{FOLDER}/documents.parquet")):
        sizes, rows = defaultdict(int), mixing.mix(frame).collect()
        for r in frame.select("source", "text").collect():
            sizes[r.source] += len(brute.words(r.text, brute.SOLID))
        want = brute.targets(dict(sizes))
        taken, largest = defaultdict(int), defaultdict(int)
        assert len(rows) == frame.count()
        for r in rows:
            source = None if r.s == "" else r.s[1:]
            assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
            assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
            taken[source] += r.taken
            largest[source] = max(largest[source], r["size"])
        for source in want:
            assert abs(taken[source] - want[source]) <= max(0.02 * want[source], largest[source])
    again = [mixing.mix(frame).select("doc_id", "taken").orderBy("doc_id").collect() for _ in range(2)]
    assert again[0] == again[1]
    assert mixing.mix(no_docs).count() == 0


def test_mixture_cuts_large_groups(spark):
    """A pair of source and size is cut by hash; its quota stays whole."""
    frame = spark.range(4000).selectExpr("id doc_id", "'a b c' text", "if(id % 4 = 0, 'x', if(id % 4 = 1, 'y', 'z')) source")
    sums = [{r.s: r.t for r in mixing.mix(frame, group_rows=g).groupBy("s").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "t").collect()}
            for g in (50_000, 100)]
    assert sums[0] == sums[1]


def test_mixed_documents(spark, docs):
    copies = Counter((r.doc_id, r["size"]) for r in mixing.mix(docs).collect() for _ in range(r.copies) if r["size"])
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, len(brute.words(r.text, brute.SOLID))) for r in got.collect()) == copies


def test_language(spark, docs, no_docs):
    rows = QUERIES["op2_language_id"](spark, FOLDER).collect()
    lang = dict(given(spark, "documents", "doc_id", "lang"))
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and held
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    model = language.fit(docs)
    found = {(r.doc_id, r.text): r for r in language.identify(docs, model).collect()}
    for (_, text), r in found.items():
        assert 0 <= r["__score"] <= 1
        assert (r["__lang"] == "und") == (not any(c.isalpha() for c in text or ""))
    assert language.identify(no_docs, model).count() == 0
    nothing = language.fit(no_docs)
    assert {r["__lang"] for r in language.identify(docs, nothing).collect()} == {"und"}


def test_language_ignores_other_columns(spark):
    """A prediction depends on the text alone."""
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.fit(frame)
    moved = frame.selectExpr("doc_id + 77777 doc_id", "text", "cast(null as string) lang", "'q' source", "n_chars")
    pick = lambda df: Counter(tuple(r) for r in language.identify(df, model).select("text", "__lang", "__score").collect())
    assert pick(frame) == pick(moved)


def test_quality(spark, docs, no_docs):
    rows = {r.doc_id: r for r in QUERIES["op5_cotrained_quality"](spark, FOLDER).collect()}
    labels = given(spark, "labels", "doc_id", "quality")
    assert sum(rows[d].kept == (q == 1) for d, q in labels if d in rows) >= 0.97 * len(labels)
    given_labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    odd = quality.score_quality(docs, given_labels.selectExpr("doc_id", "quality", "1 as score").union(
        spark.createDataFrame([(1, 0, 1), (1, 1, 1), (None, 1, 1), (2, None, 1)], "doc_id long, quality int, score int")))
    got = odd.collect()
    assert len(got) == len(ROWS) and all(not r.kept and r.score == 0 for r in got if r.doc_id in (6, 7, 8))
    assert quality.score_quality(no_docs, given_labels).count() == 0
    assert quality.score_quality(docs, given_labels.limit(0)).count() == len(ROWS)
    assert quality.keep_good(docs, given_labels).columns == docs.columns
