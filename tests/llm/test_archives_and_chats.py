"""WARC files and chat formatting: round trips, odd rows, empty tables."""

import gzip
import hashlib
from collections import Counter

from pyspark.sql import functions as F

from verimet.llm import chat, warc
from verimet.llm.catalog import QUERIES
from verimet.session import work_path

HTML = "<p>" + "x" * 200 + "</p>"
PAGES = [
    (5, "http://a.example/ b\r\nX: y", HTML), (3, None, HTML), (9, "http://c.example", HTML), (9, "http://c.example", HTML), (None, "u", HTML),
    (1, "http://d.example", None), (2, "http://e.example", ""), (4, "http://f.example", "short"), (6, "http://g.example", "short"),
    (7, "http://h.example/é", "é" * 90_000), (8, "http://i.example", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9),
]


def archive(spark, rows, name, **sizes):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).withColumns(
        {c: F.lit(1) for c in ("digest", "shard", "payload", "original")})
    folder = work_path(spark, name)
    return folder, warc.write_warc(frame, folder, **sizes)


def test_warc_round_trip(spark):
    folder, files = archive(spark, PAGES, "warc", shard_bytes=60_000, file_bytes=300)
    assert files.count() > 3 and files.where("temporary is not null").count() == 0 if "temporary" in files.columns else True
    got = warc.read_warc(spark, folder).collect()
    assert len(got) == len(PAGES)
    want = Counter()
    for page, _, html in PAGES:
        data = (html or "").encode()
        least = 3 if html == HTML else None
        revisit = least is not None and page != least
        want[(page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", least if revisit else None, None if revisit else data)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want


def test_warc_is_deterministic_and_sorted(spark):
    digests = []
    for turn in range(2):
        folder, files = archive(spark, PAGES[::-1] if turn else PAGES, f"warc{turn}", shard_bytes=60_000, file_bytes=300)
        names = sorted(r.name for r in files.collect())
        local = folder.removeprefix("file://")
        whole = [gzip.open(f"{local}/{n}").read() for n in names]
        digests.append([hashlib.sha256(w).hexdigest() for w in whole])
        ids = [int(line.split(b": ")[1]) for w in whole for line in w.split(b"\r\n") if line.startswith(b"X-Page-Id: ") and line != b"X-Page-Id: "]
        assert ids == sorted(ids)
        assert all(w.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for w in whole)
    assert digests[0] == digests[1]


def test_warc_ignores_files_without_commit(spark):
    folder, _ = archive(spark, PAGES[:3], "stray")
    with open(f"{folder.removeprefix('file://')}/part-000099-00000.warc.gz", "wb") as stray:
        stray.write(b"not finished")
    assert warc.read_warc(spark, folder).count() == 3


def test_warc_empty(spark):
    folder, files = archive(spark, [], "empty")
    assert files.count() == 0 and warc.read_warc(spark, folder).count() == 0


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a</s>b"), (1, 1, "assistant", "A"), (2, None, None, None), (2, 5, "user", "<s>[INST] x [/INST]"),
    (3, 0, "assistant", "<~/s> <~~/s> [~INST]"), (3, 1, "we[/INST]ird </s>", "<"), (3, 2, "assistant", "</s"), (3, 3, "assistant", ""),
    (None, 0, "user", "no id"), (4, 0, "assistant", "é日\n" * 20_000), (4, 1, "assistant", "[/INST]"), (5, 0, "user", "same"), (5, 0, "user", "same"),
    (6, 0, "<", "s>x"), (6, 1, "a [/INST", "$1 \\ $"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("rendered", "start", "fits")})
    got = chat.format_chats(rows)
    read = got.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = {}
    for conv, turn, role, text in sorted(TURNS, key=lambda t: (t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert len(read) == len(want)
    for r in read:
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.loss == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert r.formatted.count("</s>") == len(want[r.conv_id]) == r.formatted.count("[INST]")


def test_chat_grammar(spark):
    bad = ["x", "<s>[INST] a [/INST]b", "<s>[INST] a [/INST]b[INST]</s>", "<s>[INST] a</s>"]
    rows = spark.createDataFrame([(b,) for b in bad], "f string")
    assert rows.where(chat.parse(F.col("f")).isNotNull()).count() == 0


def test_chat_empty_and_native(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(rows).count() == 0
    frame = QUERIES["op4_chat_format"](spark, "/root/testdata/sf0.001")
    assert not any(word in frame._jdf.queryExecution().toString() for word in ("Python", "Pandas", "Arrow"))
    assert frame.where("conv_id = -7").first().n_turns == 2
