"""The pipeline on nulls, repeated rows, clashing columns and empty tables."""

import brute
import pytest
from conftest import LONG, SCHEMA
from pyspark.sql import functions as F

from verimet.session import work_path

corpus_pipeline = pytest.importorskip("corpus_pipeline")

GOOD = " ".join(f"plain{i % 37} sentence{i % 11} about weather{i}" for i in range(60)) + "."
CLASH = ("rep", "s", "size", "n_hit", "key", "cut", "score", "kept", "shard", "tie", "copies", "comp", "__kept", "at")


def folder(spark, rows, name, labels=True):
    path = work_path(spark, name)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in CLASH})
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    given = [(1, 1, 0), (2, 0, 1), (3, 1, 0), (None, 1, 0), (4, None, None)] if labels else []
    spark.createDataFrame(given, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, " ".join(f"bench{i}" for i in range(14))), (2, None), (None, "x")] if labels else []
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def odd_rows():
    rows = [(k, f"{GOOD} number {k} " + " ".join(f"own{k}x{i}" for i in range(90)), ["en", None, "de"][k % 3], ["a", None, "b"][k % 3], k or None) for k in range(12)]
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, " \n\t ", "en", "a", 3), (None, rows[0][1] + " more", "en", "a", 1), (None, None, None, None, None)]
    rows += [rows[3], rows[3], (3, rows[5][1].replace("own", "other"), "en", None, 2), (103, LONG, "en", "c", 5)]
    dirty = "and " + " ".join(f"bench{i}" for i in range(14)) + " so"
    return [*rows, (104, rows[1][1].replace("own1x5", "changed"), "en", "b", 1), (105, f"{GOOD} {dirty} " + " ".join(f"q{i}" for i in range(80)), "en", "a", 1)]


def test_odd_rows(spark):
    path, rows = folder(spark, odd_rows(), "odd-pipeline"), odd_rows()
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, path)
        out = work_path(spark, name)
        made.write.parquet(out)
        docs = spark.read.parquet(out)
        assert name == "tokens" or docs.columns == columns
        kept.append(docs.collect())
    given = [r[:2] for r in rows]
    good, single, clean, mixed, tokens = kept
    assert not [r for r in good if not (r.text or "").split()] and {(r.doc_id, r.text) for r in good} <= set(given)
    assert 104 not in {r.doc_id for r in single} or 1 not in {r.doc_id for r in single}
    assert {r.doc_id for r in single} <= {r.doc_id for r in good}
    assert not any(brute.contamination([(r.doc_id, r.text)], [(1, " ".join(f"bench{i}" for i in range(14)))])[0][5] for r in clean)
    assert {r.doc_id for r in clean} == {r.doc_id for r in single} - {105}
    assert {(r.doc_id, r.text) for r in mixed} <= {(r.doc_id, r.text) for r in clean}
    assert len(tokens) == len(mixed) and sorted(str(r.doc_id) for r in tokens) == sorted(str(r.doc_id) for r in mixed)


def test_run_on_odd_and_empty_tables(spark):
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert corpus_pipeline.run(spark, folder(spark, odd_rows(), "odd-run")).columns == names
    for rows, labels in (([], True), ([], False), (odd_rows(), False)):
        found = corpus_pipeline.run(spark, folder(spark, rows, "bare-run", labels))
        assert found.columns == names and found.count() == (0 if not rows else found.count())
