"""Token files: stripes, row indexes, Bloom filters, even shards."""

import glob

import numpy as np
import pytest
from pyarrow import orc
from pyspark.sql import functions as F

from verimet.llm import common, tokens, warc
from verimet.session import work_path


@pytest.fixture(scope="module")
def files(spark):
    """40,000 documents with even ids in one shard of several stripes."""
    import public_tokenizers

    rows = spark.range(40_000).select((F.col("id") * 2).alias("doc_id"), F.concat_ws(" ", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 256) for k in range(3)]).alias("text"))
    folder = work_path(spark, "striped")
    tokens.write_tokens(rows, folder, public_tokenizers.path("byte_bpe_50k.json"), shard_bytes=1 << 30, stripe_bytes=1 << 20)
    return folder


def scanned(frame):
    """Rows that left the scan, and rows that came out."""
    out = len(frame.collect())
    plan = frame._jdf.queryExecution().executedPlan()
    todo, found = [plan], []
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan"):
            found.append(node.metrics().apply("numOutputRows").value())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return sum(found), out


def test_stripes(files):
    names = [n for n in glob.glob(f"{files}/*.orc") if orc.ORCFile(n).nrows]
    assert len(names) == 1
    stored = orc.ORCFile(names[0])
    assert stored.nstripes > 3
    ids = [stored.read_stripe(i, ["doc_id"]).column(0).to_numpy() for i in range(stored.nstripes)]
    assert (np.concatenate(ids) == np.arange(0, 80_000, 2)).all()


def test_stripes_are_read_in_parallel(spark, files):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
        parts = tokens.read_tokens(spark, files).select(F.spark_partition_id().alias("p"), "doc_id").groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(parts) > 1 and sum(r["count"] for r in parts) == 40_000


def test_pruning(spark, files):
    """A present id costs a part of the rows; an absent one inside the range of its row group none, by the Bloom filters."""
    whole, _ = scanned(tokens.read_tokens(spark, files))
    some, found = scanned(tokens.read_tokens(spark, files, [40_000]))
    assert whole == 40_000 and found == 1 and 0 < some <= 10_000
    for absent in (40_001, 12_345, 79_997):
        assert scanned(tokens.read_tokens(spark, files, [absent])) == (0, 0)
    assert scanned(tokens.read_tokens(spark, files, [10**9])) == (0, 0)


def loads(spark, rows, target, tie=None):
    frame = spark.createDataFrame(rows, "k long, t int, w long").repartition(7)
    cuts = common.range_splits(frame, "k", "w", target, tie)
    placed = frame.withColumn("r", common.range_of("k", cuts, tie)).collect()
    assert cuts == sorted(cuts) == common.range_splits(frame.repartition(3), "k", "w", target, tie)
    order = sorted(placed, key=lambda r: (r.k is not None, r.k or 0, r.t))
    if tie:
        assert [r.r for r in order] == sorted(r.r for r in placed)
    sums = {}
    for r in placed:
        sums[r.r] = sums.get(r.r, 0) + r.w
    return sums


def test_ranges_follow_the_weights(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), 0, int(w)) for k, w in zip(rng.choice(10**6, 5000, replace=False), rng.pareto(1.2, 5000) * 100 + 1)]
    rows = [(k, t, min(w, 4000)) for k, t, w in rows]
    sums = loads(spark, rows, 20_000)
    assert max(sums.values()) <= 24_000 and len(sums) <= sum(r[2] for r in rows) // 20_000 + 1
    assert loads(spark, [], 10) == {}
    assert set(loads(spark, [(1, 0, 0), (None, 0, 0)], 10)) == {0}


def test_hot_keys_are_cut_by_their_tie(spark):
    """A third of all rows without a key, and a heavy key, are spread; other keys stay whole."""
    rng = np.random.default_rng(2)
    rows = [(None, int(t), 10) for t in rng.integers(0, common.TIES, 2000)] + [(5, int(t), 10) for t in rng.integers(0, common.TIES, 1500)]
    rows += [(int(k), int(rng.integers(0, common.TIES)), 10) for k in rng.integers(10, 300, 2500)]
    sums = loads(spark, rows, 2000, "t")
    assert max(sums.values()) <= 3000 and len(sums) > 20


def test_pages_without_id_are_spread(spark):
    rows = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).cast("long").alias("page_id"), F.lit("u").alias("url"),
        F.repeat(F.concat(F.lit("page "), (F.col("id") % 500).cast("string")), 60).alias("html"))
    folder = work_path(spark, "hot-warc")
    files = warc.write_warc(rows, folder, shard_bytes=20_000, file_bytes=1 << 20)
    assert files.count() > 8
    got = warc.read_warc(spark, folder)
    assert got.count() == 600 and got.where("page_id is null").count() == 200
    assert got.where("record_type = 'revisit' and page_id <= refers_to").count() == 0
