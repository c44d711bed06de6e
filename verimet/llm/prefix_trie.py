"""Prefix trie of conversations by truncation peeling.

A conversation is a list of turns; every distinct list of first turns is a node.  A node's key is a
chained digest, so a whole sequence is known by its last key.  The peeling starts at the
greatest depth: sequences that end there meet the nodes that came from below, equal keys
merge, the merged rows are the nodes of that depth, and without their last turn they go on to the
depth above.  Each pass finds the nodes of one depth with all their sums.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verimet.llm.common import stored, table_at
from verimet.session import work_path

TURNS = "array<struct<digest:binary,size:bigint>>"
#: Key of the node without turns.
ROOT = hashlib.sha256(b"").digest()[:16]
EMPTY = hashlib.sha256(b"").hexdigest()
#: Depth up to which every sequence is peeled; below it only as deep as it shares its turns with others.
SHALLOW = 16
#: At most this many parents are handled as heavy ones, each with more than that part of all nodes as children.
HEAVY = 1000


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order of `turn` (null first), each as digest of role and text and code points of the text.

    Texts don't travel; 40 bytes a turn do.  Null roles and texts are empty; equal turn numbers go by digest;
    rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("size")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"], t["size"])).cast(TURNS).alias("turns"))


def paths(sequences: DataFrame) -> DataFrame:
    """conv_id, depth, the keys of all prefixes, the running code points, and the last key."""

    def chain(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            digests, sizes = lists.flatten().field("digest").to_pylist(), lists.flatten().field("size").to_pylist()
            keys, sums, last, depth, at = [], [], [], [], 0
            for n in (len(x) if x is not None else 0 for x in lists):
                key, total, own, run = ROOT, 0, [], []
                for k in range(at, at + n):
                    key = hashlib.sha256(key + digests[k]).digest()[:16]
                    total += sizes[k]
                    own.append(key)
                    run.append(total)
                at += n
                keys.append(own)
                sums.append(run)
                last.append(key)
                depth.append(n)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(depth, pa.int32()), pa.array(keys, pa.list_(pa.binary())), pa.array(sums, pa.list_(pa.int64())), pa.array(last, pa.binary())],
                names=["conv_id", "depth", "keys", "sums", "last"])

    return sequences.select("conv_id", "turns").mapInArrow(chain, "conv_id long, depth int, keys array<binary>, sums array<bigint>, last binary")


def ends(found: DataFrame) -> DataFrame:
    """last, ends_sha256: digest of the comma-joined ids that end at a key, ascending.

    Ids are joined in blocks of 65,536 neighbouring numbers, and a node's blocks stream
    through one digest, so a node on which a third of all conversations end isn't gathered either.
    """
    blocks = found.groupBy("last", F.shiftright("conv_id", 16).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for last, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if last == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = last, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names=["last", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["last", "ends_sha256"])

    ordered = blocks.repartition("last").sortWithinPartitions("last", "block").select("last", "ids")
    return ordered.mapInArrow(digest, "last binary, ends_sha256 string")


def _sequences(found: DataFrame) -> DataFrame:
    """One row per distinct sequence: its members, its keys, and `cut`, the depth where its peeling starts.

    Beyond SHALLOW a sequence that shares no key with another one at 16, 32, 64, ... turns is a bare path
    from there on; it needs no regrouping.
    """
    whole = found.groupBy("last").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("keys").alias("keys"), F.first("sums").alias("sums"))
    whole = stored(whole.join(ends(found), "last"), "trie-sequences")
    deepest = whole.agg(F.max("depth")).first()[0] or 0
    if deepest <= SHALLOW:
        return whole.withColumn("cut", F.col("depth"))
    marks = [SHALLOW << k for k in range(deepest.bit_length()) if SHALLOW << k < deepest]
    at = whole.where(F.col("depth") > SHALLOW).select(
        "last", "depth", "keys", F.explode(F.array(*map(F.lit, marks))).alias("mark")).where("mark < depth").select(
        "last", "mark", F.get("keys", F.col("mark") - 1).alias("key"))
    alone = at.groupBy("mark", "key").agg(F.count("*").alias("n"), F.min("last").alias("last")).where("n = 1").groupBy("last").agg(F.min("mark").alias("cut"))
    return whole.join(alone, "last", "left").withColumn("cut", F.coalesce("cut", "depth"))


def _size(sums: str, depth: Column) -> Column:
    """Code points of the turn at `depth`."""
    return F.get(sums, depth - 1) - F.coalesce(F.get(sums, depth - 2), F.lit(0))


def _paths_below(sequences: DataFrame) -> DataFrame:
    """Nodes beyond `cut` of sequences that are alone there."""
    total, before = F.get("sums", F.col("depth") - 1), F.coalesce(F.get("sums", F.col("d") - 2), F.lit(0))
    return sequences.where("cut < depth").withColumn("d", F.explode(F.sequence(F.col("cut") + 1, F.col("depth")))).select(
        F.get("keys", F.col("d") - 1).alias("key"), F.get("keys", F.col("d") - 2).alias("parent"), "conv_id", F.col("d").alias("depth"), "n_convs",
        F.when(F.col("d") < F.col("depth"), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * (total - before)).alias("saved_tokens"),
        F.when(F.col("d") == F.col("depth"), F.col("ends_sha256")).otherwise(EMPTY).alias("ends_sha256"))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """All nodes of the trie of `sequences` (conv_id, turns as by `turn_lists`).

    Returns key, parent (its key), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.  conv_id has to be unique.  There are as many passes as the deepest depth two different
    sequences share (rounded up to 16, 32, ...), whatever the longest one is.  Keys are 128-bit digests.

    Cases: a sequence without turns ends at the root; equal sequences are one path with more members; no
    sequences give no nodes, not even a root.
    """
    spark = sequences.sparkSession
    found = stored(paths(sequences), "trie-paths")
    starts = _sequences(found)
    below = stored(_paths_below(starts), "trie-paths-below")
    trimmed = F.col("cut") < F.col("depth")
    rest = F.get("sums", F.col("depth") - 1) - F.get("sums", F.col("cut") - 1)
    folder = work_path(spark, "trie-starts")
    starts.select(
        F.col("cut").alias("start"), F.slice("keys", 1, F.col("cut")).alias("keys"), F.slice("sums", 1, F.col("cut")).alias("sums"), "n_convs", "conv_id",
        F.when(trimmed, 1).otherwise(0).cast("long").alias("n_children"), F.when(trimmed, 1).otherwise(0).cast("long").alias("n_leaves"),
        F.when(trimmed, (F.col("n_convs") - 1) * rest).otherwise(0).alias("saved_tokens"), F.when(~trimmed, F.col("ends_sha256")).alias("ends_sha256"),
    ).write.partitionBy("start").parquet(folder)
    starts = table_at(spark, folder, "keys array<binary>, sums array<bigint>, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, start int")
    deepest = starts.agg(F.max("start")).first()[0]
    nodes, survivors = below, None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        rows = starts.where(F.col("start") == depth).drop("start")
        rows = rows.unionByName(survivors) if survivors is not None else rows
        key = F.get("keys", F.lit(depth - 1)) if depth else F.lit(ROOT)
        merged = rows.groupBy(key.alias("key")).agg(
            F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("below"),
            F.sum("saved_tokens").alias("saved"), F.max("ends_sha256").alias("ends"), F.first("keys").alias("keys"), F.first("sums").alias("sums"))
        size = _size("sums", F.lit(depth)) if depth else F.lit(0)  # the root has no text
        parent = F.get("keys", F.lit(depth - 2)) if depth > 1 else F.lit(ROOT) if depth else F.lit(None).cast("binary")
        level = stored(merged.select(
            "key", parent.alias("parent"), "conv_id", F.lit(depth).alias("depth"), "n_convs", "n_children",
            F.when(F.col("n_children") == 0, 1).otherwise(F.col("below")).cast("long").alias("n_leaves"),
            (F.col("saved") + (F.col("n_convs") - 1) * size).cast("long").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
            F.slice("keys", 1, max(depth - 1, 0)).alias("keys"), F.slice("sums", 1, max(depth - 1, 0)).alias("sums")), f"trie-depth-{depth}")
        nodes = nodes.unionByName(level.drop("keys", "sums"))
        survivors = level.select(
            "keys", "sums", "n_convs", "conv_id", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256"))
    return _with_parents(nodes)


def _with_parents(nodes: DataFrame) -> DataFrame:
    """The parent's smallest member by its key.

    A parent of more than a thousandth of all nodes is heavy; there are fewer than a thousand such, so they are
    broadcast and their many children stay where they are.
    """
    total = nodes.count()
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    heavy = parents.where(F.col("n_children") * HEAVY > total).drop("n_children")
    light = parents.where((F.col("n_children") * HEAVY <= total) & (F.col("n_children") > 0)).drop("n_children")
    children = nodes.join(F.broadcast(heavy), "parent", "left")
    columns = ["key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    settled = F.col("parent_conv_id").isNotNull() | (F.col("depth") == 0)
    return children.where(settled).select(columns).unionByName(children.where(~settled).drop("parent_conv_id").join(light, "parent", "left").select(columns))
