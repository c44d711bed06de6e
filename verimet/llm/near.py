"""Near-duplicates by a multi-index join of MinHash signatures under a Hamming threshold.

A document's 64 MinHash values, 16 bits of each, make its signature.  Texts with similarity
s differ in about 64 * (1 - s) places.  Signatures are split into chunks, 13 for a similarity of
0.85 and 16 for 0.8: of two that differ in at most 25 or 31 places, some chunk differs in at
most one.  Each chunk is indexed once with each of its places left out (64 keys a
signature), so such pairs always share a key.  Every link is confirmed on the full shingle sets.

Copies of a set are folded to one representative first.  Each representative is first
compared with one other, the smallest member of the keys it shares most often (a star, not all
pairs); linked ones become one component.  Then the members of each key that still holds
several components meet with their sets in one task, which compares those of different
components, in the first key they share, and gives back links alone, never pairs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verimet.llm.common import SOLID, Words, annotate, mix, stored, trim

SHINGLE = 5
PLACES = 64
#: (least percent, chunks, radius), the tightest first; 2 * chunks - 1 differing places are what the chunks guarantee.
INDEXES = ((85, 13, 25), (80, 16, 31))
#: Members that are compared within one task; larger keys are cut into blocks.
TOGETHER = 2048
#: Ids whose broadcast is bounded by some tens of megabytes.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(6)
FACTORS = _rng.integers(0, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _rng.integers(0, 1 << 63, PLACES, dtype=np.uint64)
STEPS = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIGNED = [("__n", "long"), ("__h1", "long"), ("__h2", "long"), ("__sig", "array<smallint>")]
SETS = [*SIGNED[:3], ("__set", "array<long>")]
NAME = [n for n, _ in SIGNED[:3]]
SHORT_SETS = [*SIGNED[:3], ("__set", "array<int>")]


class Index(NamedTuple):
    """Borders of the chunks, and the differing places up to which pairs are looked at."""

    borders: np.ndarray
    radius: int

    @property
    def chunk_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.borders) - 1), np.diff(self.borders))


def index_for(percent: int) -> Index:
    """The index whose radius covers a similarity of `percent`."""
    for least, chunks, radius in INDEXES:
        if percent >= least:
            return Index(np.linspace(0, PLACES, chunks + 1).round().astype(int), radius)
    raise ValueError(f"percent is {percent}, but the index covers {INDEXES[-1][0]} and more")


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    words = Words(texts, SOLID)
    h = words.hashes()
    n = len(h)
    rolled = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, n)):
        rolled[:n - k] += h[k:] * STEPS[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(words.of[:-1], words.of[1:], strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a:b - SHINGLE + 1]))
        elif b > a:
            out.append(mix((h[a:b] * STEPS[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(found: np.ndarray) -> np.ndarray:
    least = np.full(PLACES, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), 2048):
        np.minimum(least, (found[at:at + 2048, None] * FACTORS + TERMS).min(axis=0), out=least)
    return (mix(least) >> np.uint64(48)).astype(np.uint16).view(np.int16)


def _names(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and two hashes of each whole set; together they name it."""
    one = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    two = np.array([mix(s + np.uint64(77)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    return [pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two)]


def sign(texts: pa.Array) -> list[pa.Array]:
    """Name of the set, signature."""
    sets = shingles(texts)
    places = np.concatenate([signature(s) for s in sets]) if sets else np.zeros(0, np.int16)
    of = np.arange(len(sets) + 1, dtype=np.int32) * PLACES
    return [*_names(sets), pa.ListArray.from_arrays(of, pa.array(places))]


def full_sets(texts: pa.Array) -> list[pa.Array]:
    sets = shingles(texts)
    of = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    return [*_names(sets), pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))]


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(-1, PLACES)


def short_sets(texts: pa.Array) -> list[pa.Array]:
    """Sets with 32 bits of each hash: they show at least the overlap of the full ones."""
    sets = shingles(texts)
    of = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    low = np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint32).view(np.int32)
    return [*_names(sets), pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(low))]


def index_keys(reps: DataFrame, index: Index) -> DataFrame:
    """(key, place, rep): for each chunk and each place in it, a hash of the chunk's other places."""
    borders, chunk_of = index.borders, index.chunk_of

    def run(batches):
        for batch in batches:
            ids, sig = batch.column(0), _matrix(batch.column(1)).astype(np.uint64)
            for left_out in range(PLACES):
                key = np.full(len(sig), left_out + 1, np.uint64)
                c = chunk_of[left_out]
                for p in range(borders[c], borders[c + 1]):
                    if p != left_out:
                        key = mix(key * FACTORS[p] + sig[:, p])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(np.full(len(sig), left_out), pa.int16()), ids], names=["key", "place", "rep"])
        trim()

    return reps.select("rep", "sig").mapInArrow(run, "key long, place smallint, rep long")


def _first_shared(a: np.ndarray, b: np.ndarray, index: Index) -> np.ndarray:
    """For pairs of signatures, the first place without which their chunks agree (they share that key)."""
    same, chunk_of = a == b, index.chunk_of
    agree = np.add.reduceat(same.astype(np.int8), index.borders[:-1], axis=1)[:, chunk_of] - same
    return (agree == np.diff(index.borders)[chunk_of] - 1).argmax(axis=1)


def _differing(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def _plausible(n1, n2, percent):
    """The larger set allows the needed overlap with the smaller one."""
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def links_in_group(rep, comp, n, place, sig, sets, of, percent: int, index: Index) -> list[tuple[int, int]]:
    """Links (indices) between members of different components of one group, enough to join them.

    Signatures rule out most pairs; the others are compared on their sets.  Members that a link has
    joined are not compared again.
    """
    code = np.unique(comp, return_inverse=True)[1]
    counts = np.bincount(code)
    if len(counts) == 1:
        return []
    links, mark = [], None
    ask = np.flatnonzero(code != counts.argmax())
    largest = code == counts.argmax()
    step = max(1, (1 << 23) // (len(rep) * PLACES))
    for at in range(0, len(ask), step):
        q = ask[at:at + step]
        near = (sig[q, None, :] != sig[None, :, :]).sum(axis=2, dtype=np.int16) <= index.radius
        near &= code[q, None] != code[None, :]
        near &= np.minimum(n[q, None], n[None, :]) * 100 >= np.maximum(n[q, None], n[None, :]) * percent
        near &= largest[None, :] | (rep[q, None] < rep[None, :])
        row, other = np.nonzero(near)
        mine = _first_shared(sig[q[row]], sig[other], index) == place
        row, other = row[mine], other[mine]
        if len(row) and mark is None:
            values, codes = np.unique(sets, return_inverse=True)
            mark = np.zeros(len(values), bool)
        edges = np.searchsorted(row, np.arange(len(q) + 1))
        for k in range(len(q)):
            i, them = q[k], other[edges[k]:edges[k + 1]]
            them = them[code[them] != code[i]]
            if not len(them):
                continue
            own = codes[of[i]:of[i + 1]]
            mark[own] = True
            sizes = of[them + 1] - of[them]
            ends = np.cumsum(sizes)
            spot = np.arange(ends[-1]) + np.repeat(of[them] - (ends - sizes), sizes)
            common = np.add.reduceat(mark[codes[spot]], ends - sizes, dtype=np.int64)
            mark[own] = False
            for j in them[common * 100 >= (n[i] + n[them] - common) * percent]:
                if code[j] != code[i]:
                    links.append((i, j))
                    code[code == code[j]] = code[i]
    return links


def cross_links(rows: DataFrame, percent: int, index: Index) -> DataFrame:
    """Links (a, b) between components inside groups; `rows`: group, place, rep, comp, n, sig, set."""

    def linked(group: pa.Table):
        rep, comp, n, place = (group.column(k).to_numpy() for k in ("rep", "comp", "n", "place"))
        lists = group.column("set").combine_chunks()
        of = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
        found = links_in_group(rep, comp, n, place[0], _matrix(group.column("sig")), lists.flatten().to_numpy(), of, percent, index)
        if not found:
            return None
        pairs = np.sort(np.array([(rep[i], rep[j]) for i, j in found], np.int64), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            keys = table.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (made := linked(table.slice(a, b - a))) is not None:
                    yield made
            rest = table.slice(cuts[-1])
        if rest is not None and rest.num_rows and (made := linked(rest)) is not None:
            yield made
        trim()

    rows = rows.select("group", "place", "rep", "comp", "n", "sig", "set")
    return rows.repartition("group").sortWithinPartitions("group", "rep").mapInArrow(run, "a long, b long").distinct()


def _rebuilt(docs: DataFrame, classes: DataFrame, reps: DataFrame, fields, step) -> DataFrame:
    """(rep, __set) of the classes in column rep, made once more from the text of a document that has the set."""
    asked = stored(classes.join(reps.select("rep").distinct(), "rep", "left_semi").select("rep", "doc", *NAME), "asked")
    ids = asked.select(F.col("doc").alias("__doc")).distinct()
    ids = F.broadcast(ids) if asked.count() <= BROADCAST_IDS else ids
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi")
    sets = annotate(texts, "text", fields, step, []).join(asked.select("rep", *NAME), NAME)
    return stored(sets.select("rep", "__set").dropDuplicates(["rep"]), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the similarity."""
    sets = _rebuilt(docs, classes, pairs.select(F.col("a").alias("rep")).union(pairs.select("b")), SETS, full_sets)
    first, second = (sets.select(F.col("rep").alias(k), F.col("__set").alias(f"set_{k}")) for k in ("a", "b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    both = pairs.join(second, "b").join(first, "a")
    return both.where(common * 100 >= (F.size("set_a") + F.size("set_b") - common) * percent).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(rep, comp): each node of an edge with the smallest node it can reach.

    Every round takes the least label among the neighbours, then the label's own label; the
    reach doubles, and each round is written so that no lineage grows.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("rep")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        seen = both.join(labels.select(F.col("rep").alias("b"), "comp"), "b").select(F.col("a").alias("rep"), "comp")
        least = labels.select("rep", "comp", F.col("comp").alias("old")).unionByName(seen, allowMissingColumns=True)
        least = least.groupBy("rep").agg(F.min("comp").alias("comp"), F.max("old").alias("old"))
        own = labels.select(F.col("rep").alias("comp"), F.col("comp").alias("next"))
        labels = stored(least.join(own, "comp", "left").select("rep", F.least("comp", F.coalesce("next", "comp")).alias("comp"), "old"), "labels")
        if labels.where("comp <> old").limit(1).count() == 0:
            return labels.select("rep", "comp")
        labels = labels.select("rep", "comp")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of `docs`.

    Documents are linked if 100 * common shingles >= percent * shingles of either; `percent`
    may be 80 or more, as the index is chosen for it: two texts at 85 differ in more than
    25 places with a probability of about 1 : 1,600,000, two at 80 in more than 31 with about
    1 : 12,000,000, closer ones far less often.

    Cases: a null text and one without words have no shingles and are linked with nothing; texts of one
    to four words are one shingle. Sets are linked, not ids: rows with a null doc_id link as others do, but never name a
    component (one of such rows alone has a null component_id, and all of them are kept); rows that repeat a doc_id with other
    texts may lie in other components; the order of the rows doesn't matter; no rows give no rows; further columns are ignored.
    """
    index = index_for(percent)
    signed = stored(annotate(docs.select("doc_id", "text"), "text", SIGNED, sign, ["doc_id"]), "signed")
    classes = stored(
        signed.where("__n > 0").groupBy("__h1", "__h2", "__n").agg(F.min("doc_id").alias("doc"), F.first("__sig").alias("sig")).withColumn(
            "id", F.monotonically_increasing_id()), "classes")
    # a number for each set, fixed once written, and small: row and partition of the id take turns
    part, row = F.shiftright("id", 33), F.col("id") % (1 << 33)
    parts = (classes.agg(F.max(part)).first()[0] or 0) + 1
    classes = classes.withColumn("rep", row * parts + part).drop("id")
    reps = classes.select("rep", F.col("__n").alias("n"), "sig")

    shared = index_keys(reps, index).groupBy("key").agg(
        F.min("rep").alias("leader"), F.count("*").alias("m"), F.first("place").alias("place"),
        F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("print"))
    # keys with the same members are one, the first of them
    shared = stored(shared.where("m > 1").groupBy("leader", "m", "print").agg(
        F.min_by("key", "place").alias("key"), F.min("place").alias("place"), F.count("*").alias("times")), "shared")
    members = stored(index_keys(reps, index).select("key", "rep").join(shared.drop("print"), "key"), "members")

    often = members.where("rep <> leader").groupBy("leader", "rep").agg(F.sum("times").alias("times"))
    stars = often.groupBy("rep").agg(F.max_by("leader", F.struct("times", -F.col("leader"))).alias("leader"))
    stars = stars.select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    sig_a, sig_b = (reps.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}")) for k in ("a", "b"))
    stars = stars.join(sig_b, "b").join(sig_a, "a").where(
        _plausible(F.col("n_a"), F.col("n_b"), percent) & (_differing(F.col("sig_a"), F.col("sig_b")) <= index.radius)).select("a", "b")
    edges = stored(confirmed(stored(stars, "stars"), docs, classes, percent), "links")
    labels = components(edges)

    placed = members.join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    placed = stored(placed.select("key", "place", "m", "rep", "comp"), "placed")
    open_ = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    rows = stored(placed.join(open_, "key"), "open")
    sets = _rebuilt(docs, classes, rows, SHORT_SETS, short_sets)
    rows = rows.join(reps.join(sets.withColumnRenamed("__set", "set"), "rep"), "rep")
    blocks = F.ceil(F.col("m") / TOGETHER).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    # a key of many members: by size (similar sets differ by one class at most), then by pairs of blocks
    level = F.floor(F.log("n") / float(np.log(100 / percent))).cast("long")
    rows = rows.withColumn("level", F.explode(F.when(blocks > 1, F.array(level, level + 1)).otherwise(F.array(F.lit(0).cast("long")))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    group = F.xxhash64("key", "level", F.least(mine, F.col("other")), F.greatest(mine, F.col("other")))
    more = stored(cross_links(rows.withColumn("group", group), percent, index), "more")
    if more.limit(1).count():
        labels = components(stored(edges.union(confirmed(more, docs, classes, percent)), "links"))

    linked = labels.join(classes.select("rep", "doc"), "rep")
    least = linked.groupBy("comp").agg(F.min("doc").alias("least"))
    named = classes.select("rep", *NAME, "doc").join(linked.select("rep", "comp").join(least, "comp"), "rep", "left")
    named = named.select(*NAME, F.coalesce("least", "doc").alias("component"))
    component = F.coalesce("component", "doc_id")
    return signed.drop("__sig").join(named, NAME, "left").select(
        "doc_id", F.col("__n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each component; rows that repeat a kept doc_id stay with it."""
    kept = near_duplicates(docs, percent).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi")
