"""Benchmark decontamination with suffix arrays of the training texts.

Each task cuts its documents into shards of some megabytes and sorts a shard's word
suffixes.  The suffixes of the benchmark items, sorted themselves, are searched in every shard by
bisection: the neighbours of a suffix share its longest verbatim match, and the first words of a
window give the range of all its places.  Only what can match is looked at: a shard's suffixes that
start with two words which follow each other in an item, and the items' suffixes that start with two
words of the shard; matches of a single word need no array.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verimet.llm.common import ALNUM, Words, annotate, stored

WINDOW = 10
#: Benchmark characters that a task holds in memory; larger benchmarks take several passes, one after the other.
BLOCK_CHARS = 8_000_000
#: Bytes of training text in one shard.
SHARD = 2 << 20
FIELDS = [("__n_words", "long"), ("__spans", "array<struct<start:int,end:int>>"), ("__items", "array<long>"), ("__longest", "long")]


class Queries:
    """All suffixes of the items in order, and those that hold a whole window, as word numbers (0 ends an item)."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW) -> None:
        words = Words(pa.array([text for _, text in items], pa.string()), ALNUM)
        hashes = words.hashes()
        self.hashes, first, self_ids = np.unique(hashes, return_index=True, return_inverse=True)
        self.words = [words.low[words.starts[i]:words.ends[i]].tobytes() for i in first]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.item_ids = np.array([i for i, _ in items], np.int64)
        seq, starts, need, item = [], [], [], []
        at = 0
        for i, n in enumerate(words.counts):
            seq += [self_ids[words.of[i]:words.of[i] + n] + 1, [0]]
            w = min(window, n)
            if n:
                starts.append(np.arange(at, at + n - w + 1))
                need.append(np.full(n - w + 1, w))
                item.append(np.full(n - w + 1, i))
            at += n + 1
        empty = [np.zeros(0, np.int64)]
        self.deepest = int(words.counts.max(initial=0))
        self.seq = np.concatenate([*seq, np.zeros(self.deepest + 1, np.int64)]).astype(np.int64) if seq else np.zeros(1, np.int64)
        self.starts, self.need, self.item = (np.concatenate(x or empty).astype(np.int64) for x in (starts, need, item))
        v = self.base = len(self.hashes) + 1
        self.bits = max(1, int(v).bit_length())
        # windows by their first pair of words (a single word and 0 for items of one word)
        a, b = self.seq[self.starts], self.seq[self.starts + 1]
        self.window_pairs = np.where(self.need > 1, a * v + b, a * v)
        order = np.argsort(self.window_pairs, kind="stable")
        self.starts, self.need, self.item, self.window_pairs = (x[order] for x in (self.starts, self.need, self.item, self.window_pairs))
        self.singles = bool((self.need == 1).any())
        # all suffixes in order
        self.tails = suffix_array(self.seq, np.flatnonzero(self.seq > 0), self.deepest, self.bits)
        self.tail_pairs = self.seq[self.tails] * v + self.seq[self.tails + 1]
        self.pairs = np.union1d(self.window_pairs, self.tail_pairs[self.tail_pairs % v > 0])

    def number(self, words: Words) -> np.ndarray:
        """Number of each word, 0 if no item has it."""
        if not len(self.hashes) or not len(words.starts):
            return np.zeros(len(words.starts), np.int64)
        found = words.hashes()
        spot = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        same = (self.hashes[spot] == found) & (self.sizes[spot] == words.ends - words.starts)
        return np.where(same, spot + 1, 0)


def suffix_array(text: np.ndarray, starts: np.ndarray, deepest: int, bits: int) -> np.ndarray:
    """`starts` in the order of the suffixes of `text` up to `deepest` words; 0 ends a suffix.

    Some words at a time are packed into one key; only suffixes that are still tied go on.
    """
    at_once = max(1, 62 // bits)

    def key(of):
        packed, alive = np.zeros(len(of), np.int64), np.ones(len(of), bool)
        for k in range(at_once):
            x = text[of + k]
            alive &= x > 0
            packed = (packed << bits) | np.where(alive, x, 0)
        return packed, alive

    packed, alive = key(starts)
    order = np.argsort(packed, kind="stable")
    array, packed, alive = starts[order], packed[order], alive[order]
    group = np.concatenate([[0], np.cumsum(packed[1:] != packed[:-1])]) if len(array) else np.zeros(0, np.int64)
    open_ = np.arange(len(array))
    for depth in range(at_once, deepest, at_once):
        tied = np.zeros(len(open_), bool)
        same = (group[1:] == group[:-1]) & alive[1:]
        tied[1:] |= same
        tied[:-1] |= same
        open_, group = open_[tied], group[tied]
        if not len(open_):
            break
        packed, alive = key(array[open_] + depth)
        order = np.lexsort((packed, group))
        array[open_] = array[open_][order]
        packed, alive, group = packed[order], alive[order], group[order]
        group = np.concatenate([[0], np.cumsum((packed[1:] != packed[:-1]) | (group[1:] != group[:-1]))])
    return array


def _compare(text, places, seq, starts, need):
    """Sign of (suffix of the text at places) - (first `need` words at starts), and common words."""
    sign, common = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    left, k = np.flatnonzero(need > 0), 0
    while len(left):
        x, y = text[places[left] + k], seq[starts[left] + k]
        same = (x == y) & (y > 0)
        differ = left[~same]
        sign[differ] = np.sign(x[~same] - y[~same])
        common[left[same]] += 1
        k += 1
        left = left[same]
        left = left[need[left] > k]
    return sign, common


def bisect(text, array, seq, starts, need, after: bool) -> np.ndarray:
    """For each query the first place of the array that isn't below it (or is above it)."""
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(array), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        sign, _ = _compare(text, array[mid], seq, starts[open_], need[open_])
        down = sign <= 0 if after else sign < 0
        lo[open_[down]] = mid[down] + 1
        hi[open_[~down]] = mid[~down]
    return lo


def search(texts: pa.Array, queries: Queries) -> list[pa.Array]:
    """For each text: words, hit word spans, items found, longest match in words."""
    words = Words(texts, ALNUM)
    docs = np.repeat(np.arange(len(texts)), words.counts)
    place = np.arange(len(docs)) + docs  # one 0 between texts
    size = len(docs) + len(texts) + queries.deepest + 64
    text = np.zeros(size, np.int64)
    text[place] = queries.number(words)
    hits, found, longest = _matches(text, place, docs, words, queries)
    return [pa.array(words.counts, pa.int64()), _spans(hits, docs, words), _items(found, len(texts)), pa.array(longest, pa.int64())]


def _matches(text, place, docs, words, queries):
    n = int(docs[-1]) + 1 if len(docs) else 0
    longest = np.zeros(len(words.counts), np.int64)
    none = np.zeros(len(place), bool), (np.zeros(0, np.int64), np.zeros(0, np.int64)), longest
    if not len(queries.starts) or not n:
        return none
    v = queries.base
    head = place[text[place] > 0]
    longest[docs[text[place] > 0]] = 1
    single = text[head] * v
    pair = single + text[head + 1]
    known = _within(queries.pairs, pair)
    if queries.singles:
        known |= _within(queries.pairs, single)
    array = suffix_array(text, head[known], queries.deepest, queries.bits)
    if not len(array):
        return none
    seen = np.unique(np.concatenate([pair[known], single[known]]) if queries.singles else pair[known])
    _longest(text, array, place, docs, queries, seen, longest)
    asked = _ranges(queries.window_pairs, seen)
    lo, hi = (bisect(text, array, queries.seq, queries.starts[asked], queries.need[asked], after) for after in (False, True))
    some = np.flatnonzero(hi > lo)
    if not len(some):
        return none
    count = hi[some] - lo[some]
    query = np.repeat(asked[some], count)
    spot = array[np.repeat(lo[some], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    need = queries.need[query]
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, spot, 1)
    np.add.at(edge, spot + need, -1)
    hit = np.cumsum(edge)[place] > 0
    wrong = [p for p in np.flatnonzero(hit) if words.low[words.starts[p]:words.ends[p]].tobytes() != queries.words[text[place[p]] - 1]]
    if wrong:  # a word of another spelling with the same hash
        text[place[wrong]] = 0
        return _matches(text, place, docs, words, queries)
    doc = docs[np.searchsorted(place, spot)]
    pairs = np.unique(doc * (len(queries.item_ids) + 1) + queries.item[query])
    return hit, (pairs // (len(queries.item_ids) + 1), queries.item_ids[pairs % (len(queries.item_ids) + 1)]), longest


def _longest(text, array, place, docs, queries, seen, longest) -> None:
    """Raise `longest` to the words that a document shares in a row with an item.

    Of all items' suffixes, the two next to a suffix of the shard in common order share most with it.
    """
    tails = queries.tails[_ranges(queries.tail_pairs, seen)]
    if not len(tails):
        return
    whole = lambda n: np.full(n, queries.deepest, np.int64)
    at = bisect(text, array, queries.seq, tails, whole(len(tails)), False)
    before = np.searchsorted(at, np.arange(len(array)), "right") - 1
    doc = docs[np.searchsorted(place, array)]
    for near in (before, before + 1):
        some = np.flatnonzero((near >= 0) & (near < len(tails)))
        _, common = _compare(text, array[some], queries.seq, tails[near[some]], whole(len(some)))
        np.maximum.at(longest, doc[some], common)


def _ranges(sorted_values, wanted) -> np.ndarray:
    """Places in `sorted_values` of all values that are among the sorted `wanted` ones, ascending."""
    low, high = (np.searchsorted(sorted_values, wanted, side) for side in ("left", "right"))
    size = high - low
    return np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _within(sorted_values, values):
    spot = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[spot] == values


def _spans(hit, docs, words) -> pa.Array:
    """Runs of hit words within each text, counted from the text's first word."""
    first = np.zeros(len(hit) + 1, bool)
    first[words.of] = True
    first = first[:-1] if len(hit) else first[:0]
    start = np.flatnonzero(hit & (np.concatenate([[True], ~hit[:-1]]) | first)) if len(hit) else np.zeros(0, np.int64)
    last = np.flatnonzero(hit & np.concatenate([~hit[1:] | first[1:], [True]])) if len(hit) else np.zeros(0, np.int64)
    of = np.concatenate([[0], np.cumsum(np.bincount(docs[start], minlength=len(words.counts)))]) if len(hit) else np.zeros(len(words.counts) + 1)
    base = words.of[docs[start]] if len(hit) else 0
    spans = pa.StructArray.from_arrays([pa.array(start - base, pa.int32()), pa.array(last + 1 - base, pa.int32())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(of, pa.int32()), spans)


def _items(found, n) -> pa.Array:
    doc, item = found
    of = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]) if n else np.zeros(1)
    return pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(item, pa.int64()))


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Columns `keep` of `docs` with __n_words, __spans, __items and __longest; nothing is shuffled with one block.

    The benchmark is read in blocks of about `block_chars` characters.  Usually there is one: it is broadcast, and the
    documents pass by it.  With more, the documents are written once with a row number, each block is a pass over
    their texts of its own, and the results are put together by row number; no task holds two blocks.
    __longest is the number of words in the longest verbatim match, from one word on.

    Cases: null text has no words; an item without words or id has no windows; items that share a
    window are all named; repeated items are named once; documents may repeat; no rows
    give no rows; an empty benchmark hits nothing; further columns are kept as they are.
    """
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    keep = docs.columns if keep is None else keep

    def block(k: int):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text")
        return docs.sparkSession.sparkContext.broadcast(Queries([(r.item_id, r.text) for r in part.collect()], window))

    def passed(rows: DataFrame, held, columns: list[str]) -> DataFrame:
        return annotate(rows, "text", FIELDS, lambda texts: search(texts, held.value), columns, piece=SHARD, join=True)

    if blocks == 1:
        return passed(docs, block(0), keep)
    text = [] if "text" in keep else ["text"]
    numbered = stored(docs.select(*keep, *text).withColumn("__row", F.monotonically_increasing_id()), "numbered-docs")
    found = []
    for k in range(blocks):
        held = block(k)
        found.append(stored(passed(numbered.select("__row", "text"), held, ["__row"]), f"block-{k}"))
        held.destroy()
    together = reduce(DataFrame.unionByName, found).groupBy("__row").agg(
        F.max("__n_words").alias("__n_words"), F.flatten(F.collect_list("__spans")).alias("__spans"),
        F.array_distinct(F.flatten(F.collect_list("__items"))).alias("__items"), F.max("__longest").alias("__longest"))
    return numbered.join(together, "__row").select(*keep, *(n for n, _ in FIELDS))


def hit_words(spans):
    """Words inside any span; spans of several passes may overlap."""
    ordered = F.array_sort(spans)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))

    def add(state, s):
        low = F.greatest(state["upto"], s["start"])
        return F.struct((state["n"] + F.greatest(s["end"] - low, F.lit(0))).cast("long").alias("n"), F.greatest(state["upto"], s["end"]).alias("upto"))

    return F.aggregate(ordered, start, add, lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, longest, contaminated; one row per row of `docs`."""
    found = scan(docs.select("doc_id", "text"), benchmark, ["doc_id"], window)
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), hit_words(F.col("__spans")).alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"), F.col("__items").alias("items"), F.col("__spans").alias("spans"),
        F.col("__longest").alias("longest"), (F.size("__items") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without the documents that hold a window of the benchmark."""
    return scan(docs, benchmark, None, window).where(F.size("__items") == 0).select(*docs.columns)
