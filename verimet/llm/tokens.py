"""Token files: ids of a public tokenizer in ORC, ordered by document id.

ORC packs the ids with integer run-length encoding, keeps row indexes and Bloom filters on
doc_id, and its stripes are read in parallel; a filter on doc_id skips files, stripes and row groups.
"""

from __future__ import annotations

import re
import sys
import types
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verimet.llm.common import TIES, mix, powers, range_of, range_splits, regrouped, stored, trim

END = 2
FILE = "shard int, doc_id long, at long, ids array<int>"
BACK = "shard int, doc_id long, at long, n_tokens long, ids_crc32 long"


BLANK, LETTER, NUMBER, OTHER, BETWEEN = range(5)
#: Stands between texts; texts that hold it go to the tokenizer whole.
GAP = "\uffff"
#: Characters that are split at once (about 40 bytes each).
CHARS = 1 << 20
SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def _kinds() -> np.ndarray:
    """Kind of every character the splitting rule is written out for: those below U+0250 and U+2000 to U+20CF."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in (*range(0x250), *range(0x2000, 0x20D0)):
        category = unicodedata.category(chr(c))
        if chr(c) in "\t\n\v\f\r\x85" or category in ("Zs", "Zl", "Zp"):
            kinds[c] = BLANK
        elif category[0] in "LN":
            kinds[c] = LETTER if category[0] == "L" else NUMBER
    kinds[ord(GAP)] = BETWEEN
    return kinds


class Pieces:
    """Pieces of many texts by the byte-level vocabulary's rule, found for all characters at once.

    A piece is a run of letters, of numbers or of others, with one space in front if there is one; what is left of
    a run of blanks is a piece, and its last blank is one of its own if it is no space. An apostrophe that
    stands alone takes s, t, m, d, re, ve or ll behind it. Piece i of the joined texts is `starts[i]:ends[i]`, text
    k has pieces `of[k]:of[k + 1]`, and `hashes` tells pieces apart.
    """

    def __init__(self, texts: list[str], kinds: np.ndarray) -> None:
        self.chars = chars = np.frombuffer((GAP.join(texts) + GAP * 4).encode("utf-32-le"), "<u4")
        kind = kinds[chars]
        new = np.ones(len(chars), bool)
        new[1:] = kind[1:] != kind[:-1]
        run = np.flatnonzero(new)
        # runs of blanks that something follows: the last one goes with it, or stands alone
        after = run[1:][(kind[run[:-1]] == BLANK) & (kind[run[1:]] != BETWEEN)]
        new[after - 1] = True
        new[after[chars[after - 1] == 32]] = False
        # contractions
        single = run[:-1][(np.diff(run) == 1) & (chars[run[:-1]] == 39)]
        single = single[new[single]]
        first, second = chars[single + 1], chars[single + 2]
        short = np.isin(first, [ord(c) for c in "stmd"])
        long = ~short & np.isin(first.astype(np.int64) << 32 | second, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
        new[single[short | long] + 1] = False
        new[single[short] + 2] = True
        new[single[long] + 3] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(chars))
        inside = kind[starts] != BETWEEN
        self.starts, self.ends = starts[inside], ends[inside]
        self.kind = kind
        gaps = np.flatnonzero(kind == BETWEEN)[:len(texts)]
        self.of = np.concatenate([[0], np.searchsorted(self.starts, gaps)])
        up, down = powers(len(chars) + 1)
        total = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[:len(chars)], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def text(self, some: np.ndarray) -> str:
        """Pieces behind each other."""
        starts, sizes = self.starts[some], self.ends[some] - self.starts[some]
        before = np.cumsum(sizes) - sizes
        return self.chars[np.repeat(starts - before, sizes) + np.arange(sizes.sum())].tobytes().decode("utf-32-le")

    def words(self, some: np.ndarray) -> np.ndarray:
        """Which pieces are a space and letters."""
        starts = self.starts[some]
        return (self.chars[starts] == 32) & (self.kind[starts + 1] == LETTER) & (self.ends[some] - starts > 1)


class Known:
    """Hashes and their numbers, in two sorted tables: a large one, and a small one for what is new."""

    def __init__(self) -> None:
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2

    def __len__(self) -> int:
        return sum(len(hashes) for hashes, _ in self.tables)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the hashes, -1 for unknown ones."""
        numbers = np.full(len(hashes), -1, np.int64)
        for known, number in self.tables:
            if len(known):
                spot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                found = known[spot] == hashes
                numbers[found] = number[spot[found]]
        return numbers

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        large, small = self.tables
        order = np.argsort(hashes)
        small = self._merged(small, (hashes[order], numbers[order]))
        if len(small[0]) > max(50_000, len(large[0]) // 4):
            large, small = self._merged(large, small), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.tables = [large, small]

    @staticmethod
    def _merged(a, b):
        """Table `a` with the sorted rows of `b`."""
        at = np.searchsorted(a[0], b[0])
        return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])


class Growing:
    """An array that grows at its end, with room to spare."""

    def __init__(self, kind) -> None:
        self.room, self.size = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.room):
            self.room = np.concatenate([self.room[:self.size], np.zeros(need + need // 2 - self.size, self.room.dtype)])
        self.room[self.size:need] = values
        self.size = need

    def cut(self, size: int) -> None:
        self.size = size


def _parts(text: str) -> list[str]:
    """A long text cut where a piece begins for certain: before a space between two ASCII letters or digits."""
    parts, at = [], 0
    while len(text) - at > 2 * CHARS and (cut := SAFE.search(text, at + CHARS)):
        parts.append(text[at:cut.start()])
        at = cut.start()
    return [*parts, text[at:]]


class Encoder:
    """Ids of whole texts as little-endian 32-bit integers.

    The tokenizer treats the pieces of its splitting rule one by one, so a piece is given to it once
    and remembered; texts with other characters than the rule above covers, or with the content
    of an added token such as <|endoftext|>, go to it whole.
    New pieces of a space and letters go to it behind each other: only the first id of such a
    piece stands for a string that begins with a space, so the ids can be told apart.
    Pieces are known by a 64-bit hash. The ids of all lie in one array; a batch numbers its pieces by dictionary
    encoding, looks up each different one once, and takes the ids of all by their places in that array.
    """

    def __init__(self, path: str, memory: int = 1_000_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.kinds, self.rare = _kinds(), re.compile("[^\0-\u024f\u2000-\u20cf]")
        self.memory = memory
        self.known = Known()
        self.ids, self.starts, self.sizes = Growing("<u4"), Growing(np.int64), Growing(np.int64)
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("\u0120")

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: Pieces, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The new pieces in another order, the ids of all behind each other, and how many belong to each."""
        is_word = pieces.words(new)
        words, rest = new[is_word], new[~is_word]
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        if len(words):
            ids += self._encode([pieces.text(words)])
            first = np.flatnonzero(self.opens[ids[-1]])
            if len(first) != len(words):
                raise ValueError("the vocabulary doesn't keep words apart")
            sizes.append(np.diff(first, append=len(ids[-1])))
        if len(rest):
            text, ends = pieces.text(rest), np.cumsum(pieces.ends[rest] - pieces.starts[rest]).tolist()
            found = self._encode([text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])
            ids += found
            sizes.append(np.array([len(f) for f in found], np.int64))
        return np.concatenate([words, rest]), np.concatenate(ids), np.concatenate(sizes)

    def _numbers(self, pieces: Pieces, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Numbers of the different pieces of a batch: piece `at[i]` has `hashes[i]`."""
        numbers = self.known.find(hashes)
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            order, ids, sizes = self._learn(pieces, at[fresh])
            new = self.starts.size + np.arange(len(order))
            self.starts.add(self.ids.size + np.cumsum(sizes) - sizes)
            self.sizes.add(sizes)
            self.ids.add(ids)
            numbers[np.searchsorted(at, order)] = new  # `at` ascends
            if len(self.known) < self.memory:
                self.known.add(hashes[fresh], numbers[fresh])
        return numbers

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        odd = [i for i, t in enumerate(texts) if self.rare.search(t) or any(a in t for a in self.added)]
        for i, ids in zip(odd, self._encode([texts[i] for i in odd]) if odd else [], strict=True):
            out[i] = ids.tobytes()
        plain = [i for i in range(len(texts)) if out[i] is None]
        parts = [_parts(texts[i]) for i in plain]
        flat = [p for of in parts for p in of]
        ids = self._joined(flat)
        for i, mine, at in zip(plain, parts, np.cumsum([0, *map(len, parts)]).tolist(), strict=False):
            out[i] = b"".join(ids[at:at + len(mine)])
        return out

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that the splitting rule covers, of about CHARS characters at once."""
        out, at = [], 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHARS):
                size += len(texts[stop])
                stop += 1
            out += self._together(texts[at:stop])
            at = stop
        return out

    def _together(self, texts: list[str]) -> list[bytes]:
        pieces = Pieces(texts, self.kinds)
        coded = pa.array(pieces.hashes).dictionary_encode()
        codes = coded.indices.to_numpy()
        seen = np.maximum.accumulate(codes) if len(codes) else codes
        first = np.flatnonzero(np.diff(seen, prepend=-1) > 0)  # the dictionary is in order of first use
        kept = self.starts.size, self.ids.size, len(self.known)
        numbers = self._numbers(pieces, coded.dictionary.to_numpy(), first)[codes]
        counts = self.sizes.room[numbers]
        ends = np.concatenate([[0], np.cumsum(counts)])
        taken = self.ids.room[np.repeat(self.starts.room[numbers] - ends[:-1], counts) + np.arange(ends[-1])].tobytes()
        if kept[2] >= self.memory:  # beyond the memory pieces are learnt for this batch alone; the first, frequent ones stay
            self.starts.cut(kept[0])
            self.sizes.cut(kept[0])
            self.ids.cut(kept[1])
        borders = (4 * ends[pieces.of]).tolist()
        return [taken[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)]


def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    kept = sys.modules.setdefault("_verimet_worker", types.ModuleType("_verimet_worker"))
    if not hasattr(kept, "encoders"):
        kept.encoders = {}
    if path not in kept.encoders:
        kept.encoders[path] = Encoder(path)
    return kept.encoders[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = END, shard_bytes: int = 256 << 20, stripe_bytes: int = 8 << 20) -> None:
    """Write the ids of `docs` (doc_id, text) to ORC files in `folder`, in ascending doc_id order.

    Shard borders follow from the rows; shard k is file k, sorted by doc_id, then text.  A doc_id whose rows
    outweigh a shard goes on in the next ones, by a hash of the text.  `at` counts the ids before a document in its shard.
    Texts travel once, ids never.

    Cases: null and empty texts have the end id alone; rows with the same doc_id stand behind each other;
    a null doc_id comes first; no rows give no files with rows; further columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.pmod(F.xxhash64("text"), F.lit(TIES)).cast("int"))
    cuts = range_splits(rows.select("doc_id", "tie", F.octet_length("text").alias("w")), "doc_id", "w", shard_bytes, "tie")
    rows = rows.withColumn("shard", range_of("doc_id", cuts, "tie")).repartitionById(len(cuts) + 1, F.col("shard"))
    rows = rows.sortWithinPartitions("shard", "doc_id", "text").select("shard", "doc_id", "text")
    tail = np.array([end], "<u4").tobytes()

    def encode(batches):
        work, shard, at = encoder(tokenizer), None, 0
        for batch in regrouped(batches, 2, 1 << 20):
            ids = [data + tail for data in work(batch.column(2).to_pylist())]
            counts = np.array([len(data) // 4 for data in ids], np.int64)
            before = []
            for s, n in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
                shard, at = s, at if s == shard else 0
                before.append(at)
                at += n
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before, pa.int64()), lists], names=["shard", "doc_id", "at", "ids"])
        trim()

    (
        rows.mapInArrow(encode, FILE).write
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true")
        .option("orc.row.index.stride", "10000").option("orc.rows.between.memory.checks", "500").option("orc.stripe.size", str(stripe_bytes)).option("compression", "zstd").orc(folder)
    )


def read_tokens(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the token files; with `doc_ids`, a filter that reaches the files' statistics and Bloom filters."""
    rows = spark.read.schema(FILE).orc(folder)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_summary(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from the files.

    `start` is the number of ids before a document in the whole set: those of earlier shards
    (one number per shard) and those before it in its own.
    """

    def summed(batches):
        for batch in batches:
            ids = batch.column(3)
            of = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset:ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
            flat = ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(of[:-1], of[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(of), pa.int64()), pa.array(crc, pa.int64())],
                names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = stored(read_tokens(spark, folder).mapInArrow(summed, BACK), "token-counts")
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(shards), "shard").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
