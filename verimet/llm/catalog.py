"""Queries of the numbered operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verimet.llm import chat, contamination, exact, language, merkle, mixing, near, prefix_trie, private_data, quality, secret_scan, tokens, warc
from verimet.llm.common import small_batches, stored, table
from verimet.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_warc", r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
FROM g
""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as WARC files and read back."""
    small_batches(spark, 256)
    out = work_path(spark, "warc")
    warc.write_warc(table(spark, folder, "pages"), out, shard_bytes=64 << 20, file_bytes=16 << 20)
    return warc.read_warc(spark, out, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Language of all documents."""
    small_batches(spark)
    docs = table(spark, folder, "documents")
    model = language.fit(docs.select("doc_id", "text", "lang"))
    found = language.identify(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select(
        "doc_id", language.held_out("doc_id").alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


@query("op3_suffix_decontamination")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages of ten words in all documents."""
    small_batches(spark)
    found = contamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op4_chat_format", r"""
WITH extra AS (
  SELECT * FROM (VALUES (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) t(conv_id, turn, role, text)
), turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM extra)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length('<s>[INST]  [/INST]</s>') + length(regexp_replace(role, '([<\[])(~*)(/?s>|/?INST\])', '\1~\2\3', 'g'))
      + length(regexp_replace(text, '([<\[])(~*)(/?s>|/?INST\])', '\1~\2\3', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one made of control strings; everything is read back from the formatted text."""
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    done = chat.format_chats(given.unionByName(extra))
    turns = chat.parse(F.col("formatted"))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    return done.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op5_cotrained_quality")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents."""
    small_batches(spark)
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op6_minhash_hamming")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicates among all documents."""
    small_batches(spark, 256)
    return near.near_duplicates(table(spark, folder, "documents"))


@query("op7_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM (SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, text_sha256 FROM d WINDOW g AS (PARTITION BY text_sha256))
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Exact duplicates after blanks are folded."""
    return exact.exact_duplicates(table(spark, folder, "documents"))


@query("op8_secret_scan")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in all documents."""
    small_batches(spark)
    found = secret_scan.find_secrets(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
    kinds = F.array(*(F.lit(r.kind) for r in secret_scan.BASE + secret_scan.MORE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("__spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("__spans", lambda s: s["kind"] < len(secret_scan.BASE))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans"))


@query("op9_token_orc")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as token ids in ORC files, read back."""
    import public_tokenizers

    small_batches(spark, 256)
    out = work_path(spark, "tokens")
    tokens.write_tokens(table(spark, folder, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"), shard_bytes=32 << 20)
    return tokens.token_summary(spark, out)


@query("op10_entropy_mix")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Documents mixed to the targets of their sources."""
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of an ASCII string, bit by bit."""
    bits = "lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))"
    return f"(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split({text}, '')]), {bits}))"


def _field(column: str, text: str | None = None) -> str:
    """SQL of a leaf's field."""
    return f"coalesce(octet_length(encode({text or column}::VARCHAR))::VARCHAR || ':' || {text or column}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c, text if c == "text" else None) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"


@query("op11_merkle_proofs", rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS t, {_leaf("text")} AS leaf,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS changed
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM docs
), nodes AS (
  SELECT t, 0 AS l, i, n, leaf AS d FROM leaves
  UNION ALL
  SELECT t, any_value(l) + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY t, i // 3
), tops AS (
  SELECT t, l AS h, d, row_number() OVER (ORDER BY encode(t)) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), over_all AS (
  SELECT 0 AS l, i, n, d FROM tops
  UNION ALL
  SELECT any_value(l) + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(d, '' ORDER BY i)) FROM over_all WHERE n > 1 GROUP BY i // 3
), all_nodes AS (SELECT t, l, i, n, d FROM nodes UNION ALL SELECT 't', l, i, n, d FROM over_all),
steps AS (
  SELECT a.t, a.l, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM all_nodes a JOIN all_nodes b ON a.t = b.t AND a.l = b.l AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.t, a.l, a.i
), walk AS (
  SELECT row_number() OVER () AS k, v.doc_id, v.leaf, v.changed AS folded, '' AS proof, v.t, 0 AS l, v.i, p.h, p.i AS place, p.d AS subroot, FALSE AS done
  FROM leaves v JOIN tops p ON p.t = v.t
  UNION ALL
  SELECT w.k, w.doc_id, w.leaf, CASE WHEN s.t IS NULL THEN w.folded ELSE sha256(s.before || w.folded || s.after) END,
    CASE WHEN s.t IS NULL THEN w.proof ELSE w.proof || s.before || s.after END, CASE WHEN s.t IS NULL THEN 't' ELSE w.t END,
    CASE WHEN s.t IS NULL THEN 0 ELSE w.l + 1 END, CASE WHEN s.t IS NULL THEN w.place ELSE w.i // 3 END, w.h, w.place, w.subroot, s.t IS NULL AND w.t = 't'
  FROM walk w LEFT JOIN steps s ON s.t = w.t AND s.l = w.l AND s.i = w.i WHERE NOT w.done
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM walk, (SELECT d AS root FROM over_all WHERE n = 1) WHERE done
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Proofs of all documents, checked against texts of which every second by CRC-32 lost its line ends."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = {"text": F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    return merkle.manifest(table(spark, folder, "documents"), changed).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op12_prefix_trie", rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text)) AS t,
    {_crc32("conv_id::VARCHAR")} % 6 AS h
  FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.t, [])[1:a.h], a.t[a.h + 1:]) AS t FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100
), firsts AS (
  SELECT conv_id, d, t[1:d] AS key, d = len(t) AS at_end FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)
), named AS (SELECT conv_id, d, at_end, sha256(d || to_json(key)::VARCHAR) AS id, sha256((d - 1) || to_json(key[1:d - 1])::VARCHAR) AS up, length(key[d].text) AS size FROM firsts),
nodes AS (
  SELECT id, any_value(up) AS up, min(conv_id) AS conv_id, d, count(*) AS n, coalesce(any_value(size), 0) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (at_end), '')) AS ends
  FROM named GROUP BY id, d
), children AS (SELECT up, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY up),
full_nodes AS (SELECT n.*, coalesce(c.kids, 0) AS kids FROM nodes n LEFT JOIN children c ON c.up = n.id),
pairs AS (  -- every node with all nodes above it and itself, through its smallest member
  SELECT a.id AS above, f.id, f.kids, f.n, f.size FROM full_nodes f JOIN named a ON a.conv_id = f.conv_id AND a.d <= f.d
), sums AS (SELECT above, sum((kids = 0)::INT)::BIGINT AS n_leaves, sum((n - 1) * size)::BIGINT AS saved FROM pairs GROUP BY above)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, s.n_leaves, s.saved AS saved_tokens, f.ends AS ends_sha256
FROM full_nodes f JOIN sums s ON s.above = f.id LEFT JOIN full_nodes p ON f.d > 0 AND p.id = f.up
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, each rebuilt on the first turns of its hundred's first one, as a trie."""
    own = stored(prefix_trie.turn_lists(table(spark, folder, "conversations")), "turn-lists")
    first = F.col("conv_id") - F.col("conv_id") % 100
    heads = own.where(F.col("conv_id") == first).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    rebuilt = own.withColumn("base", first).join(heads, "base", "left").select("conv_id", F.concat(
        F.slice(F.coalesce("head", F.array().cast(prefix_trie.TURNS)), F.lit(1), taken), F.slice("turns", taken + 1, F.size("turns"))).alias("turns"))
    longs = ["depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return prefix_trie.prefix_trie(rebuilt).select("conv_id", *(F.col(c).cast("long").alias(c) for c in longs), "ends_sha256")


@query("op13_private_data")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents."""
    small_batches(spark)
    found = private_data.find_private(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
    kinds = F.array(*map(F.lit, private_data.KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("__spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("__spans", lambda s: s["kind"] < len(private_data.BASE))
    return found.select(
        "doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(private_data.BASE)),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans"))
