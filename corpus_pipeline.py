"""From documents to token files: quality, near-duplicates, benchmark passages, mixture, output.

Each stage takes (spark, docs, folder) and works on all that its predecessor kept; between stages the
documents are written as Parquet below the shared folder and read again.

Cases, for every stage: nulls in any column are allowed and further columns stay as they are, whatever their names; repeated rows
and rows that repeat a doc_id are treated one by one; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verimet.llm import contamination, mixing, near, quality, tokens
from verimet.llm.common import small_batches, stored, table
from verimet.session import work_path

#: The vocabulary of the token files; a file that every executor has.
VOCABULARY = "byte_bpe_50k.json"


def good_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the co-trained classifier (5) doesn't reject; null texts and texts without words go."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, folder, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates (6) at a similarity of 0.85.

    Rows that repeat a kept doc_id stay with it; rows without doc_id stay as far as their group has no other row.
    """
    small_batches(spark, 256)
    return near.without_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item (3); shorter items count whole, those without words or id not."""
    small_batches(spark)
    return contamination.decontaminate(docs, table(spark, folder, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mixture (10) of their sources takes them; a null source is a source, the last one."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each copy, read back from the token files (9); null ids come first."""
    import public_tokenizers

    small_batches(spark, 256)
    out = work_path(spark, "tokens")
    tokens.write_tokens(docs, out, public_tokenizers.path(VOCABULARY), shard_bytes=32 << 20)
    return tokens.token_summary(spark, out)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixture", mixed),
    ("tokens", token_files),
]

#: Learned scores, signatures and token ids have no SQL form; a brute-force version tests the stages.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), f"stage-{name}")
    return docs
