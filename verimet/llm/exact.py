"""Exact de-duplication with heavy hitters removed on the map side (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verimet.llm.common import BLANK, stored


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of each text, runs of blanks as one space, null as empty."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), f"{BLANK}+", " ")
    return docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"))


def exact_duplicates(docs: DataFrame, counters: int = 4096, winners: int = 1024) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per row of `docs`.

    1. A Misra-Gries summary with `counters` counters (the built-in mergeable frequent-item
       sketch, which cuts all counters by a common amount when it is full) names up to
       `winners` digests; any digest on more than about 4/counters of the rows is among them.
    2. A second pass counts those digests exactly, folded before the shuffle.  Digests
       that turn out rare are left to the ordinary way.
    3. The verified digests, `winners` at most, are broadcast: their rows get their result on
       the map side and never travel.  All other digests meet by an ordinary shuffle.

    The sketch only chooses the way; every row's result is exact.

    Cases: a null text is empty; all empty texts are one group; rows with the same doc_id
    and text are one document (kept together); a null doc_id never wins against an id,
    a group without any id has a null keep_id and keeps its rows; no rows give no rows;
    further columns are ignored.
    """
    rows = stored(digests(docs), "digests")
    sketch = rows.agg(F.expr(f"approx_top_k(text_sha256, {winners}, {counters})").alias("top"))
    total = rows.agg(F.count("*")).scalar()
    named = sketch.select(F.explode("top").alias("t")).select(F.col("t.item").alias("text_sha256")).where(F.col("text_sha256").isNotNull())
    verified = (
        rows.join(F.broadcast(named), "text_sha256")
        .groupBy("text_sha256").agg(F.min("doc_id").alias("heavy_id"), F.count("*").alias("heavy_size"))
        .where(F.col("heavy_size") * counters >= total)
    )
    verified = stored(verified.coalesce(1), "winners")
    split = rows.join(F.broadcast(verified), "text_sha256", "left")
    heavy = split.where(F.col("heavy_size").isNotNull()).select(
        "doc_id", F.col("heavy_id").alias("keep_id"), F.col("heavy_size").alias("group_size"), "text_sha256")
    group = Window.partitionBy("text_sha256")
    rest = split.where(F.col("heavy_size").isNull()).select(
        "doc_id", F.min("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"), "text_sha256")
    return heavy.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")
