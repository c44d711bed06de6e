"""Mixing sources to target word counts by entropy balancing (DataFrame functions only).

Among all document rates w between 0 and 3 under which each source yields its target,
entropy balancing takes those nearest to one copy each: they minimise the sum of
w log w - w.  The dual has one multiplier per source, and w = min(3, exp(lambda * x))
with x the document's size over the largest of its source.  Rates depend on source and
size alone, so Newton steps and rounding run on the counts of (source, size) pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verimet.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source key `s` (null apart from the empty name) and size in words."""
    return docs.select(
        "doc_id", F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source"))).alias("s"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sources: DataFrame, share: float, weights: tuple[int, ...]) -> DataFrame:
    """`sources` (s, source_size) with `target`: weights repeat in code point order, null last.

    A share above a source's limit is dealt again by weight until none is above.  Each round is
    one aggregation to a few numbers, and the sources over their limit only become more.
    """
    order = [F.col("s") == "", F.col("s")]
    dealt = stored(
        sources.repartitionByRange(max(1, sources.sparkSession.sparkContext.defaultParallelism), *order)
        .withColumn("part", F.spark_partition_id()), "sources")
    offsets = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn(
        "offset", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("offset")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = stored(dealt.join(F.broadcast(offsets), "part").select("s", "source_size", weight.cast("long").alias("weight")), "weights")
    limit = MOST * F.col("source_size")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        over = limit <= level * F.col("weight") if capped >= 0 else F.lit(False)
        n, taken, free = ranked.agg(
            F.sum(over.cast("long")), F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight")))).first()
        if capped == (n or 0):
            break
        capped, level = n or 0, (total - (taken or 0)) / free if free else float("inf")
    return ranked.withColumn("target", F.least(limit.cast("double"), F.lit(level) * F.col("weight")))


def rate(multiplier: Column, x: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(multiplier * x))


def multipliers(pairs: DataFrame, sources: DataFrame, tolerance: float = 1e-7, rounds: int = 80) -> DataFrame:
    """s and its multiplier, by Newton steps on the logarithm of the yield, kept within brackets.

    Each step is one partial aggregation over the (source, size) counts.  Sums are decimal, so they
    don't depend on the order of rows and reruns agree.  Sources at their limit need no step.
    """
    state = sources.select(
        "s", "target", "top", F.lit(0.0).alias("lam"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"),
        ((F.col("target") >= MOST * F.col("source_size")) | (F.col("target") <= 0)).alias("done"))
    for _ in range(rounds):
        w = rate(F.col("lam"), F.col("x"))
        words = F.col("n") * F.col("size")
        exact = lambda c: F.sum(c.cast("decimal(30,9)")).cast("double")
        sums = (
            pairs.join(state, "s").where(~F.col("done")).withColumn("x", F.col("size") / F.col("top"))
            .groupBy("s").agg(exact(words * w).alias("got"), exact(F.when(w < MOST, words * w * F.col("x")).otherwise(F.lit(0.0))).alias("slope")))
        near = F.abs(F.col("got") - F.col("target")) <= tolerance * F.col("target")
        lo = F.when(F.col("got") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("got") >= F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") + F.col("got") / F.col("slope") * F.log(F.col("target") / F.col("got"))
        fallback = (
            F.when(hi == float("inf"), F.greatest(2 * lo, lo + 1.0)).when(lo == float("-inf"), F.least(2 * hi, hi - 1.0)).otherwise((lo + hi) / 2))
        step = F.when((F.col("got") > 0) & (F.col("slope") > 0) & (newton > lo) & (newton < hi), newton).otherwise(fallback)
        moved = F.col("got").isNotNull() & ~near
        state = stored(state.join(sums, "s", "left").select(
            "s", "target", "top", F.when(moved, step).otherwise(F.col("lam")).alias("lam"),
            F.when(moved, lo).otherwise(F.col("lo")).alias("lo"), F.when(moved, hi).otherwise(F.col("hi")).alias("hi"),
            F.coalesce(~moved, F.lit(True)).alias("done")), "dual")
        if state.where(~F.col("done")).limit(1).count() == 0:
            return state.select("s", "lam")
    raise RuntimeError("the dual of the mixture didn't converge")


def _rounded(pairs: DataFrame, rounds: int = 3) -> DataFrame:
    """pairs (s, size, n, rate, target) with `base` copies for all n documents and one more for `extra` of them.

    Fractions are rounded along falling size, so that their running sum is off by at most
    half a copy; what this leaves is then made up by documents that fit, the largest first.
    """
    along = Window.partitionBy("s").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("s")
    base = F.least(F.floor("rate"), F.lit(MOST)).cast("long")
    part = F.when(base >= MOST, F.lit(0.0)).otherwise(F.col("n") * (F.col("rate") - base))
    summed = F.sum(part.cast("decimal(30,9)")).over(along).cast("double")
    pairs = pairs.withColumn("base", base).withColumn("upto", F.floor(summed + 0.5).cast("long"))
    pairs = pairs.withColumn("extra", F.greatest(F.lit(0), F.least(
        F.when(F.col("base") >= MOST, 0).otherwise(F.col("n")), F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("s").orderBy(F.desc("size"))), F.lit(0)))))
    for _ in range(rounds):
        missing = F.round(F.col("target") - F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("extra"))).over(whole)).cast("long")
        pairs = pairs.withColumn("missing", missing)
        free = F.when(F.col("missing") > 0, F.when(F.col("base") >= MOST, 0).otherwise(F.col("n") - F.col("extra"))).otherwise(F.col("extra"))
        fits = F.when((F.col("size") > 0) & (F.col("size") <= F.abs("missing")), free).otherwise(F.lit(0))
        pairs = pairs.withColumn("fits", fits)
        pairs = pairs.withColumn("left", F.abs("missing") - F.coalesce(
            F.sum(F.col("fits") * F.col("size")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        change = F.least(F.col("fits"), F.floor(F.greatest(F.col("left"), F.lit(0)) / F.greatest(F.col("size"), F.lit(1)))).cast("long")
        pairs = pairs.withColumn("extra", F.col("extra") + F.signum(F.col("missing").cast("double")).cast("long") * change)
    return pairs.drop("upto", "missing", "fits", "left")


def mix(docs: DataFrame, share: float = 1.0, weights: tuple[int, ...] = WEIGHTS, group_rows: int = 50_000) -> DataFrame:
    """doc_id, s, size, source_size, target, copies, taken; one row per row of `docs`.

    Which documents of a (source, size) pair get the extra copy is decided by a hash of the id;
    pairs of more than `group_rows` documents are cut by hash and their quota with them.

    Cases: null text has size 0 and is taken 0 times its size; a null source is a source of its
    own, last in order; a source without words has target 0; rows that repeat id, source and size
    are decided alike (so a source may then miss its target by their size); a null id is
    hashed like any other; no rows give no rows; further columns are ignored.
    """
    rows = stored(sizes(docs), "sizes")
    pairs = stored(rows.groupBy("s", "size").agg(F.count("*").alias("n")), "pairs")
    totals = pairs.groupBy("s").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.max("size").alias("top"))
    sources = stored(source_targets(totals.drop("top"), share, weights).join(totals.select("s", "top"), "s"), "targets")
    lam = multipliers(pairs, sources)
    full = (F.col("target") >= MOST * F.col("source_size")) & (F.col("target") > 0)
    rated = pairs.join(sources, "s").join(lam, "s").withColumn("rate", F.when(full, F.lit(float(MOST))).when(
        F.col("target") <= 0, F.lit(0.0)).otherwise(rate(F.col("lam"), F.col("size") / F.col("top"))))
    quota = stored(
        _rounded(rated.select("s", "size", "n", "rate", "target", "source_size"))
        .withColumn("cuts", F.ceil(F.col("n") / group_rows).cast("long")).drop("rate"), "quota")
    split = rows.join(quota, ["s", "size"]).withColumn("h", F.xxhash64(F.lit(10), F.col("doc_id")))
    split = split.withColumn("cut", F.pmod(F.shiftrightunsigned("h", 32), F.col("cuts")))
    counted = (
        split.where(F.col("cuts") > 1).groupBy("s", "size", "cut").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first("extra").alias("extra"))
        .withColumn("upto", F.sum("m").over(Window.partitionBy("s", "size").orderBy("cut"))))
    share_of = lambda upto: F.floor(F.col("extra").cast("decimal(20,0)") * upto / F.col("n"))
    counted = counted.select("s", "size", "cut", (share_of(F.col("upto")) - share_of(F.col("upto") - F.col("m"))).cast("long").alias("own"))
    split = split.join(counted, ["s", "size", "cut"], "left").withColumn("own", F.coalesce("own", "extra"))
    spot = F.rank().over(Window.partitionBy("s", "size", "cut").orderBy("h", "doc_id"))
    copies = F.col("base") + (spot <= F.col("own")).cast("long")
    return split.select("doc_id", "s", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, share: float = 1.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Rows of `docs`, each as often as the mix takes it.  Documents without words are not taken."""
    copies = mix(docs, share, weights).where("taken > 0").select(
        F.col("doc_id").alias("__id"), F.col("s").alias("__s"), F.col("size").alias("__size"), F.col("copies").alias("__copies")).distinct()
    keyed = docs.withColumns({
        "__s2": F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source"))),
        "__size2": F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")})
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__s2") == F.col("__s")) & (F.col("__size2") == F.col("__size"))
    return keyed.join(copies, on).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)
