"""Exact grouped quantiles by distributed selection.

``percentile`` keeps every distinct value of a group in one aggregation buffer.
Here each wanted rank has a bracket of values that must hold it.  A mergeable sketch gives the first
brackets.  While a bracket may hold many distinct values, a round counts the rows below it and
on its two ends, and a sketch of the rows inside gives the next, narrower one; a rank that lies on an
end is settled there, so heavy ties end the search.  A rank outside its bracket is seen by
the counts and gets the values of that side.  What remains is a bounded number of values per rank,
which are ranked by their counts.  The answer is exact (linear interpolation).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verimet.session import shared_dir

ACCURACY = 10_000
MARGIN = 4.0 / ACCURACY
# Below this count a group is ranked whole: the sketch margin would be too thin.
SMALL_GROUP = 10_000
# Distinct values per rank that may be ranked together.
REST = 10_000
# Parts into which a round's sketch cuts a bracket.
PARTS = 200
# Groups up to which their brackets are broadcast (some hundred bytes each).
FEW_GROUPS = 50_000

_TARGET = "array<struct<rank:bigint,lo:double,hi:double,settled:boolean>>"


def _attach(rows: DataFrame, per_group: DataFrame, keys: Sequence[str], few: bool, how: str = "inner") -> DataFrame:
    """Join by the group's keys; null keys find their group too."""
    named = per_group.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    return rows.join(F.broadcast(named) if few else named, same, how).drop(*(f"_g_{k}" for k in keys))


def _first_brackets(rows: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """keys, n, _lo, _hi and _t: for each prob the ranks next to it and the values that should enclose them."""
    wanted = [q for p in probs for q in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    summary = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.percentile_approx("_x", wanted, ACCURACY).alias("_sketch"))
    small = F.col("n") <= SMALL_GROUP
    targets = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("n") - 1)
        for rank in (F.floor(at), F.ceil(at)):
            targets.append(F.struct(
                rank.alias("rank"), F.when(small, F.col("_lo")).otherwise(F.col("_sketch")[2 * i]).alias("lo"),
                F.when(small, F.col("_hi")).otherwise(F.col("_sketch")[2 * i + 1]).alias("hi"), F.lit(False).alias("settled")))
    return summary.select(*keys, "n", "_lo", "_hi", F.array(*targets).cast(_TARGET).alias("_t"))


def _narrowed(rows: DataFrame, groups: DataFrame, keys: Sequence[str], targets: int, few: bool) -> DataFrame:
    """One round: brackets that are narrower, on the other side of a miss, or settled on one value."""
    x, joined = F.col("_x"), _attach(rows, groups, keys, few)
    aggs, grid = [], [k / PARTS for k in range(PARTS + 1)]
    for i in range(targets):
        box = F.col("_t")[i]
        inside = ~box["settled"] & (x > box["lo"]) & (x < box["hi"])
        aggs += [
            F.count(F.when(x < box["lo"], 1)).alias(f"_below{i}"), F.count(F.when(x == box["lo"], 1)).alias(f"_on_lo{i}"),
            F.count(F.when((x == box["hi"]) & (box["hi"] > box["lo"]), 1)).alias(f"_on_hi{i}"), F.count(F.when(inside, 1)).alias(f"_in{i}"),
            F.approx_count_distinct(F.when(inside, x)).alias(f"_distinct{i}"), F.percentile_approx(F.when(inside, x), grid, ACCURACY).alias(f"_grid{i}"),
        ]
    counted = _attach(groups, joined.groupBy(*keys).agg(*aggs), keys, few)
    moved = []
    for i in range(targets):
        box = F.col("_t")[i]
        below, on_lo, on_hi, within = (F.col(f"_{c}{i}") for c in ("below", "on_lo", "on_hi", "in"))
        rank, cuts = box["rank"] - below, F.col(f"_grid{i}")
        at = F.floor((rank - on_lo) * PARTS / F.greatest(within, F.lit(1))).cast("int")
        enough = F.col(f"_distinct{i}") <= REST // 2
        lo = F.when(rank < 0, F.col("_lo")).when(rank < on_lo, box["lo"]).when(rank >= on_lo + within + on_hi, box["hi"]).when(
            rank >= on_lo + within, box["hi"]).when(enough, box["lo"]).otherwise(F.get(cuts, F.greatest(at - 1, F.lit(0))))
        hi = F.when(rank < 0, box["lo"]).when(rank < on_lo, box["lo"]).when(rank >= on_lo + within + on_hi, F.col("_hi")).when(
            rank >= on_lo + within, box["hi"]).when(enough, box["hi"]).otherwise(F.get(cuts, F.least(at + 2, F.lit(PARTS))))
        hit = (rank >= 0) & (rank < on_lo + within + on_hi)
        settled = hit & ((rank < on_lo) | (rank >= on_lo + within) | enough)
        moved.append(F.when(box["settled"], box).otherwise(F.struct(box["rank"].alias("rank"), lo.alias("lo"), hi.alias("hi"), settled.alias("settled"))))
    return counted.select(*keys, "n", "_lo", "_hi", F.array(*moved).cast(_TARGET).alias("_t"))


def _select(rows: DataFrame, groups: DataFrame, keys: Sequence[str], targets: int, few: bool) -> DataFrame:
    """keys, n, _i, _value: the value at each rank, null where its bracket doesn't hold it."""
    joined = _attach(rows, groups, keys, few)
    # Values inside any bracket keep their identity, all others fold into one row per key.
    inside = F.exists("_t", lambda t: (F.col("_x") >= t["lo"]) & (F.col("_x") <= t["hi"]))
    below = [F.count(F.when(F.col("_x") < F.col("_t")[i]["lo"], 1)).alias(f"_below{i}") for i in range(targets)]
    counts = joined.groupBy(*keys, F.when(inside, F.col("_x")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), *below).checkpoint()
    ranked = counts.groupBy(*keys).agg(*[F.sum(f"_below{i}").alias(f"_below{i}") for i in range(targets)])
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.col("_t")[i].alias("t"), F.col(f"_below{i}").alias("below")) for i in range(targets)])
    per_rank = _attach(groups, ranked, keys, few).select(*keys, "n", wanted.alias("_q"))
    linked = _attach(counts.where(F.col("_v").isNotNull()).select(*keys, "_v", "_c"), per_rank, keys, few).withColumn("_q", F.explode("_q"))
    linked = linked.where((F.col("_v") >= F.col("_q.t.lo")) & (F.col("_v") <= F.col("_q.t.hi")))
    upto = Window.partitionBy(*keys, "_q.i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("_q.below") + F.sum("_c").over(upto) - 1  # highest zero-based rank this value holds
    holds = (F.col("_q.t.rank") <= F.col("_last")) & (F.col("_q.t.rank") > F.col("_last") - F.col("_c"))
    found = linked.withColumn("_last", last).groupBy(*keys, F.col("_q.i").alias("_i")).agg(F.max(F.when(holds, F.col("_v"))).alias("_value"))
    every = groups.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(targets - 1))).alias("_i"))
    return _attach(every, found, [*keys, "_i"], False, "left")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], few_groups: bool = False, cheap: bool = False
) -> DataFrame:
    """One row per key: `n` and `quantiles` (array in the order of `probs`).

    No group's values meet in one task: a rank's last bracket holds at most about REST distinct values.  Set
    `few_groups` when the number of groups has a fixed bound (months, hours); it is counted all the same, and only
    the brackets of at most FEW_GROUPS groups are broadcast.  `df` is read several times; unless it is `cheap` (a stored
    table), its keys and values are written once before.  Null values are left out; null keys are a group.
    """
    if not keys:
        one = exact_quantiles(df.select(F.when(F.col(value).isNotNull(), F.lit(0)).alias("_all"), value).where("_all = 0"), ["_all"], value, probs, True, cheap)
        return one.drop("_all")
    shared_dir(df.sparkSession)  # checkpoint() below needs its folder
    rows = df.select(*keys, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    rows = rows if cheap else rows.checkpoint()
    targets = 2 * len(probs)
    groups = _first_brackets(rows, keys, probs).checkpoint()
    size = groups.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("most")).first()
    few, most = size.groups <= FEW_GROUPS, size.most or 0
    open_ = most * 2 * MARGIN > REST // 2
    while True:
        while open_:
            groups = _narrowed(rows, groups, keys, targets, few).checkpoint()
            open_ = groups.where(F.exists("_t", lambda t: ~t["settled"])).limit(1).count() > 0
        found = _select(rows, groups, keys, targets, few).checkpoint()
        missed = found.where(F.col("_value").isNull()).groupBy(*keys).agg(F.collect_set("_i").alias("_missed")).checkpoint()
        if missed.isEmpty():
            break
        # A sketch was wrong: those ranks start again from the whole range.
        again = _attach(groups, missed, keys, few)
        fresh = F.transform("_t", lambda t, i: F.when(F.array_contains("_missed", i), F.struct(
            t["rank"].alias("rank"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.lit(False).alias("settled"))).otherwise(F.struct(
                t["rank"].alias("rank"), t["lo"].alias("lo"), t["hi"].alias("hi"), F.lit(True).alias("settled"))))
        rest = _attach(groups, missed.select(*keys), keys, few, "left_anti")
        groups = again.withColumn("_t", fresh.cast(_TARGET)).drop("_missed").unionByName(rest).checkpoint()
        open_ = True
    pair = lambda i: (F.max(F.when(F.col("_i") == 2 * i, F.col("_value"))), F.max(F.when(F.col("_i") == 2 * i + 1, F.col("_value"))))
    between = []
    for i, p in enumerate(probs):
        low, high = pair(i)
        at = F.lit(float(p)) * (F.col("n") - 1)
        between.append(low + (high - low) * (at - F.floor(at)))
    return found.groupBy(*keys, "n").agg(F.array(*between).alias("quantiles"))
