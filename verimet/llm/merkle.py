"""Merkle manifest of a dataset, with proofs by pointer jumping.

Leaves of one tree are hashed in runs of three until one node, the tree's root, remains; the roots of all
trees are the leaves of a last tree.  Each node then holds a pointer to an ancestor and the segment of sibling
digests on the way.  Joining the nodes with themselves through the pointer doubles the distance and
appends the ancestor's segment, so a proof of any depth takes its logarithm in joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verimet.llm.common import stored

#: Children of a node.
RUN = 3
#: Levels that are built at once, from groups of 27 nodes.
STEP = 3
#: Name of the tree over the trees; names of the others begin with n (null) or s.
TOP = "t"
#: Bytes up to which the ancestors' side of a join is broadcast; their number is counted before.
SMALL = 32 << 20
STEPS = "array<struct<left:binary,right:binary>>"
NOTHING = b""


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Digest of one row (32 bytes)."""
    return F.unhex(F.sha2(F.concat(*(encoded(v) for v in values)), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def node_digest(*children: Column) -> Column:
    """Digest of the children's digests in hexadecimal, one behind the other."""
    return F.unhex(F.sha2(hexed(F.concat(*children)), 256))


def fold(leaf: Column, steps: Column) -> Column:
    """The ancestor that follows from a leaf and the siblings on its way."""
    return F.aggregate(steps, leaf, lambda d, s: node_digest(s["left"], d, s["right"]))


def siblings_digest(steps: Column) -> Column:
    """Hexadecimal digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: hexed(F.concat(s["left"], s["right"]))), ""), 256)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Stored `rows` with column i, the place within column t from 0 on, and n, the rows with that t.

    A range sort by (t, order) deals the rows evenly, whatever t's sizes; row numbers inside a partition
    and the counts of the partitions before give the place.  `order` must not leave ties that differ in content.
    """
    keys = [F.col("t"), *(F.col(c).asc_nulls_first() for c in order)]
    dealt = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns(
        {"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), name)
    blocks = dealt.groupBy("part", "t").agg(F.min("row").alias("first"), F.count("*").alias("m"))
    tree = Window.partitionBy("t")
    blocks = blocks.select(
        "part", "t", (F.coalesce(F.sum("m").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("m").over(tree).alias("n"))
    return dealt.join(blocks, ["part", "t"]).withColumn("i", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def height(n: Column) -> Column:
    """Levels above n leaves."""
    return F.size(F.filter(F.array(*(F.lit(RUN ** k).cast("long") for k in range(40))), lambda p: p < n))


def _up(nodes: Column) -> Column:
    """Digests of the next level of one group."""
    at = lambda k: F.coalesce(F.get(nodes, k), F.lit(NOTHING))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / RUN).cast("int")), lambda k: node_digest(*(at(k * RUN + j) for j in range(RUN))))


def _step(nodes: Column, k: Column) -> Column:
    """Siblings of node k to its left and right."""
    at = lambda j: F.coalesce(F.get(nodes, j), F.lit(NOTHING))
    nothing, place = F.lit(NOTHING), k % RUN
    left = F.when(place == 0, nothing).when(place == 1, at(k - 1)).otherwise(F.concat(at(k - 2), at(k - 1)))
    right = F.when(place == 2, nothing).when(place == 1, at(k + 1)).otherwise(F.concat(at(k + 1), at(k + 2)))
    return F.struct(left.alias("left"), right.alias("right"))


def _steps(nodes: Column) -> Column:
    return F.transform(nodes, lambda _, k: _step(nodes, k))


def grow(leaves: DataFrame, carry: list[str], name: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Trees over `leaves` (t, i, n, d and the columns `carry`).

    Returns leaves (t, i, n, h, carry..., d, step), inner nodes below the roots (t, l, i, h, step), the roots (t, h, d),
    and the greatest height.
    """
    now = leaves.withColumn("h", height(F.col("n"))).withColumn("more", F.struct(*carry) if carry else F.lit(True))
    deepest, level, stages = None, 0, []
    while deepest is None or level < deepest:
        g = now.groupBy("t", "n", "h", F.floor(F.col("i") / RUN ** STEP).alias("g")).agg(
            F.sort_array(F.collect_list(F.struct("i", "d", *(["more"] if not level else [])))).alias("own"))
        g = g.withColumn("l0", F.transform("own", lambda x: x["d"]))
        for k in range(STEP):
            g = g.withColumn(f"l{k + 1}", _up(F.col(f"l{k}")))
        g = stored(g if not level else g.drop("own"), f"{name}-{level}")
        stages.append((level, g))
        if deepest is None:
            deepest = g.agg(F.max("h")).first()[0] or 0
        level += STEP
        now = g.where(F.col("h") > level).select("t", "n", "h", F.col("g").alias("i"), F.get(f"l{STEP}", F.lit(0)).alias("d"))
    bottom = stages[0][1]
    lowest = bottom.select("t", "n", "h", F.explode(F.transform("own", lambda x, k: F.struct(x.alias("x"), _step(F.col("l0"), k).alias("step")))).alias("e")).select(
        "t", "n", "h", F.col("e.x.i").alias("i"), F.col("e.x.d").alias("d"), *(F.col(f"e.x.more.{c}").alias(c) for c in carry), F.col("e.step").alias("step"))
    inner, roots = None, None
    for low, g in stages:
        for k in range(STEP):
            if low + k:
                part = g.where(F.col("h") > low + k).select(
                    "t", "h", F.lit(low + k).alias("l"), (F.col("g") * RUN ** (STEP - k)).alias("base"),
                    F.posexplode(_steps(F.col(f"l{k}"))).alias("j", "step")).select(
                    "t", "h", "l", (F.col("base") + F.col("j")).alias("i"), "step")
                inner = part if inner is None else inner.unionByName(part)
        top = F.array(*(F.get(f"l{k}", F.lit(0)) for k in range(STEP + 1)))
        least = low if not low else low + 1
        part = g.where((F.col("h") >= least) & (F.col("h") <= low + STEP)).select("t", "h", F.get(top, F.col("h") - low).alias("d"))
        roots = part if roots is None else roots.unionByName(part)
    return lowest, inner, roots, deepest


def prove(rows: DataFrame, order: str, carry: list[str]) -> DataFrame:
    """Proofs of the rows (t, name of their tree; d, digest; the column `order`; the columns `carry`), which have to be stored.

    Returns t, d, carry, h (height of the tree), steps (siblings on the way to the root, from the leaf on) and root.
    Inside a tree leaves ascend by `order` (null first), then by digest; equal rows are interchangeable.
    """
    leaves, inner, roots, deepest = grow(numbered(rows, [order, "d"], "merkle-leaves"), [*dict.fromkeys([order, *carry])], "merkle-tree")
    roots = stored(roots, "merkle-roots")
    tops, above, last, over = grow(
        numbered(roots.select(F.lit(TOP).alias("t"), F.col("t").alias("tree"), "h", "d"), ["tree"], "merkle-subroots").withColumnRenamed("h", "below"),
        ["tree", "below"], "merkle-top")
    up = F.floor(F.col("i") / RUN)
    no_tree, no_place = F.lit(None).cast("string"), F.lit(None).cast("long")
    parent = [F.col("t").alias("at"), (F.col("l") + 1).alias("al"), up.alias("ai"), F.array("step").cast(STEPS).alias("steps")]
    inner, above = inner.select("t", "l", "i", *parent), above.select("t", "l", "i", *parent)
    climbs = F.col("h") > 0  # a lone tree's root is the root of all
    subroots = tops.select(
        F.col("tree").alias("t"), F.col("below").alias("l"), F.lit(0).cast("long").alias("i"), F.when(climbs, F.col("t")).otherwise(no_tree).alias("at"),
        F.when(climbs, F.lit(1)).alias("al"), F.when(climbs, up).otherwise(no_place).alias("ai"),
        F.when(climbs, F.array("step")).otherwise(F.array()).cast(STEPS).alias("steps"))
    nodes = stored(inner.unionByName(above).unionByName(subroots), "merkle-nodes-1")
    # a lone leaf is its tree's root: it points to that node, without a step
    state = leaves.select(
        "t", "d", *carry, "h", F.col("t").alias("at"), F.when(F.col("h") > 0, 1).otherwise(0).alias("al"), F.when(F.col("h") > 0, up).otherwise(0).cast("long").alias("ai"),
        F.when(F.col("h") > 0, F.array("step")).otherwise(F.array()).cast(STEPS).alias("steps"))
    distance = 1
    while distance < deepest + over + 1:
        near = F.col("t") == TOP
        ahead = nodes.where(near | (F.col("l") == distance) | (F.col("l") == 0))
        state = _jump(state, ahead, distance)
        if 2 * distance < deepest + over + 1:
            held = nodes.where(near | (F.col("l") % (2 * distance) == 0))
            via = nodes.where(near | (F.col("l") % (2 * distance) == distance))
            nodes = stored(_jump(held, via, distance), f"merkle-nodes-{2 * distance}")
        distance *= 2
    root = last.first()  # one digest
    return state.drop("at", "al", "ai").withColumn("root", F.lit(bytes(root.d) if root else None).cast("binary"))


def _jump(state: DataFrame, ahead: DataFrame, distance: int) -> DataFrame:
    """`state` with the pointers and steps of the nodes it points to appended.

    Few ancestors are broadcast after they were counted; else each has a small share of the rows.
    """
    table = ahead.select("t", "l", "i", F.col("at").alias("nt"), F.col("al").alias("nl"), F.col("ai").alias("ni"), F.col("steps").alias("on"))
    table = table.withColumnsRenamed({"t": "at", "l": "al", "i": "ai"})
    if ahead.count() * (64 * distance + 100) <= SMALL:
        table = F.broadcast(table)
    joined = state.join(table, ["at", "al", "ai"], "left")
    steps = F.concat("steps", F.coalesce("on", F.array().cast(STEPS)))
    return joined.withColumn("steps", steps).drop("at", "al", "ai", "on").withColumnsRenamed({"nt": "at", "nl": "al", "ni": "ai"})


def digests(docs: DataFrame, fields: list[str], tree: str, order: str, changed: dict[str, Column] | None = None) -> DataFrame:
    """The stored leaf table: t, doc (`order`), d and, with other values for some fields, d_changed.  Whole rows are read once."""
    changed = changed or {}
    rows = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col(tree).cast("string")), F.lit("n")).alias("t"), F.col(order).alias("doc"),
        leaf_digest(*(F.col(c) for c in fields)).alias("d"), leaf_digest(*(changed.get(c, F.col(c)) for c in fields)).alias("d_changed"))
    return stored(rows, "merkle-digests")


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """Proofs of all documents: one tree per source over rows by doc_id, and one over the sources (null first, bytewise).

    Returns doc_id, leaf, subroot, root, proof_sha256 (hexadecimal), steps, folded_root (from the leaf with the values
    `changed`, if given, and the original siblings) and verified (whether that is the root).

    Cases: nulls in any column are encoded apart from empty texts; rows of equal doc_id go by digest, repeated rows are
    leaves of their own; a single row is leaf, subroot and root in one, with an empty proof; no rows give no rows; further
    columns are left out.
    """
    rows = digests(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", changed)
    done = prove(rows, "doc", ["doc", "d_changed"])
    folded = fold(F.col("d_changed"), F.col("steps"))
    return done.withColumn("folded", folded).select(
        F.col("doc").alias("doc_id"), hexed(F.col("d")).alias("leaf"), hexed(fold(F.col("d"), F.slice("steps", 1, F.col("h")))).alias("subroot"),
        hexed(F.col("root")).alias("root"), siblings_digest(F.col("steps")).alias("proof_sha256"), "steps",
        hexed(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
