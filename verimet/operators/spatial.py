"""Nearest neighbours, grid look-ups and grid-to-station interpolation.

No operator pairs everything with everything.  Points and queries are put into cell trees along
a curve through cubes of the unit sphere; a cell holds its count and the box around its
points, and is split in four per axis while it holds more than LEAF points.  The search starts with the
pair of the two roots.  In each round both cells of a pair are replaced by their children, and a
query cell keeps only point cells that can hold one of its k nearest, judged by the counts and
the least and greatest distances of the boxes.  Dense and empty regions, near and far queries need
as many rounds as their own cells are deep.  Chord length orders pairs exactly like great-circle
distance, so poles and the date line need no special case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verimet.functions.geo import EARTH_RADIUS_KM, chord_to_km, coordinate_key, unit_sphere, wrap_longitude
from verimet.operators.filters import land_only
from verimet.session import stored

# Splits in four per axis: the smallest cubes have an edge of about 12 m.
DEPTH = 10
# Cells with more points are split.  Only at the last level a cell may hold more: all positions within 12 m.
LEAF = 16
POSITION_SCALE = 1_000_000
# Chords closer than this (about 6 mm on the ground) count as equal; the id decides.
TIE_SCALE = 1e9

# Slack of the pruning on the chord, so that ties by the scale above survive.
SLACK = 2.0 / TIE_SCALE

_AXES = ("x", "y", "z")


def _on_sphere(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.withColumns(dict(zip(_AXES, unit_sphere(F.col(lat), F.col(lon)))))


def tie_key(chord: Column) -> Column:
    return F.floor(chord * TIE_SCALE)


def _cell(level: int) -> Column:
    """Id of the cube at `level`: a leading one, then six bits a level, so the parent's id is that without the last six."""
    found = F.lit(1).cast("long")
    for depth in range(level):
        digits = [F.shiftright(F.least(F.floor((F.col(a) + 1.0) * 4.0**DEPTH / 2.0), F.lit(4**DEPTH - 1)).cast("long"), 2 * (DEPTH - 1 - depth)) % 4 for a in _AXES]
        found = found * 64 + digits[0] * 16 + digits[1] * 4 + digits[2]
    return found


def _with_code(df: DataFrame) -> DataFrame:
    return df.withColumn("code", _cell(DEPTH))


def _levels(levels: list[int]) -> Column:
    """Ids of a point's cells at some levels, from its smallest one."""
    return F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright("code", 6 * (DEPTH - i)).alias("id")) for i in levels])


def cell_tree(coded: DataFrame) -> DataFrame:
    """Stored cells with points: id, up (the parent's id), level, held, leaf, box.  One row per cell whose parent had to be split."""
    sides = [f(a).alias(f"{a}{i}") for a in _AXES for i, f in enumerate((F.min, F.max))]
    cells = (
        coded.select(*_AXES, F.explode(_levels(list(range(DEPTH + 1)))).alias("c"))
        .groupBy("c.level", "c.id").agg(F.count(F.lit(1)).alias("held"), *sides)
        .select("level", "id", F.shiftright("id", 6).alias("up"), "held", F.struct(*[f"{a}{i}" for a in _AXES for i in (0, 1)]).alias("box"))
    )
    # A cell holds what its at most 64 children hold.
    above = F.sum("held").over(Window.partitionBy("level", "up"))
    kept = cells.withColumn("_above", above).where((F.col("level") == 0) | (F.col("_above") > LEAF)).drop("_above")
    return stored(kept.withColumn("leaf", (F.col("held") <= LEAF) | (F.col("level") == DEPTH)), "cells")


def _below(tree: DataFrame, level: int, side: str) -> DataFrame:
    """Cells of the next round by the cell of this one; leaves stay."""
    deeper = F.col("level") == level + 1
    return tree.where(deeper | (F.col("leaf") & (F.col("level") <= level))).select(
        F.when(deeper, F.col("up")).otherwise(F.col("id")).alias(side), F.col("id").alias("child"), F.col("box").alias("child_box"), F.col("held").alias("child_held"))


def _gaps(low: tuple[Column, Column], other: Column, axis: str) -> tuple[Column, Column]:
    """Least and greatest distance of an interval to a box along one axis."""
    a, b = low
    c, d = other[f"{axis}0"], other[f"{axis}1"]
    return F.greatest(c - b, a - d, F.lit(0.0)), F.greatest(F.abs(d - a), F.abs(b - c))


def _pruned(pairs: DataFrame, by: str, sides: dict[str, tuple[Column, Column]], k: int) -> DataFrame:
    """Pairs whose point cell can hold one of the k nearest of `by`; `bound` is a distance that k points don't exceed."""
    gaps = [_gaps(sides[a], F.col("pbox"), a) for a in _AXES]
    near, far = (F.sqrt(sum((g[i] * g[i] for g in gaps), F.lit(0.0))) for i in (0, 1))
    all_of = Window.partitionBy(by)
    nearest_first = all_of.orderBy("far").rowsBetween(Window.unboundedPreceding, 0)
    pairs = pairs.withColumns({"near": near, "far": far}).where(F.col("near") <= F.col("bound") + SLACK)
    pairs = pairs.withColumn("enough", F.when(F.sum("held").over(nearest_first) >= k, F.col("far")))
    pairs = pairs.withColumn("bound", F.least("bound", F.coalesce(F.min("enough").over(all_of), F.lit(float("inf")))))
    return pairs.where(F.col("near") <= F.col("bound") + SLACK).drop("near", "far", "enough")


def _leaf_of(coded: DataFrame, tree: DataFrame, levels: list[int], side: str) -> DataFrame:
    """Points with the id of their leaf, which lies at one of `levels`."""
    leaves = tree.where("leaf")
    return coded.withColumn("c", F.explode(_levels(levels))).withColumn(side, F.col("c.id")).drop("c", "code").join(
        leaves.select(F.col("id").alias(side)), side)


def k_nearest(queries: DataFrame, points: DataFrame, k: int, same: bool = False) -> DataFrame:
    """Exact k nearest ids per query: (qid, rank, pid, chord).  `qid` is unique.

    queries: qid, x, y, z.  points: one row per position, x, y, z and `ids`
    (array of the ids there that can be an answer).  Both are read twice.  `same` says that
    the queries lie on the points, so one tree serves both.
    """
    asked, held = (df if "code" in df.columns else _with_code(df) for df in (queries, points))
    trees = {"p": cell_tree(held)}
    trees["q"] = trees["p"] if same else cell_tree(asked)
    # at most DEPTH + 1 rows a tree
    levels = {s: {r.level: r.leaf for r in t.groupBy("level").agg(F.max("leaf").alias("leaf")).collect()} for s, t in trees.items()}
    depth = {s: max(found, default=0) for s, found in levels.items()}
    leaves = {s: sorted(level for level, leaf in found.items() if leaf) for s, found in levels.items()}
    roots = {s: t.where(F.col("level") == 0) for s, t in trees.items()}
    pairs = roots["q"].select(F.col("id").alias("q"), F.col("box").alias("qbox")).join(
        roots["p"].select(F.col("id").alias("q"), F.col("id").alias("p"), F.col("box").alias("pbox"), "held"), "q").withColumn("bound", F.lit(float("inf")))
    boxes = {a: (F.col("qbox")[f"{a}0"], F.col("qbox")[f"{a}1"]) for a in _AXES}
    for level in range(max(depth.values())):
        if level < depth["q"]:
            pairs = pairs.join(_below(trees["q"], level, "q"), "q").select(
                F.col("child").alias("q"), F.col("child_box").alias("qbox"), "p", "pbox", "held", "bound")
        if level < depth["p"]:
            pairs = pairs.join(_below(trees["p"], level, "p"), "p").select(
                "q", "qbox", F.col("child").alias("p"), F.col("child_box").alias("pbox"), F.col("child_held").alias("held"), "bound")
        pairs = _pruned(pairs, "q", boxes, k)
        if level % 4 == 3:
            pairs = stored(pairs, "pairs")
    mine = pairs.drop("qbox").join(_leaf_of(asked, trees["q"], leaves["q"], "q"), "q").drop("q")
    mine = _pruned(mine, "qid", {a: (F.col(a), F.col(a)) for a in _AXES}, k).select("qid", "p", *_AXES)
    targets = _leaf_of(held, trees["p"], leaves["p"], "p").withColumnsRenamed({a: f"p{a}" for a in _AXES})
    chord = F.sqrt(sum((F.pow(F.col(a) - F.col(f"p{a}"), 2.0) for a in _AXES), F.lit(0.0)))
    found = mine.join(targets, "p").select("qid", chord.alias("chord"), F.explode("ids").alias("pid"))
    nearest_first = Window.partitionBy("qid").orderBy(tie_key(F.col("chord")), "pid")
    return found.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).select("qid", "rank", "pid", "chord")


def nearest_stations(stations: DataFrame, k: int = 4, radius_km: float = EARTH_RADIUS_KM) -> DataFrame:
    """k nearest stations of each station, itself first: (station, rank, neighbour, km).

    Ties go to the smaller id.  Stations sharing a position are searched once:
    only the k+1 smallest ids of a position can be anybody's neighbour, so a
    position with very many stations stays small.
    """
    rows = stations.select(
        "station", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")
    ).withColumns({"la": coordinate_key(F.col("lat"), POSITION_SCALE), "lo": coordinate_key(F.col("lon"), POSITION_SCALE)})
    by_id = Window.partitionBy("la", "lo").orderBy("station")
    heads = rows.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    positions = heads.groupBy("la", "lo").agg(
        F.sort_array(F.collect_list("station")).alias("ids"), F.min("lat").alias("lat"), F.min("lon").alias("lon")
    )
    points = stored(_with_code(_on_sphere(positions, "lat", "lon")), "positions")
    # One search per position, k+1 deep: any member can leave itself out and still has k-1 others.
    queries = points.select(F.struct("la", "lo").alias("qid"), *_AXES, "code")
    near = (
        k_nearest(queries, points.select("ids", *_AXES, "code"), k + 1, same=True)
        .groupBy("qid")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "pid", "chord"))).alias("near"))
        .select(F.col("qid.la").alias("la"), F.col("qid.lo").alias("lo"), "near")
    )
    others = F.slice(F.filter("near", lambda n: n["pid"] != F.col("station")), 1, k - 1)
    itself = F.array(F.struct(F.lit(0).alias("rank"), F.col("station").alias("pid"), F.lit(0.0).alias("chord")))
    return (
        rows.join(near, ["la", "lo"])
        .select("station", F.posexplode(F.concat(itself, others)).alias("i", "n"))
        .select(
            "station",
            (F.col("i") + 1).cast("long").alias("rank"),
            F.col("n.pid").alias("neighbour"),
            chord_to_km(F.col("n.chord"), radius_km).alias("km"),
        )
    )


def station_clusters(stations: DataFrame, k: int = 4) -> DataFrame:
    """Cluster table: station and its k nearest (itself first) as an array."""
    if stations.select("station").distinct().limit(k).count() < k:
        raise ValueError(f"a cluster needs at least {k} stations")
    lists = (
        nearest_stations(stations, k)
        .groupBy("station")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("s"))
        .select("station", F.transform("s", lambda s: s["neighbour"]).alias("closest_stations"))
    )
    return stored(lists, "clusters")  # a look-up table that many jobs read


def _grid_points(grid: DataFrame, lat: str, lon: str) -> DataFrame:
    distinct = grid.select(F.col(lat).alias("lat"), F.col(lon).alias("lon")).distinct()
    keyed = distinct.select(
        coordinate_key(F.col("lat")).alias("gla"), coordinate_key(F.col("lon")).alias("glo"), "lat", "lon"
    )
    return _on_sphere(keyed, "lat", "lon").select(F.array(F.struct("gla", "glo")).alias("ids"), *_AXES)


def nearest_grid_points(
    stations: DataFrame, grid: DataFrame, k: int = 1, lat: str = "latitude", lon: str = "longitude",
    radius_km: float = EARTH_RADIUS_KM,
) -> DataFrame:
    """(station, rank, gla, glo, km): the k nearest grid positions of each station."""
    points = stored(_with_code(_grid_points(grid, lat, lon)), "grid-points")
    queries = stored(_with_code(_on_sphere(stations.select(F.col("station").alias("qid"), "lat", "lon"), "lat", "lon").select("qid", *_AXES)), "asked")
    found = k_nearest(queries, points, k)
    return found.select(
        F.col("qid").alias("station"), F.col("rank").cast("long").alias("rank"),
        F.col("pid.gla").alias("gla"), F.col("pid.glo").alias("glo"), chord_to_km(F.col("chord"), radius_km).alias("km"),
    )


def _with_grid_key(grid: DataFrame, lat: str, lon: str) -> DataFrame:
    return grid.withColumns({"gla": coordinate_key(F.col(lat)), "glo": coordinate_key(F.col(lon))})


def values_at_nearest(stations: DataFrame, grid: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Grid rows taken at the nearest grid point of each station."""
    near = nearest_grid_points(stations, grid, 1, lat, lon).select("station", "gla", "glo")
    return _with_grid_key(grid, lat, lon).join(near, ["gla", "glo"]).drop("gla", "glo")


def at_station_coordinates(grid: DataFrame, stations: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Grid rows whose position is a station's grid position (integer keys, exact)."""
    places = stations.select("station", coordinate_key(F.col("lat")).alias("gla"), coordinate_key(F.col("lon")).alias("glo"))
    return _with_grid_key(grid, lat, lon).join(places, ["gla", "glo"]).drop("gla", "glo")


def on_land(grid: DataFrame, mask: DataFrame, lat: str = "latitude", lon: str = "longitude", flag: str = "lsm") -> DataFrame:
    """Grid rows over land; mask longitudes may run 0..360.

    The mask is filtered first, so the join carries land cells only.
    """
    land = land_only(mask, flag).select(
        coordinate_key(F.col(lat)).alias("gla"), coordinate_key(wrap_longitude(F.col(lon))).alias("glo")
    )
    return _with_grid_key(grid, lat, lon).join(land.distinct(), ["gla", "glo"], "left_semi").drop("gla", "glo")


def interpolate_bilinear(
    stations: DataFrame, grid: DataFrame, values: list[str], step: float, by: list[str],
    lat: str = "latitude", lon: str = "longitude",
) -> DataFrame:
    """Regular lat/lon grid -> stations: weighted sum of the four surrounding cells.

    Stations without all four corners at a time get null.  The corners of each station are found by integer
    arithmetic.  The grid is folded to one row per time and box (the square between four cells) that has
    stations, by an equi-join on cells; its size follows the grid, however many stations a box has.  A station's value
    is then made from one row of its box, so nothing is grouped by station and time; only rows of a station
    that is listed more than once still are.
    """
    fi, fj = F.col("lat") / step, F.col("lon") / step
    i0, j0 = F.floor(fi + 1e-9), F.floor(fj + 1e-9)
    di, dj = F.greatest(fi - i0, F.lit(0.0)), F.greatest(fj - j0, F.lit(0.0))
    offsets = [(a, b) for a in (0, 1) for b in (0, 1)]
    weights = F.array(*[(di if a else 1.0 - di) * (dj if b else 1.0 - dj) for a, b in offsets])
    listed = F.count(F.lit(1)).over(Window.partitionBy("station"))
    wanted = stations.select("station", i0.alias("_i0"), j0.alias("_j0"), weights.alias("_w"), listed.alias("_listed"))
    corners = F.array(*[F.struct((F.col("_i0") + a).alias("i"), (F.col("_j0") + b).alias("j"), F.lit(n).alias("n")) for n, (a, b) in enumerate(offsets)])
    boxes = wanted.select("_i0", "_j0").distinct().select("_i0", "_j0", F.explode(corners).alias("_c")).select("_i0", "_j0", "_c.i", "_c.j", F.col("_c.n").alias("_n"))
    cells = grid.select(
        *by, *values, F.floor(F.col(lat) / step + 0.5).alias("i"), F.floor(F.col(lon) / step + 0.5).alias("j")
    )
    # Per value and corner the sum of the cell's rows, one as a rule, and over all corners their number.
    at = [F.when(F.col("_n") == n, True) for n in range(len(offsets))]
    sums = {f"_s{k}_{n}": F.sum(F.when(at[n], F.col(v))) for k, v in enumerate(values) for n in range(len(offsets))}
    counts = {f"_k{k}": F.count(v) for k, v in enumerate(values)}
    folded = cells.join(boxes, ["i", "j"]).groupBy("_i0", "_j0", *by).agg(*[a.alias(c) for c, a in {**sums, **counts}.items()])
    parts = {}
    for k in range(len(values)):
        parts[f"_v{k}"] = sum((F.col("_w")[n] * F.coalesce(F.col(f"_s{k}_{n}"), F.lit(0.0)) for n in range(len(offsets))), F.lit(0.0))
        parts[f"_k{k}"] = F.col(f"_k{k}")
    placed = folded.join(wanted, ["_i0", "_j0"]).select("station", *by, "_listed", *[c.alias(n) for n, c in parts.items()])
    once = placed.where(F.col("_listed") == 1).drop("_listed")
    again = placed.where(F.col("_listed") > 1).groupBy("station", *by).agg(*[F.sum(c).alias(c) for c in parts])
    return once.unionByName(again).select("station", *by, *[F.when(F.col(f"_k{k}") == 4, F.col(f"_v{k}")).alias(v) for k, v in enumerate(values)])


def interpolate_inverse_distance(
    stations: DataFrame, grid: DataFrame, values: list[str], by: list[str], k: int = 3,
    lat: str = "latitude", lon: str = "longitude",
) -> DataFrame:
    """Scattered grid -> stations: inverse-square-distance mean of the k nearest points."""
    near = nearest_grid_points(stations, grid, k, lat, lon)
    # A point on the station (below a centimetre) takes all the weight.
    weight = 1.0 / F.pow(F.greatest(F.col("km"), F.lit(1e-5)), 2.0)
    weighted = near.select("station", "gla", "glo", weight.alias("w"))
    placed = _with_grid_key(grid, lat, lon).join(weighted, ["gla", "glo"])
    return placed.groupBy("station", *by).agg(
        *[
            (F.sum(F.col("w") * F.col(v)) / F.sum(F.when(F.col(v).isNotNull(), F.col("w")))).alias(v)
            for v in values
        ]
    )


def mean_location(df: DataFrame) -> DataFrame:
    return df.groupBy("station").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
