"""Past/future windows per target series.

A window starts at every row i of a series and covers `past` rows of history
followed by `steps` future rows.  It is positional: gaps in time are not
filled.  Rows past the end of the series are zeros and enter the statistics.

The series is dealt by calendar chunks (see `sequences`), so a long or hot series
is spread over many tasks, and windows are made in overlapping blocks of it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verimet.functions.clock import to_epoch_ns
from verimet.operators.projections import normalised_features
from verimet.operators.sequences import BLOCK, CHUNK, CORE, numbered, overlapping_blocks, with_position
from verimet.sources.sinks import write_bucketed

PAST = 30
BLOCK_ROWS = 2048
#: Windows that a task holds as arrays at once.
WINDOWS_AT_ONCE = 2048


def future_steps(model: str, fh: int) -> int:
    """Rows that cover `fh` hours: hourly HRRR, 3-hourly GFS and NAM."""
    name = model.upper()
    if name == "HRRR":
        return fh
    if name == "GFS":
        return fh // 3
    if name == "NAM":
        return (fh + 2) // 3
    raise KeyError(f"unknown forecast model {model!r}")


def future_steps_column(model: str, fh: Column) -> Column:
    name = model.upper()
    if name == "HRRR":
        return fh.cast("int")
    return F.floor((fh if name == "GFS" else fh + 2) / 3).cast("int")


# Observation columns of a station, and stations of a cluster by forecast model.
OBSERVED_COLUMNS = 16
CLUSTER_STATIONS = {"HRRR": 4, "NAM": 4, "GFS": 5}


def persisted_features(model: str, features: Sequence[str]) -> list[str]:
    """The features whose future isn't known: the observations of the cluster's stations, which come last."""
    width = CLUSTER_STATIONS[model.upper()] * OBSERVED_COLUMNS
    return list(features)[-width:]


def _near(reach: int) -> Column:
    """Chunks that a row follows as one of their next `reach` rows."""
    return F.filter("_of.homes", lambda h: F.col("_pos") < h["end"] + reach)


def store_layout(
    df: DataFrame, keys: Sequence[str], name: str, path: str, order: str = "valid_time", past: int = PAST, max_steps: int = 18,
    block_rows: int = BLOCK_ROWS, ties: Sequence[str] = (), buckets: int = 200, counted: DataFrame | None = None,
) -> DataFrame:
    """Save the series as table `name`, numbered, cut into overlapping blocks and bucketed by (keys, chunk); returns it.

    Series are numbered and dealt once, by key and chunk, when the table is written; blocks of `block_rows` rows are cut inside
    the chunks, and only rows that follow another chunk travel again.  Windows of any features, targets and lengths within
    its reach (`past` + `max_steps` - 1 rows) then need no exchange: every bucket holds whole blocks.
    """
    reach = past + max_steps - 1
    size = max(block_rows, reach)
    further = [c for c in df.columns if c not in (*keys, order, *ties)]
    # Rows without a time lie in a chunk that comes first and that a join finds.
    month = F.coalesce(F.trunc(F.col(order), "MM"), F.lit("0001-01-01").cast("date"))
    rows = numbered(df, keys, [order, *ties, *_sortable(df, further)], month, reach, counted=counted, parts=buckets)
    inside = overlapping_blocks(rows, "_rank", size, reach).drop("_of", "_rank")
    copied, home = rows.where(F.size("_of.homes") > 0).withColumn("_home", F.explode(_near(reach))), F.col("_home")
    final = F.floor((home["end"] - home["first"] - 1) / size)
    both = (final > 0) & (F.col("_pos") - home["first"] < final * size + reach)
    copied = copied.withColumns({CHUNK: home["chunk"], BLOCK: F.explode(F.when(both, F.array(final, final - 1)).otherwise(F.array(final))), CORE: F.lit(False)})
    blocks = inside.unionByName(copied.drop("_of", "_rank", "_home").repartition(buckets, *keys, CHUNK))
    blocks.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys, CHUNK).sortBy(*keys, CHUNK, BLOCK, "_pos").saveAsTable(name)
    return df.sparkSession.table(name)


def _by_chunk(table: DataFrame, keys: Sequence[str], per_key: DataFrame) -> DataFrame:
    """Rows of `per_key` for every chunk of a layout, which lies by key and chunk and so isn't dealt again to meet them."""
    return table.select(*keys, CHUNK).distinct().join(per_key, list(keys)).hint("shuffle_hash")


def _sortable(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Plain columns: rows of equal time and ties differ in none of them or have an order."""
    return [c for c in columns if isinstance(df.schema[c].dataType, T.AtomicType)]


class _Shape(NamedTuple):
    kept: list[str]
    order: str
    along: list[str]
    features: list[str]
    scaled: frozenset[str]
    persisted: frozenset[str]
    past: int
    max_steps: int
    last_valid: bool
    with_x: bool
    block_rows: int


class Series(NamedTuple):
    """Windows that aren't made yet: rows in the order a task makes them from, and what a window is."""

    rows: DataFrame
    shape: _Shape
    schema: T.StructType
    table: DataFrame
    again: partial[Series]

    def per_key(self, models: DataFrame, small: bool = False) -> Series:
        """The windows of a layout with the columns of their key's row in `models`, which is broadcast if `small`; keys without one are skipped."""
        return self.again(self.table, per_key=self._to_meet(models, small))

    def _to_meet(self, models: DataFrame, small: bool) -> DataFrame:
        return F.broadcast(models) if small else _by_chunk(self.table, self.again.keywords["keys"], models)

    def only(self, kept: DataFrame, name: str, path: str, buckets: int, small: bool = False) -> Series:
        """The windows of the keys in `kept` from a smaller layout, saved as table `name`; these are from a layout, too."""
        keys = self.again.keywords["keys"]
        met = self._to_meet(kept, small)
        left = self.table.join(met, met.columns, "left_semi")
        write_bucketed(left, name, path, [*keys, CHUNK], buckets, [*keys, CHUNK, BLOCK, "_pos"])
        return self.again(self.table.sparkSession.table(name))

    def frame(self) -> DataFrame:
        """One row per window."""
        shape = self.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return windows_of(batches, shape)

        return self.rows.mapInArrow(run, self.schema)


def build_windows(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    persisted: Sequence[str] = (),
    target: str = "target_error",
    order: str = "valid_time",
    past: int = PAST,
    steps: Column | int = 1,
    max_steps: int = 18,
    normalise: Sequence[str] | None = None,
    last_valid: bool = False,
    block_rows: int = BLOCK_ROWS,
    with_x: bool = True,
    ties: Sequence[str] = (),
    laid_out: bool = False,
    per_key: DataFrame | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """One row per start row: `x` (past+steps structs), `y` (steps), `future_times` (ns, 0 padded).

    `init_time` is the time of the last past row, null when the series ends before it;
    `last` holds that row's scaled features, so narrow uses need not build `x`.

    The input is read twice (row counts, then rows): feed a stored table when
    computing it is expensive, or count the same rows in a frame that is cheaper.

    features    columns of x, in order
    persisted   subset whose future rows repeat the last past value
    normalise   subset that is z-scored with the past rows (default: by name rule)
    steps       future rows, a number or a per-key column; at most `max_steps`
    last_valid  persist the last non-null past value instead of the last row's
    block_rows  rows of a block; with the rows that follow it, a block is all that its windows are made from
    ties        further columns that order rows of equal time
    with_x      build `x`; without it only targets and times of the future rows are gathered
    laid_out    `df` is a table of `store_layout` with at least this reach: it is read as it lies, without an exchange
    per_key     one row per key (a model, say), whose further columns every window shows; keys without one are skipped
    counted     a frame with the same rows by keys and order, in which they are counted instead

    Spark numbers the rows and deals them once, by key and calendar chunk; a task cuts the blocks and makes their windows,
    some thousand at a time, as arrays.  Only rows at the border of two chunks travel again.
    """
    return window_series(
        df, keys, features, persisted, target, order, past, steps, max_steps, normalise, last_valid, block_rows, with_x, ties, laid_out, per_key,
        counted).frame()


def window_series(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], persisted: Sequence[str] = (), target: str = "target_error",
    order: str = "valid_time", past: int = PAST, steps: Column | int = 1, max_steps: int = 18, normalise: Sequence[str] | None = None,
    last_valid: bool = False, block_rows: int = BLOCK_ROWS, with_x: bool = True, ties: Sequence[str] = (), laid_out: bool = False,
    per_key: DataFrame | None = None, counted: DataFrame | None = None,
) -> Series:
    """What `build_windows` makes its windows from, for those that use windows where they are made."""
    again = partial(
        window_series, keys=keys, features=features, persisted=persisted, target=target, order=order, past=past, steps=steps, max_steps=max_steps,
        normalise=normalise, last_valid=last_valid, block_rows=block_rows, with_x=with_x, ties=ties, laid_out=laid_out, counted=counted)
    scaled = set(normalised_features(features) if normalise is None else normalise)
    steps = F.lit(steps) if isinstance(steps, int) else steps
    reach = past + max_steps - 1

    along = [c for c in per_key.columns if c not in (*keys, CHUNK)] if per_key is not None else []
    shown = [steps.cast("int").alias("_steps"), F.col(target).cast("double").alias("_y"), to_epoch_ns(F.col(order)).alias("_t"),
             *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)]]
    values = ["_steps", "_y", "_t", *(f"_f{i}" for i in range(len(features)))]
    placed = [*keys, order, *along, "start"]
    if laid_out:
        blocks = df if per_key is None else df.join(per_key, [c for c in (*keys, CHUNK) if c in per_key.columns])
        begins = F.row_number().over(Window.partitionBy(*keys, CHUNK, BLOCK).orderBy("_pos")) == 1
        rows = blocks.withColumn("_begins", begins).select(
            *keys, order, *along, F.col("_pos").alias("start"), F.col(CORE).alias("_own"), "_begins", *shown)
    else:
        # Rows that nothing else tells apart are ordered by what they hold, so both readings below agree.
        held = [c for c in dict.fromkeys([*features, target]) if c not in (*keys, order, *ties)]
        chunked = numbered(df, keys, [order, *ties, *_sortable(df, held)], F.trunc(F.col(order), "MM"), reach, per_key, counted)
        chunked = chunked.select(
            *keys, order, *[F.col("_of")[c].alias(c) for c in along], F.col("_pos").alias("start"), CHUNK, "_rank", "_pos", "_of", *shown)
        # Windows that end in their chunk, or beyond the series, are made where it lies.
        within = (F.col("_rank") + reach < F.col("_of.rows")) | F.col("_of.final")
        inside = chunked.select(*placed, within.alias("_own"), (F.col("_rank") == 0).alias("_begins"), *values)
        # For the others the last rows of a chunk meet those that follow it.
        itself = F.array(F.struct(F.col(CHUNK).alias("chunk"), F.lit(True).alias("own")))
        near = F.transform(_near(reach), lambda h: F.struct(h["chunk"].alias("chunk"), F.lit(False).alias("own")))
        border = chunked.where(~within | (F.size("_of.homes") > 0)).withColumn("_at", F.explode(F.when(within, near).otherwise(F.concat(itself, near))))
        border = border.select(*placed, F.col("_at.chunk").alias(CHUNK), F.col("_at.own").alias("_own"), *values)
        begins = F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy("start")) == 1
        rows = inside.unionByName(border.withColumn("_begins", begins).select(*inside.columns))
    kept = [*keys, order, "start"]
    cell = T.StructType([T.StructField(f, T.DoubleType()) for f in features])
    fields = [*[rows.schema[c] for c in kept], T.StructField("init_time", rows.schema[order].dataType), T.StructField("last", cell)]
    if with_x:
        fields.append(T.StructField("x", T.ArrayType(cell)))
    fields += [T.StructField("y", T.ArrayType(T.DoubleType())), T.StructField("future_times", T.ArrayType(T.LongType()))]
    fields += [rows.schema[c] for c in along]
    shape = _Shape(
        kept, order, list(along), list(features), frozenset(scaled), frozenset(persisted), past, max_steps, last_valid, with_x, max(block_rows, reach))
    return Series(rows, shape, T.StructType(fields), df, again)


def windows_of(batches: Iterator[pa.RecordBatch], shape: _Shape) -> Iterator[pa.RecordBatch]:
    """Windows of the own rows of a task, some thousand at a time."""
    for rows, until in _pieces(batches, shape.past + shape.max_steps - 1):
        yield from _windows_of(rows, until, shape)


def _pieces(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Rows, and up to which of them windows can be made; the others wait for the `reach` rows that follow or for the next series."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        begins = np.flatnonzero(rows.column("_begins").to_numpy(zero_copy_only=False))
        until = max(int(begins[-1]) if len(begins) else 0, rows.num_rows - reach)
        if until:
            yield rows, until
        held = rows.slice(until)
    if held is not None and held.num_rows:
        yield held, held.num_rows


def _known(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, zero where there is none, and where there is one."""
    zero = pa.scalar(0, column.type)
    return column.fill_null(zero).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _windows_of(rows: pa.RecordBatch, until: int, shape: _Shape) -> Iterator[pa.RecordBatch]:
    """Windows of the own ones of the first `until` rows, some thousand at a time; the first row begins or goes on with a series."""
    column = dict(zip(rows.schema.names, rows.columns, strict=True))
    begins = np.union1d([0], np.flatnonzero(column["_begins"].to_numpy(zero_copy_only=False)))
    lengths = np.diff(np.append(begins, rows.num_rows))
    within = np.ones(rows.num_rows, bool)
    within[begins] = False
    start = _known(column["start"])[0]
    if (np.diff(start)[within[1:]] != 1).any():
        raise ValueError("the rows of a block are not in order")
    # A block ends with the rows that follow it, or with its series.
    left = shape.block_rows - start % shape.block_rows + shape.past + shape.max_steps - 1
    ends = np.minimum(np.repeat(begins + lengths, lengths), np.arange(rows.num_rows) + left)
    own = np.flatnonzero(column["_own"].to_numpy(zero_copy_only=False)[:until])
    values = [_known(column[f"_f{i}"]) for i in range(len(shape.features))]
    target, times = _known(column["_y"]), _known(column["_t"])
    steps, told = _known(column["_steps"])
    if (steps < 0).any():
        raise ValueError("a window has fewer than no future rows")
    for k in range(0, len(own), WINDOWS_AT_ONCE):
        at = own[k:k + WINDOWS_AT_ONCE]
        yield _made(column, at, ends[at], steps[at], told[at], values, target, times, shape)


def _made(column, at, ends, steps, told, values, target, times, shape: _Shape) -> pa.RecordBatch:
    past, n = shape.past, len(at)
    reach = past + shape.max_steps
    width = past + max(shape.max_steps, int(steps.max(initial=0)))
    place = at[:, None] + np.arange(width)
    real = place < ends[:, None]
    real[:, reach:] = False
    place = np.where(real, place, 0)
    zeros = not real.all()

    def gathered(known: tuple[np.ndarray, np.ndarray], part: slice = slice(None)) -> tuple[np.ndarray, np.ndarray | None]:
        """Rows of the windows, zeros beyond the end, and where a value isn't null (None: everywhere)."""
        cells = known[0][place[:, part]]
        if zeros:
            cells[~real[:, part]] = 0
        return cells, None if known[1].all() else known[1][place[:, part]] | ~real[:, part]

    ahead = np.arange(width - past) < steps[:, None]
    chosen = np.concatenate([np.ones((n, past), bool), ahead], axis=1)
    chosen[~told] = False
    unknown = None if told.all() else pa.array(~told)

    def lists(flat: pa.Array, shown: np.ndarray) -> pa.Array:
        offsets = np.append(0, np.cumsum(shown.sum(axis=1))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=unknown)

    def flat(cells: np.ndarray, valid: np.ndarray | None, shown: np.ndarray) -> pa.Array:
        return pa.array(cells[shown], mask=None if valid is None else ~valid[shown])

    last, cells_of = [], []
    for name, known in zip(shape.features, values, strict=True):
        cells, valid = gathered(known, slice(None) if shape.with_x else slice(past))
        mean, spread, some = np.zeros(n), np.ones(n), None
        if name in shape.scaled:
            mean, spread, some = _scale(cells[:, :past], None if valid is None else valid[:, :past])
            cells = (cells - mean[:, None]) / spread[:, None]
            if some is not None:
                valid = valid & some[:, None]
        held, known_held = cells[:, past - 1], None if valid is None else valid[:, past - 1]
        last.append(pa.array(held, mask=None if known_held is None else ~known_held))
        if not shape.with_x:
            continue
        if name in shape.persisted and shape.last_valid and (zeros or valid is not None):
            seen = real[:, :past] if valid is None else real[:, :past] & valid[:, :past]
            newest = past - 1 - np.argmax(seen[:, ::-1], axis=1)
            held, known_held = cells[np.arange(n), newest], seen.any(axis=1)
        if name in shape.persisted:
            cells[:, past:] = held[:, None]
            if known_held is not None:
                valid = np.ones(cells.shape, bool) if valid is None else valid
                valid[:, past:] = known_held[:, None]
        cells_of.append(flat(cells, valid, chosen))
    ahead = chosen[:, past:]
    future = slice(past, None)
    newest = pa.array(at + past - 1, mask=~real[:, past - 1])
    here = pa.array(at)
    out = [
        *[column[c].take(here) for c in shape.kept], column[shape.order].take(newest), pa.StructArray.from_arrays(last, shape.features),
        *([lists(pa.StructArray.from_arrays(cells_of, shape.features), chosen)] if shape.with_x else []),
        lists(flat(*gathered(target, future), ahead), ahead), lists(flat(*gathered(times, future), ahead), ahead),
        *[column[c].take(here) for c in shape.along],
    ]
    names = [*shape.kept, "init_time", "last", *(["x"] if shape.with_x else []), "y", "future_times", *shape.along]
    return pa.RecordBatch.from_arrays(out, names)


def _scale(past: np.ndarray, valid: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Mean and spread of past rows; all nulls have neither, which the third value tells (None: all windows have both).

    Zero rows beyond the end count as values, nulls do not; the spread is taken after filling nulls
    with the mean, hence the division by all past rows.
    """
    rows = past.shape[1]
    if valid is None:
        mean = past.sum(axis=1) / rows
        off = past - mean[:, None]
        some = None
    else:
        count = valid.sum(axis=1)
        some = count > 0
        mean = past.sum(axis=1) / np.maximum(count, 1)
        off = np.where(valid, past - mean[:, None], 0.0)
    spread = np.sqrt(np.einsum("ij,ij->i", off, off) / rows)
    return mean, np.where(spread < 1e-8, 1.0, spread), some


def with_data(windows: DataFrame) -> DataFrame:
    """Drop items without data."""
    return windows.where(F.col("x").isNotNull() & (F.size("x") > 0))


def window_images(
    df: DataFrame, keys: Sequence[str], image: str, order: str = "valid_time", past: int = PAST,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Image of the first future row, clamped to the series' last row.

    `image` holds one image per station of the cluster.  A missing one becomes
    zeros shaped like another of the same row; all missing is an error.
    """
    rows = with_position(df, keys, [order], F.trunc(F.col(order), "MM"), "_pos")
    blocks = overlapping_blocks(rows, "_pos", max(block_rows, past + 1), past)
    series = Window.partitionBy(*keys, BLOCK).orderBy("_pos")
    chosen = F.last(F.struct(F.col(image).alias("v"))).over(series.rowsBetween(0, past))["v"]
    picked = blocks.withColumn("_img", chosen).where(F.col(CORE))
    reference = F.filter("_img", lambda m: m.isNotNull())[0]
    zeros = _zeros_like(reference, df.schema[image].dataType.elementType)
    filled = F.when(
        F.exists("_img", lambda m: m.isNotNull()), F.transform("_img", lambda m: F.coalesce(m, zeros))
    ).otherwise(F.raise_error(F.lit("no image for any station of the cluster")))
    return picked.select(*keys, order, F.col("_pos").alias("start"), filled.alias("images"))


def _zeros_like(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _zeros_like(v, kind.elementType))
    return F.lit(0).cast(kind)


def profile_images(
    df: DataFrame, channels: Sequence[str], time: str = "time", height: str = "range", station: str = "station"
) -> DataFrame:
    """Per station-hour image [height][time][channel]; a missing cell is null.

    Cells are folded to one row per (hour, height, time), then gathered by height, then by
    hour, so a group is bounded by the instrument's heights x scans per hour, not by the
    number of raw rows.  A height seen at every scan is an image row as it is.
    """
    cells = df.groupBy(station, F.window(time, "1 hour").alias("_w"), F.col(height).alias("_h"), F.col(time).alias("_t")).agg(
        *[F.max(c).alias(c) for c in channels]
    )
    value = F.array(*[F.col(c).cast("double") for c in channels])
    rows = cells.groupBy(station, F.col("_w.start").alias("valid_time"), "_h").agg(
        F.sort_array(F.collect_list(F.struct("_t", value.alias("v")))).alias("cells"))
    grouped = rows.groupBy(station, "valid_time").agg(F.sort_array(F.collect_list(F.struct("_h", "cells"))).alias("rows"))
    times = F.array_sort(F.array_distinct(F.flatten(F.transform("rows", lambda r: F.transform(r["cells"], lambda c: c["_t"])))))
    empty = F.array_repeat(F.lit(None).cast("double"), len(channels))

    def row(r: Column) -> Column:
        gaps = F.transform("times", lambda t: F.coalesce(F.get(F.filter(r["cells"], lambda c: c["_t"] == t), F.lit(0))["v"], empty))
        return F.when(F.size(r["cells"]) == F.size("times"), F.transform(r["cells"], lambda c: c["v"])).otherwise(gaps)

    return grouped.withColumn("times", times).select(
        station, "valid_time", F.transform("rows", lambda r: r["_h"]).alias("heights"), "times", F.transform("rows", row).alias("image"))


def profile_cells(images: DataFrame, station: str = "station") -> DataFrame:
    """Long form of images: (station, valid_time, h, t, channel, value)."""
    return (
        images.select(station, "valid_time", F.posexplode("image").alias("h", "_r"))
        .select(station, "valid_time", "h", F.posexplode("_r").alias("t", "_p"))
        .select(station, "valid_time", "h", "t", F.posexplode("_p").alias("channel", "value"))
    )


def channel_scaling(images: DataFrame) -> DataFrame:
    """Mean and sample deviation per channel over all images, rows and columns."""
    return profile_cells(images).groupBy("channel").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
    )


def scale_channels(images: DataFrame, scaling: DataFrame) -> DataFrame:
    """Images with every channel z-scored; `scaling` has one row per channel."""
    packed = scaling.agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct("mean", "sd")))).alias("m"))
    table = packed.select("m").scalar()

    def cell(v: Column, c: Column) -> Column:
        return (v - F.col("_s")[c]["mean"]) / F.col("_s")[c]["sd"]

    return images.withColumn("_s", table).withColumn(
        "image", F.transform("image", lambda r: F.transform(r, lambda p: F.transform(p, cell)))
    ).drop("_s")


def latest_snapshot(df: DataFrame, now=None, ts: str = "valid_time") -> DataFrame:
    """Rows at `now` when there are any, else at the newest time."""
    newest = df.agg(
        F.coalesce(F.max(F.when(F.col(ts) == F.lit(now).cast("timestamp_ntz"), F.col(ts))), F.max(ts)).alias("t")
    ).scalar() if now is not None else df.agg(F.max(ts).alias("t")).scalar()
    return df.where(F.col(ts) == newest)
