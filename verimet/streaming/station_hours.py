"""Hourly tables from a stream, with the state of many stations in one place.

A gauge shows a running total, so a row's amount needs the row before it in event time, which
may come later, in another batch, or twice.  The state of a station is the rows of hours that are still
open and the last total before them.  When the watermark passes the end of an hour, no earlier row can
arrive any more: its rows are put in order, their steps are taken from the carried total, and the
hour is emitted once.  A timer on the watermark closes hours of stations that fall silent.

Stations are dealt to a fixed number of parts by their hash.  A part is one state and one call a batch, in which
its stations are folded together as arrays; a call for each station would cost more than its few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verimet.operators.resample import MAX_GAUGE_STEP
from verimet.streaming.increments import _event_time

HOUR = 3_600_000_000  # microseconds
#: Parts that the stations are dealt to; a checkpoint keeps the number it began with.
PARTS = 256
_STATE = "stations binary, last binary, rows binary"

Reducer = Callable[[pd.DataFrame, np.ndarray], tuple[pd.DataFrame, np.ndarray]]


def closed_hours(
    stream: DataFrame, values: Sequence[str], reduce: Reducer, out: Sequence[str], right: bool = False, hours: int = 1,
    ts: str = "time_5M", tie: str = "event_id", delay: str = "2 hours", station: str = "station", parts: int = PARTS,
) -> DataFrame:
    """Rows (station, valid_time, out...) of the bins that the watermark has passed, each emitted once.

    `reduce(rows, last)` gets rows of one or more closed bins of many stations, in order of (sid, time, tie), as columns
    `sid` (the station's number), `bin` (label in microseconds), `at`, `tie` and the values, and by `sid` the numbers
    that the former call returned (NaN at first); it returns a frame with `sid`, `bin` and the outputs, and the numbers to carry.
    Bins are closed and labelled on the left, or both on the `right`.  A row that comes again (same time
    and tie) counts once; rows later than `delay` behind the newest are left out, as are rows without a time.  The state
    of a station is the rows of its open bins, at most those of `delay` and one bin, and one number; a task holds that
    of one of `parts` parts of the stations and the part's rows of a batch.
    """
    size, names = hours * HOUR, list(values)
    row = np.dtype([("sid", "<i8"), ("at", "<i8"), ("tie", "<i8"), *[(n, "<f8") for n in names]])
    rows = stream.where(F.col(ts).isNotNull()).select(station, ts, tie, *[F.col(n).cast("double").alias(n) for n in names])
    rows = _event_time(rows, ts).withWatermark(ts, delay).withColumn("_at", F.unix_micros(ts)).withColumnRenamed(tie, "_tie")
    rows = rows.withColumns({
        "_tie": F.coalesce(F.col("_tie").cast("long"), F.lit(-(2**63))), "_part": F.pmod(F.xxhash64(station), F.lit(parts))})
    kind = rows.schema[station]
    schema = T.StructType([kind, T.StructField("valid_time", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in out]])
    arrow = to_arrow_type(kind.dataType)

    def packed(stations: pa.Array) -> bytes:
        sink, batch = pa.BufferOutputStream(), pa.RecordBatch.from_arrays([stations], ["station"])
        with pa.ipc.new_stream(sink, batch.schema) as file:
            file.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, last, held = pa.array([], arrow), np.zeros(0), np.zeros(0, row)
        if state.exists:
            stations, numbers, open_rows = state.get
            known = pa.ipc.open_stream(stations).read_all().column(0).combine_chunks()
            last, held = np.frombuffer(numbers), np.frombuffer(open_rows, row)
        if not state.hasTimedOut:
            pieces, named = [held], [known]
            for frame in frames:
                new = np.zeros(len(frame), row)
                new["at"], new["tie"] = frame["_at"], frame["_tie"]
                for n in names:
                    new[n] = frame[n].to_numpy(float)
                pieces.append(new)
                named.append(pa.array(frame[station], arrow, from_pandas=True))
            coded = pa.chunked_array(named, arrow).combine_chunks().dictionary_encode("encode")  # known stations keep their numbers
            held, codes = np.concatenate(pieces), coded.indices.to_numpy()
            held["sid"][len(pieces[0]):] = codes[len(known):]
            known = coded.dictionary
            last = np.r_[last, np.full(len(known) - len(last), np.nan)]
        held = held[np.lexsort((held["tie"], held["at"], held["sid"]))]
        again = np.zeros(len(held), bool)
        again[1:] = np.logical_and.reduce([held[n][1:] == held[n][:-1] for n in ("sid", "at", "tie")])
        held = held[~again]
        mark = state.getCurrentWatermarkMs() * 1000 // size * size  # bins that end here or before are complete
        done = held["at"] <= mark if right else held["at"] < mark
        closed, held = held[done], held[~done]
        if len(closed):
            frame = pd.DataFrame({n: closed[n] for n in row.names})
            frame["bin"] = -(-frame["at"] // size) * size if right else frame["at"] // size * size
            made, last = reduce(frame, last)
            labels = pd.DataFrame({station: known.take(pa.array(made["sid"].to_numpy())).to_pandas(), "valid_time": made["bin"].to_numpy()})
            yield pd.concat([labels, made[list(out)].reset_index(drop=True)], axis=1)
        state.update((packed(known), last.astype(float).tobytes(), held.tobytes()))
        if len(held):
            first = int(held["at"].min())
            state.setTimeoutTimestamp((-(-first // size) if right else first // size + 1) * size // 1000)

    bins = rows.groupBy("_part").applyInPandasWithState(advance, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return bins.withColumn("valid_time", F.timestamp_micros("valid_time").cast("timestamp_ntz"))


def _gauge_hours(sampled: Sequence[str], hours: int) -> Reducer:
    def reduce(rows: pd.DataFrame, last: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
        sid, total = rows["sid"].to_numpy(), rows["precip_total"].to_numpy()
        begins, ends = np.r_[True, sid[1:] != sid[:-1]], np.r_[sid[1:] != sid[:-1], True]
        step = total - np.where(begins, last[sid], np.r_[np.nan, total[:-1]])
        step[step > MAX_GAUGE_STEP] = np.nan
        rows = rows.assign(precip_step=np.maximum(step, 0.0))
        bins = rows.groupby(["sid", "bin"])
        out = bins.agg(precip_total=("precip_step", "sum"), wspd_sonic_mean=("wspd_sonic", "mean"))
        on_hour = rows[(rows["at"] % HOUR < 60_000_000) & (rows["at"] // HOUR % hours == 0)]
        top = on_hour.drop_duplicates(["sid", "bin"]).set_index(["sid", "bin"])
        for n in sampled:
            out[n] = top[n].reindex(out.index)
        last = last.copy()
        last[sid[ends]] = total[ends]
        return out.reset_index(), last

    return reduce


def station_hours(stream: DataFrame, sampled: Sequence[str] = (), hours: int = 1, ts: str = "time_5M", tie: str = "event_id", delay: str = "2 hours", parts: int = PARTS) -> DataFrame:
    """The hourly station table of a stream: gauge sums, wind mean and the sample on the hour (left bins)."""
    values = list(dict.fromkeys(["precip_total", "wspd_sonic", *sampled]))
    out = [*sampled, "wspd_sonic_mean", "precip_total"]
    return closed_hours(stream, values, _gauge_hours(sampled, hours), out, False, hours, ts, tie, delay, parts=parts)


def _report_hours(last: Sequence[str]) -> Reducer:
    def reduce(rows: pd.DataFrame, carried: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
        bins = rows.groupby(["sid", "bin"])
        out = bins[list(last)].last()  # the last that isn't missing
        out["wspd_sonic_mean"] = bins["wspd_sonic"].mean()
        out["wmax_sonic"] = bins["wmax_sonic"].max()
        out["precip_total"] = bins["precip_total"].sum()
        return out.reset_index(), carried

    return reduce


def airport_hours(stream: DataFrame, last: Sequence[str] = ("tair", "wspd_sonic"), ts: str = "valid_time", tie: str = "event_id", delay: str = "2 hours", parts: int = PARTS) -> DataFrame:
    """Right-closed airport hours of a stream: last known values, wind mean, gust maximum, precipitation sum.

    Hours without reports have no row; `resample.on_spine` adds them to the stored table.
    """
    values = list(dict.fromkeys([*last, "wspd_sonic", "wmax_sonic", "precip_total"]))
    out = [*last, "wspd_sonic_mean", "wmax_sonic", "precip_total"]
    return closed_hours(stream, values, _report_hours(last), out, True, 1, ts, tie, delay, parts=parts)
