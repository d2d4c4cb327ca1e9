"""Streams of camera frames: keyframes decided by state, a window bounded by count, and load shedding.

State per stream is one short record, so it stays small however long the stream; the same step function runs over a batch
in order (`replay`), which the tests hold against the stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "stream long, id long, ts double, status string, n_window int, dropped long"
STATE = "last_key double, last_x double, last_y double, window string, backlog_until double"
MOST, LEAST_KEPT = 7, 2


def step(state: tuple, stream: int, frame_id: int, ts: float, x: float, y: float, rate: float, motion: float, cost: float, backlog: int) -> tuple[tuple, tuple]:
    """One frame: (new state, output row). A frame is a keyframe when 0.95 / rate seconds have gone by since the last one, or
    it moved by `motion` or more. Work on a keyframe takes `cost` seconds; while more than `backlog` of them are waiting,
    frames are shed (they get a pose and nothing else). The window holds `MOST` keyframes; the one that goes is the most
    crowded by its neighbours, never the newest `LEAST_KEPT`."""
    last, lx, ly, window, busy = state
    held = [] if not window else [(int(a), float(b)) for a, b in (w.split(":") for w in window.split(","))]
    waiting = max(0.0, busy - ts) / cost if cost > 0 else 0.0
    moved = math.hypot(x - lx, y - ly) if last == last else math.inf
    key = last != last or ts - last >= 0.95 / rate or moved >= motion
    gone = -1
    if key and waiting > backlog:
        status = "shed"
    elif key:
        status = "keyframe"
        held.append((frame_id, ts))
        last, lx, ly, busy = ts, x, y, max(busy, ts) + cost
        if len(held) > MOST:
            inner = held[:-LEAST_KEPT]
            score = lambda k: sum(1.0 / (1e-5 + abs(held[k][1] - t)) for j, (_, t) in enumerate(held) if j != k) * math.sqrt(abs(ts - held[k][1]) + 1e-5)
            k = max(range(len(inner)), key=lambda k: (score(k), -held[k][0]))
            gone = held.pop(k)[0]
    else:
        status = "tracked"
    return (last, lx, ly, ",".join(f"{a}:{b!r}" for a, b in held), busy), (stream, frame_id, ts, status, len(held), gone)


START = (math.nan, 0.0, 0.0, "", -math.inf)


def keyframes(frames: DataFrame, rate: float = 1.0, motion: float = 1.0, cost: float = 0.0, backlog: int = 3) -> DataFrame:
    """Streaming rows (stream, id, ts, x, y) to their status, through `applyInPandasWithState`."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else START
        rows = []
        for pdf in batches:
            for r in pdf.sort_values(["ts", "id"]).itertuples(index=False):
                now, out = step(now, int(key[0]), int(r.id), float(r.ts), float(r.x), float(r.y), rate, motion, cost, backlog)
                rows.append(out)
        state.update(now)
        yield pd.DataFrame(rows, columns=["stream", "id", "ts", "status", "n_window", "dropped"])

    return frames.groupBy("stream").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def replay(frames: DataFrame, rate: float = 1.0, motion: float = 1.0, cost: float = 0.0, backlog: int = 3) -> DataFrame:
    """The same over a finished table. A stream is a sequence by nature; streams are spread over tasks, and each is read in
    order from a sorted partition without being gathered."""

    def run(batches):
        stream, now = None, START
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.stream != stream:
                    stream, now = r.stream, START
                now, out = step(now, int(r.stream), int(r.id), float(r.ts), float(r.x), float(r.y), rate, motion, cost, backlog)
                rows.append(out)
            yield pd.DataFrame(rows, columns=["stream", "id", "ts", "status", "n_window", "dropped"])

    x = frames.select("stream", "id", "ts", "x", "y").repartition("stream").sortWithinPartitions("stream", "ts", "id")
    return x.mapInPandas(run, OUT)


def windowed_counts(events: DataFrame, at: str, late: str, width: str, by: str) -> DataFrame:
    """Event-time windows with a watermark: n and total of `value` per window and `by`."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there, in micro-batches, to Parquet, then stop."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def to_callback(stream: DataFrame, call, checkpoint: str) -> None:
    """Each micro-batch to call(df, epoch): the sink for keyframe updates and connectivity."""
    stream.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
