"""Ordered work: path lengths, gaps, resampling, ranks, hulls, gap-filled exposures, bounded recent windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.plans.iterate import numbered


def path_length(df: DataFrame, key: str, order: list[str], x: str, y: str, z: str | None = None, closed: bool = False) -> DataFrame:
    """key, length: summed distances of consecutive rows; with `closed` back to the first."""
    w = Window.partitionBy(key).orderBy(*order)
    axes = [c for c in (x, y, z) if c]

    def gap(pairs: list[tuple[Column, Column]]) -> Column:
        return F.sqrt(sum(((b - a) * (b - a) for a, b in pairs), F.lit(0.0)))

    step = gap([(F.col(c), F.lead(c).over(w)) for c in axes])
    rows = df.withColumn("step", step)
    place = F.struct(*order)
    ends = [e for c in axes for e in (F.min_by(c, place).alias(f"first_{c}"), F.max_by(c, place).alias(f"last_{c}"))]
    total = rows.groupBy(key).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), *ends)
    if closed:
        total = total.withColumn("length", F.col("length") + gap([(F.col(f"last_{c}"), F.col(f"first_{c}")) for c in axes]))
    return total.select(key, "length")


def split_at_gaps(df: DataFrame, key: str, order: list[str], at: str, most: float) -> DataFrame:
    """Rows with `part`, from 0: a new part starts where `at` moves on by more than `most`."""
    w = Window.partitionBy(key).orderBy(*order)
    jump = F.when(F.abs(F.col(at) - F.lag(at).over(w)) > most, 1).otherwise(0)
    return df.withColumn("jump", jump).withColumn("part", F.sum("jump").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("jump")


def resampled(df: DataFrame, key: str, order: list[str], x: str, y: str, step: float) -> DataFrame:
    """key, at, x, y: points each `step` along the path, the first one included."""
    w = Window.partitionBy(key).orderBy(*order)
    d = F.hypot(F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y))
    e = df.withColumn("d", d).withColumn("nx", F.lead(x).over(w)).withColumn("ny", F.lead(y).over(w)).withColumn("s", F.sum("d").over(w) - F.col("d")).where("d > 0")
    first = F.ceil(F.col("s") / step)
    last = F.ceil((F.col("s") + F.col("d")) / step) - 1
    e = e.where(last >= first).select(key, "s", "d", x, y, "nx", "ny", F.explode(F.sequence(first, last)).alias("step_no"))
    t = (F.col("step_no") * step - F.col("s")) / F.col("d")
    return e.select(key, (F.col("step_no") * step).alias("at"), (F.col(x) + (F.col("nx") - F.col(x)) * t).alias("x"), (F.col(y) + (F.col("ny") - F.col(y)) * t).alias("y"))


def even_samples(low: Column, high: Column, n: int, whole: bool = False) -> Column:
    """Array of n evenly spaced numbers; for n of 1 or less the middle."""
    if n <= 1:
        mid = (low + high) / 2.0
        return F.array(F.floor(mid) if whole else mid)
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: low + (high - low) * k / float(n - 1))
    return F.transform(at, F.floor) if whole else at


def segment_cells(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels of segments x1, y1, x2, y2: one per step along the longer side."""
    n = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")), F.lit(1.0)).cast("int")
    x = df.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("n") + 0.5)
    return x.select(*keys, "k", at("x1", "x2").alias("u"), at("y1", "y2").alias("v"))


def relabelled(df: DataFrame, label: str, new: str) -> DataFrame:
    """Labels numbered from 0 by falling frequency, ties to the smaller label. Only counts are ranked, range by range."""
    n = df.groupBy(label).agg((F.lit(0) - F.count("*")).alias("less_"))
    return df.join(numbered(n, ["less_", label], new).drop("less_"), label)


def exposure_filled(frames: DataFrame, key: str | None = None) -> DataFrame:
    """key, id, ts, exposure: an exposure of zero becomes the mean of its positive neighbours, the one before already filled;
    with one positive neighbour that one. A series that stays unfilled anywhere is cleared to zero throughout. `key` tells
    captures apart; without it all frames are one capture, and one window.

    In a run of zeros all take the positive value before it, and the last one its mean with the value after."""
    keys = [key] if key else []
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    order = w.orderBy("id")
    e = F.when(F.col("exposure") > 0, F.col("exposure"))
    before, after = F.last(e, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lead(e).over(order)
    x = frames.select(*keys, "id", "ts", F.coalesce(e, (before + after) / 2.0, before, after, F.lit(0.0)).alias("e"))
    ok = F.min("e").over(w) > 0
    return x.select(*keys, "id", "ts", F.when(ok, F.col("e")).otherwise(F.lit(0.0)).alias("exposure"))


def exposure_means(frames: DataFrame, key: str | None = None) -> DataFrame:
    """Single gaps only, by windows: a zero exposure becomes the mean of the rows before and after."""
    w = Window.partitionBy(*([key] if key else [])).orderBy("id")
    a, b = F.lag("exposure").over(w), F.lead("exposure").over(w)
    return frames.withColumn("exposure", F.when(F.col("exposure") > 0, F.col("exposure")).otherwise((a + b) / 2.0))


def recent(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The n latest rows per key."""
    return df.withColumn("age", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where(F.col("age") <= n)


def convex_hull(df: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """key, place, x, y: hull corners counter-clockwise from the leftmost. Before a group's points meet, each of its
    slices gives only its own hull, so a large group arrives as few corners."""
    schema = f"{key} long, slice int, place int, x double, y double"

    def hull(pdf):
        pts = sorted({(a, b) for a, b in zip(pdf[x], pdf[y], strict=True) if a == a and b == b})
        turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

        def half(order):
            out = []
            for p in order:
                while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        corners = half(pts) + half(pts[::-1]) if len(pts) > 2 else pts
        import pandas as pd

        return pd.DataFrame({key: pdf[key].iloc[0], "slice": 0, "place": range(len(corners)), "x": [c[0] for c in corners], "y": [c[1] for c in corners]})

    rows = df.select(F.col(key).cast("long").alias(key), F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    part = rows.withColumn("slice", F.pmod(F.xxhash64(x, y), F.lit(64)).cast("int")).groupBy(key, "slice").applyInPandas(hull, schema)
    whole = part.select(key, F.col("x").alias(x), F.col("y").alias(y))
    return whole.groupBy(key).applyInPandas(hull, schema).select(key, "place", "x", "y")
