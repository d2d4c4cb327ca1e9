"""Neighbourhood joins of point tables by grid cells.

A cell is the integer part of each coordinate over a cell size. Two points within one cell size are in the same or in
touching cells, so a radius join is an equi-join on the cell after one side is copied to the 27 cells around its own;
the residual test is exact. Tables have pid, x, y, z; extra columns stay in their side's struct.
A crowded cell makes a skewed join, which adaptive execution splits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.plans.iterate import Scratch

AXES = ("x", "y", "z")


def cell(size: float, axes=AXES) -> Column:
    return F.struct(*[F.floor(F.col(a) / F.lit(float(size))).alias(f"c{a}") for a in axes])


def spread_bits(v: Column) -> Column:
    """21 bits of a number with two empty bits after each."""
    v = v.cast("long").bitwiseAND(F.lit(0x1FFFFF))
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def gather_bits(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(0x1249249249249249))
    for shift, mask in ((2, 0x10C30C30C30C30C3), (4, 0x100F00F00F00F00F), (8, 0x1F0000FF0000FF), (16, 0x1F00000000FFFF), (32, 0x1FFFFF)):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(i: Column, j: Column, k: Column, level: int = 21) -> Column:
    """Interleaved cell code; `level` keeps the first 3 * level bits."""
    code = spread_bits(i).bitwiseOR(F.shiftleft(spread_bits(j), 1)).bitwiseOR(F.shiftleft(spread_bits(k), 2))
    return F.shiftright(code, 3 * (21 - level))


def morton_cell(code: Column) -> Column:
    return F.struct(gather_bits(code).alias("i"), gather_bits(F.shiftright(code, 1)).alias("j"), gather_bits(F.shiftright(code, 2)).alias("k"))


def bounds(points: DataFrame) -> dict[str, float]:
    r = points.agg(*[f(a).alias(f"{n}_{a}") for a in AXES for f, n in ((F.min, "low"), (F.max, "high"))], F.count("*").alias("n")).first()
    return r.asDict()


def indexed(points: DataFrame, level: int = 21) -> DataFrame:
    """Points with their Morton code over the cube around all, range-partitioned and sorted by it."""
    b = bounds(points)
    side = max([(b[f"high_{a}"] or 0.0) - (b[f"low_{a}"] or 0.0) for a in AXES] + [1e-12])
    grid = [F.least(F.floor((F.col(a) - F.lit(b[f"low_{a}"])) / side * (1 << 21)), F.lit((1 << 21) - 1)).cast("long") for a in AXES]
    return points.withColumn("code", morton(*grid, level=level)).repartitionByRange("code").sortWithinPartitions("code")


def size_for(points: DataFrame, per_cell: float = 4.0) -> float:
    """A cell size that holds about `per_cell` points where the points fill their box evenly."""
    b = bounds(points)
    sides = [max((b[f"high_{a}"] or 0.0) - (b[f"low_{a}"] or 0.0), 1e-9) for a in AXES]
    return max((math.prod(sides) * per_cell / max(b["n"], 1)) ** (1 / 3), max(sides) / (1 << 20))


def around(size: float, rings: int = 1) -> Column:
    """The cells at up to `rings` steps from a point's own."""
    steps = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for d, a in zip((i, j, k), AXES, strict=True)]) for i in range(-rings, rings + 1) for j in range(-rings, rings + 1) for k in range(-rings, rings + 1)])
    own = cell(size)
    return F.transform(steps, lambda s: F.struct(*[(own[f"c{a}"] + s[f"d{a}"]).alias(f"c{a}") for a in AXES]))


def squared(a: str = "a", b: str = "b") -> Column:
    d = [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in AXES]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def radius_join(left: DataFrame, right: DataFrame, radius: float, strict: bool = False) -> DataFrame:
    """Pairs (a, b, d2): structs of a left and a right row at most (or strictly less than) `radius` apart."""
    p = left.select(F.struct("*").alias("a"), F.explode(around(radius)).alias("cell"))
    q = right.select(F.struct("*").alias("b"), cell(radius).alias("cell"))
    near = F.col("d2") < radius * radius if strict else F.col("d2") <= radius * radius
    return p.join(q, "cell").select("a", "b", squared().alias("d2")).where(near)


def annulus_join(left: DataFrame, right: DataFrame, distance: float, tolerance: float) -> DataFrame:
    """Pairs whose distance is within `tolerance` of `distance`."""
    return radius_join(left, right, distance + tolerance).where(F.sqrt("d2").between(distance - tolerance, distance + tolerance))


def exists_within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Left rows with a right row strictly nearer than `radius`."""
    found = radius_join(left, right, radius, strict=True).select("a.pid").distinct()
    return left.join(found, "pid", "left_semi")


def none_within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    found = radius_join(left, right, radius, strict=True).select("a.pid").distinct()
    return left.join(found, "pid", "left_anti")


def knn_join(left: DataFrame, right: DataFrame, k: int, include_self: bool = False, max_distance: float | None = None, size: float | None = None) -> DataFrame:
    """(a, b, d2, rank): for each left row its k nearest right rows, ties to the smaller pid.

    Round by round: a left row is done when its k-th hit is no farther than the cell size, which the 27 cells around it
    guarantee to be complete; the others go on with doubled cells, until nobody is left or a cell spans everything.
    """
    scratch = Scratch(left.sparkSession)
    size = size or size_for(right, 2.0 * k)
    b, c = bounds(left), bounds(right)
    if not b["n"] or not c["n"]:
        return radius_join(left, right, 1.0).withColumn("rank", F.lit(0)).where("false")
    reach = 2.0 * math.sqrt(sum((max(b[f"high_{a}"], c[f"high_{a}"]) - min(b[f"low_{a}"], c[f"low_{a}"])) ** 2 for a in AXES)) + 1e-9
    if max_distance is not None:
        reach = min(reach, max_distance)
    order = Window.partitionBy("a.pid").orderBy("d2", "b.pid")
    done, going = None, left
    while True:
        size = min(size, reach)
        x = radius_join(going, right, size)
        if not include_self:
            x = x.where("a.pid <> b.pid")
        x, _ = scratch.cut(x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        if size >= reach:
            return x if done is None else done.unionByName(x)
        full = x.where(F.col("rank") == k).select("a.pid")
        hits = x.withColumn("pid", F.col("a.pid")).join(full, "pid", "left_semi").drop("pid")
        done = hits if done is None else done.unionByName(hits)
        going, _ = scratch.cut(going.join(full, "pid", "left_anti"))
        if not going.limit(1).count():
            return done
        size *= 2.0


def nearest(left: DataFrame, right: DataFrame, max_distance: float | None = None) -> DataFrame:
    """pid, nearest_pid, distance: each left row's nearest right row; beyond `max_distance` that distance and no id."""
    x = knn_join(left, right, 1, include_self=True, max_distance=max_distance)
    x = x.select(F.col("a.pid").alias("pid"), F.col("b.pid").alias("nearest_pid"), F.sqrt("d2").alias("distance"))
    if max_distance is None:
        return x
    return left.select("pid").join(x, "pid", "left").withColumn("distance", F.coalesce("distance", F.lit(float(max_distance))))


def cylinder(points: DataFrame, origin, axis, radius: float, half_length: float, positive_only: bool = False) -> DataFrame:
    """Points in a cylinder around an axis through `origin`."""
    n = math.sqrt(sum(v * v for v in axis))
    u = [v / n for v in axis]
    d = [F.col(a) - float(o) for a, o in zip(AXES, origin, strict=True)]
    along = d[0] * u[0] + d[1] * u[1] + d[2] * u[2]
    off2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] - along * along
    return points.where((off2 <= radius * radius) & along.between(0.0 if positive_only else -half_length, half_length))


def oriented_box(points: DataFrame, centre, axes, half) -> DataFrame:
    """Points in a box with given unit axes and half sizes."""
    d = [F.col(a) - float(o) for a, o in zip(AXES, centre, strict=True)]
    keep = F.lit(True)
    for u, h in zip(axes, half, strict=True):
        keep = keep & (F.abs(d[0] * u[0] + d[1] * u[1] + d[2] * u[2]) <= h)
    return points.where(keep)


def along_ray(points: DataFrame, origin, direction, radius: float) -> DataFrame:
    """Points within `radius` of a half line, with their place along it."""
    n = math.sqrt(sum(v * v for v in direction))
    d = [F.col(a) - float(o) for a, o in zip(AXES, origin, strict=True)]
    along = (d[0] * direction[0] + d[1] * direction[1] + d[2] * direction[2]) / n
    off2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] - along * along
    return points.withColumn("along", along).where((off2 <= radius * radius) & (F.col("along") >= 0))


def asof_bracket(queries: DataFrame, samples: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """For each query row (key, at) the sample at or before it and the one at or after it: columns at0, v0, at1, v1.

    One union ordered per key; the neighbours come from windows that skip nulls, so nothing is joined by range.
    """
    q = queries.select("*", F.lit(None).cast(samples.schema[at].dataType).alias("s_at"), F.lit(None).cast(samples.schema[value].dataType).alias("s_v"), F.lit(True).alias("is_query"))
    missing = [c for c in queries.columns if c not in (key, at)]
    s = samples.select(key, at, *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in missing], F.col(at).alias("s_at"), F.col(value).alias("s_v"), F.lit(False).alias("is_query"))
    x = q.unionByName(s).withColumn("sample", F.when(~F.col("is_query"), F.struct("s_at", "s_v")))
    before = Window.partitionBy(key).orderBy(at, "is_query").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(key).orderBy(F.desc(at), "is_query").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("p", F.last("sample", ignorenulls=True).over(before)).withColumn("n", F.last("sample", ignorenulls=True).over(after))
    return x.where("is_query").select(*queries.columns, F.col("p.s_at").alias("at0"), F.col("p.s_v").alias("v0"), F.col("n.s_at").alias("at1"), F.col("n.s_v").alias("v1"))


def asof_lerp(queries: DataFrame, samples: DataFrame, key: str, at: str, value: str, tolerance: float | None = None) -> DataFrame:
    """Brackets with `v`, interpolated between them; NULL without both, or when the nearer one is beyond `tolerance`."""
    x = asof_bracket(queries, samples, key, at, value)
    gap = (F.col("at1") - F.col("at0")).cast("double")
    share = F.when(gap == 0, 0.0).otherwise((F.col(at) - F.col("at0")).cast("double") / F.when(gap != 0, gap))
    v = F.col("v0") + (F.col("v1") - F.col("v0")) * share
    if tolerance is not None:
        near = F.least((F.col(at) - F.col("at0")).cast("double"), (F.col("at1") - F.col(at)).cast("double"))
        v = F.when(near <= tolerance, v)
    return x.withColumn("v", v)


def transfer(left: DataFrame, right: DataFrame, value: str, radius: float, how: str = "average", sigma: float | None = None) -> DataFrame:
    """pid, value, n: `value` of right rows carried to left rows within a radius: average, lower median, or normal weights."""
    x = radius_join(left, right, radius).select(F.col("a.pid").alias("pid"), F.col(f"b.{value}").alias("v"), "d2").where(F.col("v").isNotNull())
    if how == "average":
        found = F.avg("v")
    elif how == "median":
        ordered = F.sort_array(F.collect_list("v"))
        found = F.get(ordered, F.greatest(F.floor(F.count("v") / 2), F.lit(1)).cast("int") - 1)
    else:
        w = F.exp(F.col("d2") / (-2.0 * (sigma or radius / 3.0) ** 2))
        found = F.sum(w * F.col("v")) / F.sum(w)
    return x.groupBy("pid").agg(found.alias(value), F.count("v").alias("n"))


def smoothed(points: DataFrame, value: str, sigma: float, value_sigma: float | None = None) -> DataFrame:
    """pid, value: normal-weighted mean over a ball of three sigma; bilateral where `value_sigma` is given."""
    x = radius_join(points, points, 3.0 * sigma)
    w = F.exp(F.col("d2") / (-2.0 * sigma * sigma))
    v, own = F.col(f"b.{value}"), F.col(f"a.{value}")
    if value_sigma:
        w = w * F.exp((v - own) * (v - own) / (-2.0 * value_sigma * value_sigma))
    return x.where(v.isNotNull()).groupBy(F.col("a.pid").alias("pid")).agg((F.sum(w * v) / F.sum(w)).alias(value))


def gradient_norm(points: DataFrame, value: str, radius: float) -> DataFrame:
    """pid, gradient: length of the mean of value differences over squared distances, along the directions."""
    x = radius_join(points, points, radius).where("d2 > 0")
    g = [F.avg((F.col(f"b.{value}") - F.col(f"a.{value}")) * (F.col(f"b.{a}") - F.col(f"a.{a}")) / F.col("d2")).alias(f"g{a}") for a in AXES]
    x = x.groupBy(F.col("a.pid").alias("pid")).agg(*g)
    return x.select("pid", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz")).alias("gradient"))
