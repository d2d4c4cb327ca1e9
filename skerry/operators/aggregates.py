"""Grouped and global aggregates over point tables: moments, voxels, rasters, levels, densities, modes, nests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fields import clean
from .spatial import AXES, cell, morton, radius_join


def box(df: DataFrame) -> DataFrame:
    return df.agg(*[f(a).alias(f"{n}_{a}") for a in AXES for f, n in ((F.min, "low"), (F.max, "high"))])


def centroid(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Mean position; rows with an invalid weight are left out."""
    if weight is None:
        return df.agg(*[F.avg(a).alias(a) for a in AXES])
    w = clean(F.col(weight))
    return df.agg(*[F.try_divide(F.sum(w * F.col(a)), F.sum(w)).alias(a) for a in AXES])


def covariance(df: DataFrame) -> DataFrame:
    """The six population covariances."""
    return df.agg(*[F.covar_pop(a, b).alias(f"{a}{b}") for i, a in enumerate(AXES) for b in AXES[i:]])


def cross_covariance(a: DataFrame, b: DataFrame, key: str = "pid") -> DataFrame:
    """Nine population covariances of two tables aligned by key."""
    x = a.select(key, *[F.col(c).alias(f"a{c}") for c in AXES]).join(b.select(key, *[F.col(c).alias(f"b{c}") for c in AXES]), key)
    return x.agg(*[F.covar_pop(f"a{p}", f"b{q}").alias(f"{p}{q}") for p in AXES for q in AXES])


def voxel_centroids(df: DataFrame, size: float) -> DataFrame:
    return df.groupBy(cell(size).alias("c")).agg(*[F.avg(a).alias(a) for a in AXES], F.count("*").alias("n")).select("c.*", *AXES, "n")


def voxel_nearest(df: DataFrame, size: float) -> DataFrame:
    """In each voxel the point nearest its centre, ties to the smaller pid."""
    d = [F.col(a) - (F.floor(F.col(a) / size) + 0.5) * size for a in AXES]
    d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    return df.groupBy(cell(size).alias("c")).agg(F.min_by("pid", F.struct(d2, "pid")).alias("pid")).select("c.*", "pid")


def voxel_random(df: DataFrame, size: float, seed: int) -> DataFrame:
    """In each voxel one point by a seeded hash."""
    return df.groupBy(cell(size).alias("c")).agg(F.min_by("pid", F.xxhash64(F.lit(seed), "pid")).alias("pid")).select("c.*", "pid")


def per_cell(df: DataFrame, size: float) -> DataFrame:
    """One row: points, occupied cells, points per occupied cell."""
    return df.select(cell(size).alias("c")).agg(F.count("*").alias("n"), F.countDistinct("c").alias("cells"), (F.count("*") / F.countDistinct("c")).alias("per_cell"))


def level_statistics(df: DataFrame, levels: list[int]) -> DataFrame:
    """For each level of the cell tree over integer cells i, j, k: cells, and greatest, mean and deviation of their sizes.
    Finest cells are counted once; the levels above are sums over their codes."""
    top = max(levels)
    fine = df.groupBy(morton(F.col("i"), F.col("j"), F.col("k"), top).alias("code")).agg(F.count("*").alias("n"))
    x = fine.select("n", "code", F.explode(F.array(*[F.lit(v) for v in levels])).alias("level"))
    x = x.groupBy("level", F.expr(f"shiftright(code, 3 * ({top} - level))").alias("code")).agg(F.sum("n").alias("n"))
    return x.groupBy("level").agg(F.count("*").alias("cells"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation"))


RASTER = ("n", "low", "high", "mean", "deviation")


def raster(df: DataFrame, step: float, x: str = "x", y: str = "y", height: str = "z", value: str | None = None) -> DataFrame:
    """Cells i, j (nearest multiple of the step): n, low, high, mean, deviation of heights, ids of extremes, and of `value`
    the low, mean and high over valid ones."""
    at = lambda c: F.floor(F.col(c) / step + 0.5)
    h = F.col(height)
    stats = [F.count("*").alias("n"), F.min(h).alias("low"), F.max(h).alias("high"), F.avg(h).alias("mean"), F.stddev_pop(h).alias("deviation")]
    stats += [F.min_by("pid", F.struct(h, "pid")).alias("lowest"), F.max_by("pid", F.struct(h, -F.col("pid"))).alias("highest")] if "pid" in df.columns else []
    if value:
        v = clean(F.col(value))
        stats += [F.min(v).alias("value_low"), F.avg(v).alias("value_mean"), F.max(v).alias("value_high")]
    return df.groupBy(at(x).alias("i"), at(y).alias("j")).agg(*stats)


def filled_raster(cells: DataFrame, column: str = "mean", policy: str = "leave", custom: float = 0.0) -> DataFrame:
    """All cells of the bounding grid with `column`; empty ones by policy: leave, low, high, mean, custom, interpolate
    (along i, between the nearest filled cells of the row, ends as they are)."""
    e = cells.agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"), F.min(column).alias("low"), F.max(column).alias("high"), F.avg(column).alias("mean"))
    grid = e.select(F.explode(F.sequence("i0", "i1")).alias("i"), "j0", "j1").select("i", F.explode(F.sequence("j0", "j1")).alias("j"))
    full = grid.join(cells.select("i", "j", F.col(column).alias("h")), ["i", "j"], "left")
    if policy == "leave":
        return full
    if policy in ("low", "high", "mean"):
        return full.crossJoin(F.broadcast(e.select(F.col(policy).alias("fill")))).select("i", "j", F.coalesce("h", "fill").alias("h"))  # one row
    if policy == "custom":
        return full.select("i", "j", F.coalesce("h", F.lit(float(custom))).alias("h"))
    at = F.when(F.col("h").isNotNull(), F.struct("i", "h"))
    before = Window.partitionBy("j").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("j").orderBy("i").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    x = full.withColumn("p", F.last(at, ignorenulls=True).over(before)).withColumn("q", F.first(at, ignorenulls=True).over(after))
    share = F.try_divide(F.col("i") - F.col("p.i"), F.col("q.i") - F.col("p.i"))
    return x.select("i", "j", F.coalesce("h", F.col("p.h") + (F.col("q.h") - F.col("p.h")) * share).alias("h"))


def grid_size(extent: Column, step: Column | float) -> Column:
    """Cells along an axis; NULL for a step or an extent that is not positive."""
    s = step if isinstance(step, Column) else F.lit(float(step))
    return F.when((s > 0) & (extent > 0), 1 + F.floor(extent / F.when(s > 0, s) + 0.5))


def neighbour_counts(df: DataFrame, radius: float) -> DataFrame:
    """pid, n (others in the ball), density in volume and on the disc."""
    x = radius_join(df, df, radius).groupBy(F.col("a.pid").alias("pid")).agg((F.count("*") - 1).alias("n"))
    return x.withColumn("volume_density", F.col("n") / (4.0 / 3.0 * 3.141592653589793 * radius**3)).withColumn("surface_density", F.col("n") / (3.141592653589793 * radius**2))


def close_repeats(df: DataFrame, distance: float) -> DataFrame:
    """Points with `repeated`: nearer than `distance` to a point with a smaller pid that is not itself repeated."""
    from .filters import thinned

    kept = thinned(df, distance).select("pid", F.lit(False).alias("repeated"))
    return df.join(kept, "pid", "left").withColumn("repeated", F.coalesce("repeated", F.lit(True)))


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value per key, ties to the smaller one."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("n")).alias("k"), F.col(value).alias("v"))).alias(value), F.max("n").alias("n"))


def top_two(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """first, second: the two commonest values per key, -1 where there is none."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))
    at = n.withColumn("r", r).where("r <= 2")
    pick = lambda k: F.coalesce(F.max(F.when(F.col("r") == k, F.col(value))), F.lit(-1))
    return at.groupBy(*keys).agg(pick(1).alias("first"), pick(2).alias("second"))


def pairs_with(df: DataFrame, a: str, b: str, least: int) -> DataFrame:
    """Unordered pairs, itself-pairs left out, that occur `least` times or more."""
    p = df.where(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).agg(F.count("*").alias("n"))
    return p.where(F.col("n") >= least)


def nested_pairs(df: DataFrame, a: str, b: str, items: list[str], least: int = 1) -> DataFrame:
    """Each unordered pair with its sorted list of items."""
    p = df.where(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).agg(F.sort_array(F.collect_list(F.struct(*items))).alias("items"))
    return p.where(F.size("items") >= least)


def conflicted(df: DataFrame, track: str, view: str) -> DataFrame:
    """Tracks that see a view more than once."""
    return df.groupBy(track).agg(F.count(view).alias("n"), F.countDistinct(view).alias("views")).where("n <> views")


def views_by_tracks(df: DataFrame, view: str, more_than: int) -> DataFrame:
    n = df.groupBy(view).agg(F.count("*").alias("n")).where(F.col("n") > more_than)
    return n.orderBy(F.desc("n"), F.desc(view))


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(value))


def tsdf_fold(df: DataFrame, keys: list[str], order: str, value: str, weight: str, as_written: bool = False) -> DataFrame:
    """Running truncated distance per voxel in the order of `order`: (t*w + v*dw) / (w + dw). `as_written` leaves the
    weight of the new sample out of the numerator. A voxel's samples are one array."""
    steps = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"))))
    start = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("w"))

    def add(acc: Column, s: Column) -> Column:
        more = s.v if as_written else s.v * s.w
        return F.struct(F.coalesce(F.try_divide(acc.t * acc.w + more, acc.w + s.w), F.lit(0.0)).alias("t"), (acc.w + s.w).alias("w"))

    x = df.groupBy(*keys).agg(steps.alias("s")).select(*keys, F.aggregate("s", start, add).alias("f"))
    return x.select(*keys, F.col("f.t").alias("tsdf"), F.col("f.w").alias("weight"))


def scatter_tsdf(points: DataFrame, size: float, truncation: float) -> DataFrame:
    """Every oriented point (nx, ny, nz) gives its signed distance to the 27 voxel centres around it; kept where the
    squared distance is under 2 * size and the value under the truncation; weighted mean per voxel, which needs no order."""
    from .spatial import around

    x = points.select("*", F.explode(around(size)).alias("v"))
    d = [(F.col(f"v.c{a}") + 0.5) * size - F.col(a) for a in AXES]
    sdf = d[0] * F.col("nx") + d[1] * F.col("ny") + d[2] * F.col("nz")
    d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    x = x.select("v.*", sdf.alias("sdf"), d2.alias("d2")).where((F.col("d2") < 2 * size) & (F.abs("sdf") < truncation))
    w = F.exp(F.col("d2") / (-2.0 * size * size))
    return x.groupBy("cx", "cy", "cz").agg((F.sum(w * F.col("sdf")) / F.sum(w)).alias("tsdf"), F.sum(w).alias("weight"))


def cube_rollup(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts and sums over all prefixes of the keys."""
    return df.rollup(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
