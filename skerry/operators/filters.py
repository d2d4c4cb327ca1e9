"""Row selection: bands, boxes, polygons, visibility, outliers, and their complements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.geometry import point_in_polygon

from .spatial import knn_join, radius_join


def valid(c: Column) -> Column:
    """Neither NULL nor NaN."""
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def band(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Strictly between."""
    return df.where((F.col(column) > low) & (F.col(column) < high))


def complement(df: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    return df.join(kept.select(key), key, "left_anti")


def subset(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows named by a selection, with all their columns, each once."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def in_range(column: Column, low: float, high: float, outside: bool = False) -> Column:
    """Closed range; NULL and NaN count as outside."""
    inside = F.coalesce(valid(column) & column.between(low, high), F.lit(False))
    return ~inside if outside else inside


def visible(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.withColumn("visible", in_range(F.col(column), low, high))


def in_box(df: DataFrame, low, high, inside: bool = True) -> DataFrame:
    keep = F.lit(True)
    for c, a, b in zip("xyz", low, high, strict=True):
        keep = keep & F.col(c).between(a, b)
    return df.where(keep if inside else ~keep)


def in_polygon(df: DataFrame, ring, u: str = "x", v: str = "y", inside: bool = True) -> DataFrame:
    """Even-odd rule in the plane of two coordinates."""
    keep = point_in_polygon(F.col(u), F.col(v), ring)
    return df.where(keep if inside else ~keep)


def route_by_size(df: DataFrame, group: str, small: int, large: int) -> DataFrame:
    """Rows with `route`: removed below `small` rows of their group, structure from `large` on, else objects."""
    n = df.groupBy(group).agg(F.count("*").alias("group_size"))
    return df.join(n, group).withColumn("route", F.when(F.col("group_size") < small, "removed").when(F.col("group_size") >= large, "structure").otherwise("objects"))


def statistical_outliers(points: DataFrame, k: int = 5, sigmas: float = 1.0) -> DataFrame:
    """pid, mean_distance, kept: mean distance to the k nearest others, kept up to mean + sigmas * population deviation."""
    near = knn_join(points, points, k).groupBy(F.col("a.pid").alias("pid")).agg(F.avg(F.sqrt("d2")).alias("mean_distance"))
    limit = near.agg((F.avg("mean_distance") + sigmas * F.stddev_pop("mean_distance")).alias("limit"))
    return near.crossJoin(F.broadcast(limit)).select("pid", "mean_distance", (F.col("mean_distance") <= F.col("limit")).alias("kept"))  # limit: one row


def mad_inliers(df: DataFrame, value: str, limit: float = 2.5) -> DataFrame:
    """Rows whose distance from the median is under `limit` scaled median absolute deviations."""
    from .fields import median

    middle = median(df, value)
    if middle is None:
        return df.where("false")
    off = F.abs(F.col(value) - middle)
    spread = median(df.select(off.alias("off")), "off")
    return df.where(off / (1.4826 * spread + 1e-6) < limit)


def plane_noise(points: DataFrame, radius: float, relative: float, drop_isolated: bool = True) -> DataFrame:
    """Points whose distance from the plane of their neighbours is at most `relative` times the spread of their own."""
    from .fitting import neighbour_planes

    fitted = neighbour_planes(points, radius).select("pid", "n", "offset", "rms")
    out = points.join(fitted, "pid", "left")
    lonely = F.col("n").isNull() | (F.col("n") < 3)
    return out.where(F.when(lonely, F.lit(not drop_isolated)).otherwise(F.abs("offset") <= relative * F.col("rms") + 1e-12)).select(*points.columns)


def faces_inside(faces: DataFrame, ids: DataFrame, any_vertex: bool = False) -> DataFrame:
    """Faces (fid, v) all of whose vertices (or any) are among `ids` (pid)."""
    corner = faces.select("fid", F.explode("v").alias("pid")).join(ids.select("pid").distinct().withColumn("hit", F.lit(True)), "pid", "left")
    n = corner.groupBy("fid").agg(F.count("hit").alias("hits"), F.count("*").alias("n"))
    good = n.where(F.col("hits") > 0 if any_vertex else F.col("hits") == F.col("n"))
    return faces.join(good.select("fid"), "fid", "left_semi")


def observed_enough(observations: DataFrame, track: str, valid_column: str, least: int = 2) -> DataFrame:
    """Valid observations of tracks that have at least `least` of them."""
    good = observations.where(F.col(valid_column))
    keys = good.groupBy(track).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(track)
    return good.join(keys, track, "left_semi")


def thinned(points: DataFrame, distance: float) -> DataFrame:
    """Greedy minimum-distance sample in the order of pid: a point stays when no staying point with a smaller pid lies
    nearer. Each round settles the points without an undecided smaller neighbour, and is written to the shared folder."""
    from skerry.plans.iterate import Scratch

    scratch = Scratch(points.sparkSession)
    pairs = radius_join(points, points, distance, strict=True).where("a.pid > b.pid").select(F.col("a.pid").alias("pid"), F.col("b.pid").alias("smaller"))
    pairs, _ = scratch.cut(pairs)
    gone = None
    while pairs.limit(1).count():
        held = pairs.select("pid").distinct()
        first = pairs.select(F.col("smaller").alias("pid")).distinct().join(held, "pid", "left_anti")
        out = pairs.join(first.withColumnRenamed("pid", "smaller"), "smaller", "left_semi").select("pid").distinct()
        out, _ = scratch.cut(out)
        gone = out if gone is None else gone.union(out)
        left = pairs.join(out, "pid", "left_anti").join(out.withColumnRenamed("pid", "smaller"), "smaller", "left_anti")
        pairs, _ = scratch.cut(left.select("pid", "smaller"))
    return points if gone is None else points.join(gone.distinct(), "pid", "left_anti")


def depth_visible(points: DataFrame, width: float) -> DataFrame:
    """Points with `nearest_z`, the least z in their (x, y) cell, and whether they are it: a depth buffer."""
    cell = [F.floor(F.col(c) / width).alias(f"i{c}") for c in "xy"]
    x = points.select("*", *cell)
    low = x.groupBy("ix", "iy").agg(F.min("z").alias("nearest_z"))
    return x.join(low, ["ix", "iy"]).withColumn("seen", F.col("z") <= F.col("nearest_z"))


def keep_largest_id(faces: DataFrame) -> DataFrame:
    """Of faces with the same vertices in any order, the one with the greatest id."""
    best = faces.groupBy(F.sort_array("v").alias("key")).agg(F.max("fid").alias("fid")).select("fid")
    return faces.join(best, "fid", "left_semi")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= n)
