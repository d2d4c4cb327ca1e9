"""Choosing a cell size or tree level, leaves of median splits, frusta, and neighbourhood measures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import vectors as V

from .fields import clean, kth
from .spatial import AXES, bounds, knn_join, radius_join

DEEPEST = 21


def cube_side(points: DataFrame) -> float:
    b = bounds(points)
    return max([(b[f"high_{a}"] or 0.0) - (b[f"low_{a}"] or 0.0) for a in AXES] + [1e-12])


def level_for_radius(side: float, radius: float, factor: float = 2.5) -> int:
    """The level of the cube tree whose cells are nearest in size to `factor` radii: few cells per ball, few points too many."""
    aim = math.log2(side / (radius * factor)) if radius > 0 else DEEPEST
    return min(max(round(aim), 1), DEEPEST)


def cells_by_level(points: DataFrame, levels: int = DEEPEST) -> DataFrame:
    """level, cells: occupied cells of the cube tree at each level. The finest are counted once, those above from them."""
    from .spatial import morton

    b, side = bounds(points), cube_side(points)
    grid = [F.least(F.floor((F.col(a) - F.lit(b[f"low_{a}"])) / side * (1 << DEEPEST)), F.lit((1 << DEEPEST) - 1)).cast("long") for a in AXES]
    code = points.select(morton(*grid).alias("code")).distinct()
    up = F.explode(F.sequence(F.lit(1), F.lit(levels)))
    return code.select("code", up.alias("level")).groupBy("level").agg(F.countDistinct(F.expr(f"shiftright(code, 3 * ({DEEPEST} - level))")).alias("cells"))


def level_for_count(points: DataFrame, aim: int) -> int:
    """The level whose number of occupied cells is nearest to `aim`, the coarser of two."""
    rows = cells_by_level(points).collect()  # one row per level
    return min((abs(r["cells"] - aim), r["level"]) for r in rows)[1]


def median_leaves(points: DataFrame, depth: int) -> DataFrame:
    """Points with `leaf`: cells of a tree that splits at the median of x, y and z in turn, lower half first (values up to
    the median go down). Medians come from summaries of bounded size: their rank is off by a millionth at most."""
    now = points.withColumn("leaf", F.lit(1).cast("long"))
    for k in range(depth):
        axis = AXES[k % 3]
        cut = now.groupBy("leaf").agg(F.percentile_approx(axis, 0.5, 1_000_000).alias("cut"))
        now = now.join(F.broadcast(cut), "leaf")  # 2 ** depth rows at most
        now = now.withColumn("leaf", 2 * F.col("leaf") + (F.col(axis) > F.col("cut")).cast("long")).drop("cut")
    return now


def touching_leaves(leaves: DataFrame, gap: float = 0.0) -> DataFrame:
    """a < b: leaves of points whose boxes come within `gap` of each other along every axis."""
    box = leaves.groupBy("leaf").agg(*[f(c).alias(f"{n}_{c}") for c in AXES for f, n in ((F.min, "low"), (F.max, "high"))])
    p, q = (box.select(*[F.col(c).alias(f"{s}_{c}") for c in box.columns]) for s in "pq")
    near = F.col("p_leaf") < F.col("q_leaf")
    for c in AXES:
        near = near & (F.col(f"p_low_{c}") <= F.col(f"q_high_{c}") + gap) & (F.col(f"q_low_{c}") <= F.col(f"p_high_{c}") + gap)
    return p.join(q, near).select(F.col("p_leaf").alias("a"), F.col("q_leaf").alias("b"))  # leaves are few: boxes, not points


def frustum_relation(low: Column, high: Column, planes: list[tuple[float, float, float, float]]) -> Column:
    """inside, intersect or outside: a box against planes (a, b, c, d) whose inner side has a*x + b*y + c*z + d >= 0. By the
    corner farthest along each plane's normal and the one nearest."""
    inside, outside = F.lit(True), F.lit(False)
    for *n, d in planes:
        far = sum((v * (high[c] if v > 0 else low[c]) for v, c in zip(n, AXES, strict=True)), F.lit(float(d)))
        near = sum((v * (low[c] if v > 0 else high[c]) for v, c in zip(n, AXES, strict=True)), F.lit(float(d)))
        inside, outside = inside & (near >= 0), outside | (far < 0)
    return F.when(outside, "outside").when(inside, "inside").otherwise("intersect")


def in_frustum_by_cells(points: DataFrame, size: float, planes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Points inside all planes: cells wholly outside are dropped, of those that planes cross each point is tested."""
    corner = lambda k: V.vec(*[(F.floor(F.col(c) / size) + k) * size for c in AXES])
    x = points.withColumn("cell_", frustum_relation(corner(0), corner(1), planes)).where("cell_ <> 'outside'")
    own = F.lit(True)
    for a, b, c, d in planes:
        own = own & (F.col("x") * a + F.col("y") * b + F.col("z") * c + d >= 0)
    return x.where((F.col("cell_") == "inside") | own).drop("cell_")


def largest_radius(df: DataFrame, key: str) -> DataFrame:
    """key, radius: greatest distance from a group's centroid."""
    m = df.groupBy(key).agg(*[F.avg(a).alias(f"m{a}") for a in AXES])
    d2 = sum(((F.col(a) - F.col(f"m{a}")) * (F.col(a) - F.col(f"m{a}")) for a in AXES), F.lit(0.0))
    return df.join(m, key).groupBy(key).agg(F.sqrt(F.max(d2)).alias("radius"))


def first_moment(points: DataFrame, radius: float) -> DataFrame:
    """pid, moment in 0..1: squared mean step towards the neighbours over the mean squared step; 0 in the midst of its
    neighbours, near 1 at the end of a line."""
    x = radius_join(points, points, radius).where("d2 > 0")
    x = x.groupBy(F.col("a.pid").alias("pid")).agg(*[F.avg(F.col(f"b.{a}") - F.col(f"a.{a}")).alias(f"m{a}") for a in AXES], F.avg("d2").alias("s"))
    return x.select("pid", ((F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz")) / F.col("s")).alias("moment"))


def naive_radius(points: DataFrame, share: float = 0.01, least_points: int = 100_000) -> float:
    """A radius from the box alone: its diagonal times `share`, more for sparse clouds."""
    b = bounds(points)
    diagonal = math.sqrt(sum((b[f"high_{a}"] - b[f"low_{a}"]) ** 2 for a in AXES))
    return diagonal * min(share * max(1.0, math.sqrt(least_points / max(b["n"], 1))), 0.25)


def tuned_radius(points: DataFrame, aim: int = 16, rounds: int = 10, sample: int = 200, seed: int = 1) -> float:
    """A radius at which the median count of neighbours, over a seeded sample of points against all, comes within a third of `aim`."""
    probe = points.orderBy(F.xxhash64(F.lit(seed), "pid"), "pid").limit(sample)
    radius = naive_radius(points)
    for _ in range(rounds):
        n = radius_join(probe, points, radius).groupBy(F.col("a.pid").alias("pid")).agg(F.count("*").alias("n"))
        middle = kth(n, "n", max(n.count() - 1, 0) // 2) or 1
        if abs(middle - aim) * 3 <= aim:
            break
        radius *= min(max((aim / middle) ** 0.5, 0.5), 2.0)
    return radius


def aligned_mean_normal(df: DataFrame, key: str) -> DataFrame:
    """key, normal: unit mean of a group's normals, each turned to the side of the one of smallest pid."""
    first = df.groupBy(key).agg(F.min_by(V.vec("nx", "ny", "nz"), "pid").alias("f"))
    x = df.join(first, key)
    s = F.when(V.dot(V.vec("nx", "ny", "nz"), F.col("f")) < 0, -1.0).otherwise(1.0)
    x = x.groupBy(key).agg(*[F.sum(s * F.col(f"n{a}")).alias(a) for a in AXES])
    return x.select(key, V.normalize(V.vec(*AXES)).alias("normal"))


def far_candidates(candidates: DataFrame, points: DataFrame, distance: float) -> DataFrame:
    """Candidates with no point nearer than `distance`."""
    near = radius_join(candidates, points, distance, strict=True).select("a.pid").distinct()
    return candidates.join(near, "pid", "left_anti")


def with_parents(level: DataFrame, above: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(pid, near, rank) the k nearest of the same level, and (pid, parent) the nearest of the level above."""
    near = knn_join(level, level, k).select(F.col("a.pid").alias("pid"), F.col("b.pid").alias("near"), "rank")
    parent = knn_join(level, above, 1, include_self=True).select(F.col("a.pid").alias("pid"), F.col("b.pid").alias("parent"))
    return near, parent


def pushed_down(children: DataFrame, parents: DataFrame, value: str, share: float = 0.5) -> DataFrame:
    """Children (pid, parent, good, value) that are not good take their parent's value, good ones the mix of both."""
    up = parents.select(F.col("pid").alias("parent"), F.col(value).alias("up_"))
    x = children.join(up, "parent", "left")
    new = F.when(F.col("up_").isNull(), F.col(value)).when(F.col("good"), share * F.col(value) + (1 - share) * F.col("up_")).otherwise(F.col("up_"))
    return x.withColumn(value, new).drop("up_")


def median_of_good(points: DataFrame, near: DataFrame, value: str, least: int = 3) -> DataFrame:
    """pid, value: the lower median of good neighbours' values (near: pid, near), the own one where fewer than `least` are good."""
    good = points.where("good").select(F.col("pid").alias("near"), F.col(value).alias("v"))
    m = near.join(good, "near").groupBy("pid").agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("m"))
    return points.join(m, "pid", "left").select("pid", F.when(F.col("n") >= least, F.col("m")).otherwise(F.col(value)).alias(value))


def chi_square(counts: DataFrame, expected: str, observed: str, least: float = 5.0) -> DataFrame:
    """One row, chi2 and classes: classes (bin, expected, observed) are joined from below until each expects `least`; the
    rest goes with the last. A histogram is small, so it is walked in order."""
    w = Window.partitionBy(F.lit(0)).orderBy("bin")
    so_far = F.floor(F.sum(expected).over(w) / least)
    total = counts.agg(F.floor(F.sum(expected) / least).alias("most"))
    x = counts.withColumn("upto", so_far).withColumn("before", F.coalesce(F.lag("upto").over(w), F.lit(0)))
    x = x.crossJoin(F.broadcast(total)).withColumn("class", F.least("before", F.greatest(F.col("most") - 1, F.lit(0))))  # one row
    x = x.groupBy("class").agg(F.sum(expected).alias("e"), F.sum(observed).alias("o"))
    return x.agg(F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e")).alias("chi2"), F.count("*").alias("classes"))


def local_chi_square(points: DataFrame, value: str, k: int, limits: list[float], shares: list[float]) -> DataFrame:
    """pid, chi2: values of each point's k nearest (itself included) against a model that gives the classes between `limits`
    the probabilities `shares`."""
    x = knn_join(points, points, k, include_self=True).select(F.col("a.pid").alias("pid"), clean(F.col(f"b.{value}")).alias("v")).where("v is not null")
    bins = sum((F.when(F.col("v") > limit, 1).otherwise(0) for limit in limits), F.lit(0))
    n = [F.count(F.when(bins == j, 1)).alias(f"o{j}") for j in range(len(shares))]
    x = x.groupBy("pid").agg(F.count("*").alias("n"), *n)
    terms = [(F.col(f"o{j}") - F.col("n") * s) * (F.col(f"o{j}") - F.col("n") * s) / (F.col("n") * s) for j, s in enumerate(shares)]
    return x.select("pid", sum(terms, F.lit(0.0)).alias("chi2"))
