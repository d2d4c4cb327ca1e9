"""Model fits. Moments are sums in the JVM, so a group of any size arrives at the solver as a few numbers; only fits
whose loss is no sum of moments see rows, in seeded samples of bounded size."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.plans.iterate import Scratch

from .spatial import AXES, knn_join, nearest, radius_join


def moments(prefix: str = "") -> list[Column]:
    c = lambda a: F.col(f"{prefix}{a}")
    first = [F.avg(c(a)).alias(f"m{a}") for a in AXES]
    return [F.count("*").alias("n"), *first, *[F.covar_pop(c(a), c(b)).alias(f"{a}{b}") for i, a in enumerate(AXES) for b in AXES[i:]]]


EIGEN = "n long, mx double, my double, mz double, l1 double, l2 double, l3 double, nx double, ny double, nz double, dx double, dy double, dz double"


def eigen(df: DataFrame, key: str) -> DataFrame:
    """key and of the rows' moments: mean, eigenvalues falling, least direction (normal) and greatest direction. Signs: the
    component of greatest size is positive."""

    def solve(batches):
        for pdf in batches:
            m = np.zeros((len(pdf), 3, 3))
            for i, a in enumerate(AXES):
                for j, b in enumerate(AXES):
                    m[:, i, j] = pdf[a + b if i <= j else b + a]
            w, v = np.linalg.eigh(m)
            for k in (0, 2):
                big = np.abs(v[:, :, k]).argmax(1)
                v[:, :, k] *= np.where(v[np.arange(len(v)), big, k] < 0, -1.0, 1.0)[:, None]
            out = {key: pdf[key], "n": pdf["n"], **{f"m{a}": pdf[f"m{a}"] for a in AXES}}
            out |= {f"l{k + 1}": np.maximum(w[:, 2 - k], 0.0) for k in range(3)}
            out |= {f"n{a}": v[:, i, 0] for i, a in enumerate(AXES)} | {f"d{a}": v[:, i, 2] for i, a in enumerate(AXES)}
            yield pd.DataFrame(out)

    return df.mapInPandas(solve, f"{key} {df.schema[key].dataType.simpleString()}, {EIGEN}")


def group_planes(df: DataFrame, key: str) -> DataFrame:
    """key, plane n . p + d = 0 of least squares, and rms distance, per group."""
    x = eigen(df.groupBy(key).agg(*moments()), key)
    return x.select("*", (0.0 - (F.col("nx") * F.col("mx") + F.col("ny") * F.col("my") + F.col("nz") * F.col("mz"))).alias("d"), F.sqrt("l3").alias("rms"))


def neighbour_planes(points: DataFrame, radius: float) -> DataFrame:
    """pid, n, normal, offset of the point from its neighbours' plane, rms."""
    x = radius_join(points, points, radius).select(F.col("a.pid").alias("pid"), *[F.col(f"b.{a}").alias(a) for a in AXES])
    f = eigen(x.groupBy("pid").agg(*moments()), "pid").join(points.select("pid", *AXES), "pid")
    off = sum((F.col(f"n{a}") * (F.col(a) - F.col(f"m{a}")) for a in AXES), F.lit(0.0))
    return f.select("pid", "n", "nx", "ny", "nz", off.alias("offset"), F.sqrt("l3").alias("rms"))


def knn_eigen(points: DataFrame, k: int) -> DataFrame:
    """pid and the eigen decomposition of its k nearest points, itself included."""
    x = knn_join(points, points, k, include_self=True).select(F.col("a.pid").alias("pid"), *[F.col(f"b.{a}").alias(a) for a in AXES])
    return eigen(x.groupBy("pid").agg(*moments()), "pid")


def eigen_features(x: DataFrame) -> DataFrame:
    """Eleven shape features of eigenvalues l1 >= l2 >= l3."""
    a, b, c = F.col("l1"), F.col("l2"), F.col("l3")
    s = a + b + c
    part = lambda v: F.when(v > 0, F.try_divide(v, s) * F.log(F.try_divide(v, s))).otherwise(F.lit(0.0))
    return x.select(
        "*", s.alias("eigen_sum"), F.cbrt(a * b * c).alias("omnivariance"), (0.0 - (part(a) + part(b) + part(c))).alias("eigenentropy"),
        F.try_divide(a - c, a).alias("anisotropy"), F.try_divide(b - c, a).alias("planarity"), F.try_divide(a - b, a).alias("linearity"),
        F.try_divide(a, s).alias("pca1"), F.try_divide(b, s).alias("pca2"), F.try_divide(c, s).alias("surface_variation"),
        F.try_divide(c, a).alias("sphericity"), (1.0 - F.abs("nz")).alias("verticality"),
    )


def quadric(df: DataFrame, key: str) -> DataFrame:
    """key, coefficients of z = c0 + c1 x + c2 y + c3 x^2 + c4 xy + c5 y^2, rms. Normal equations are sums in the JVM."""
    terms = {"1": F.lit(1.0), "x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y")}
    names = list(terms)
    sums = [F.sum(terms[a] * terms[b]).alias(f"s_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    sums += [F.sum(terms[a] * F.col("z")).alias(f"r_{i}") for i, a in enumerate(names)] + [F.sum(F.col("z") * F.col("z")).alias("zz"), F.count("*").alias("n")]

    def solve(batches):
        for pdf in batches:
            m = np.array([[pdf[f"s_{min(i, j)}_{max(i, j)}"] for j in range(6)] for i in range(6)]).transpose(2, 0, 1)
            r = np.array([pdf[f"r_{i}"] for i in range(6)]).T
            c = np.array([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(m, r, strict=True)]).reshape(-1, 6)
            sse = np.maximum(pdf["zz"].to_numpy() - 2 * (c * r).sum(1) + np.einsum("ni,nij,nj->n", c, m, c), 0)
            yield pd.DataFrame({key: pdf[key], **{f"c{i}": c[:, i] for i in range(6)}, "rms": np.sqrt(sse / pdf["n"].to_numpy())})

    schema = f"{key} {df.schema[key].dataType.simpleString()}, {', '.join(f'c{i} double' for i in range(6))}, rms double"
    return df.groupBy(key).agg(*sums).mapInPandas(solve, schema)


def curvature(points: DataFrame, radius: float) -> DataFrame:
    """pid, gaussian, mean: curvatures of the quadric over each point's neighbours, heights along z."""
    x = radius_join(points, points, radius).select(F.col("a.pid").alias("pid"), *[(F.col(f"b.{a}") - F.col(f"a.{a}")).alias(a) for a in AXES])
    q = quadric(x, "pid")
    fx, fy, fxx, fxy, fyy = F.col("c1"), F.col("c2"), 2.0 * F.col("c3"), F.col("c4"), 2.0 * F.col("c5")
    g = 1.0 + fx * fx + fy * fy
    mean = ((1.0 + fx * fx) * fyy - 2.0 * fx * fy * fxy + (1.0 + fy * fy) * fxx) / (2.0 * F.pow(g, F.lit(1.5)))
    return q.select("pid", ((fxx * fyy - fxy * fxy) / (g * g)).alias("gaussian"), mean.alias("mean"))


def sphere(df: DataFrame) -> tuple[np.ndarray, float]:
    """Centre and radius of algebraic least squares: one aggregate, one small system."""
    t = {"x": F.col("x"), "y": F.col("y"), "z": F.col("z"), "1": F.lit(1.0)}
    w = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    r = df.agg(*[F.sum(t[a] * t[b]).alias(f"{a}{b}") for a in t for b in t], *[F.sum(t[a] * w).alias(f"w{a}") for a in t]).first()
    c = np.linalg.lstsq(np.array([[r[f"{a}{b}"] for b in t] for a in t]), np.array([r[f"w{a}"] for a in t]), rcond=None)[0]
    middle = c[:3] / 2.0
    return middle, math.sqrt(max(c[3] + middle @ middle, 0.0))


def ransac_plane(df: DataFrame, tolerance: float, candidates: int = 200, seed: int = 1, sample: int = 3000) -> dict:
    """The plane by three sampled points with most rows within `tolerance`, refitted to them. A seeded sample of `sample`
    rows gives the candidates; all candidates are scored over all rows in one aggregate."""
    rows = df.orderBy(F.xxhash64(F.lit(seed), "pid"), "pid").limit(sample).select(*AXES).collect()  # `sample` rows at most
    p, rng, planes = np.array(rows, float), np.random.default_rng(seed), []
    if len(p) < 3:
        return {}
    for _ in range(candidates):
        a, b, c = p[rng.choice(len(p), 3, replace=False)]
        n = np.cross(b - a, c - a)
        if np.linalg.norm(n) > 1e-12:
            n /= np.linalg.norm(n)
            planes.append((n, -n @ a))
    off = lambda n, d: F.abs(F.col("x") * float(n[0]) + F.col("y") * float(n[1]) + F.col("z") * float(n[2]) + float(d))
    score = df.agg(*[F.count(F.when(off(n, d) <= tolerance, 1)).alias(f"s{k}") for k, (n, d) in enumerate(planes)]).first()
    best = max(range(len(planes)), key=lambda k: (score[k], -k))
    near = df.where(off(*planes[best]) <= tolerance).select(F.lit(0).alias("g"), *AXES)
    return group_planes(near, "g").first().asDict() | {"inliers": score[best]}


def rigid_transform(pairs: DataFrame, scaled: bool = False) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Rotation, translation, scale and rms that take (ax, ay, az) to (bx, by, bz) best, from one aggregate."""
    c = lambda s, a: F.col(f"{s}{a}")
    r = pairs.agg(*[F.avg(c(s, a)).alias(f"m{s}{a}") for s in "ab" for a in AXES], *[F.covar_pop(c("a", p), c("b", q)).alias(f"c{p}{q}") for p in AXES for q in AXES], sum((F.var_pop(c("a", a)) for a in AXES), F.lit(0.0)).alias("va"), sum((F.var_pop(c("b", a)) for a in AXES), F.lit(0.0)).alias("vb")).first()
    h = np.array([[r[f"c{p}{q}"] for q in AXES] for p in AXES], float)
    u, w, vt = np.linalg.svd(h)
    d = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    turn = vt.T @ d @ u.T
    s = float((w * np.diag(d)).sum() / r["va"]) if scaled and r["va"] else 1.0
    ma, mb = (np.array([r[f"m{k}{a}"] for a in AXES], float) for k in "ab")
    rms = math.sqrt(max(r["vb"] + s * s * r["va"] - 2 * s * float((w * np.diag(d)).sum()), 0.0))
    return turn, mb - s * turn @ ma, s, rms


def moved(points: DataFrame, turn: np.ndarray, shift: np.ndarray, scale: float = 1.0) -> DataFrame:
    new = [sum((F.col(b) * float(scale * turn[i, j]) for j, b in enumerate(AXES)), F.lit(float(shift[i]))).alias(a) for i, a in enumerate(AXES)]
    return points.select(*[c for c in points.columns if c not in AXES], *new)


def icp(points: DataFrame, target: DataFrame, rounds: int = 20, overlap: float = 1.0, least_change: float = 1e-6) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation, translation, rms that lay points on target: nearest pairs, the nearer share `overlap` of them, best motion,
    until the rms stands still. Each round's cloud is written to the shared folder."""
    from .fields import kth

    scratch = Scratch(points.sparkSession)
    now, turn, shift, last = points.select("pid", *AXES), np.eye(3), np.zeros(3), math.inf
    for _ in range(rounds):
        pairs = nearest(now, target).join(now.select("pid", *[F.col(a).alias(f"a{a}") for a in AXES]), "pid")
        pairs = pairs.join(target.select(F.col("pid").alias("nearest_pid"), *[F.col(a).alias(f"b{a}") for a in AXES]), "nearest_pid")
        pairs, _ = scratch.cut(pairs)
        if overlap < 1.0:
            limit = kth(pairs, "distance", max(int(pairs.count() * overlap) - 1, 0))
            pairs = pairs.where(F.col("distance") <= limit)
        r, t, _, rms = rigid_transform(pairs)
        now, _ = scratch.cut(moved(now, r, t))
        turn, shift = r @ turn, r @ shift + t
        if last - rms < least_change:
            break
        last = rms
    return turn, shift, rms


def track_lines(df: DataFrame, key: str, least: int = 2) -> DataFrame:
    """key, mean, direction, rms of the line through a track's valid points; tracks of fewer points are left out."""
    ok = df.where(~(F.isnan("x") | F.isnan("y") | F.isnan("z")))
    x = eigen(ok.groupBy(key).agg(*moments()).where(F.col("n") >= least), key)
    return x.select(key, "n", "mx", "my", "mz", "dx", "dy", "dz", F.sqrt(F.col("l2") + F.col("l3")).alias("rms"))


def colour_outliers(df: DataFrame, key: str, value: str, rounds: int = 10, sigmas: float = 2.5, least: int = 4) -> DataFrame:
    """Rows with `inlier`: per key, values within so many deviations of the mean, refitted on inliers for some rounds; keys
    with fewer than `least` rows keep all. Each round is an aggregate and a join on the key."""
    scratch = Scratch(df.sparkSession)
    now, _ = scratch.cut(df.withColumn("inlier", F.lit(True)))
    for _ in range(rounds):
        v = F.when(F.col("inlier"), F.col(value))
        fit = now.groupBy(key).agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.count(v).alias("c"))
        x = now.join(fit, key).withColumn("new", (F.col("c") < least) | (F.abs(F.col(value) - F.col("m")) <= sigmas * F.col("s") + 1e-12))
        x, _ = scratch.cut(x.withColumn("moved", F.col("new") != F.col("inlier")))
        now = x.drop("m", "s", "c", "inlier", "moved").withColumnRenamed("new", "inlier")
        if not x.where("moved").limit(1).count():
            break
    return now
