"""Primitive shapes: distances, fits by Levenberg-Marquardt whose sums are JVM aggregates, and detection of several shapes."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import vectors as V
from skerry.plans.iterate import Scratch

from .fields import kth
from .spatial import AXES

Parameters = list[float]


def _off(p: Parameters) -> list[Column]:
    return [F.col(a) - float(v) for a, v in zip(AXES, p, strict=False)]


def _dot(a, b) -> Column:
    return sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))


def _unit(v) -> list[float]:
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [float(x) / n for x in v]


def plane_residual(p: Parameters) -> Column:
    """Normal (3), offset."""
    return _dot([F.col(a) for a in AXES], _unit(p[:3])) + float(p[3])


def sphere_residual(p: Parameters) -> Column:
    """Centre (3), radius."""
    d = _off(p)
    return F.sqrt(_dot(d, d)) - float(p[3])


def cylinder_residual(p: Parameters) -> Column:
    """A point of the axis (3), its direction (3), radius."""
    d, u = _off(p), _unit(p[3:6])
    along = _dot(d, u)
    return F.sqrt(F.greatest(_dot(d, d) - along * along, F.lit(0.0))) - float(p[6])


def cone_residual(p: Parameters) -> Column:
    """Tip (3), direction of the opening (3), half angle."""
    d, u = _off(p), _unit(p[3:6])
    along = _dot(d, u)
    out = F.sqrt(F.greatest(_dot(d, d) - along * along, F.lit(0.0)))
    return out * math.cos(p[6]) - along * math.sin(p[6])


def torus_residual(p: Parameters) -> Column:
    """Centre (3), axis (3), radius of the ring, radius of the tube."""
    d, u = _off(p), _unit(p[3:6])
    along = _dot(d, u)
    out = F.sqrt(F.greatest(_dot(d, d) - along * along, F.lit(0.0))) - float(p[6])
    return F.sqrt(out * out + along * along) - float(p[7])


RESIDUALS: dict[str, Callable[[Parameters], Column]] = {"plane": plane_residual, "sphere": sphere_residual, "cylinder": cylinder_residual, "cone": cone_residual, "torus": torus_residual}


def fitted(df: DataFrame, kind: str, start: Parameters, rounds: int = 30, step: float = 1e-6) -> tuple[Parameters, float]:
    """Parameters of least squared residuals, and their rms. A round is one aggregate: products of the residual's central
    differences by each parameter; the driver solves the small damped system, and a step that makes it worse is taken back."""
    residual, p, damp = RESIDUALS[kind], [float(v) for v in start], 1e-3
    moved = lambda p, k, by: [v + (by if j == k else 0.0) for j, v in enumerate(p)]
    n = len(p)

    def sums(p):
        r = residual(p)
        j = [(residual(moved(p, k, step)) - residual(moved(p, k, -step))) / (2 * step) for k in range(n)]
        x = df.select(r.alias("r"), *[c.alias(f"j{k}") for k, c in enumerate(j)])
        pairs = [F.sum(F.col(f"j{a}") * F.col(f"j{b}")).alias(f"h{a}_{b}") for a, b in itertools.combinations_with_replacement(range(n), 2)]
        row = x.agg(F.count("*").alias("n"), F.sum(F.col("r") * F.col("r")).alias("e"), *[F.sum(F.col(f"j{k}") * F.col("r")).alias(f"g{k}") for k in range(n)], *pairs).first()
        h = np.array([[row[f"h{min(a, b)}_{max(a, b)}"] or 0.0 for b in range(n)] for a in range(n)])
        return row["n"], row["e"] or 0.0, np.array([row[f"g{k}"] or 0.0 for k in range(n)]), h

    count, error, g, h = sums(p)
    for _ in range(rounds):
        by = -np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-12), g, rcond=None)[0]
        new = [a + float(b) for a, b in zip(p, by, strict=True)]
        found = sums(new)
        if found[1] <= error:
            done = error - found[1] <= 1e-14 * (1.0 + error)
            p, (count, error, g, h), damp = new, found, damp / 10
            if done:
                break
        else:
            damp *= 10
            if damp > 1e8:
                break
    return p, math.sqrt(error / max(count, 1))


def sphere_of_four(a: Column, b: Column, c: Column, d: Column) -> Column:
    """x, y, z, r of the sphere through four points, by Cramer's rule; NULL for points of one plane."""
    rows = [V.sub(p, a) for p in (b, c, d)]
    half = [0.5 * V.dot(r, r) for r in rows]
    det = V.dot(rows[0], V.cross(rows[1], rows[2]))
    part = lambda x, y: F.try_divide(V.dot(V.vec(*half), V.cross(x, y)), det)
    column = lambda k: V.vec(*[r[k] for r in rows])
    x, y, z = part(column("y"), column("z")), part(column("z"), column("x")), part(column("x"), column("y"))
    return F.when(F.abs(det) > 1e-12, F.struct((a.x + x).alias("x"), (a.y + y).alias("y"), (a.z + z).alias("z"), F.sqrt(x * x + y * y + z * z).alias("r")))


def robust_sphere(df: DataFrame, outliers: float = 0.3, candidates: int = 100, seed: int = 1, sample: int = 2000) -> tuple[Parameters, float]:
    """Sphere of least median residual among those through four sampled points, refitted to the rows within 2.5 robust
    deviations. A seeded sample proposes; the order statistic of each proposal is taken over that sample, the fit over all."""
    rows = np.array(df.orderBy(F.xxhash64(F.lit(seed), "pid"), "pid").limit(sample).select(*AXES).collect(), float)  # `sample` rows at most
    rng, best = np.random.default_rng(seed), (math.inf, None)
    for _ in range(candidates):
        q = rows[rng.choice(len(rows), 4, replace=False)]
        m, h = q[1:] - q[0], 0.5 * ((q[1:] - q[0]) ** 2).sum(1)
        if abs(np.linalg.det(m)) < 1e-12:
            continue
        c = np.linalg.solve(m, h)
        off = np.abs(np.linalg.norm(rows - (q[0] + c), axis=1) - np.linalg.norm(c))
        score = float(np.quantile(off, 1.0 - outliers))
        if score < best[0]:
            best = (score, [*(q[0] + c).tolist(), float(np.linalg.norm(c))])
    off = df.select("*", F.abs(sphere_residual(best[1])).alias("off_"))
    spread = 1.4826 * (kth(off, "off_", off.count() // 2) or 0.0)
    return fitted(off.where(F.col("off_") <= max(2.5 * spread, best[0])).select(*AXES), "sphere", best[1])


def _proposals(p: np.ndarray, n: np.ndarray, kinds: list[str], rng) -> list[tuple[str, Parameters]]:
    """Shapes through a few oriented points."""
    out = []
    if "plane" in kinds:
        out.append(("plane", [*n[0].tolist(), float(-n[0] @ p[0])]))
    if "sphere" in kinds:
        # where the two normals' lines come nearest
        m = np.column_stack([n[0], -n[1]])
        t = np.linalg.lstsq(m, p[1] - p[0], rcond=None)[0]
        c = (p[0] + t[0] * n[0] + p[1] + t[1] * n[1]) / 2
        out.append(("sphere", [*c.tolist(), float((np.linalg.norm(p[0] - c) + np.linalg.norm(p[1] - c)) / 2)]))
    u = np.cross(n[0], n[1])
    if "cylinder" in kinds and np.linalg.norm(u) > 1e-6:
        u /= np.linalg.norm(u)
        flat = lambda v: v - (v @ u) * u
        m = np.column_stack([flat(n[0]), -flat(n[1])])
        t = np.linalg.lstsq(m, flat(p[1] - p[0]), rcond=None)[0]
        c = p[0] + t[0] * n[0]
        out.append(("cylinder", [*c.tolist(), *u.tolist(), float(np.linalg.norm(flat(p[0] - c)))]))
    if "cone" in kinds and len(p) > 2 and abs(np.linalg.det(n[:3])) > 1e-6:
        tip = np.linalg.solve(n[:3], (n[:3] * p[:3]).sum(1))
        d = p[:3] - tip
        d /= np.maximum(np.linalg.norm(d, axis=1), 1e-12)[:, None]
        u = np.cross(d[1] - d[0], d[2] - d[0])
        if np.linalg.norm(u) > 1e-9:
            u /= np.linalg.norm(u)
            u = u if u @ d.mean(0) > 0 else -u
            out.append(("cone", [*tip.tolist(), *u.tolist(), float(np.arccos(np.clip(d @ u, -1, 1)).mean())]))
    return out


def detected(points: DataFrame, kinds: list[str], tolerance: float, least: int, most: int = 20, candidates: int = 200, seed: int = 1, sample: int = 3000) -> tuple[list[dict], DataFrame]:
    """Shapes with at least `least` rows within `tolerance`, best first, and the rows with `shape` (place in the list, -1).

    Points have normals. Each round a seeded sample of the rows left proposes shapes through neighbours in a cell of a
    random level (near points lie on one shape more often); all proposals are scored over all rows left in one aggregate;
    the best is refitted to its rows, which then leave. Rows are written between rounds."""
    scratch = Scratch(points.sparkSession)
    left, _ = scratch.cut(points)
    found, done = [], None
    for _ in range(most):
        rows = left.orderBy(F.xxhash64(F.lit(seed + len(found)), "pid"), "pid").limit(sample).select(*AXES, "nx", "ny", "nz").collect()  # `sample` rows
        x = np.array(rows, float).reshape(-1, 6)
        if len(x) < 4:
            break
        rng, proposals = np.random.default_rng(seed + len(found)), []
        low, side = x[:, :3].min(0), max(float((x[:, :3].max(0) - x[:, :3].min(0)).max()), 1e-9)
        while len(proposals) < candidates:
            at, size = int(rng.integers(len(x))), side / 2 ** int(rng.integers(0, 5))
            near = np.flatnonzero((np.floor((x[:, :3] - low) / size) == np.floor((x[at, :3] - low) / size)).all(1))
            pick = rng.choice(near if len(near) > 3 else len(x), 3, replace=False)
            proposals += _proposals(x[pick, :3], x[pick, 3:], kinds, rng) or [("plane", [0.0, 0.0, 1.0, 1e18])]
        hit = lambda k, p: F.abs(RESIDUALS[k](p)) <= tolerance
        row = left.agg(*[F.count(F.when(hit(k, p), 1)).alias(f"s{i}") for i, (k, p) in enumerate(proposals)]).first()
        best = max(range(len(proposals)), key=lambda i: (row[f"s{i}"], -i))
        kind, p = proposals[best]
        if row[f"s{best}"] < least:
            break
        refit, rms = fitted(left.where(hit(kind, p)), kind, p, rounds=8)
        p = refit if left.where(hit(kind, refit)).count() >= row[f"s{best}"] else p
        mine, _ = scratch.cut(left.where(hit(kind, p)).withColumn("shape", F.lit(len(found))))
        found.append({"kind": kind, "parameters": p, "rows": mine.count(), "rms": rms})
        done = mine if done is None else done.unionByName(mine)
        left, _ = scratch.cut(left.where(~F.coalesce(hit(kind, p), F.lit(False))))
    rest = left.withColumn("shape", F.lit(-1))
    return found, rest if done is None else done.unionByName(rest)


def weighted_score(df: DataFrame, kind: str, p: Parameters, tolerance: float) -> DataFrame:
    """One row, score: rows within the tolerance weighted by how near they are."""
    off = F.abs(RESIDUALS[kind](p)) / tolerance
    return df.agg(F.coalesce(F.sum(F.when(off <= 1, 1.0 - off)), F.lit(0.0)).alias("score"))


def equivalent(df: DataFrame, a: tuple[str, Parameters], b: tuple[str, Parameters], tolerance: float, share: float = 0.9) -> DataFrame:
    """One row, same: each of two shapes explains that share of the rows that the other explains."""
    p, q = (F.abs(RESIDUALS[k](v)) <= tolerance for k, v in (a, b))
    n = lambda c: F.count(F.when(c, 1))
    return df.agg((n(p & q) >= share * F.greatest(n(p), n(q))).alias("same"))


def score_bounds(hits: int, seen: int, total: int) -> tuple[float, float]:
    """Interval of a shape's support in `total` rows from the hits among `seen` random ones: mean and one deviation of the
    hypergeometric estimate."""
    mean = (hits + 1) * total / (seen + 2)
    spread = math.sqrt(max((hits + 1) * (seen - hits + 1) / ((seen + 2) ** 2 * (seen + 3)), 0.0)) * total
    return max(mean - spread, 0.0), min(mean + spread, float(total))


def plane_bitmap(df: DataFrame, u, v, size: float) -> DataFrame:
    """One row: bounds of the rows in a plane's axes u and v, and cells of a bitmap of that size along both."""
    at = [_dot([F.col(a) for a in AXES], [float(x) for x in axis]) for axis in (u, v)]
    e = df.agg(F.min(at[0]).alias("u0"), F.max(at[0]).alias("u1"), F.min(at[1]).alias("v0"), F.max(at[1]).alias("v1"))
    cells = lambda a, b: (F.floor((F.col(b) - F.col(a)) / size) + 1).alias(f"n{a[0]}")
    return e.select("*", cells("u0", "u1"), cells("v0", "v1"))


def quadric_height(c: list[Column], x: Column, y: Column) -> Column:
    """z of a quadric c0 + c1 x + c2 y + c3 x^2 + c4 xy + c5 y^2."""
    return c[0] + c[1] * x + c[2] * y + c[3] * x * x + c[4] * x * y + c[5] * y * y


def quadric_grid(quadrics: DataFrame, key: str, low: float, high: float, steps: int) -> DataFrame:
    """key, i, j, x, y, z: a quadric (c0 to c5) over a regular grid of `steps` cells a side."""
    at = lambda k: low + (high - low) * F.col(k) / steps
    k = F.sequence(F.lit(0), F.lit(steps))
    x = quadrics.withColumn("i", F.explode(k)).withColumn("j", F.explode(k)).withColumn("x", at("i")).withColumn("y", at("j"))
    return x.select(key, "i", "j", "x", "y", quadric_height([F.col(f"c{n}") for n in range(6)], F.col("x"), F.col("y")).alias("z"))
