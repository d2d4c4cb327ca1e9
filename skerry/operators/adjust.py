"""Bundle adjustment as tables: residuals with their derivatives as columns, normal equations by blocks, masks, routes.

A camera is axis-angle w (wx, wy, wz), translation t (tx, ty, tz) and focal length f with its centre (cx, cy); a point
is (x, y, z). Derivatives are analytic, for a small turn of the camera on the left of its rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import camera
from skerry.functions import vectors as V
from skerry.plans.iterate import let

CAMERA = ("w0", "w1", "w2", "t0", "t1", "t2")


def point_residual(r: Column, t: Column, f, cx, cy, p: Column, u: Column, v: Column) -> Column:
    """du, dv: where a point projects less where it was seen, and each one's derivatives by the camera's six numbers (a0..a5,
    b0..b5) and by the point (pa0..pa2, pb0..pb2)."""
    return let(F.struct(camera.to_camera(r, t, p).alias("q"), camera.rotate(r, p).alias("turned")), lambda s: _point_terms(r, f, cx, cy, u, v, s.q, s.turned))


def _point_terms(r: Column, f, cx, cy, u: Column, v: Column, q: Column, turned: Column) -> Column:
    """The terms of a point in the camera's axes; `turned` is the point before the translation, which a turn moves."""
    z = F.when(q.z > 0, q.z)
    gx, gz = f / z, 0.0 - f * q.x / (z * z)
    hy, hz = f / z, 0.0 - f * q.y / (z * z)
    zero = F.lit(0.0)
    du = [gz * turned.y, gx * turned.z - gz * turned.x, 0.0 - gx * turned.y, gx, zero, gz]
    dv = [hz * turned.y - hy * turned.z, 0.0 - hz * turned.x, hy * turned.x, zero, hy, hz]
    m = [camera.row(r, k) for k in range(3)]
    by_point = [[gx * m[0][c] + gz * m[2][c] for c in "xyz"], [hy * m[1][c] + hz * m[2][c] for c in "xyz"]]
    named = [(f * q.x / z + cx - u).alias("du"), (f * q.y / z + cy - v).alias("dv")]
    named += [c.alias(f"a{k}") for k, c in enumerate(du)] + [c.alias(f"b{k}") for k, c in enumerate(dv)]
    named += [c.alias(f"{n}{k}") for n, cs in zip(("pa", "pb"), by_point, strict=True) for k, c in enumerate(cs)]
    return F.when(q.z > 0, F.struct(*named))


def line_residual(r: Column, t: Column, f, cx, cy, p: Column, q: Column, a: Column, b: Column, c: Column) -> Column:
    """Signed distances of the projected ends of a 3D line from the seen line a*u + b*v + c = 0 of unit normal."""
    on = lambda i: a * i.u + b * i.v + c
    off = lambda x: let(camera.to_camera(r, t, x), lambda y: let(camera.project(y, f, f, cx, cy), on))
    return F.struct(off(p).alias("d0"), off(q).alias("d1"))


def masked(columns: dict[str, Column], free: dict[str, bool]) -> dict[str, Column]:
    """Derivatives with those by constant numbers set to zero."""
    return {k: c if free.get(k, True) else F.lit(0.0) for k, c in columns.items()}


def normal_blocks(residuals: DataFrame, key: str, prefixes: tuple[str, str], n: int, residual: tuple[str, str] = ("du", "dv")) -> DataFrame:
    """key, i, j, h and key, i, g folded into one table (j = -1 for g): sums of derivative products per key, added up before
    any shuffle. `residuals` has `prefixes`0.. for both rows of each observation."""
    h = [(i, j, F.sum(sum((F.col(f"{p}{i}") * F.col(f"{p}{j}") for p in prefixes), F.lit(0.0)))) for i in range(n) for j in range(i, n)]
    g = [(i, -1, F.sum(sum((F.col(f"{p}{i}") * F.col(d) for p, d in zip(prefixes, residual, strict=True)), F.lit(0.0)))) for i in range(n)]
    x = residuals.groupBy(key).agg(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), s.alias("h")) for i, j, s in h + g]).alias("e"))
    return x.select(key, F.explode("e").alias("e")).select(key, "e.i", "e.j", "e.h")


def two_view_line(n1: Column, n2: Column, d1: Column, d2: Column) -> Column:
    """The line in both planes n . p + d = 0 that two views see it in: a point (nearest the origin) and its unit direction;
    NULL for parallel planes."""
    u = V.cross(n1, n2)
    s = V.dot(u, u)
    p = V.sub(V.scale(V.cross(n2, u), 0.0 - d1), V.scale(V.cross(n1, u), 0.0 - d2))
    ok = s > 1e-18
    safe = F.when(ok, s)
    return F.when(ok, F.struct(V.scale(p, F.lit(1.0) / safe).alias("point"), V.normalize(u).alias("direction")))


def same_line_3d(p1: Column, p2: Column, q1: Column, q2: Column, degrees: float, distance: float) -> Column:
    """Whether two segments in space lie on one line: folded angle, and distances of one's ends from the other's line."""
    def near(d: Column) -> Column:
        angle = let(V.sub(q2, q1), lambda e: F.degrees(F.acos(F.least(F.try_divide(F.abs(V.dot(d, e)), V.length(e)), F.lit(1.0)))))
        off = lambda x: let(V.cross(V.sub(x, p1), d), V.length)
        return (angle <= degrees) & (F.greatest(off(q1), off(q2)) <= distance)

    return F.coalesce(let(V.normalize(V.sub(p2, p1)), near), F.lit(False))


def routed(points: DataFrame, least_inliers: int = 2, least_seen: int = 2) -> DataFrame:
    """Points (inliers, seen, host_stays) with `route`: keep while the host frame stays; of leaving ones those that were seen
    and good often enough are folded into the prior, the others dropped."""
    fold = (F.col("inliers") >= least_inliers) & (F.col("seen") >= least_seen)
    return points.withColumn("route", F.when(F.col("host_stays") & (F.col("inliers") > 0), "keep").when(fold, "marginalise").otherwise("drop"))


def with_residuals(points: DataFrame, residuals: DataFrame, key: str) -> DataFrame:
    """Points that have a residual left."""
    return points.join(residuals.select(key).distinct(), key, "left_semi")


def photometric(target: DataFrame, seen: DataFrame, gain: float = 1.0, bias: float = 0.0, huber: float = 9.0) -> DataFrame:
    """key, r, weight, gu, gv, state: of positions `seen` (key, img, u, v, value) the bilinear value of the target raster (img,
    i, j, v) less the host's value under an affine light change; its gradient; `oob` off the raster, `outlier` beyond four
    Huber widths, else `in`."""
    at = seen.select("*", F.floor("u").alias("i0"), F.floor("v").alias("j0"))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    x = at.select("key", "img", "value", (F.col("u") - F.col("i0")).alias("fu"), (F.col("v") - F.col("j0")).alias("fv"), "i0", "j0", corner.alias("c"))
    x = x.withColumn("i", F.col("i0") + F.col("c.a")).withColumn("j", F.col("j0") + F.col("c.b"))
    x = x.join(target.select("img", "i", "j", F.col("v").alias("w")), ["img", "i", "j"], "left")
    wu = F.when(F.col("c.a") == 1, F.col("fu")).otherwise(1.0 - F.col("fu"))
    wv = F.when(F.col("c.b") == 1, F.col("fv")).otherwise(1.0 - F.col("fv"))
    su, sv = (F.when(F.col(f"c.{n}") == 1, 1.0).otherwise(-1.0) for n in "ab")
    w = F.col("w")
    x = x.groupBy("key", "value").agg(F.count("w").alias("n"), F.sum(w * wu * wv).alias("q"), F.sum(w * su * wv).alias("gu"), F.sum(w * wu * sv).alias("gv"))
    r = F.when(F.col("n") == 4, F.col("q") - (gain * F.col("value") + bias))
    weight = F.when(F.abs(r) <= huber, 1.0).otherwise(huber / F.abs(r))
    state = F.when(F.col("n") < 4, "oob").when(F.abs(r) > 4 * huber, "outlier").otherwise("in")
    return x.select("key", r.alias("r"), weight.alias("weight"), "gu", "gv", state.alias("state"))


def views_of_faces(vertices: DataFrame, faces: DataFrame, views: DataFrame, far: float, width: int, height: int, most_angle: float = 75.0, buffer: float = 8.0) -> DataFrame:
    """fid, view_id, angle, depth, area: which views see which faces. `views` has view_id, r (nine numbers), t, f, cx, cy, and
    sees as far as `far`. Views and faces meet by cells of that size; then go faces turned away or by more than an angle,
    behind the view or beyond its reach, with a corner off the image, and those whose middle a face nearer by more than a
    hundredth hides in a buffer of `buffer` pixels a cell. `area` is that of the projected face."""
    from .mesh import with_points
    from .spatial import radius_join

    a, b, c = F.col("a"), F.col("b"), F.col("c")
    x = with_points(vertices, faces).withColumn("m", V.scale(V.add(V.add(a, b), c), 1.0 / 3.0))
    x = x.select(F.col("fid").alias("pid"), "m.*", F.struct("a", "b", "c", "m").alias("face"))
    v = views.withColumn("o", camera.centre(F.col("r"), F.col("t")))
    v = v.select(F.col("view_id").alias("pid"), "o.*", F.struct("r", "t", "f", "cx", "cy").alias("view"))
    x = radius_join(x, v, far).select(F.col("a.pid").alias("fid"), F.col("b.pid").alias("view_id"), "a.face", "b.view", V.vec("b.x", "b.y", "b.z").alias("o"))
    f, w = F.col("face"), F.col("view")
    away = let(F.struct(V.cross(V.sub(f.b, f.a), V.sub(f.c, f.a)).alias("n"), V.sub(F.col("o"), f.m).alias("to")), lambda s: V.angle_degrees(s.n, s.to))
    at = lambda p: let(camera.to_camera(w.r, w.t, p), lambda q: camera.project(q, w.f, w.f, w.cx, w.cy))
    x = x.select("fid", "view_id", away.alias("angle"), "face", "view").where(F.col("angle") < most_angle)
    x = x.select("fid", "view_id", "angle", *[at(f[n]).alias(n) for n in "abcm"]).where(F.col("m").isNotNull())
    inside = F.lit(True)
    for n in "abc":
        inside = inside & F.coalesce(camera.inside_image(F.col(f"{n}.u"), F.col(f"{n}.v"), width, height), F.lit(False))
    area = F.abs((F.col("b.u") - F.col("a.u")) * (F.col("c.v") - F.col("a.v")) - (F.col("c.u") - F.col("a.u")) * (F.col("b.v") - F.col("a.v"))) / 2.0
    x = x.where(inside).select("fid", "view_id", "angle", F.col("m.depth").alias("depth"), area.alias("area"), F.floor(F.col("m.u") / buffer).alias("i"), F.floor(F.col("m.v") / buffer).alias("j"))
    front = x.groupBy("view_id", "i", "j").agg(F.min("depth").alias("front"))
    return x.join(front, ["view_id", "i", "j"]).where(F.col("depth") <= 1.01 * F.col("front")).select("fid", "view_id", "angle", "depth", "area")


def seam_edges_of_labels(faces: DataFrame, labels: DataFrame, vertices: DataFrame, one: int, two: int) -> DataFrame:
    """vid, other: edges at each vertex between a face of label `one` and a face of label `two`, of some length."""
    from .mesh import seam_edges

    pair = labels.where(F.col("label").isin(one, two))
    e = seam_edges(faces.join(pair.select("fid"), "fid", "left_semi"), pair).select("a", "b").distinct()
    e = e.select(F.col("a").alias("vid"), F.col("b").alias("other")).union(e.select(F.col("b").alias("vid"), F.col("a").alias("other")))
    at = lambda s: vertices.select(F.col("vid").alias(s), V.vec("x", "y", "z").alias(f"p_{s}"))
    return e.join(at("vid"), "vid").join(at("other"), "other").where(V.distance2(F.col("p_vid"), F.col("p_other")) > 0).select("vid", "other")


def merged_projections(projections: DataFrame) -> DataFrame:
    """vid, patch, u, v, faces: a vertex's projections into one patch made one; its place is that of the smallest face's."""
    x = projections.groupBy("vid", "patch").agg(F.min_by(F.struct("u", "v"), F.array_min("faces")).alias("p"), F.flatten(F.collect_list("faces")).alias("faces"))
    return x.select("vid", "patch", "p.u", "p.v", F.sort_array(F.array_distinct("faces")).alias("faces"))


def edge_projections(projections: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, patch, pa, pb: patches that both ends of an edge project into, once each."""
    end = lambda s: projections.select(F.col("vid").alias(s), "patch", F.struct("u", "v").alias(f"p{s}"))
    x = edges.select("a", "b").distinct().join(end("a"), "a").join(end("b"), ["b", "patch"])
    return x.groupBy("a", "b", "patch").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"))


def subdivided(triangles: DataFrame, most_area: float) -> DataFrame:
    """fid, part, a, b, c: triangles cut into four by the middles of their sides, as often as it takes for no part to be larger
    than `most_area`. A face is cut k times at once: its parts are numbered by k digits of base four."""
    from skerry.functions.geometry import triangle_area

    area = triangle_area(F.col("a"), F.col("b"), F.col("c"))
    k = F.greatest(F.ceil(F.log2(F.greatest(area, F.lit(1e-300)) / most_area) / 2.0), F.lit(0)).cast("int")
    x = triangles.select("fid", "a", "b", "c", k.alias("k"))
    x = x.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(4.0), F.col("k")).cast("long") - 1)))
    middle = lambda p, q: V.lerp3(p, q, 0.5)

    def cut(t: Column, level: Column) -> Column:
        d = F.expr("0") + F.pmod(F.floor(F.col("part") / F.pow(F.lit(4.0), level.cast("double"))), F.lit(4))
        ab, bc, ca = middle(t.a, t.b), middle(t.b, t.c), middle(t.c, t.a)
        one = lambda p, q, r: F.struct(p.alias("a"), q.alias("b"), r.alias("c"))
        return F.when(d == 0, one(t.a, ab, ca)).when(d == 1, one(ab, t.b, bc)).when(d == 2, one(ca, bc, t.c)).otherwise(one(ab, bc, ca))

    levels = F.filter(F.sequence(F.lit(0), F.col("k")), lambda i: i < F.col("k"))
    return x.select("fid", "part", F.aggregate(levels, F.struct("a", "b", "c"), cut).alias("t")).select("fid", "part", "t.a", "t.b", "t.c")
