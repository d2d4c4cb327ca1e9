"""Planar and spatial geometry as column expressions. Structs hold points (x, y[, z]), segments and planes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import clamp, cross, dot, length, normalize, scale, sub, vec


def point2(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def segment(x1, y1, x2, y2) -> Column:
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return F.struct(*[c(v).cast("double").alias(n) for v, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])


def line_through(s: Column) -> Column:
    """a, b, c with a*x + b*y + c = 0 through a segment's ends."""
    a, b = s.y2 - s.y1, s.x1 - s.x2
    return F.struct(a.alias("a"), b.alias("b"), (0.0 - (a * s.x1 + b * s.y1)).alias("c"))


def intersect_lines(p: Column, q: Column) -> Column:
    """The point of two lines; NULL when they are parallel."""
    d = p.a * q.b - q.a * p.b
    safe = F.when(F.abs(d) > 1e-12, d)
    return F.when(F.abs(d) > 1e-12, point2((p.b * q.c - q.b * p.c) / safe, (q.a * p.c - p.a * q.c) / safe))


def segment_length(s: Column) -> Column:
    return F.hypot(s.x2 - s.x1, s.y2 - s.y1)


def line_distance(s: Column, x: Column, y: Column) -> Column:
    """Distance of a point from the line through a segment; NULL for a segment of no length."""
    n = segment_length(s)
    return F.when(n > 0, F.abs((s.x2 - s.x1) * (s.y1 - y) - (s.x1 - x) * (s.y2 - s.y1)) / F.when(n > 0, n))


def point_segment_distance2(s: Column, x: Column, y: Column) -> Column:
    dx, dy = s.x2 - s.x1, s.y2 - s.y1
    n = dx * dx + dy * dy
    t = clamp(F.when(n > 0, ((x - s.x1) * dx + (y - s.y1) * dy) / F.when(n > 0, n)).otherwise(F.lit(0.0)), 0.0, 1.0)
    u, v = x - (s.x1 + t * dx), y - (s.y1 + t * dy)
    return u * u + v * v


def folded_angle(p: Column, q: Column) -> Column:
    """Angle of two segments' directions in degrees, folded to 0..90."""
    n = segment_length(p) * segment_length(q)
    d = (p.x2 - p.x1) * (q.x2 - q.x1) + (p.y2 - p.y1) * (q.y2 - q.y1)
    return F.degrees(F.acos(F.least(F.when(n > 0, F.abs(d) / F.when(n > 0, n)), F.lit(1.0))))


def end_distances(p: Column, q: Column) -> list[Column]:
    """Distances of q's ends from p's line, then of p's ends from q's."""
    return [line_distance(p, q.x1, q.y1), line_distance(p, q.x2, q.y2), line_distance(q, p.x1, p.y1), line_distance(q, p.x2, p.y2)]


def segment_measure(p: Column, q: Column) -> Column:
    """angle (0..90), mean, least and greatest of the four end distances, and energy = angle + 5 * mean."""
    d = end_distances(p, q)
    mean = (d[0] + d[1] + d[2] + d[3]) / 4.0
    angle = folded_angle(p, q)
    short = F.when(segment_length(p) <= segment_length(q), F.least(d[2], d[3])).otherwise(F.least(d[0], d[1]))
    long_ = F.when(segment_length(p) <= segment_length(q), F.greatest(d[2], d[3])).otherwise(F.greatest(d[0], d[1]))
    return F.struct(angle.alias("angle"), mean.alias("mean"), short.alias("least_short"), long_.alias("greatest_short"), F.greatest(*d).alias("greatest"), (angle + 5.0 * mean).alias("energy"))


def segments_cross(p: Column, q: Column) -> Column:
    """Whether two segments cross properly: each one's ends lie strictly on different sides of the other."""
    side = lambda s, x, y: (s.x2 - s.x1) * (y - s.y1) - (s.y2 - s.y1) * (x - s.x1)
    return (side(p, q.x1, q.y1) * side(p, q.x2, q.y2) < 0) & (side(q, p.x1, p.y1) * side(q, p.x2, p.y2) < 0)


def clip_to_box(s: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """A segment's part inside a closed rectangle, by the parameter interval of all four sides; NULL if there is none."""
    dx, dy = s.x2 - s.x1, s.y2 - s.y1
    low, high, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for d, at, a, b in ((dx, s.x1, x0, x1), (dy, s.y1, y0, y1)):
        t0, t1 = F.try_divide(F.lit(a) - at, d), F.try_divide(F.lit(b) - at, d)
        low = F.when(d == 0, low).otherwise(F.greatest(low, F.least(t0, t1)))
        high = F.when(d == 0, high).otherwise(F.least(high, F.greatest(t0, t1)))
        ok = ok & F.when(d == 0, at.between(a, b)).otherwise(F.lit(True))
    return F.when(ok & (low <= high), segment(s.x1 + low * dx, s.y1 + low * dy, s.x1 + high * dx, s.y1 + high * dy))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length of two intervals over that of the shorter one."""
    low, high = F.greatest(F.least(a0, a1), F.least(b0, b1)), F.least(F.greatest(a0, a1), F.greatest(b0, b1))
    return F.try_divide(F.greatest(high - low, F.lit(0.0)), F.least(F.abs(a1 - a0), F.abs(b1 - b0)))


def point_in_polygon(x: Column, y: Column, ring: Column | list[tuple[float, float]]) -> Column:
    """Even-odd rule. `ring` is a list of points or an array column of structs (x, y); it is closed by itself."""
    if not isinstance(ring, Column):
        ring = F.array(*[point2(F.lit(float(a)), F.lit(float(b))) for a, b in ring])
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    at = lambda a, b: a.x + (y - a.y) * F.try_divide(b.x - a.x, b.y - a.y)
    hits = F.zip_with(ring, turned, lambda a, b: F.when(((a.y > y) != (b.y > y)) & (x < at(a, b)), 1).otherwise(0))
    return F.aggregate(hits, F.lit(0), lambda n, h: n + h) % 2 == 1


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    return 0.5 * length(cross(sub(b, a), sub(c, a)))


def signed_volume(a: Column, b: Column, c: Column) -> Column:
    """Signed volume of the tetrahedron with the origin."""
    return dot(a, cross(b, c)) / 6.0


def barycentric(x: Column, y: Column, a: Column, b: Column, c: Column) -> Column:
    """Weights of a point in a planar triangle; NULL if the triangle has no area."""
    d = (b.y - c.y) * (a.x - c.x) + (c.x - b.x) * (a.y - c.y)
    u = F.try_divide((b.y - c.y) * (x - c.x) + (c.x - b.x) * (y - c.y), d)
    v = F.try_divide((c.y - a.y) * (x - c.x) + (a.x - c.x) * (y - c.y), d)
    return F.struct(u.alias("u"), v.alias("v"), (1.0 - u - v).alias("w"))


def point_in_triangle(x: Column, y: Column, a: Column, b: Column, c: Column) -> Column:
    k = barycentric(x, y, a, b, c)
    return (k.u >= 0) & (k.v >= 0) & (k.w >= 0)


def blend3(k: Column, a: Column, b: Column, c: Column) -> Column:
    """Vertex values blended by barycentric weights."""
    return vec(k.u * a.x + k.v * b.x + k.w * c.x, k.u * a.y + k.v * b.y + k.w * c.y, k.u * a.z + k.v * b.z + k.w * c.z)


def plane_distance(p: Column, normal: Column, d: Column) -> Column:
    """Signed distance from the plane normal . p + d = 0."""
    return F.try_divide(dot(p, normal) + d, length(normal))


def plane_through(a: Column, b: Column, c: Column) -> Column:
    """Unit normal and offset of a plane by three points; NULL when they lie on a line."""
    n = normalize(cross(sub(b, a), sub(c, a)))
    return F.when(n.isNotNull(), F.struct(n.alias("n"), (0.0 - dot(n, a)).alias("d")))


def ray_plane(origin: Column, ray: Column, normal: Column, d: Column) -> Column:
    """Parameter t >= 0 of a ray's point in a plane, else NULL."""
    t = F.try_divide(0.0 - (dot(origin, normal) + d), F.when(F.abs(dot(ray, normal)) > 1e-12, dot(ray, normal)))
    return F.when(t >= 0, t)


def ray_triangle(origin: Column, ray: Column, a: Column, b: Column, c: Column) -> Column:
    """Parameter t > 0 of a ray's point in a triangle, else NULL."""
    e, f = sub(b, a), sub(c, a)
    p = cross(ray, f)
    det = F.when(F.abs(dot(e, p)) > 1e-12, dot(e, p))
    s = sub(origin, a)
    u, q = dot(s, p) / det, cross(s, e)
    v, t = dot(ray, q) / det, dot(f, q) / det
    return F.when((u >= 0) & (v >= 0) & (u + v <= 1) & (t > 0), t)


def point_triangle_distance2(p: Column, a: Column, b: Column, c: Column) -> Column:
    """Squared distance of a point from a triangle in space: from its plane if the foot is inside, else from its sides."""

    def side(s: Column, e: Column) -> Column:
        d, w = sub(e, s), sub(p, s)
        t = clamp(F.coalesce(F.try_divide(dot(w, d), dot(d, d)), F.lit(0.0)), 0.0, 1.0)
        r = sub(w, scale(d, t))
        return dot(r, r)

    n = cross(sub(b, a), sub(c, a))
    nn = dot(n, n)
    inside = (dot(cross(sub(b, a), sub(p, a)), n) >= 0) & (dot(cross(sub(c, b), sub(p, b)), n) >= 0) & (dot(cross(sub(a, c), sub(p, c)), n) >= 0)
    flat = F.try_divide(dot(sub(p, a), n) * dot(sub(p, a), n), nn)
    return F.when((nn > 0) & inside, flat).otherwise(F.least(side(a, b), side(b, c), side(c, a)))


def dip_direction(n: Column) -> Column:
    """Dip (0..90) and dip direction (0..360) in degrees of a plane by its normal, the normal taken upwards."""
    up = F.when(n.z < 0, -1.0).otherwise(1.0)
    dip = F.degrees(F.acos(clamp(F.try_divide(F.abs(n.z), length(n)), -1.0, 1.0)))
    turn = F.degrees(F.atan2(n.x * up, n.y * up))
    return F.struct(dip.alias("dip"), F.when(turn < 0, turn + 360.0).otherwise(turn + 0.0).alias("direction"))


def strike_dip(n: Column) -> Column:
    """Strike (90 degrees before the dip direction) and dip."""
    d = dip_direction(n)
    strike = d.direction - 90.0
    return F.struct(F.when(strike < 0, strike + 360.0).otherwise(strike).alias("strike"), d.dip.alias("dip"))


def normal_of_dip(dip: Column, direction: Column) -> Column:
    s = F.sin(F.radians(dip))
    return vec(s * F.sin(F.radians(direction)), s * F.cos(F.radians(direction)), F.cos(F.radians(dip)))


def spherical(p: Column) -> Column:
    """Yaw and pitch in degrees, and range, as a scanner sees a point."""
    r = length(p)
    return F.struct(F.degrees(F.atan2(p.y, p.x)).alias("yaw"), F.degrees(F.asin(clamp(F.try_divide(p.z, r), -1.0, 1.0))).alias("pitch"), r.alias("range"))


def unroll_cylinder(p: Column, radius: float) -> Column:
    """A point rolled off a vertical cylinder around the origin: arc length, height, distance from the surface."""
    return vec(F.atan2(p.y, p.x) * radius, p.z, F.hypot(p.x, p.y) - radius)


def unroll_cone(p: Column, half_angle: float) -> Column:
    """A point rolled off a vertical cone with its tip at the origin, opening downwards."""
    slant = (F.hypot(p.x, p.y) * math.sin(half_angle)) + (0.0 - p.z) * math.cos(half_angle)
    turn = F.atan2(p.y, p.x) * math.sin(half_angle)
    return vec(slant * F.sin(turn), 0.0 - slant * F.cos(turn), F.hypot(p.x, p.y) * math.cos(half_angle) + p.z * math.sin(half_angle))


def fold_upwards(n: Column, towards: Column) -> Column:
    """A normal turned to the side of `towards`."""
    return F.when(dot(n, towards) < 0, scale(n, -1.0)).otherwise(n)
