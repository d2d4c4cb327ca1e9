"""Pinhole cameras and rigid motions. A pose is a struct of nine rotation values r0..r8 (row by row) and t (x, y, z) that
takes world to camera; intrinsics are fx, fy, cx, cy and radial k1, k2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import dot, sub, vec


def row(r: Column, k: int) -> Column:
    return vec(F.get(r, F.lit(3 * k)), F.get(r, F.lit(3 * k + 1)), F.get(r, F.lit(3 * k + 2)))


def rotate(r: Column, p: Column) -> Column:
    """Row-major 3x3 array times a point."""
    return vec(dot(row(r, 0), p), dot(row(r, 1), p), dot(row(r, 2), p))


def transpose(r: Column) -> Column:
    return F.array(*[F.get(r, F.lit(3 * (k % 3) + k // 3)) for k in range(9)])


def skew(v: Column) -> Column:
    zero = F.lit(0.0)
    return F.array(zero, 0.0 - v.z, v.y, v.z, zero, 0.0 - v.x, 0.0 - v.y, v.x, zero)


def determinant(r: Column) -> Column:
    a, b, c = row(r, 0), row(r, 1), row(r, 2)
    return a.x * (b.y * c.z - b.z * c.y) - a.y * (b.x * c.z - b.z * c.x) + a.z * (b.x * c.y - b.y * c.x)


def inverse(r: Column) -> Column:
    """Inverse of a 3x3 array by cofactors; NULL for a singular one."""
    m = [F.get(r, F.lit(k)) for k in range(9)]
    co = [
        m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4],
        m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6], m[2] * m[3] - m[0] * m[5],
        m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3],
    ]
    d = determinant(r)
    return F.when(F.abs(d) > 1e-15, F.transform(F.array(*co), lambda v: F.try_divide(v, d)))


def axis_angle_matrix(v: Column) -> Column:
    """Rotation about a vector by its length in radians (Rodrigues)."""
    a = F.sqrt(dot(v, v))
    n = lambda c: F.coalesce(F.try_divide(c, a), F.lit(0.0))
    x, y, z, s, c = n(v.x), n(v.y), n(v.z), F.sin(a), F.cos(a)
    k = 1.0 - c
    return F.array(c + x * x * k, x * y * k - z * s, x * z * k + y * s, y * x * k + z * s, c + y * y * k, y * z * k - x * s, z * x * k - y * s, z * y * k + x * s, c + z * z * k)


def matrix_axis_angle(r: Column) -> Column:
    """Axis times angle of a rotation; half turns take the axis from the diagonal."""
    m = [F.get(r, F.lit(k)) for k in range(9)]
    cosine = F.least(F.greatest((m[0] + m[4] + m[8] - 1.0) / 2.0, F.lit(-1.0)), F.lit(1.0))
    angle = F.acos(cosine)
    w = vec(m[7] - m[5], m[2] - m[6], m[3] - m[1])
    half = F.try_divide(angle, 2.0 * F.sin(angle))
    root = lambda v: F.sqrt(F.greatest((v + 1.0) / 2.0, F.lit(0.0))) * angle
    sign = lambda v: F.when(v < 0, -1.0).otherwise(1.0)
    turn = vec(root(m[0]), root(m[4]) * sign(m[1]), root(m[8]) * sign(m[2]))
    return F.when(angle < 1e-12, vec(0.0, 0.0, 0.0)).when(cosine < -1 + 1e-12, turn).otherwise(vec(w.x * half, w.y * half, w.z * half))


def to_camera(r: Column, t: Column, p: Column) -> Column:
    q = rotate(r, p)
    return vec(q.x + t.x, q.y + t.y, q.z + t.z)


def to_world(r: Column, t: Column, q: Column) -> Column:
    return rotate(transpose(r), sub(q, t))


def centre(r: Column, t: Column) -> Column:
    q = rotate(transpose(r), t)
    return vec(0.0 - q.x, 0.0 - q.y, 0.0 - q.z)


def similarity(r: Column, t: Column, s, p: Column) -> Column:
    q = rotate(r, p)
    return vec(q.x * s + t.x, q.y * s + t.y, q.z * s + t.z)


def scale_about(p: Column, c: Column, s) -> Column:
    return vec(c.x + (p.x - c.x) * s, c.y + (p.y - c.y) * s, c.z + (p.z - c.z) * s)


def project(q: Column, fx, fy, cx, cy, k1=0.0, k2=0.0) -> Column:
    """Pixel (u, v) and depth of a point in camera space, with radial distortion; NULL behind the camera."""
    x, y = F.try_divide(q.x, F.when(q.z > 0, q.z)), F.try_divide(q.y, F.when(q.z > 0, q.z))
    r2 = x * x + y * y
    d = 1.0 + k1 * r2 + k2 * r2 * r2
    return F.when(q.z > 0, F.struct((fx * x * d + cx).alias("u"), (fy * y * d + cy).alias("v"), q.z.alias("depth")))


def back_project(u: Column, v: Column, depth: Column, fx, fy, cx, cy) -> Column:
    return vec((u - cx) / fx * depth, (v - cy) / fy * depth, depth)


def inside_image(u: Column, v: Column, width: int, height: int) -> Column:
    return (u >= 0) & (u <= width - 1) & (v >= 0) & (v <= height - 1)


def undistort(x: Column, y: Column, k1: float, k2: float, rounds: int = 8) -> Column:
    """Undo radial distortion of normalised coordinates by a fixed number of fixed-point steps."""

    def step(acc: Column, _: Column) -> Column:
        r2 = acc.x * acc.x + acc.y * acc.y
        d = 1.0 + k1 * r2 + k2 * r2 * r2
        return F.struct((x / d).alias("x"), (y / d).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")), step)


def in_frustum(q: Column, tan_half_x: float, tan_half_y: float, near: float, far: float) -> Column:
    return q.z.between(near, far) & (F.abs(q.x) <= q.z * tan_half_x) & (F.abs(q.y) <= q.z * tan_half_y)


def depth_uncertainty(depth: Column, focal: float, baseline: float, pixel: float = 1.0) -> Column:
    return depth * depth * (pixel / (focal * baseline))


def interpolate_pose(t0: Column, t1: Column, share: Column) -> Column:
    """Linear blend of two translations at a share of the way."""
    return vec(t0.x + (t1.x - t0.x) * share, t0.y + (t1.y - t0.y) * share, t0.z + (t1.z - t0.z) * share)


def depth_points(depth: Column, width: int, fx, fy, cx, cy, millimetres: float = 1000.0) -> Column:
    """A row-major depth raster to an array of points; cells without depth are left out."""
    at = F.transform(depth, lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    kept = F.filter(at, lambda c: c.d > 0)
    return F.transform(kept, lambda c: back_project(c.i % width, F.floor(c.i / width), c.d / millimetres, fx, fy, cx, cy))
