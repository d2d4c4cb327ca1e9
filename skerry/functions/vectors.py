"""Vectors of three as struct columns (x, y, z), and component-wise families on arrays.

All functions take and give columns, stay inside generated code, and give NULL for NULL. Division by zero gives NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(x, y, z) -> Column:
    as_column = lambda c: F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c))
    return F.struct(as_column(x).cast("double").alias("x"), as_column(y).cast("double").alias("y"), as_column(z).cast("double").alias("z"))


def add(a: Column, b: Column) -> Column:
    return vec(a.x + b.x, a.y + b.y, a.z + b.z)


def sub(a: Column, b: Column) -> Column:
    return vec(a.x - b.x, a.y - b.y, a.z - b.z)


def mul(a: Column, b: Column) -> Column:
    return vec(a.x * b.x, a.y * b.y, a.z * b.z)


def scale(a: Column, s) -> Column:
    return vec(a.x * s, a.y * s, a.z * s)


def negate(a: Column) -> Column:
    return vec(0.0 - a.x, 0.0 - a.y, 0.0 - a.z)


def dot(a: Column, b: Column) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def cross(a: Column, b: Column) -> Column:
    return vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance2(a: Column, b: Column) -> Column:
    d = sub(a, b)
    return dot(d, d)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(distance2(a, b))


def normalize(a: Column) -> Column:
    n = length(a)
    return F.when(n > 0, scale(a, F.lit(1.0) / F.when(n > 0, n)))


def lerp(a: Column, b: Column, t) -> Column:
    return a + (b - a) * t


def lerp3(a: Column, b: Column, t) -> Column:
    return vec(lerp(a.x, b.x, t), lerp(a.y, b.y, t), lerp(a.z, b.z, t))


def clamp(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def fraction(v: Column) -> Column:
    return v - F.floor(v)


def fmod(v: Column, by) -> Column:
    """Remainder with the sign of the dividend; NULL when dividing by zero."""
    by = by if isinstance(by, Column) else F.lit(by)
    return F.when(by != 0, v % F.when(by != 0, by))


def reflect(i: Column, n: Column) -> Column:
    return sub(i, scale(n, 2.0 * dot(n, i)))


def smoothstep(a, b, v: Column) -> Column:
    a, b = (c if isinstance(c, Column) else F.lit(float(c)) for c in (a, b))
    t = clamp(F.try_divide(v - a, b - a), 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


def rsqrt(v: Column) -> Column:
    return F.when(v > 0, F.lit(1.0) / F.sqrt(F.when(v > 0, v)))


def floor3(a: Column) -> Column:
    return F.struct(F.floor(a.x).alias("x"), F.floor(a.y).alias("y"), F.floor(a.z).alias("z"))


def abs3(a: Column) -> Column:
    return vec(F.abs(a.x), F.abs(a.y), F.abs(a.z))


def angle_degrees(a: Column, b: Column) -> Column:
    """Angle between two vectors, 0 to 180; NULL if either has no direction."""
    n = length(a) * length(b)
    return F.degrees(F.acos(clamp(F.when(n > 0, dot(a, b) / F.when(n > 0, n)), -1.0, 1.0)))


def array_each(a: Column, b: Column, op: str) -> Column:
    """Component-wise + - * / of two arrays; a zero divisor gives NULL there."""
    ops = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": F.try_divide}
    return F.zip_with(a, b, ops[op])


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def array_extremes(a: Column) -> Column:
    """Least and greatest element, and their difference."""
    return F.struct(F.array_min(a).alias("low"), F.array_max(a).alias("high"), (F.array_max(a) - F.array_min(a)).alias("range"))


def has_repeats(a: Column) -> Column:
    return F.size(a) != F.size(F.array_distinct(a))


def inside_box(p: Column, low: Column, high: Column) -> Column:
    """Closed axis-aligned box."""
    return reduce(lambda x, y: x & y, [p[c].between(low[c], high[c]) for c in "xyz"])


def box_distance(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Least distance between two axis-aligned boxes, 0 where they meet: a bound for pruning."""
    gap = lambda c: F.greatest(low_b[c] - high_a[c], low_a[c] - high_b[c], F.lit(0.0))
    return F.sqrt(gap("x") * gap("x") + gap("y") * gap("y") + gap("z") * gap("z"))
