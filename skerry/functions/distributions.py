"""Distribution functions as expressions: errors, normal, Weibull, chi-square."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _near_and_far(a: Column) -> tuple[Column, Column]:
    """For a >= 0 the error function by its power series, and its complement by a continued fraction."""
    n = F.sequence(F.lit(1), F.lit(80))
    start = F.struct(a.alias("term"), a.alias("sum"))

    def term(acc: Column, k: Column) -> Column:
        t = acc.term * (0.0 - a * a) / k
        return F.struct(t.alias("term"), (acc.sum + t / (2 * k + 1)).alias("sum"))

    near = F.aggregate(n, start, term, lambda acc: acc.sum * (2.0 / math.sqrt(math.pi)))
    down = F.reverse(F.sequence(F.lit(1), F.lit(60)))
    tail = F.aggregate(down, a, lambda acc, k: a + (k / 2.0) / acc)
    return near, F.exp(0.0 - a * a) / (math.sqrt(math.pi) * tail)


def erf(x: Column) -> Column:
    """Error function: the power series up to 3, the continued fraction of its complement beyond; error under 1e-12."""
    x = x.cast("double")
    a = F.abs(x)
    near, far = _near_and_far(a)
    return F.signum(x) * F.when(a < 3.0, near).when(a < 27.0, 1.0 - far).otherwise(F.lit(1.0))


def erfc(x: Column) -> Column:
    """Complement of the error function; beyond 3 by the continued fraction itself, so small values keep their digits."""
    x = x.cast("double")
    a = F.abs(x)
    near, far = _near_and_far(a)
    above = F.when(a < 3.0, 1.0 - near).when(a < 27.0, far).otherwise(F.lit(0.0))
    return F.when(x < 0, 2.0 - above).otherwise(above)


def normal_pdf(x: Column, mean, std) -> Column:
    z = (x - mean) / std
    return F.exp(-0.5 * z * z) / (std * math.sqrt(2.0 * math.pi))


def normal_cdf(x: Column, mean, std) -> Column:
    return 0.5 * (1.0 + erf((x - mean) / (std * math.sqrt(2.0))))


def weibull_pdf(x: Column, shape, size, shift=0.0) -> Column:
    u = (x - shift) / size
    return F.when(u > 0, (shape / size) * F.pow(u, F.lit(shape) - 1.0) * F.exp(0.0 - F.pow(u, F.lit(shape)))).otherwise(F.lit(0.0))


def weibull_cdf(x: Column, shape, size, shift=0.0) -> Column:
    u = (x - shift) / size
    return F.when(u > 0, 1.0 - F.exp(0.0 - F.pow(u, F.lit(shape)))).otherwise(F.lit(0.0))


def chi_square_tail(x: Column, freedom: int) -> Column:
    """Probability that chi-square with `freedom` degrees (a whole number) exceeds x, by the finite sum."""
    h = x / 2.0
    if freedom % 2 == 0:
        terms = F.sequence(F.lit(1), F.lit(freedom // 2 - 1)) if freedom > 2 else F.array().cast("array<int>")
        start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

        def even(acc: Column, k: Column) -> Column:
            t = acc.t * h / k
            return F.struct(t.alias("t"), (acc.s + t).alias("s"))

        return F.aggregate(terms, start, even, lambda acc: F.exp(0.0 - h) * acc.s)
    tail = erfc(F.sqrt(h))
    if freedom == 1:
        return tail
    first = F.sqrt(h) * (2.0 / math.sqrt(math.pi))
    terms = F.sequence(F.lit(1), F.lit((freedom - 1) // 2))

    def odd(acc: Column, k: Column) -> Column:
        return F.struct((acc.t * h / (k + 0.5)).alias("t"), (acc.s + acc.t).alias("s"))

    start = F.struct(first.alias("t"), F.lit(0.0).alias("s"))
    return tail + F.exp(0.0 - h) * F.aggregate(terms, start, odd, lambda acc: acc.s)


def mahalanobis_weight(d2: Column) -> Column:
    """exp(-d2 / 2) of a squared Mahalanobis distance."""
    return F.exp(-0.5 * d2)
