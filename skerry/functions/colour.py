"""Colours as expressions: luma, hue, ramps and scalar-field colouring. Channels are 0 to 255 unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import dip_direction
from .vectors import clamp


def rgb(r, g, b) -> Column:
    return F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


def composite(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / 3.0


def normalised(v: Column, low: float, high: float, log: bool = False, symmetric: bool = False) -> Column:
    """A value's place in its display range, 0 to 1; outside it -1. Log takes magnitudes; symmetric centres zero at one half."""
    if symmetric:
        top = max(abs(low), abs(high))
        return F.when(F.abs(v) > top, -1.0).otherwise(0.5 + v / (2.0 * top))
    if log:
        a, b = (F.log10(F.lit(max(abs(x), 1e-12))) for x in (low, high))
        p = (F.log10(F.greatest(F.abs(v), F.lit(1e-12))) - a) / (b - a)
        return F.when((p < 0) | (p > 1), -1.0).otherwise(p)
    p = (v - low) / (high - low)
    return F.when((p < 0) | (p > 1), -1.0).otherwise(p)


def jet(p: Column) -> Column:
    """Blue over cyan and yellow to red for 0 to 1, each channel 0 to 1."""
    f = lambda at: clamp(1.5 - F.abs(4.0 * p - at), 0.0, 1.0)
    return F.struct(f(3.0).alias("r"), f(2.0).alias("g"), f(1.0).alias("b"))


def ramp(p: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """Piecewise linear colour between stops (place, colour), places rising."""

    def channel(k: int) -> Column:
        out = F.lit(float(stops[-1][1][k]))
        for (a, x), (b, y) in reversed(list(zip(stops, stops[1:], strict=False))):
            out = F.when(p <= b, x[k] + (y[k] - x[k]) * (clamp(p, a, b) - a) / (b - a)).otherwise(out)
        return F.floor(out + 0.5)

    return rgb(channel(0), channel(1), channel(2))


def wave(v: Column, period: float) -> Column:
    """Colours that repeat with a coordinate, one third of a period apart."""
    f = lambda shift: F.floor(127.5 * (1.0 + F.sin(v * (6.283185307179586 / period) + shift)) + 0.5)
    return rgb(f(0.0), f(2.0943951023931953), f(4.1887902047863905))


def hsv_of_normal(n: Column) -> Column:
    """Hue by dip direction, saturation by dip, full value."""
    d = dip_direction(n)
    return F.struct(d.direction.alias("h"), (d.dip / 90.0).alias("s"), F.lit(1.0).alias("v"))


def with_intensity(r: Column, g: Column, b: Column, i: Column, low: float, high: float) -> Column:
    s = clamp((i - low) / (high - low), 0.0, 1.0)
    return rgb(F.floor(r * s), F.floor(g * s), F.floor(b * s))


def blend_images(a: Column, b: Column, share: float) -> Column:
    """Two rasters of one size, cell by cell."""
    return F.zip_with(a, b, lambda x, y: x * (1.0 - share) + y * share)
