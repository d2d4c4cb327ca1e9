"""Scalar fields: statistics that skip invalid values, histograms, percentiles, one-dimensional k-means, fits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import valid


def clean(c: Column) -> Column:
    """NaN becomes NULL, minus zero becomes zero."""
    return F.when(valid(c), c.cast("double") + 0.0)


def statistics(df: DataFrame, value: str) -> DataFrame:
    """One row: n, n_valid, mean, mean_square (0 without valid values), low, high, variance (population)."""
    v = clean(F.col(value))
    return df.agg(
        F.count("*").alias("n"), F.count(v).alias("n_valid"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.avg(v * v), F.lit(0.0)).alias("mean_square"),
        F.min(v).alias("low"), F.max(v).alias("high"), F.var_pop(v).alias("variance"),
    )


def histogram(df: DataFrame, value: str, classes: int | None = None, most: int = 512) -> DataFrame:
    """bin, n for all bins: equal widths between the extremes, the last one closed. Without `classes`, the rounded-up
    square root of the number of values, at least 4 and at most `most`. With one class it counts all rows."""
    x = df.select(clean(F.col(value)).alias("v"))
    r = x.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("all"), F.count("v").alias("n")).first()
    spark = df.sparkSession
    if r["n"] == 0 or r["high"] == r["low"] and classes != 1:
        return spark.range(0).select(F.col("id").cast("int").alias("bin"), F.col("id").alias("n"))
    k = classes or min(max(math.ceil(math.sqrt(r["n"])), 4), most)
    if k == 1:
        return x.agg(F.count("*").alias("n")).select(F.lit(0).alias("bin"), "n")
    at = F.least(F.floor((F.col("v") - r["low"]) * k / (r["high"] - r["low"])), F.lit(k - 1)).cast("int")
    counts = x.where("v is not null").groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(k).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def binned_percentile(df: DataFrame, value: str, share: float, bins: int = 10_000) -> DataFrame:
    """One row, `percentile`: lower end of the first bin at which more than `share` of the values have come."""
    x = df.select(clean(F.col(value)).alias("v")).where("v is not null")
    ends = x.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("total"))
    place = F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)) * (bins - 1))
    counts = x.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin"), "low", "high", "total").agg(F.count("*").alias("n"))  # ends: one row
    so_far = F.sum("n").over(Window.partitionBy("total").orderBy("bin"))  # at most `bins` rows
    passed = counts.withColumn("c", so_far).where(F.col("c") > F.col("total") * share)
    return passed.groupBy("low", "high").agg(F.min("bin").alias("bin")).select((F.col("low") + F.col("bin") * (F.col("high") - F.col("low")) / (bins - 1)).alias("percentile"))


def kth(df: DataFrame, value: str, k: int, bins: int = 1024) -> float | None:
    """The valid value at place k (from 0) in rising order. Each round counts `bins` ranges and goes on in the one that
    holds the place, so nothing is sorted and no task gets more than counts."""
    x = df.select(clean(F.col(value)).alias("v")).where("v is not null")
    infinite = math.inf
    finite = F.when(F.abs("v") < infinite, F.col("v"))
    r = x.agg(F.min(finite).alias("low"), F.max(finite).alias("high"), F.count("*").alias("n"), F.count(F.when(F.col("v") == -infinite, 1)).alias("below"), F.count(finite).alias("finite")).first()
    if not 0 <= k < r["n"]:
        return None
    if k < r["below"]:
        return -infinite
    k -= r["below"]
    if k >= r["finite"]:
        return infinite
    low, high = r["low"], r["high"]
    while low < high:
        part = 1.0 if math.isfinite(high - low) else 0.5  # halves, where the range itself overflows
        at = F.least(F.floor((F.col("v") * part - low * part) / (high * part - low * part) * bins), F.lit(bins - 1))
        rows = x.where(F.col("v").between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("bin").collect()
        for row in rows:
            if k < row["n"]:
                low, high = row["low"], row["high"]
                break
            k -= row["n"]
    return low


def median(df: DataFrame, value: str) -> float | None:
    """Mean of the two middle valid values."""
    n = df.where(valid(F.col(value))).count()
    return None if n == 0 else (kth(df, value, (n - 1) // 2) + kth(df, value, n // 2)) / 2.0


def rank_from_top(df: DataFrame, value: str, share: float) -> float | None:
    """The least of the ceil(n * share) greatest valid values."""
    n = df.where(valid(F.col(value))).count()
    return kth(df, value, n - math.ceil(n * share))


def k_means_1d(df: DataFrame, value: str, k: int, rounds: int = 100, skip_negative: bool = False) -> list[float]:
    """Centres from evenly spaced starts, moved until the class sizes stand still; an empty class keeps its centre.
    A round is one small aggregate of k rows."""
    x = df.select(clean(F.col(value)).alias("v")).where("v is not null")
    if skip_negative:
        x = x.where("v >= 0")
    r = x.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    if r["low"] is None:
        return []
    centres, sizes = [r["low"] + (r["high"] - r["low"]) * (j + 0.5) / k for j in range(k)], None
    for _ in range(rounds):
        near = x.groupBy(nearest_centre(F.col("v"), centres).alias("j")).agg(F.count("*").alias("n"), F.avg("v").alias("m")).collect()
        now = {row["j"]: row["n"] for row in near}
        for row in near:
            centres[row["j"]] = row["m"]
        if now == sizes:
            break
        sizes = now
    return centres


def nearest_centre(v: Column, centres: list[float]) -> Column:
    """Place of the nearest centre; ties to the first."""
    return F.array_min(F.array(*[F.struct(F.abs(v - c).alias("d"), F.lit(j).alias("j")) for j, c in enumerate(centres)])).j


def fit_normal(df: DataFrame, value: str, robust_sigmas: float | None = None) -> DataFrame:
    """mean, variance (population); with `robust_sigmas`, again over values strictly within so many deviations."""
    x = df.select(clean(F.col(value)).alias("v")).where("v is not null")
    first = x.agg(F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))
    if robust_sigmas is None:
        return first
    near = x.crossJoin(F.broadcast(first)).where(F.abs(F.col("v") - F.col("mean")) < robust_sigmas * F.sqrt("variance"))  # one row
    return near.agg(F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))


def chi_square_normal(df: DataFrame, value: str, classes: int = 8) -> DataFrame:
    """One row: chi-square distance of the values from the normal law fitted to them, over equally likely classes."""
    from statistics import NormalDist

    x = df.select(clean(F.col(value)).alias("v")).where("v is not null")
    fit = fit_normal(df, value)
    cuts = [NormalDist().inv_cdf(j / classes) for j in range(1, classes)]
    z = x.crossJoin(F.broadcast(fit)).select(F.try_divide(F.col("v") - F.col("mean"), F.sqrt("variance")).alias("z"))
    place = sum((F.when(F.col("z") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    n = z.groupBy(place.alias("j")).agg(F.count("*").alias("n"))
    got = n.agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return got.select((F.col("squares") * classes / F.col("total") - F.col("total")).alias("chi_square"), F.col("total").alias("n"))


def fit_weibull(df: DataFrame, value: str, rounds: int = 60) -> tuple[float, float]:
    """Shape and scale of greatest likelihood for positive values, by bisection on the shape; a round is one aggregate."""
    x = df.select(clean(F.col(value)).alias("v")).where("v > 0")
    mean_log = x.agg(F.avg(F.log("v"))).first()[0]
    if mean_log is None:
        return math.nan, math.nan
    top = x.agg(F.max("v")).first()[0]

    def slope(a: float) -> float:
        w = F.pow(F.col("v") / top, F.lit(a))
        r = x.agg((F.sum(w * F.log("v")) / F.sum(w)).alias("s")).first()["s"]
        return r - 1.0 / a - mean_log

    low, high = 1e-2, 1.0
    while slope(high) < 0 and high < 1e4:
        high *= 2.0
    for _ in range(rounds):
        a = (low + high) / 2.0
        low, high = (low, a) if slope(a) > 0 else (a, high)
        if high - low < 1e-10 * high:
            break
    a = (low + high) / 2.0
    return a, top * x.agg(F.avg(F.pow(F.col("v") / top, F.lit(a)))).first()[0] ** (1.0 / a)


def product(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Row by row product of two fields."""
    return a.select(key, F.col(value).alias("u")).join(b.select(key, F.col(value).alias("w")), key).select(key, (F.col("u") * F.col("w")).alias(value))


def energy_threshold(df: DataFrame, value: str, share: float = 0.7, factor: float = 1.5) -> float | None:
    """Factor times the root of the valid value at place floor(share * n) in rising order."""
    found = kth(df, value, int(share * df.where(valid(F.col(value))).count()))
    return None if found is None else factor * math.sqrt(found)
