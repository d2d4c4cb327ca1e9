"""Set operations over tables and cells, merges that reconcile schemas, canonical de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only_in_first(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    return a.select(*columns).distinct().join(b.select(*columns).distinct(), columns, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame, columns: list[str], multiset: bool = False) -> DataFrame:
    """Rows in one table only, with `side`; as multisets by count where asked."""
    x, y = a.select(*columns), b.select(*columns)
    p, q = (x.exceptAll(y), y.exceptAll(x)) if multiset else (only_in_first(a, b, columns), only_in_first(b, a, columns))
    return p.withColumn("side", F.lit("a")).union(q.withColumn("side", F.lit("b")))


def compare_counts(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One row: distinct rows in a, in b, in a only, in b only. One pass over the union."""
    both = a.select(*columns).distinct().withColumn("s", F.lit(1)).union(b.select(*columns).distinct().withColumn("s", F.lit(2)))
    m = both.groupBy(*columns).agg(F.sum("s").alias("s"))
    n = lambda *v: F.count(F.when(F.col("s").isin(*v), 1))
    return m.agg(n(1, 3).alias("in_a"), n(2, 3).alias("in_b"), n(1).alias("only_a"), n(2).alias("only_b"))


def append(a: DataFrame, b: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """Union by name; columns missing on a side get its default, or NULL."""
    x = a.unionByName(b, allowMissingColumns=True)
    for c, v in (defaults or {}).items():
        if c in x.columns:
            x = x.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return x


def append_meshes(vertices: list[DataFrame], faces: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Meshes (vid, ...) and (fid, v) under one numbering, each shifted by what comes before, tagged `part`."""
    vs, fs, v0, f0 = None, None, 0, 0
    for k, (v, f) in enumerate(zip(vertices, faces, strict=True)):
        v1 = v.withColumn("vid", F.col("vid") + v0).withColumn("part", F.lit(k))
        f1 = f.withColumn("v", F.transform("v", lambda i: i + F.lit(v0))).withColumn("fid", F.col("fid") + f0).withColumn("part", F.lit(k))
        vs, fs = (v1, f1) if vs is None else (append(vs, v1), append(fs, f1))
        v0 += (v.agg(F.max("vid")).first()[0] or -1) + 1 if v.limit(1).count() else 0
        f0 += (f.agg(F.max("fid")).first()[0] or -1) + 1 if f.limit(1).count() else 0
    return vs, fs


def unordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias(a), F.greatest(a, b).alias(b)]


def distinct_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a) != F.col(b)).select(*unordered(a, b)).distinct()


def distinct_segments(df: DataFrame, layout: str = "layout_id") -> DataFrame:
    """Segments x1, y1, x2, y2 once per layout, whichever end comes first; the smallest line_id stays."""
    p, q = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    best = df.groupBy(layout, F.least(p, q).alias("p"), F.greatest(p, q).alias("q")).agg(F.min("line_id").alias("line_id"))
    return df.join(best.select(layout, "line_id"), [layout, "line_id"], "left_semi")


def all_pairs_in_lists(df: DataFrame, key: str, items: str) -> DataFrame:
    """key, a, b: pairs a < b of each list's distinct items. For short lists; the result grows with their squares."""
    x = df.select(key, F.array_distinct(items).alias("s"))
    x = x.select(key, "s", F.explode("s").alias("a"))
    return x.select(key, "a", F.explode(F.filter("s", lambda v: v > F.col("a"))).alias("b"))


def merged_names(names: Column, joiner: str = "_") -> Column:
    return F.array_join(names, joiner)


def with_columns_checked(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose name must be new."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    return df.withColumn(name, value)


def renamed(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename a column; the new name must be free."""
    if new in df.columns or old not in df.columns:
        raise ValueError(f"can't rename {old} to {new}")
    return df.withColumnRenamed(old, new)
