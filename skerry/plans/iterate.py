"""What iterative plans share: a folder all executors see, tables that cut lineage, and components of a graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind `value` once and build an expression on it: a one-element transform, so it is evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The session's own setting wins; a temporary one is made only in local mode, where
    driver and executors are one process. A cluster must name its folder."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="skerry-checkpoint-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def small(df: DataFrame, bound: int = 4096) -> DataFrame:
    """Mark for broadcast after counting: only a table of at most `bound` short rows is broadcast, a larger one is joined as it comes."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


class Scratch:
    """Tables written into the shared folder to cut lineage; those no longer read can be dropped early."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/skerry-{uuid.uuid4().hex}"
        self.count = 0

    def cut(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, order: list[str], new: str) -> DataFrame:
    """Rows numbered from 0 in the order of columns, without a global window: rows are sorted by ranges, each range is
    numbered for itself and starts where the ranges before it end. Only one count a range (a partition) is gathered."""
    scratch = Scratch(df.sparkSession)
    x, _ = scratch.cut(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    n = x.groupBy("range_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    x = x.join(F.broadcast(n.select("range_", before.alias("before_"))), "range_")
    place = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    return x.withColumn(new, (F.col("before_") + place - 1).cast("long")).drop("range_", "before_")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    `edges` has long columns a and b; loops and repeats are allowed. Returns (id, component_id): the smallest id that
    can be reached, for every id with at least one edge to another id. Each step takes a partially aggregated minimum
    per node and joins it back, so a node with many neighbours is never gathered in one task (skewed joins are split by
    adaptive execution); edges stay distributed, and every round is written to the shared folder.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = scratch.cut(now)
    seen = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(low.where("a > m").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        large, mid = scratch.cut(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.union(low.select("a", F.col("m").alias("b"))).distinct()
        small, new = scratch.cut(small)
        mark = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(path)
        scratch.drop(mid)
        now, path = small, new
        if mark == seen:
            break
        seen = mark
    out = now.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return out.union(now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
