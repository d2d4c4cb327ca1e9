"""Verification of buckets in cells of bounded size, and links counted once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, small

#: Rows of a bucket per block; a cell holds two blocks at most.
BLOCK = 1024
#: Crowded buckets that are broadcast at most, some 24 bytes each; as many are in 100,000 * BLOCK members at least.
CROWDED = 100_000


def with_counts(members: DataFrame, n: DataFrame, bound: int = BLOCK) -> DataFrame:
    """members (key, rep) joined with the counts (key, n, ...) of their buckets. The crowded buckets, of more than `bound`
    members, are few: they are broadcast (if counted to be), so their members stay where they are; only the members of
    the others are shuffled by key. `n` is read three times, so it should be a written table."""
    crowded = small(n.where(F.col("n") > bound), CROWDED)
    others = members.join(crowded.select("key"), "key", "left_anti").join(n.where(F.col("n") <= bound), "key")
    return members.join(crowded, "key").unionByName(others)


def in_buckets(scratch: Scratch, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rep, buckets): of members (key, rep), for each rep the keys it shares with another, each with the number of blocks
    its bucket is cut into. Only ids move here; what is to be compared is dealt once, by `into_cells`."""
    n, _ = scratch.cut(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    blocks = F.ceil(F.col("n") / block).cast("int").alias("blocks")
    return with_counts(members, n, block).groupBy("rep").agg(F.collect_list(F.struct("key", blocks)).alias("buckets"))


def into_cells(rows: DataFrame) -> DataFrame:
    """Rows with rep and `buckets` dealt into cells (key, i, j) of two blocks at most, sorted by cell.

    A bucket of n rows is cut into ceil(n / block) blocks by a hash of rep; each pair of blocks is a cell and each row goes
    to the cells of its block, with the block's number in `side`. So any two rows of a bucket meet in a cell, just once if
    their blocks differ, and no task gets a bucket that is large.
    """
    x = rows.withColumn("keys", F.transform("buckets", lambda b: b.key)).withColumn("b", F.explode("buckets")).drop("buckets")
    x = x.withColumn("key", F.col("b.key")).withColumn("blocks", F.col("b.blocks")).drop("b")
    x = x.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("other", "blocks")
    return x.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys (longs or ints without nulls), across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = k[:, a].tolist()
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def lists(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after another, and the length of each row's list."""
    c = table.column(column).combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False), c.value_lengths().to_numpy(zero_copy_only=False)


def shared_before(values: np.ndarray, lengths: np.ndarray, key: int) -> np.ndarray:
    """Which pairs of rows also share a bucket with a smaller key, so that they are counted there."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    row, values = row[values < key], values[values < key]
    names, at, n = np.unique(values, return_inverse=True, return_counts=True)
    row, at = row[n[at] > 1], at[n[at] > 1]
    if not len(at):
        return np.zeros((len(lengths), len(lengths)), bool)
    columns, at = np.unique(at, return_inverse=True)
    found = np.zeros((len(lengths), len(lengths)), bool)
    for a in range(0, len(columns), 4096):
        part = (at >= a) & (at < a + 4096)
        m = np.zeros((len(lengths), min(4096, len(columns) - a)), np.float32)
        m[row[part], at[part] - a] = 1
        found |= m @ m.T > 0
    return found


def count_links(linked: np.ndarray, counted: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch | None:
    """For each row with a link in this cell: its id, the summed sizes of what it is counted with, the least id of its
    component in the cell. `linked` and `counted` are symmetric."""
    some = np.flatnonzero(linked.any(1))
    if not len(some):
        return None
    linked, counted = linked[np.ix_(some, some)], counted[np.ix_(some, some)]
    ids, sizes = ids[some], sizes[some]
    low = ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], top).min(1))
        if (new == low).all():
            break
        low = new
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counted @ sizes, pa.int64()), pa.array(low, pa.int64())], ["rep", "links", "low"])


FOUND = "rep long, links long, low long"


def classes_linked(scratch: Scratch, classes: DataFrame, found: DataFrame) -> DataFrame:
    """For each class (rep, least, m): rep, n_links of one of its m members, component_id by the least id in reach."""
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(scratch, found.select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("id", "rep")
    x = classes.join(links, "rep", "left").join(parts, "rep", "left")
    x = x.select("rep", "least", F.coalesce("component_id", "rep").alias("part"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = x.groupBy("part").agg(F.min("least").alias("component_id"))
    return x.join(named, "part").select("rep", "n_links", "component_id")
