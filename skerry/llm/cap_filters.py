"""Near-duplicate vectors by spherical-cap filters of random product codes.

A code rotates a vector at random, cuts it into two halves, and has `width` random directions for each half; its filters
are all pairs of directions, so a few numbers per half stand for width^2 caps of the sphere. A vector is list-decoded to
the caps it lies deepest in: the best sums of two half scores are among the best of either half, so they are found
without looking at all filters. The cap's height is the vector's own: that of its `TAKEN`-th best filter of a code.
Vectors that are close share filters; those sharing one meet in a cell and are compared in double precision. With
`CODES` codes, two vectors at the least cosine share 12 of 24 filters in the mean and miss each other in under 1 of
1,000 (measured by a test). `width` grows with the square root of the number of vectors, which holds buckets of spread
vectors at about `BUCKET`, so the work grows as the input; large buckets are cut into cells.

Equal vectors form a class that is filtered once; its size enters the links. A pair is counted in its least common
filter only, so no pairs are written: cells give counts per vector and, for the components, one edge per vector.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components links with nothing and is its
own component. Vectors of different dimensions never link. Rows with a null id have no links and a null component and
are not kept. Rows that repeat an id are vectors of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import FOUND, classes_linked, count_links, groups, in_buckets, into_cells, lists, shared_before
from .common import Scratch

CODES, TAKEN, BUCKET, SEED = 4, 6, 64, 9


def code(number: int, dim: int, width: int):
    """Rotation and the two halves' unit directions of a code."""
    rng = np.random.default_rng([SEED, number, dim, width])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    half = (dim + 1) // 2
    sides = [rng.standard_normal((width, size)) for size in (half, dim - half)]
    return turn, [s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-12) for s in sides], half


def decode(x: np.ndarray, made, width: int, taken: int = TAKEN) -> np.ndarray:
    """The `taken` best filters of each unit vector, as numbers below width^2. Ties go to the smaller direction."""
    turn, sides, half = made
    y = x @ turn.T
    taken = min(taken, width)
    scores, order = [], []
    for part, side in zip((y[:, :half], y[:, half:]), sides, strict=True):
        s = part @ side.T
        o = np.sort(np.argpartition(-s, taken - 1, axis=1)[:, :taken], axis=1)
        o = np.take_along_axis(o, np.argsort(-np.take_along_axis(s, o, 1), axis=1, kind="stable"), 1)
        scores.append(np.take_along_axis(s, o, 1))
        order.append(o)
    a, b = np.array([(i, j) for i in range(taken) for j in range(taken) if (i + 1) * (j + 1) <= taken]).T
    total = scores[0][:, a] + scores[1][:, b]
    best = np.argsort(-total, axis=1, kind="stable")[:, :taken]
    rows = np.arange(len(x))[:, None]
    return order[0][rows, a[best]] * width + order[1][rows, b[best]]


def _filters(width: int):
    def run(batches):
        made = {}
        for batch in batches:
            values, lengths = lists(pa.Table.from_batches([batch]), "v")
            ends = np.cumsum(lengths)
            filters = [None] * batch.num_rows
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                x = values[(ends[rows] - dim)[:, None] + np.arange(dim)].astype(float)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                found = []
                for r in range(CODES):
                    if (r, dim) not in made:
                        made[r, dim] = code(r, dim, width)
                    found.append(decode(x, made[r, dim], width) + (dim * CODES + r) * width * width)
                for row, f in zip(rows.tolist(), np.concatenate(found, axis=1), strict=True):
                    filters[row] = f
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(filters, pa.list_(pa.int64()))], ["rep", "filters"])

    return run


def _verify(least: float):
    def run(batches):
        for t in groups(batches, ["key", "i", "j"]):
            if t.num_rows < 2:
                continue
            values, lengths = lists(t, "v")
            x = values.astype(float).reshape(len(lengths), -1)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            linked = x @ x.T >= least
            np.fill_diagonal(linked, False)
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            if i != j:
                side = t.column("side").to_numpy()
                linked &= side[:, None] != side[None, :]
            if not linked.any():
                continue
            some = np.flatnonzero(linked.any(1))
            t, linked = t.take(some), linked[np.ix_(some, some)]
            counted = linked & ~shared_before(*lists(t, "keys"), t.column("key")[0].as_py())
            out = count_links(linked, counted, t.column("rep").to_numpy(), t.column("m").to_numpy())
            if out is not None:
                yield out

    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    good = rows.where("ok").select("vec_id", F.transform("v", lambda x: x.cast("double") + 0.0).alias("v"))
    classes = good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    classes, _ = scratch.cut(classes.withColumn("rep", F.monotonically_increasing_id()))
    n = classes.count()
    width = max(16, math.ceil(math.sqrt(n * TAKEN / BUCKET)))
    coded = classes.select("rep", "v").mapInArrow(_filters(width), "rep long, filters array<long>")
    members, _ = scratch.cut(coded.select(F.explode("filters").alias("key"), "rep"))
    dealt = into_cells(classes.select("rep", "m", "v").join(in_buckets(scratch, members), "rep"))
    found, _ = scratch.cut(dealt.mapInArrow(_verify(least), FOUND))
    told, _ = scratch.cut(classes_linked(scratch, classes.select("rep", "least", "m"), found))
    linked = good.join(classes.select("v", "rep"), "v").join(told, "rep").select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
