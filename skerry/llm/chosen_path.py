"""Near-duplicate texts: n-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles, each a 64-bit hash. Equal sets form a class; a class has a row of min-hash
values, of which two sets share each with probability equal to their Jaccard similarity, so a value stands for a sampled
shared token. A run starts with one value and puts sets with the same one in a bucket. Buckets of up to `SMALL` sets
are compared by brute force; larger ones are split further, each along `BRANCHES` sampled values which the path so far
chooses, down to `DEPTH` splits. A large bucket whose sets are alike (a mean similarity of `ALIKE`, told by how its split
falls) would not get smaller; it, and what is still large at the end, is compared by brute force in cells of bounded size. `RUNS` runs with independent first values repeat this. Two sets of similarity s meet in a run with
probability of about s at the first split and s*(1-(1-s)^2) and so on below, at least 0.74 for s = 0.8; six runs miss
such a pair in under 1 of 3,000 cases, and closer pairs far less often. Buckets with the very same sets are compared once.

The comparison is exact: intersection sizes of the whole shingle sets in each cell. A pair is counted in its least common
bucket only, and no pairs are written, only counts and component edges per class.

Defined cases: a text of one to four words is one shingle of them all; one without words (null, empty, blank) has no
shingles and links with nothing. Words keep their case. Repeated rows are members of their class. Rows with null ids
link like others; their class is named by the smallest id in it, and is null if it has none. All rows with the smallest
id of a component are kept here; `first_of_each` keeps one of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import FOUND, classes_linked, count_links, groups, in_buckets, into_cells, lists, shared_before, with_counts
from .common import Scratch, small
from .texts import small_batches

WORDS, LEAST = 5, 0.8
RUNS, BRANCHES, DEPTH, SMALL, VALUES, ALIKE = 6, 2, 3, 256, 32, 0.5
_RNG = np.random.default_rng(7)
_MULTIPLY = _RNG.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_STEP = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, hashes: dict, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    found = (text or "").encode().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * _STEP[k]
    return np.unique(mixed(out + np.uint64(n)))


def min_hashes(values: np.ndarray) -> np.ndarray:
    """`VALUES` min-hash values of a set that isn't empty."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 4096):
        x = values[at : at + 4096, None] * _MULTIPLY + _ADD
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(0))
    return low.view(np.int64)


def _described(batches):
    hashes = _Hashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            piece = batch.slice(at, 512)
            high, low, size, values = [], [], [], []
            for text in piece.column(1).to_pylist():
                s = shingles(text, hashes)
                one, two = digest(s)
                high.append(one)
                low.append(two)
                size.append(len(s))
                values.append(min_hashes(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(size, pa.int64()), pa.array(values, pa.list_(pa.int64())), piece.column(2)], ["doc_id", "high", "low", "size", "values", "hash"])


def digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed longs."""
    d = xxhash.xxh3_128_intdigest(values.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def _sets(batches):
    """Sets of those rows whose text is that of the class; another row of the same id isn't."""
    hashes = _Hashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            found = [shingles(text, hashes) for text in piece.column("text").to_pylist()]
            same = [digest(s) == k for s, k in zip(found, zip(piece.column("high").to_pylist(), piece.column("low").to_pylist(), strict=True), strict=True)]
            sets = pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([piece.column("rep"), piece.column("m"), piece.column("buckets"), sets], ["rep", "m", "buckets", "set"]).filter(pa.array(same))


def buckets(scratch: Scratch, classes: DataFrame) -> DataFrame:
    """(key, rep): buckets to be compared, of two classes at least, each membership once."""
    start = classes.select("rep", F.posexplode(F.slice("values", 1, RUNS)).alias("run", "value"))
    now, _ = scratch.cut(start.select("rep", F.xxhash64("run", "value").alias("key")))
    done = []
    for depth in range(DEPTH + 1):
        n = now.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who")).where("n > 1")
        n, _ = scratch.cut(n)
        large = n.where(F.col("n") > SMALL)
        if depth == DEPTH or large.limit(1).count() == 0:
            done.append(with_counts(now, n).select("key", "rep", "n", "who"))
            break
        going = with_counts(now, large.select("key", "n"), SMALL).join(classes.select("rep", "values"), "rep")
        going = going.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1))))
        pick = F.pmod(F.xxhash64("key", "branch"), F.lit(VALUES - RUNS)) + RUNS
        child = F.xxhash64("key", "branch", F.get("values", pick.cast("int")))
        kids, _ = scratch.cut(going.select("rep", F.col("key").alias("parent"), F.col("n").alias("of"), child.alias("key")))
        # two members share a child with the probability of their similarity, so this is the mean similarity of a bucket
        size = kids.groupBy("parent", "of", "key").agg(F.count("*").cast("double").alias("c"))
        mean = size.groupBy("parent", "of").agg((F.sum(F.col("c") * F.col("c"))).alias("s")).where(F.col("s") >= ALIKE * BRANCHES * F.col("of") * F.col("of"))
        alike, _ = scratch.cut(mean.select("parent"))
        ready = n.where(F.col("n") <= SMALL).unionByName(n.join(alike.withColumnRenamed("parent", "key"), "key", "left_semi"))
        ready, _ = scratch.cut(ready)
        done.append(with_counts(now, ready).select("key", "rep", "n", "who"))
        now, _ = scratch.cut(kids.join(alike, "parent", "left_anti").select("rep", "key"))
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    found, _ = scratch.cut(found)
    once = found.select("key", "n", "who").distinct().groupBy("n", "who").agg(F.min("key").alias("key")).select("key")
    return found.join(once, "key").select("key", "rep")


def _compare(batches):
    for t in groups(batches, ["key", "i", "j"]):
        one_each = np.unique(t.column("rep").to_numpy(), return_index=True)[1]
        if len(one_each) < t.num_rows:  # rows that repeat id and text
            t = t.take(one_each)
        if t.num_rows < 2:
            continue
        values, sizes = lists(t, "set")
        common = overlaps(values, sizes)
        linked = common >= LEAST * (sizes[:, None] + sizes[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        if t.column("i")[0].as_py() != t.column("j")[0].as_py():
            side = t.column("side").to_numpy()
            linked &= side[:, None] != side[None, :]
        if not linked.any():
            continue
        some = np.flatnonzero(linked.any(1))
        t, linked = t.select(["rep", "m", "keys", "key"]).take(some), linked[np.ix_(some, some)]
        counted = linked & ~shared_before(*lists(t, "keys"), t.column("key")[0].as_py())
        out = count_links(linked, counted, t.column("rep").to_numpy(), t.column("m").to_numpy())
        if out is not None:
            yield out


def overlaps(values: np.ndarray, sizes: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Intersection sizes of all pairs of sets that lie one after another in `values`."""
    n = len(sizes)
    if n == 2:
        k = len(np.intersect1d(values[: sizes[0]], values[sizes[0] :], assume_unique=True))
        return np.array([[sizes[0], k], [k, sizes[1]]], float)
    row = np.repeat(np.arange(n), sizes)
    _, at, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[at] > 1
    row, at = row[shared], at[shared]
    names, at = np.unique(at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    common = np.zeros((n, n), np.float32)
    for a in range(0, len(names), columns):
        x, y = np.searchsorted(at, [a, a + columns])
        m = np.zeros((n, min(columns, len(names) - a)), np.float32)
        m[row[x:y], at[x:y] - a] = 1
        common += m @ m.T
    return common.astype(float)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id linked with it, directly or not), n_links (other documents
    linked with it directly, copies included), kept (it is the one of that id)."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    seen, _ = scratch.cut(hashed.mapInArrow(_described, "doc_id long, high long, low long, size long, values array<long>, hash long"))
    some = seen.where("size > 0")
    classes = some.groupBy("high", "low").agg(F.min("doc_id").alias("least"), F.count("*").alias("m"), F.any_value("size").alias("size"), F.any_value("values").alias("values"), F.min("hash").alias("hash"))
    classes, _ = scratch.cut(classes.withColumn("rep", F.monotonically_increasing_id()))
    cells, _ = scratch.cut(buckets(scratch, classes))
    wanted = classes.select("rep", "m", F.col("least").alias("doc_id"), "hash", "high", "low").join(in_buckets(scratch, cells), "rep")
    wanted, _ = scratch.cut(wanted)  # a class is in RUNS * BRANCHES^DEPTH buckets at most
    named, nameless = wanted.where("doc_id is not null").drop("hash"), wanted.where("doc_id is null").drop("doc_id")
    held = rows.join(small(named, 200_000), "doc_id").select("rep", "m", "high", "low", "buckets", "text")
    if nameless.limit(1).count():  # sets of rows without any id: one of the texts, which are told by their hash
        texts = hashed.where("doc_id is null").groupBy("hash").agg(F.any_value("text").alias("text"))
        held = held.union(texts.join(small(nameless, 200_000), "hash").select("rep", "m", "high", "low", "buckets", "text"))
    held = held.mapInArrow(_sets, "rep long, m long, buckets array<struct<key:bigint,blocks:int>>, set array<long>")
    found, _ = scratch.cut(into_cells(held).mapInArrow(_compare, FOUND))
    told = classes_linked(scratch, classes.select("rep", "least", "m"), found)
    told = told.join(classes.select("rep", "high", "low"), "rep").select("high", "low", "n_links", "component_id")
    out = some.join(told, ["high", "low"]).select("doc_id", F.col("component_id").alias("class_id"), "n_links")
    alone = seen.where("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, of which one row of each component stays: that of the smallest id (nulls last).

    Where an id is null or repeated, rows are numbered in a written copy, so each is told from the others. The numbers of
    the rows that go are broadcast if they are few enough (counted first), else joined.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("at"), F.struct("*").alias("row"))
    repeated = rows.groupBy("at").agg(F.count("*").alias("n")).where("n > 1 or at is null").limit(1).count()
    if repeated:
        rows, _ = scratch.cut(docs.select(F.monotonically_increasing_id().alias("at"), F.struct("*").alias("row")))
    found, _ = scratch.cut(near_duplicates(rows.select("at", F.col("row").getField(text).alias("text")), "at", "text").select(F.col("doc_id").alias("at"), "class_id"))
    groups_ = found.join(found.where("at <> class_id").select("class_id").distinct(), "class_id")  # rows alone in their class stay
    key = F.struct(F.col("id").isNull().alias("none"), "id", "at")
    named = groups_.join(rows.select("at", F.col("row").getField(doc_id).alias("id")), "at")
    first = named.groupBy("class_id").agg(F.min(key).alias("first")).select("class_id", F.col("first.at").alias("first"))
    gone, _ = scratch.cut(named.join(first, "class_id").where("at <> first").select("at"))
    return rows.join(small(gone, 500_000), "at", "left_anti").select("row.*")
