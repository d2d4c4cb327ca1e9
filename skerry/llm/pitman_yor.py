"""Language-model scoring by a hierarchical Pitman-Yor model of words.

Restaurants. A word's context is the word before it, at the start of a text the end token; each such word has a
restaurant. Its parent is that of its class `u2`, one of 64 by its last three letters within `u1`, one of 64 by its last
letter. The restaurant of a `u2` has that of its `u1` as parent, those have the root, and the root has the uniform
distribution over the V training tokens and one place for all unknown ones. Customers of the lowest restaurants are all
(word before, word) counts of the training texts. The totals of the classes are 4,161 numbers and are sent to every
task; those of the words' restaurants grow with the corpus and stay spread.

Seating. State is the number of tables per restaurant and dish. A sweep of the blocked Gibbs sampler takes all customers
of a dish out of a restaurant and seats them anew, one after another, given the parent's predictive probability and the
totals of the sweep before; each next batch is as large as 1/32 of those seated, but one at least. New tables are
customers of the parent, which is seated next, up to the root. After `BURN` sweeps the predictive probabilities of
`AVERAGED` sweeps are averaged. Sweeps draw from seeded generators per part of the vocabulary and sweep, so any task can
be lost and run again.

Flow. Texts are read once, in blocks of about `BLOCK_CHARS`: a block writes its documents as sorted references to its
distinct (word, context) pairs, and these pairs, summed over the block, packed by parts of the word hashes. One shuffle
brings each part its shares; it adds up the counts, and writes them with, for each block, the places of the block's words
and contexts in the part, so hashes move once. The block's documents pass through the same shuffle and wait in the table
it is written to. Parts then run the sweeps, one job each, whose states are written, and send each block the
probabilities of its pairs; the block adds them up per document. A pair that is everywhere is one entry per block, so no
part or task has more of it than others. A context's customers are spread over the parts of the words after it. The part
that its own hash falls in owns its totals: after each sweep every part sends the owners the tables of its contexts, and
the owners send back the sums; a context that is everywhere is one entry per part. Log probabilities move in steps of
2**-11, so a text's score is off by about 1.4e-4 times the root of its length.

Defined cases: null and empty texts are an end token alone. Words are compared by 64-bit hashes, as contexts by
the first 40 bits of them and their class. Every row is scored,
repeated ids included, and learned from where its fold says so. With no training text, N is 0 and every word unknown.
"""

from __future__ import annotations

import collections
import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold
from .texts import small_batches, trim

U1, U2 = 64, 64 * 64
#: Discount and strength by level: root, u1, u2, word before.
DISCOUNT, STRENGTH = (0.55, 0.75, 0.85, 0.85), (5.0, 20.0, 20.0, 5.0)
BURN, AVERAGED, SEED = 2, 2, 20
BLOCK_CHARS, PART_CHARS = 8_000_000, 16_000_000
END = xxhash.xxh3_64_intdigest(b"")  # no word is empty
#: Numbers that describe all restaurants (see Part.totals), and the rows in which their sums reach the driver.
N_TOTALS, SLOTS = 2 * U2 + U1 + 4, 32
#: Kinds of rows between parts; `docs` then holds the kind and the number of sweeps done, `block` the sender.
STATIC, TOTALS, ASKED, INDEX, SUMMED, PLACES, STATE = range(7)
LOG_STEP = 2.0**-11

_PACKED = "block long, part int, docs array<long>, body binary"


def slim(a: np.ndarray) -> np.ndarray:
    """Numbers of 0 or more in the smallest type that holds them all."""
    return a.astype(np.min_scalar_type(a.max(initial=0)))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in their smallest types, all first bytes of an array's numbers before all second ones, compressed."""
    arrays = tuple(slim(a) if a.dtype.kind in "iu" and a.min(initial=0) >= 0 else a for a in arrays)
    head = b"".join(struct.pack("<3sxQ", a.dtype.str.encode()[:3], len(a)) for a in arrays)
    bodies = (np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays)
    return zstandard.compress(struct.pack("<I", len(arrays)) + head + b"".join(bodies), 3)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + 12 * n, []
    for k in range(n):
        kind, size = struct.unpack_from("<3sxQ", raw, 4 + 12 * k)
        kind = np.dtype(kind.decode())
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        at += planes.nbytes
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
    return out


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lowered; bytes.split() cuts at blank and 0x09 to 0x0D only."""
    return (text or "").encode().lower().split()


def context_class(word: bytes) -> int:
    tail = word.decode(errors="replace")[-3:]
    return xxhash.xxh3_64_intdigest(tail[-1:].encode()) % U1 * 64 + xxhash.xxh3_64_intdigest(tail.encode()) % 64


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part of each word; it grows with the hash, so parts are ranges of sorted hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def block_rows(block: int, rows: list[tuple[int | None, bool, str | None]], parts: int):
    """The packed rows of a block: part -1 holds its documents, the others their share of its pairs."""
    vocabulary: dict[bytes, int] = collections.defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    vocabulary[b""]  # the end token is word 0
    ids = [np.array([*map(vocabulary.__getitem__, words_of(text)), 0], np.int32) for _, _, text in rows]
    vocabulary.default_factory = None  # else dict and method hold each other until a full garbage collection
    names = list(vocabulary)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    classes = np.fromiter(map(context_class, names), np.int64, len(names))
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sizes = np.array([len(x) for x in ids])
    flat = np.concatenate(ids)
    before = np.empty(len(flat), np.int64)
    before[1:] = place[flat[:-1]]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    before[starts] = place[0]
    pairs, at = np.unique(place[flat] * len(names) + before, return_inverse=True)
    train = np.repeat(np.array([t for _, t, _ in rows]), sizes)
    counts = np.bincount(at[train], minlength=len(pairs)).astype(np.uint32)
    held = np.sort(np.repeat(np.arange(len(rows)), sizes) * len(pairs) + at) % len(pairs)
    steps = np.diff(held, prepend=0).astype(np.int32)
    steps[starts] = held[starts]
    word, before, hashes = pairs // len(names), pairs % len(names), hashes[order]
    named = hashes >> np.uint64(24) << np.uint64(12) | classes[order].astype(np.uint64)  # contexts: 40 bits of hash, then the class
    # a part of its own below zero, so that documents pass through the shuffle of the parts as a group
    yield block, -1 - xxhash.xxh3_64_intdigest(struct.pack("<q", block)) % (1 << 31), [i for i, _, _ in rows], pack(sizes.astype(np.uint32), steps)
    edges = np.searchsorted(part_of(hashes, parts), np.arange(parts + 1))
    cuts = np.searchsorted(word, edges)
    for p in range(parts):
        a, b = edges[p], edges[p + 1]
        if a < b:
            x, y = cuts[p], cuts[p + 1]
            n = np.bincount(word[x:y] - a, minlength=b - a).astype(np.uint32)
            contexts, to = np.unique(named[before[x:y]], return_inverse=True)
            yield block, p, [], pack(np.diff(hashes[a:b], prepend=np.uint64(0)), n, np.diff(contexts, prepend=np.uint64(0)), to, counts[x:y])


def _batch(rows) -> pa.RecordBatch:
    block, part, docs, body = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(part, pa.int32()), pa.array(docs, pa.list_(pa.int64())), pa.array(body, pa.binary())], ["block", "part", "docs", "body"])


def _blocks(parts: int):
    def run(batches):
        task, seen, rows, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for row in zip(*(piece.column(k).to_pylist() for k in range(3)), strict=True):
                    rows.append(row)
                    size += len(row[2] or "") + 1
                    if size >= BLOCK_CHARS:
                        for out in block_rows(task << 32 | seen, rows, parts):
                            yield _batch([out])
                        rows, size, seen = [], 0, seen + 1
                        trim()
        if rows:
            for out in block_rows(task << 32 | seen, rows, parts):
                yield _batch([out])
        rows = []
        trim()

    return run


def read_pairs(body: bytes):
    """Hashes of a packed share's words, the word of each pair, numbers and classes of the contexts, the context of each
    pair and its training count."""
    steps, n, before, context, counts = unpack(body)
    n, before = n.astype(np.int64), np.cumsum(before, dtype=np.uint64)
    return np.cumsum(steps, dtype=np.uint64), np.repeat(np.arange(len(n)), n), before, (before & np.uint64(U2 - 1)).astype(np.int64), context.astype(np.int64), counts.astype(np.int64)


class Part:
    """Seating of the words of one part. Pairs are sorted by word and context; only those with customers count.
    `contexts` are the sorted numbers of all words before, also of those that are only asked for."""

    def __init__(self, number: int, hashes: np.ndarray, contexts: np.ndarray, classes: np.ndarray, pairs: np.ndarray, counts: np.ndarray):
        self.number, self.hashes, self.contexts, self.classes, self.pairs3, self.c3 = number, hashes, contexts, classes, pairs, counts
        self.word3, self.context = pairs // max(len(contexts), 1), pairs % max(len(contexts), 1)
        self.pairs, self.to2 = np.unique(self.word3 * U2 + classes[self.context], return_inverse=True)
        self.word, self.u2 = self.pairs // U2, self.pairs % U2
        self.pairs1, self.to1 = np.unique(self.word * U1 + self.u2 // 64, return_inverse=True)
        self.word1, self.u1 = self.pairs1 // U1, self.pairs1 % U1
        self.n_words = len(hashes)
        self.tables([np.ones(len(x), np.int64) for x in (pairs, self.pairs, self.pairs1, hashes)])

    @classmethod
    def merged(cls, number: int, bodies) -> Part:
        shares = [read_pairs(b) for b in bodies]
        hashes = np.unique(np.concatenate([s[0][np.unique(s[1][s[5] > 0])] for s in shares]))
        contexts, first = np.unique(np.concatenate([s[2] for s in shares]), return_index=True)
        keys, counts = [], []
        for h, w, before, _, u, c in shares:
            c, keep = c[c > 0], c > 0
            keys.append(np.searchsorted(hashes, h)[w[keep]] * len(contexts) + np.searchsorted(contexts, before)[u[keep]])
            counts.append(c)
        pairs, at = np.unique(np.concatenate(keys), return_inverse=True)
        return cls(number, hashes, contexts, np.concatenate([s[3] for s in shares])[first], pairs, np.bincount(at, np.concatenate(counts), len(pairs)).astype(np.int64))

    def tables(self, found: list[np.ndarray]) -> None:
        self.t3, self.t2, self.t1, self.t0 = found
        self.c2 = np.bincount(self.to2, self.t3, len(self.pairs)).astype(np.int64)
        self.c1 = np.bincount(self.to1, self.t2, len(self.pairs1)).astype(np.int64)
        self.c0 = np.bincount(self.word1, self.t1, self.n_words).astype(np.int64)

    def by_context(self, n: np.ndarray) -> np.ndarray:
        """Sums of a number of each lowest pair: `t3` or `c3`, as far as this part's words go."""
        return np.bincount(self.context, n, len(self.contexts)).astype(np.int64)

    def totals(self) -> np.ndarray:
        """Customers of u2; tables of u2 and of u1; customers and tables of the root; number of words; tokens."""
        add = lambda u, n, size: np.bincount(u, n, size)
        rest = [self.c0.sum(), self.t0.sum(), self.n_words, self.c3.sum()]
        return np.concatenate([add(self.u2, self.c2, U2), add(self.u2, self.t2, U2), add(self.u1, self.t1, U1), rest]).astype(float)

    def predictive(self, totals: np.ndarray):
        """Root probabilities by word, then those of all (word, u1) and (word, u2) with customers."""
        m = Totals(totals)
        p0 = m.root(self.c0, self.t0)
        p1 = m.level1(self.c1, self.t1, self.u1, p0[self.word1])
        return p0, p1, m.level2(self.c2, self.t2, self.u2, p1[self.to1])

    def sweep(self, totals: np.ndarray, number: int, tables3: np.ndarray | None = None) -> None:
        """`tables3` are the tables of each context's restaurant over all parts; by default this part is the only one."""
        rng, m = np.random.default_rng([SEED, self.number, number]), Totals(totals)
        p0, p1, p2 = self.predictive(totals)
        open3 = STRENGTH[3] + DISCOUNT[3] * (self.by_context(self.t3) if tables3 is None else tables3)
        t3 = seat(rng, self.c3, open3[self.context] * p2[self.to2], DISCOUNT[3])
        c2 = np.bincount(self.to2, t3, len(self.pairs)).astype(np.int64)
        t2 = seat(rng, c2, m.open2[self.u2] * p1[self.to1], DISCOUNT[2])
        c1 = np.bincount(self.to1, t2, len(self.pairs1)).astype(np.int64)
        t1 = seat(rng, c1, m.open1[self.u1] * p0[self.word1], DISCOUNT[1])
        c0 = np.bincount(self.word1, t1, self.n_words).astype(np.int64)
        self.tables([t3, t2, t1, seat(rng, c0, np.full(self.n_words, m.open0 * m.uniform), DISCOUNT[0])])


class Totals:
    """What the totals of all parts say about each restaurant: customers, and the weight of opening a table."""

    def __init__(self, x: np.ndarray):
        c2, tables2, tables1 = x[:U2], x[U2 : 2 * U2], x[2 * U2 : 2 * U2 + U1]
        c0, tables0, words, self.tokens = x[2 * U2 + U1 :]
        self.all2, self.all1, self.all0 = STRENGTH[2] + c2, STRENGTH[1] + tables2.reshape(U1, 64).sum(1), STRENGTH[0] + c0
        self.open2, self.open1, self.open0 = STRENGTH[2] + DISCOUNT[2] * tables2, STRENGTH[1] + DISCOUNT[1] * tables1, STRENGTH[0] + DISCOUNT[0] * tables0
        self.uniform, self.words = 1.0 / (words + 1), words

    def root(self, c, t):
        return (np.maximum(c - DISCOUNT[0] * t, 0) + self.open0 * self.uniform) / self.all0

    def level1(self, c, t, u, parent):
        return (np.maximum(c - DISCOUNT[1] * t, 0) + self.open1[u] * parent) / self.all1[u]

    def level2(self, c, t, u, parent):
        return (np.maximum(c - DISCOUNT[2] * t, 0) + self.open2[u] * parent) / self.all2[u]


def seat(rng, customers: np.ndarray, open_weight: np.ndarray, discount: float) -> np.ndarray:
    """Tables after seating each dish's customers: the next one opens a table with weight `open_weight`, against the
    seated less a discount per table. They come in batches of 1/32 of those seated, of one at least."""
    tables = (customers > 0).astype(np.int64)
    many = np.flatnonzero(customers > 1)
    many = many[np.argsort(-customers[many], kind="stable")]
    c, w, t = customers[many], open_weight[many], tables[many].astype(float)
    i = 1
    while len(c) and (n := int(np.searchsorted(-c, -i))):  # dishes with more than i customers come first
        c, w = c[:n], w[:n]
        come = max(1, i // 32)
        p = w / (w + i - discount * t[:n])
        left = np.minimum(c - i, come)
        t[:n] += rng.random(n) < p if come == 1 else rng.binomial(left, p)
        i += come
    tables[many] = t.astype(np.int64)
    return tables


def _merge(parts: int):
    def run(key, table):
        p = key[0].as_py()
        if p < 0:
            return table
        trim()
        blocks, bodies = (table.column(k).to_pylist() for k in ("block", "body"))
        part = Part.merged(p, bodies)
        n = np.bincount(part.word3, minlength=part.n_words)
        static = pack(n, part.classes, part.context, part.c3)
        rows = [(p, p, [STATIC, 0], static), (p, p % SLOTS, [TOTALS, 0], pack(part.totals()))]
        t, c = part.by_context(part.t3), part.by_context(part.c3)
        for q, a, b in _owners(part_of(part.contexts << np.uint64(12), parts)):
            rows.append((p, q, [ASKED, 0], pack(np.diff(part.contexts[a:b], prepend=np.uint64(0)), t[a:b], c[a:b])))
        for block, body in zip(blocks, bodies, strict=True):
            steps, of_word, before, context, _ = unpack(body)
            hashes, at = np.cumsum(steps, dtype=np.uint64), np.zeros(len(steps), np.int64)
            if part.n_words:
                at = np.minimum(np.searchsorted(part.hashes, hashes), part.n_words - 1)
                at = np.where(part.hashes[at] == hashes, at + 1, 0)  # 0: no training text has it
            places = np.searchsorted(part.contexts, np.cumsum(before, dtype=np.uint64))
            rows.append((block, p, [PLACES, 0], pack(at, of_word, np.diff(places, prepend=0), context)))
        return pa.Table.from_batches([_batch(rows)])

    return run


def _owners(owner: np.ndarray):
    """Runs of equal numbers in a sorted array: number, start, end."""
    found, starts = np.unique(owner, return_index=True)
    return zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(owner)], strict=True)


def _rows_of(table):
    """Rows between parts, by sender: sender, kind, sweeps done, body."""
    rows = zip(table.column("block").to_pylist(), table.column("docs").to_pylist(), table.column("body").to_pylist(), strict=True)
    return sorted((block, *(docs or [STATIC, 0]), body) for block, docs, body in rows)


def _own(key, table):
    """Sum tables and customers of the contexts that fall in a part; each sender gets its contexts' sums."""
    q, asked = key[0].as_py(), [(p, *unpack(body)) for p, _, _, body in _rows_of(table)]
    contexts = [np.cumsum(steps, dtype=np.uint64) for _, steps, _, _ in asked]
    mine = np.unique(np.concatenate(contexts))
    at = [np.searchsorted(mine, x) for x in contexts]
    sums = [np.bincount(np.concatenate(at), np.concatenate([x[k] for x in asked]), len(mine)) for k in (2, 3)]
    rows = [(q, p, [SUMMED, 0], pack(sums[0][x].astype(np.uint32), sums[1][x].astype(np.uint64))) for (p, *_), x in zip(asked, at, strict=True)]
    rows += [(p, q, [INDEX, 0], pack(np.diff(x, prepend=0).astype(np.uint32))) for (p, *_), x in zip(asked, at, strict=True)]
    return pa.Table.from_batches([_batch(rows)])


def _own_again(number: int):
    """The same for the tables after later sweeps, by the places that the first time found."""

    def run(key, table):
        rows = _rows_of(table)
        at = {p: np.cumsum(unpack(body)[0], dtype=np.int64) for p, kind, _, body in rows if kind == INDEX}
        t = {p: unpack(body)[0] for p, kind, _, body in rows if kind == ASKED}
        total = np.bincount(np.concatenate([at[p] for p in t]), np.concatenate([*t.values()]))
        return pa.Table.from_batches([_batch([(key[0].as_py(), p, [SUMMED, number], pack(total[at[p]].astype(np.uint32))) for p in t])])

    return run


def _context_totals(rows, size: int):
    """Tables of a part's contexts by sweeps done, and their customers (if the first sums are there), from the owners' rows."""
    tables: dict[int, list[np.ndarray]] = {}
    customers = []
    for _, kind, number, body in rows:
        if kind == SUMMED:
            t, *c = unpack(body)
            tables.setdefault(number, []).append(t)
            customers += c
    done = {n: np.concatenate(tables[n]).astype(float) for n in tables}
    assert all(len(t) == size for t in done.values())
    return done, np.concatenate(customers).astype(float) if customers else np.zeros(size)


def _static(p: int, rows) -> Part:
    """A part from its packed counts. Words and contexts are known by their places only; owners' rows keep the order."""
    n, classes, context, c = unpack(next(body for _, kind, _, body in rows if kind == STATIC))
    pairs = np.repeat(np.arange(len(n)), n.astype(np.int64)) * max(len(classes), 1) + context
    return Part(p, np.zeros(len(n), np.uint64), np.zeros(len(classes), np.uint64), classes.astype(np.int64), pairs, c.astype(np.int64))


def _states(rows) -> dict[int, list[np.ndarray]]:
    """Tables of a part by sweeps done."""
    return {number: [t.astype(np.int64) for t in unpack(body)] for _, kind, number, body in rows if kind == STATE}


def _sweep(sent):
    """One more sweep of a part: its state, its totals, and for the owners the tables of its contexts."""

    def run(key, table):
        trim()
        p, rows = key[0].as_py(), _rows_of(table)
        number, totals = sent.value
        part, states = _static(p, rows), _states(rows)
        if number in states:
            part.tables(states[number])
        tables, _ = _context_totals(rows, len(part.contexts))
        part.sweep(totals, number, tables[number])
        out = [(p, p % SLOTS, [TOTALS, number + 1], pack(part.totals())), (p, p, [STATE, number + 1], pack(part.t3, part.t2, part.t1, part.t0))]
        t, at = part.by_context(part.t3), 0
        for q, size in sorted((q, len(unpack(body)[0])) for q, kind, of, body in rows if kind == SUMMED and of == number):
            out.append((p, q, [ASKED, number + 1], pack(t[at : at + size])))
            at += size
        return pa.Table.from_batches([_batch(out)])

    return run


def _sum(key, table):
    total = np.sum([unpack(body)[0] for body in table.column("body").to_pylist()], axis=0)
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["slot", "totals"])


def _answer(sent):
    """Log probabilities of each block's pairs, the mean of the predictive ones after the last sweeps."""

    def run(key, table):
        trim()
        history, rows = sent.value, _rows_of(table)
        part, states = _static(key[0].as_py(), rows), _states(rows)
        tables, customers = _context_totals(rows, len(part.contexts))
        count0 = np.append(np.bincount(part.word3, part.c3, part.n_words).astype(np.int64), 0)
        models = []
        for number, totals in history.items():
            if number in states:
                part.tables(states[number])
            m = Totals(totals)
            models.append((m, part.t3, *part.predictive(totals), tables[number]))
        out = []
        for block, kind, _, body in rows:
            if kind == PLACES:
                at, of_word, steps, context = unpack(body)
                at = at.astype(np.int64) - 1
                word, context = np.repeat(at, of_word.astype(np.int64)), np.cumsum(steps, dtype=np.int64)[context]
                p = np.zeros(len(word))
                for m, part.t3, p0, p1, p2, t in models:
                    p += look_up_word(part, t, customers, word, context, look_up(part, m, p0, p1, p2, word, part.classes[context]))
                logs = np.minimum(np.rint(np.log10(p / len(models)) / -LOG_STEP), 65535)
                out.append((block, key[0].as_py(), [], pack(of_word, count0[at], logs.astype(np.uint16))))
        return pa.Table.from_batches([_batch(out)]) if out else table.slice(0, 0)

    return run


def look_up_word(part: Part, tables3, customers3, word, context, parent):
    """Probabilities of pairs of a word (-1 an unknown one) and a place in the part's contexts, with or without
    customers, given those of the contexts' classes and the tables and customers of all contexts over all parts."""
    keys = np.where(word >= 0, word * len(part.contexts) + context, -1)
    own = np.zeros(len(keys))
    if len(part.pairs3):
        at = np.minimum(np.searchsorted(part.pairs3, keys), len(part.pairs3) - 1)
        own = np.where(part.pairs3[at] == keys, np.maximum(part.c3 - DISCOUNT[3] * part.t3, 0)[at], 0.0)
    return (own + (STRENGTH[3] + DISCOUNT[3] * tables3[context]) * parent) / (STRENGTH[3] + customers3[context])


def look_up(part: Part, m: Totals, p0, p1, p2, word, u2):
    """Probabilities of pairs, with or without customers; word -1 is an unknown one."""

    def found(keys, among, hit, miss):
        at = np.minimum(np.searchsorted(among, keys), max(len(among) - 1, 0))
        return np.where(among[at] == keys, hit[at], miss) if len(among) else miss

    none = m.open0 * m.uniform / m.all0
    root = np.where(word >= 0, p0[word], none) if len(p0) else np.full(len(word), none)
    u1 = u2 // 64
    one = found(np.where(word >= 0, word * U1 + u1, -1), part.pairs1, p1, m.level1(0, 0, u1, root))
    return found(np.where(word >= 0, word * U2 + u2, -1), part.pairs, p2, m.level2(0, 0, u2, one))


def _add_up(sent):
    def run(key, table):
        trim()
        tokens, words = sent.value
        rows = sorted(zip(table.column("part").to_pylist(), table.column("docs").to_pylist(), table.column("body").to_pylist(), strict=True), key=lambda r: r[0])
        (_, docs, body), answers = rows[0], [unpack(r[2]) for r in rows[1:]]
        sizes, steps = (x.astype(np.int64) for x in unpack(body))
        known = np.concatenate([np.repeat(c.astype(np.int64), n.astype(np.int64)) for n, c, _ in answers])
        logs = np.concatenate([x for _, _, x in answers]) * -LOG_STEP
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.cumsum(steps)
        at -= np.repeat(at[starts] - steps[starts], sizes)
        base = np.log10((known + 0.5) / (tokens + 0.5 * (words + 1)))
        total = lambda x: np.add.reduceat(x[at].astype(float), starts)
        n = [sizes, total(known > 0).astype(np.int64), np.full(len(docs), int(tokens), np.int64), total(base), total(logs)]
        return pa.Table.from_arrays([pa.array(docs, pa.int64()), *map(pa.array, n)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _free(spark) -> None:
    """Let the driver forget finished shuffles, so that executors drop their files before the next job writes."""
    spark.sparkContext._jvm.System.gc()


def score(docs: DataFrame, held_out_fold: int = 1, of: int = 5) -> DataFrame:
    """Score every row of doc_id (long) and text; rows whose fold is `held_out_fold` are scored but not learned from."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch, context = Scratch(spark), spark.sparkContext
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(chars // PART_CHARS, 1)  # by the texts alone: a block has a row for each part that it has words of
    rows = docs.select(F.col("doc_id").cast("long"), fold("doc_id", of) != held_out_fold, "text")
    kind = F.col("docs")[0]
    made = rows.mapInArrow(_blocks(parts), _PACKED).groupBy("part").applyInArrow(_merge(parts), _PACKED)
    path = f"{scratch.root}/made"
    made.withColumn("what", F.when(F.col("part") < 0, "texts").when(kind == PLACES, "places").otherwise("counts")).write.partitionBy("what").parquet(path)
    _free(spark)
    table = lambda what: spark.read.schema(f"{_PACKED}, what string").parquet(path).where(F.col("what") == what).drop("what")
    texts, places, of_parts = table("texts"), table("places"), table("counts")
    owned, _ = scratch.cut(of_parts.where(kind == ASKED).groupBy("part").applyInArrow(_own, _PACKED))
    summed, index = [owned.where(kind == SUMMED)], owned.where(kind == INDEX)
    static, states, history, swept = of_parts.where(kind == STATIC), [], [], of_parts
    for k in range(BURN + AVERAGED):
        if k:
            given = static.unionByName(summed[k - 1])
            given = given.unionByName(states[-1]) if states else given
            swept, _ = scratch.cut(given.groupBy("part").applyInArrow(_sweep(context.broadcast((k - 1, history[k - 1]))), _PACKED))
            states.append(swept.where(kind == STATE))
            again = index.unionByName(swept.where(kind == ASKED)).groupBy("part").applyInArrow(_own_again(k), _PACKED)
            summed.append(scratch.cut(again)[0])
            _free(spark)
        found = swept.where(kind == TOTALS).groupBy("part").applyInArrow(_sum, "slot int, totals array<double>")
        rows = sorted(found.collect())  # at most SLOTS rows of N_TOTALS numbers
        history.append(np.sum([r["totals"] for r in rows], axis=0) if rows else np.zeros(N_TOTALS))
    tokens, words = float(history[0][-1]), float(history[0][-2])
    last = range(BURN, BURN + AVERAGED)
    given = static.unionByName(places).unionByName(summed[0])
    for k in last:
        given = given.unionByName(summed[k]).unionByName(states[k - 1])
    answers, _ = scratch.cut(given.groupBy("part").applyInArrow(_answer(context.broadcast({k: history[k] for k in last})), _PACKED))
    scratch.drop(f"{path}/what=places")
    scratch.drop(f"{path}/what=counts")
    _free(spark)
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = texts.unionByName(answers).groupBy("block").applyInArrow(_add_up(context.broadcast((tokens, words))), schema)
    return out.withColumn("held_out", fold("doc_id", of) == held_out_fold).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
