"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes exactly when each neighbouring pair is: merging the pair's bytes
alone gives the pair back. So the encoder is a nondeterministic transducer over the token trie: a hypothesis holds the
last finished token and the trie node of the one in progress; at a node that ends a token which fits the last one, it
may finish it. `Transducer` determinises this as bytes arrive: a state is the set of live hypotheses with their output
not yet written, output common to all of them is written at once, and states and moves are kept. A hypothesis dies when
its trie walk ends, so output waits for no more bytes than the longest token has.

`Utf8Machine` decodes token after token; a character cut by a token's end waits in its state.

Defined cases: null and empty texts have no tokens, and their digests are those of no bytes. Every row gives one row.
Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import array
import base64
import functools
import hashlib
import itertools

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .texts import map_rows, trim

#: Pieces and moves kept before they are dropped and found anew; this bounds memory (to 0.4 GB and 0.15 GB a worker), not results.
KEPT, KEPT_LESS = (800_000, 700_000), (40_000, 300_000)
KEPT_FITS = 60_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines `base64 rank` of a tiktoken file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge_bytes(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain BPE: merge the neighbouring pair of least rank, leftmost first, until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def last_merge(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The two pieces whose merge makes a token."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 2:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    def __init__(self, ranks: dict[bytes, int], kept: int = KEPT[1]):
        self.ranks, self.kept = ranks, kept
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.go: dict[int, int] = {}  # trie node * 256 + byte -> node; the root is 0
        self.ends: dict[int, int] = {}  # node -> token
        self.inner: set[int] = set()  # nodes with children
        n = 1
        for token, rank in ranks.items():
            node = 0
            for b in token:
                key = node * 256 + b
                if key not in self.go:
                    self.go[key] = n
                    self.inner.add(node)
                    n += 1
                node = self.go[key]
            self.ends[node] = rank
        self.spines: tuple[dict, dict] = ({}, {})
        self.fit: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = self._packed([((), -1, 0)])
        self.states, self.index = [start], {start: 0}
        self.moves: dict[int, int] = {}  # state * 256 + byte -> state, or its complement if output is written
        self.written: dict[int, tuple[int, ...]] = {}
        self.finals: dict[int, tuple[int, ...]] = {}  # output still to be written where a text may end, if any

    def _spine(self, token: int, last: bool) -> list[tuple[bytes, int, int]]:
        """The pieces that stand at one end of a token while it is merged, from the whole down to a byte: the piece, and the
        ranks at which it comes to be and is merged away."""
        found = self.spines[last].get(token)
        if found is None:
            found, piece, until = [], self.bytes_of[token], 1 << 60
            while True:
                since = self.ranks[piece] if len(piece) > 1 else -1
                found.append((piece, since, until))
                if len(piece) == 1:
                    break
                piece, until = last_merge(piece, self.ranks)[-1 if last else 0], since
            self.spines[last][token] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two neighbouring tokens: pieces at the border cross if they stand there at
        the same time and their own merge comes before what takes either away (of equal ranks the left one comes first)."""
        if left < 0:
            return True
        key = left << 32 | right
        found = self.fit.get(key)
        if found is None:
            if len(self.fit) >= KEPT_FITS:
                self.fit.clear()
            found = self.fit[key] = self._fits(left, right)
        return found

    def _fits(self, left: int, right: int) -> bool:
        rank = self.ranks.get
        for a, since_a, until_a in self._spine(left, True):
            for b, since_b, until_b in self._spine(right, False):
                if since_b < until_a and since_a <= until_b:
                    m = rank(a + b)
                    if m is not None and m < until_a and m <= until_b:
                        return False
        return True

    @staticmethod
    def _packed(hypotheses) -> bytes:
        """A state in 4 bytes a number: for each hypothesis how many tokens wait, these, the last token, the trie node."""
        return array.array("i", [x for waiting, last, node in hypotheses for x in (len(waiting), *waiting, last, node)]).tobytes()

    @staticmethod
    def _unpacked(state: bytes):
        numbers, at = array.array("i", state).tolist(), 0
        while at < len(numbers):
            end = at + 1 + numbers[at]
            yield tuple(numbers[at + 1 : end]), numbers[end], numbers[end + 1]
            at = end + 2

    def _move(self, state: int, b: int) -> int:
        live = []
        for waiting, last, node in self._unpacked(self.states[state]):
            child = self.go.get(node * 256 + b)
            if child is None:
                continue
            if child in self.inner:
                live.append((waiting, last, child))
            token = self.ends.get(child)
            if token is not None and self.fits(last, token):
                live.append(((*waiting, token), token, 0))
        first, same = live[0][0], min(len(w) for w, _, _ in live)
        k = 0
        while k < same and all(w[k] == first[k] for w, _, _ in live):
            k += 1
        rests = sorted((w[k:], last, node) for w, last, node in live)
        then = self._packed(rests)
        at = self.index.get(then)
        if at is None:
            at = self.index[then] = len(self.states)
            self.states.append(then)
            rest = next((w for w, _, node in rests if node == 0), ())
            if rest:
                self.finals[at] = rest
        key = state << 8 | b
        if k:
            self.written[key] = first[:k]
            at = ~at
        self.moves[key] = at
        return at

    def encode(self, data: bytes) -> tuple[int, ...]:
        """Token ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        if len(self.moves) >= self.kept:
            self._reset()
        out: list[int] = []
        state, known = 0, self.moves.get
        for b in data:
            then = known(state << 8 | b)
            if then is None:
                then = self._move(state, b)
            if then < 0:
                out += self.written[state << 8 | b]
                then = ~then
            state = then
        return (*out, *self.finals.get(state, ()))


def _longer(first: int) -> tuple[int, int, int] | None:
    """Bytes to come after a first byte, and the least and greatest second byte; None if no character starts so."""
    if 0xC2 <= first <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= first <= 0xEF:
        return 2, 0xA0 if first == 0xE0 else 0x80, 0x9F if first == 0xED else 0xBF
    if 0xF0 <= first <= 0xF4:
        return 3, 0x90 if first == 0xF0 else 0x80, 0x8F if first == 0xF4 else 0xBF
    return None


class Utf8Machine:
    """Incremental UTF-8: a state is the bytes of a character that has begun. Wrong bytes become U+FFFD, one for each broken start."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.moves = bytes_of, {b"": {}}
        self.whole: dict[int, str] = {}  # tokens of whole characters

    @staticmethod
    def feed(state: bytes, data: bytes) -> tuple[bytes, str]:
        out, held = [], state
        for b in data:
            if held:
                n, low, high = _longer(held[0])
                if (low if len(held) == 1 else 0x80) <= b <= (high if len(held) == 1 else 0xBF):
                    held += bytes([b])
                    if len(held) == n + 1:
                        value = held[0] & (0x3F >> n)
                        for c in held[1:]:
                            value = value << 6 | c & 0x3F
                        out.append(chr(value))
                        held = b""
                    continue
                out.append("�")
                held = b""
            if b < 0x80:
                out.append(chr(b))
            elif _longer(b):
                held = bytes([b])
            else:
                out.append("�")
        return held, "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of all ids. A run of tokens that begin and end with whole characters leaves the machine where it was, so such
        runs are looked up at once; others go through it token by token."""
        out, state = [], b""
        for at in range(0, len(ids), 64):
            run = ids[at : at + 64]
            if not state:
                try:
                    out.append("".join(map(self.whole.__getitem__, run)))
                    continue
                except KeyError:
                    pass
            state = self._through(state, run, out)
        return "".join(out) + ("�" if state else "")

    def _through(self, state: bytes, ids: list[int], out: list[str]) -> bytes:
        moves = self.moves[state]
        for i in ids:
            move = moves.get(i)
            if move is None:
                then, text = self.feed(state, self.bytes_of[i])
                move = moves[i] = (then, text, self.moves.setdefault(then, {}))
                if not state and not then:
                    self.whole[i] = text
            state, text, moves = move
            out.append(text)
        return state


class _Pieces(dict):
    """Ids by piece. A missing one is looked for among those set aside when this last was full, else encoded; short ones are kept."""

    def __init__(self, transducer: Transducer, kept: int):
        self.transducer, self.kept, self.aside = transducer, kept, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.aside.get(piece) or self.transducer.encode(piece.encode())
        if len(piece) <= 64:
            if len(self) >= self.kept // 2:
                self.aside = dict(self)
                self.clear()
            self[piece] = found
        return found


class Tokenizer:
    """Pieces by a pattern, each encoded for itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: tuple[int, int] = KEPT):
        self.transducer = Transducer(ranks, kept[1])
        self.machine = Utf8Machine(self.transducer.bytes_of)
        self.pieces = _Pieces(self.transducer, kept[0])
        self.find = regex.compile(pattern).findall

    def encode(self, text: str) -> list[int]:
        return list(itertools.chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))

    def decode(self, ids) -> str:
        return self.machine.decode(ids)

    def forget(self) -> None:
        """Drop pieces, moves and fits; they are found anew."""
        self.pieces.clear()
        self.pieces.aside = {}
        self.transducer._reset()
        self.transducer.fit.clear()
        trim()


@functools.lru_cache(maxsize=2)
def _built(data: bytes, pattern: str, kept: tuple[int, int]) -> Tokenizer:
    return Tokenizer(parse_ranks(data), pattern, kept)


def _worker(data, pattern: str, kept: tuple[int, int], row):
    """A row function over the tokenizer of this Python process, built once. One that keeps less forgets all it has kept at a
    task's end: its process may wait through stages that need the memory."""

    def work():
        tokenizer = _built(data.value, pattern, kept)
        made = functools.partial(row, tokenizer)
        if kept == KEPT_LESS:
            made.close = tokenizer.forget
        return made

    return work


def _digest(tokenizer: Tokenizer, text: str | None):
    ids = tokenizer.encode(text or "")
    decoded = tokenizer.decode(ids).encode()
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _ids(tokenizer: Tokenizer, text: str | None):
    ids = tokenizer.encode(text or "")
    return ids, len(ids), tokenizer.decode(ids) == (text or "")


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, vocabulary: str, pattern: str, keep: list[str], text: str = "text", kept: tuple[int, int] = KEPT) -> DataFrame:
    """Columns `keep` with ids, n_tokens, and round_trip: whether the ids decode to the text again.

    The vocabulary file (some hundred KB, of fixed size) is read by the driver and broadcast.
    """
    data = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    out = [("ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType()), ("round_trip", T.BooleanType())]
    return map_rows(docs, keep, [text], _worker(data, pattern, kept, _ids), out)


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, keep: list[str], text: str = "text", kept: tuple[int, int] = KEPT) -> DataFrame:
    """Columns `keep` with n_tokens, the digest of the ids, and the digest of what they decode to."""
    data = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    out = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return map_rows(docs, keep, [text], _worker(data, pattern, kept, _digest), out)
