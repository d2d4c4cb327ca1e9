"""Secret scans: base patterns, and Shannon entropy in sliding windows over candidate strings.

A run of base64 or URL-safe characters is cut at separators; pieces that the allow list names (words, placeholders) break
it, and what stands between them is a candidate. It falls into a class by the characters it has; a window of the class's
length slides over it, the counts of characters are kept up to date as one leaves and one comes, and the entropy follows
from a running sum of c*log2(c); changes between small letters, capitals and digits are counted the same way, since names
written in capitals and small letters change seldom. Where a window reaches its class's limits it is marked; marked
windows that overlap become one span of kind `entropy`.

Defined cases: a null text is an empty one and has no spans. Every row gives one row, repeated ids included. Positions
are code points, ends are exclusive. Spans of kind `entropy` inside or across base spans are cut back to what the base
spans leave, and pieces under `WINDOW` characters go, since the base span marks them already.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .texts import map_rows

KINDS = ("assign", "access", "hex", "entropy")
#: The base patterns and the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST = 16
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
PIECE = re.compile(r"[A-Za-z0-9]+")
#: By class: window, least entropy in bits (16 different characters have 4, 20 have 4.32), least changes in a window.
CLASSES = {"hex": (20, 2.6, 3), "upper": (20, 3.4, 2), "mixed": (16, 3.4, 6), "letters": (20, 3.65, 6)}
#: Allowed runs as a whole: UUIDs; numbers, dates and phone numbers; one character again and again.
ALLOWED = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+|(.)\1+")
#: Allowed pieces between separators: a word of one case or with a capital, with a short number behind; placeholders.
WORDLIKE = re.compile(r"(?:[A-Z]?[a-z]{3,}|[A-Z]{3,})[0-9]{0,4}|(?i:[a-z0-9]*example[a-z0-9]*)")
_MOST = max(w for w, _, _ in CLASSES.values())
_NLOGN = [0.0] + [n * math.log2(n) for n in range(1, _MOST + 1)]


def kind_of(s: str) -> str | None:
    """The class of a candidate; None for strings of a single kind of character."""
    digit = any("0" <= c <= "9" for c in s)
    lower = any("a" <= c <= "z" for c in s)
    upper = any("A" <= c <= "Z" for c in s)
    if lower and upper:
        return "mixed" if digit else "letters"
    if not digit or not (lower or upper):
        return None
    return "hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) else "upper"


def candidates(text: str):
    """Start and text of each candidate."""
    for run in RUN.finditer(text):
        if ALLOWED.fullmatch(run[0]):
            continue
        start = run.start()
        for piece in PIECE.finditer(text, run.start(), run.end()):
            if WORDLIKE.fullmatch(piece[0]):
                if piece.start() - start >= LEAST:
                    yield _trimmed(text, start, piece.start())
                start = piece.end()
        if run.end() - start >= LEAST:
            yield _trimmed(text, start, run.end())


def _trimmed(text: str, a: int, b: int) -> tuple[int, str]:
    """Separators in front belong to what stands before; behind, only the padding of base64 does to the key."""
    while a < b and text[a] in "+/_=-":
        a += 1
    while b > a and text[b - 1] in "+/_-":
        b -= 1
    return a, text[a:b]


def _sort(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def entropy_spans(s: str, limit: float, window: int = 20, changes: int = 0) -> list[tuple[int, int]]:
    """Unions of the windows whose entropy is `limit` or more, with at least so many changes of the sort of character."""
    counts: dict[str, int] = {}
    total, changed, found = 0.0, 0, []
    sorts = [_sort(c) for c in s]
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _NLOGN[n + 1] - _NLOGN[n]
        changed += i > 0 and sorts[i] != sorts[i - 1]
        first = i - window + 1
        if first >= 0:
            if changed >= changes and math.log2(window) - total / window >= limit:
                if found and found[-1][1] >= first:
                    found[-1] = (found[-1][0], i + 1)
                else:
                    found.append((first, i + 1))
            n = counts[out := s[first]]
            counts[out] = n - 1
            total -= _NLOGN[n] - _NLOGN[n - 1]
            changed -= i > first and sorts[first + 1] != sorts[first]
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def secret_spans(text: str) -> tuple[list, list]:
    """Base spans, and all spans, each sorted by start and then by kind."""
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    base = sorted(base_spans(text), key=order)
    taken = _union([(a, b) for _, a, b in base])
    more, at = [], 0
    for start, s in candidates(text):
        found = _windows(s, 0)
        if not s.isalnum():  # a piece may be a key by itself, in a class that its neighbours hide
            found = _union(sorted(found + [x for m in PIECE.finditer(s) if len(m[0]) >= LEAST for x in _windows(m[0], m.start())]))
        while at < len(taken) and taken[at][1] <= start:  # candidates come in order, so this pointer only goes forward
            at += 1
        for a, b in found:
            a, b = a + start, b + start
            for c, d in itertools.islice(taken, at, None):
                if c >= b:
                    break
                if d > a:
                    if c - a >= LEAST:
                        more.append(("entropy", a, c))
                    a = max(a, d)
            if b - a >= LEAST:
                more.append(("entropy", a, b))
    return base, sorted(base + more, key=order)


def _windows(s: str, at: int) -> list[tuple[int, int]]:
    """Marked stretches of a string that stands at `at`, by its class."""
    kind = kind_of(s)
    if kind is None:
        return []
    window, limit, changes = CLASSES[kind]
    return [(a + at, b + at) for a, b in entropy_spans(s, limit, window, changes)]


def _union(spans) -> list[tuple[int, int]]:
    """Sorted spans with overlapping and touching ones made one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each group of overlapping spans replaced by one mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda x: x[1]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def _digest(text: str | None):
    base, spans = secret_spans(text or "")
    told = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b in xs)
    n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
    return (*n, hashlib.sha256(told(base).encode()).hexdigest(), told(spans))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of base spans by kind, their digest, and all spans."""
    long, string = T.LongType(), T.StringType()
    out = [("n_assign", long), ("n_access", long), ("n_hex", long), ("base_sha256", string), ("spans", string)]
    return map_rows(docs, [doc_id], [text], lambda: _digest, out)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows with secrets masked in `text`; other columns, and texts without secrets (null too), are untouched."""
    kept = [c for c in docs.columns if c != text]

    def row(value):
        return (value if value is None else redact(value, secret_spans(value)[1]),)

    return map_rows(docs, kept, [text], lambda: row, [(text, T.StringType())]).select(*docs.columns)
