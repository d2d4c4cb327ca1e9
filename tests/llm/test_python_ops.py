"""Classifier, tokenizer, page extraction, secrets, near-duplicates and language model against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.llm import bpe_transducer, cap_filters, chosen_path, compression_quality, entropy_secrets, html_mincut, pitman_yor, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_links string, rep long"


def nasty(spark):
    long = " ".join(f"w{k % 997}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n "), (3, " \n "), (None, "one two three"), (4, "one two three"), (5, long), (6, long + " end"), (7, "é😀 \x00 token: abcdefgh")]
    return spark.createDataFrame([(*r, "clash", 9) for r in rows], DOCS)


# --- 1


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    x = queries.op1_compression_quality(spark, sf)
    assert x.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    got = x.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    wins = sum((g > b) + 0.5 * (g == b) for g, b in itertools.product(good, bad)) / (len(good) * len(bad))
    assert wins > 0.95 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([(4, 1), (99, 0), (1, None)], "doc_id long, quality int")
    got = compression_quality.held_out_scores(nasty(spark), labels).collect()
    assert len(got) == 9 and len({r["score"] for r in got}) == 1 and 0 < got[0]["score"] < 1
    assert compression_quality.held_out_scores(nasty(spark).where("false"), labels).count() == 0


def test_quality_scores_brute_force(spark):
    """Scores recomputed from the dictionaries and weights alone, one chunk at a time, and the same from few labels."""
    import zstandard

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(nasty(spark).select("doc_id", "text"))
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0
    for least in (None, 2):
        labels = spark.read.parquet(f"{sf}/labels.parquet")
        if least:
            labels = labels.where(train & (F.col("quality") == 0)).orderBy("doc_id").limit(least).union(labels.where(train & (F.col("quality") == 1)).orderBy("doc_id").limit(least))
        model = compression_quality.fit(docs, labels, train)
        assert model.weights

        def size(dictionary, chunk):
            return len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)).compress(chunk))

        want = []
        for r in docs.collect():
            data = (r["text"] or "").encode()
            parts = [data[i : i + 512] for i in range(0, len(data), 512)][:200]
            d = [((x := size(model.bad, c)) - (y := size(model.good, c))) / (x + y) for c in parts]
            if len(data) <= 512 * 200:
                mean = sum(v * len(c) for v, c in zip(d, parts, strict=True)) / len(data) if data else 0.0
                z = model.weights[0] + model.weights[1] * mean + model.weights[2] * min(d, default=0.0)
                want.append((str(r["doc_id"]), len(data), round(1 / (1 + math.exp(-z)), 9)))
        got = [(str(r["doc_id"]), len((r["text"] or "").encode()), round(r["score"], 9)) for r in compression_quality.score(docs, model, ["doc_id", "text"]).collect()]
        assert Counter(want) == Counter(g for g in got if g[1] <= 512 * 200) and len(got) == docs.count()


def test_logistic_separates():
    x = np.array([[-1.0], [-0.8], [0.9], [1.1], [0.1]])
    w = compression_quality.logistic(x, np.array([0, 0, 1, 1, 0.0]), np.ones(5))
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert p[2] > 0.5 > p[1] and p[3] > p[2]


# --- 2


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers as P
    import tiktoken

    ranks = bpe_transducer.parse_ranks(bpe_transducer.read_vocabulary(P.path("byte_bpe_50k.tiktoken")))
    return bpe_transducer.Tokenizer(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_bpe_equals_tiktoken(tokenizers, text):
    mine, theirs = tokenizers
    ids = mine.encode(text)
    assert ids == theirs.encode_ordinary(text) and mine.decode(ids) == text


def test_bpe_long_runs(tokenizers):
    mine, theirs = tokenizers
    for text in ("a" * 5000, "=-" * 800, " " * 3000 + "x", "thatthethenthere" * 200, "<|endoftext|>"):
        assert mine.encode(text) == theirs.encode_ordinary(text)


@given(st.lists(st.binary(max_size=4), max_size=8))
def test_utf8_machine(pieces):
    machine = bpe_transducer.Utf8Machine(dict(enumerate(pieces)))
    assert machine.decode(range(len(pieces))) == b"".join(pieces).decode("utf-8", "replace")


def test_bpe_query(spark, tokenizers):
    import public_tokenizers as P

    docs = nasty(spark)
    got = bpe_transducer.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ["doc_id", "n_links"]).collect()
    want = []
    for r in docs.collect():
        ids = tokenizers[1].encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], "clash", len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)
    assert bpe_transducer.encode(docs.where("false"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, docs.columns).count() == 0


# --- 5


def test_page_article(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op5_html_mincut(spark, SF).collect()}
    for r in rows:
        import html

        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


PAGE = """<!doctype html><head><title>T</title><style>p{}</style></head><body><div id="site-header"><a href=/>Home</a> <a href=/a>About us</a></div>
<div class="cookie-notice"><p>We use cookies to make this site better for you, and you may read all about it in our policy.</p></div>
<div class=wrap><div class=col><h1>The&nbsp;title &amp; more</h1><p>A first paragraph with quite a few words in it, and a <a href="x">link</a>, which ends here.<p>Short one.
<ul><li>an item<li>two items</ul><p>A last paragraph, a &lt; b &#233; and a < b, long enough to be told from the things around it.</div>
<aside><p>Other stories that are long and wordy and would like to be read by all who come here, every day.</p></aside></div>
<form><p>Write to us about all that you like and we will answer as soon as we can.</p><input></form>
<section class="comments"><p>I liked this very much, thank you for it, and I hope that there is more to come.</p></section><script>if (a<b) "</p>"</script><footer>&copy; us</footer>"""


def test_page_with_everything():
    assert html_mincut.main_text(PAGE).split("\n") == [
        "The title & more", "A first paragraph with quite a few words in it, and a link, which ends here.", "Short one.", "an item", "two items",
        "A last paragraph, a < b é and a < b, long enough to be told from the things around it.",
    ]


def soup(rng):
    """A page without any telling tag or name: links, an article with short lines and lists, teasers among links, a notice; and its article's blocks."""
    word = lambda: "".join(rng.choice(list("abcdeimnorst"), rng.integers(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    links = lambda n: "<ul>" + "".join(f"<li><a href=/{k}>{text(rng.integers(1, 4))}</a></li>" for k in range(n)) + "</ul>"
    rows, want = [], []
    for k in range(rng.integers(4, 12)):
        kind = rng.integers(0, 4) if 0 < k else 3
        t = text(rng.integers(1, 4)) if kind < 2 else text(rng.integers(20, 60)) + "."
        if kind == 0:
            items = [text(rng.integers(1, 4)) for _ in range(rng.integers(2, 5))]
            rows.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
            want += items
        else:
            rows.append(f"<h3>{t}</h3>" if kind == 1 else f"<p>{t}</p>")
            want.append(t)
    last = text(25) + "."
    teaser = "".join(f"<li>{text(rng.integers(12, 20))}.</li>" if k == 2 else f"<li><a href=/x>{text(3)}</a></li>" for k in range(7))
    page = f"<body><div>{links(6)}</div><div><div>{''.join(rows)}<p>{last}</p></div></div><div><ul>{teaser}</ul></div><div>{links(4)}<p>Copyright {text(3)}</p></div></body>"
    return page, [*want, last]


def test_the_cut_mends_what_the_classifier_gets_wrong():
    rng = np.random.default_rng(11)
    wrong = [0, 0]
    blocks = mended = 0
    for _ in range(150):
        page, want = soup(rng)
        found = html_mincut.blocks_of(page)
        odds = [html_mincut.log_odds(b) for b in found]
        truth = [b.text in want for b in found]
        assert sum(truth) == len(want)
        cut = html_mincut.minimum_cut(odds, html_mincut.smoothness(found))
        sign = [x > 0 for x in odds]
        blocks += len(found)
        mended += sum(s != t == c for s, t, c in zip(sign, truth, cut, strict=True))
        for k, labels in enumerate((sign, cut)):
            wrong[k] += sum(a != b for a, b in zip(labels, truth, strict=True))
    assert mended > 150 and wrong[1] < 0.01 * blocks and wrong[1] * 10 < wrong[0]


def test_nothing_else_is_dropped_and_references_are_read_for_themselves():
    assert html_mincut.main_text("<article><p>Let <math><mi>x</mi></math> be <svg><title>t</title><text>a</text></svg></p><audio>old</audio></article>") == "Let x be a\nold"
    assert html_mincut.main_text("<article><p>a &am<b>p; b &lt;b></p></article>") == "a &amp; b <b>"
    links = "".join(f"<li><a href=/>{w}</a></li>" for w in "one two three".split())
    assert html_mincut.main_text(f"<article><h1>Title</h1><p>See these.</p><ul>{links}</ul></article>").endswith("one\ntwo\nthree")


def test_hostile_and_long_pages_take_linear_time():
    import time

    began = time.time()
    for page in ("<div>" * 40_000 + "</i>" * 40_000, "<div>" * 40_000 + "</p></ul>" * 40_000, "<i><div>" + "<b>" * 40_000 + "</i>" * 40_000 + "x", "<div>" * 5000 + "abc def." + "</div>" * 5000):
        html_mincut.main_text(page)
    long = "".join(f"<p>line {k} of a long page that goes on and on.</p>" for k in range(20_000))
    assert html_mincut.main_text(f"<main>{long}</main>").count("\n") == 19_999
    assert time.time() - began < 20


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=1, max_size=7), st.data())
def test_minimum_cut_is_minimal(odds, data):
    n = len(odds)
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.floats(0, 2)), max_size=10))
    edges = [e for e in edges if e[0] != e[1]]
    cost = lambda lab: sum(max(o, 0) if not k else max(-o, 0) for o, k in zip(odds, lab, strict=True)) + sum(w for a, b, w in edges if lab[a] != lab[b])
    best = min(cost(lab) for lab in itertools.product((False, True), repeat=n))
    assert cost(html_mincut.minimum_cut(odds, edges)) == pytest.approx(best, abs=1e-6)


@given(st.text("<>/apdiv =\"'&;!-", max_size=80))
def test_any_markup_is_read(page):
    html_mincut.main_text(page)


def test_pages_null_and_empty(spark):
    df = spark.createDataFrame([(1, None, "c"), (1, "", "c"), (2, "<p", "c")], "page_id long, html string, text string")
    assert [r["text"] for r in html_mincut.extract(df, ["page_id"]).collect()] == ["", "", ""]


# --- 8


def plain_base(text):
    kinds = {
        "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        "access": re.compile(r"AKIA[A-Z0-9]+"),
        "hex": re.compile(r"[0-9a-f]+"),
    }
    out = []
    for k, p in kinds.items():
        for m in p.finditer(text):
            if k == "assign" and len(m[2]) >= 6 or k == "access" and len(m[0]) >= 20 or k == "hex" and len(m[0]) >= 24:
                out.append((m.start(), list(kinds).index(k), f"{k}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "SECRET", "api_key", ": ", '="', "AKIA", "AKIAABCDEFGH1234", "0123456789ab", "deadbeef", " ", "x", "é", "Zq3+/"]), max_size=14).map("".join))
def test_base_spans(text):
    base, spans = entropy_secrets.secret_spans(text)
    assert [f"{k}:{a}:{b}" for k, a, b in base] == plain_base(text)
    assert set(base) <= set(spans)


@given(st.text("ab1Z", min_size=20, max_size=60))
def test_entropy_windows(s):
    def entropy(w):
        return -sum(n / len(w) * math.log2(n / len(w)) for n in Counter(w).values())

    hit = {i for a in range(len(s) - 19) if entropy(s[a : a + 20]) >= 1.6 - 1e-12 for i in range(a, a + 20)}
    near = {i for a in range(len(s) - 19) if entropy(s[a : a + 20]) >= 1.6 + 1e-9 for i in range(a, a + 20)}
    got = {i for a, b in entropy_secrets.entropy_spans(s, 1.6) for i in range(a, b)}
    assert near <= got <= hit | got and got <= {i for a in range(len(s) - 19) if entropy(s[a : a + 20]) >= 1.6 - 1e-9 for i in range(a, a + 20)}


def test_entropy_finds_keys_and_spares_words():
    key = "ghp_x8Kq2ZrT5vB9nM1cW7yD4eF6hJ3"
    assert any(k == "entropy" for k, *_ in entropy_secrets.secret_spans(f"use {key} here")[1])
    for plain in ("internationalization-and-localization", "123e4567-e89b-12d3-a456-426614174000", "http://site.example.com/a/long/path/to/some/page", "2024-01-01-2024-12-31-0000"):
        assert entropy_secrets.secret_spans(plain)[1] == []
    assert entropy_secrets.redact("a token: abcdefgh b", entropy_secrets.secret_spans("a token: abcdefgh b")[1]) == "a [SECRET] b"


def planted_secrets(rng, n):
    """Random keys of several alphabets and lengths, none of a form that a base pattern names."""
    sets = {
        "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 24, 64),
        "letters": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 24, 48),
        "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 20, 40),
        "lower": ("abcdefghijklmnopqrstuvwxyz0123456789", 20, 40),
        "short": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 16, 20),
        "HEX": ("0123456789ABCDEF", 24, 64),
    }
    for k in range(n):
        name = list(sets)[k % len(sets)]
        letters, low, high = sets[name]
        yield name, "".join(rng.choice(list(letters), rng.integers(low, high)))


def test_entropy_finds_what_no_pattern_names_and_nothing_else(spark):
    """Every clean text of the table with one key put into it: how many are found, how much of them, and what else is."""
    rng = np.random.default_rng(8)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").orderBy("doc_id").limit(600).collect()]
    clean = [t for t in texts if not entropy_secrets.base_spans(t)]
    assert len(clean) > 400
    assert [entropy_secrets.secret_spans(t)[1] for t in clean] == [[]] * len(clean)
    found, of = Counter(), Counter()
    for text, (name, key) in zip(clean, planted_secrets(rng, len(clean)), strict=False):
        at = text.find(" ", int(rng.integers(0, len(text))))
        at = len(text) if at < 0 else at
        put = rng.choice([" {} ", ' "{}" ', " key={} ", " https://h.example.com/{}/x "])
        start = at + put.index("{}")
        spans = entropy_secrets.secret_spans(text[:at] + put.replace("{}", key) + text[at:])[1]
        of[name] += 1
        found[name] += any(a <= start + 3 and b >= start + len(key) - 3 for _, a, b in spans)
        assert all(b > start - 12 and a < start + len(key) for _, a, b in spans)
    assert all(found[k] >= 0.9 * of[k] for k in of), (found, of)
    assert sum(found.values()) >= 0.95 * sum(of.values()), (found, of)


def test_allow_list_goes_by_pieces():
    key = "x8Kq2ZrT5vB9nM1cW7yD4eF6hJ3"
    text = f"/example/{key}/page"
    assert [(text[a:b]) for _, a, b in entropy_secrets.secret_spans(text)[1]] == [key]
    many = " ".join(f"token=abcdefgh{k} x8Kq2ZrT5vB9nM1cW7yD{k}" for k in range(20_000))
    base, spans = entropy_secrets.secret_spans(many)
    assert len(base) == 20_000 and len(spans) == 40_000


def test_secret_query(spark):
    docs = nasty(spark)
    got = entropy_secrets.scan(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    assert [r["spans"] for r in got if r["doc_id"] == 7] == ["assign:5:20"]
    masked = entropy_secrets.redacted(docs)
    assert masked.columns == docs.columns and masked.where("doc_id = 7").first()["text"].endswith("[SECRET]")


# --- 7


def brute_pairs(texts, least=0.8):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    return {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-12}


def test_near_duplicates_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [(9000 + k, " ".join(f"v{(i * 7919) % 5003}" if i != k * 3 else f"z{k}" for i in range(400))) for k in range(40)]
    docs = docs.unionByName(spark.createDataFrame([*more, (9100, None), (9101, ""), (9102, more[0][1]), (9103, "a b"), (9104, "a b")], "doc_id long, text string"))
    rows = docs.collect()
    pairs = brute_pairs([r["text"] for r in rows])
    n = Counter(i for p in pairs for i in p)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), 1 << 60), r["doc_id"])
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in chosen_path.near_duplicates(docs).collect()}
    assert got == {r["doc_id"]: (n[i], low[find(i)]) for i, r in enumerate(rows)}


def test_near_duplicates_odd_rows(spark):
    docs = nasty(spark)
    got = chosen_path.near_duplicates(docs)
    assert got.count() == docs.count()
    assert {r["class_id"] for r in got.where("doc_id in (5, 6)").collect()} == {5}
    first = chosen_path.first_of_each(docs)
    assert first.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in first.collect()) == ["1", "2", "3", "3", "4", "5", "7"]
    assert chosen_path.near_duplicates(docs.where("false")).count() == 0 and chosen_path.first_of_each(docs.where("false")).count() == 0


def test_rows_without_ids_link_like_others(spark):
    base = [f"w{i}" for i in range(200)]
    near = lambda k: " ".join(base[:k] + ["other"] + base[k + 1 :])
    rows = [(None, near(199)), (None, near(199)), (8, " ".join(base)), (None, "x y z"), (None, near(0)), (9, None)]
    got = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    told = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"], r["kept"]) for r in got)
    assert told == [("8", "8", 3, True), ("9", "9", 0, True), ("None", "8", 3, False), ("None", "8", 3, False), ("None", "8", 3, False), ("None", "None", 0, False)]


def test_large_buckets_split_into_cells(spark, monkeypatch):
    from skerry.llm import cells

    rows = [(k, k % 3) for k in range(25)]
    x = spark.createDataFrame(rows, "rep long, key long")
    dealt = cells.into_cells(x.select("rep").join(cells.in_buckets(cells.Scratch(spark), x.select("key", "rep"), 4), "rep")).collect()
    met = Counter()
    by = {}
    for r in dealt:
        by.setdefault((r["key"], r["i"], r["j"]), []).append((r["rep"], r["side"]))
    for (_, i, j), rs in by.items():
        met.update(frozenset((a, b)) for (a, s), (b, t) in itertools.combinations(rs, 2) if i == j or s != t)
    assert met == Counter(frozenset(p) for p in itertools.combinations(range(25), 2) if p[0] % 3 == p[1] % 3)


# --- 9


def test_vectors_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((260, 24))
    for k in range(0, 120, 3):
        x[k + 1] = x[k] + 0.05 * rng.standard_normal(24)
    for k in range(200, 240):
        x[k] = x[200] + 0.08 * rng.standard_normal(24)
    x[250], x[251] = x[3], x[3]
    x = x.astype(np.float32)
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] + [1.0] * 23), (904, [None] + [1.0] * 23), (905, [float("inf")] * 24), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, x[3].tolist())]
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), *odd], "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("m", F.lit("clash"))
    got = {r["vec_id"]: r for r in cap_filters.near_duplicates(df).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = y @ y.T >= 0.95
    np.fill_diagonal(s, False)
    assert [got[i]["n_links"] for i in range(260)] == s.sum(1).tolist()
    low = np.arange(260)
    while True:
        new = np.minimum(low, np.where(s, low[None], 1 << 60).min(1))
        if (new == low).all():
            break
        low = new
    assert [got[i]["component_id"] for i in range(260)] == low.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 906))
    assert got[906]["n_links"] == 1 and got[907]["component_id"] == 906
    assert got[None]["n_links"] == 0 and got[None]["kept"] is False
    assert cap_filters.near_duplicates(df.where("false")).count() == 0


def test_filters_of_close_vectors_meet():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((3000, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    width, share = 70, np.zeros(3000, int)
    for r in range(cap_filters.CODES):
        made = cap_filters.code(r, 64, width)
        a, b = cap_filters.decode(x, made, width), cap_filters.decode(y, made, width)
        share += (a[:, :, None] == b[:, None, :]).sum((1, 2))
    assert (share == 0).mean() < 1e-3 and share.mean() > 10


def test_list_decoding_takes_the_best():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((50, 10))
    turn, sides, half = made = cap_filters.code(0, 10, 20)
    y = x @ turn.T
    every = (y[:, :half] @ sides[0].T)[:, :, None] + (y[:, half:] @ sides[1].T)[:, None, :]
    want = np.argsort(-every.reshape(50, -1), axis=1)[:, :6]
    assert [set(r) for r in cap_filters.decode(x, made, 20)] == [set(r) for r in want]


# --- 10


def test_language_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(nasty(spark).select("doc_id", "text"))
    rows = docs.collect()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    c = Counter(w for r in rows if fold(r["doc_id"]) != 1 for w in tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, fold(r["doc_id"]) == 1, len(ts := tokens(r["text"])), sum(c[w] > 0 for w in ts), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts), 6)) for r in rows)
    got = pitman_yor.score(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    again = pitman_yor.score(docs).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_probabilities_add_up_to_one():
    texts = [(i, True, "a b a c d the the of a b" * (i + 1)) for i in range(5)]
    packed = [r for r in pitman_yor.block_rows(0, texts, 1) if r[1] == 0]
    part = pitman_yor.Part.merged(0, [r[3] for r in packed])
    totals = part.totals()
    part.sweep(totals, 0)
    totals = part.totals()
    m = pitman_yor.Totals(totals)
    p0, p1, p2 = part.predictive(totals)
    for u2 in (*np.unique(part.u2).tolist(), 77):
        words = np.array([*range(part.n_words), -1])
        p = pitman_yor.look_up(part, m, p0, p1, p2, words, np.full(len(words), u2))
        assert p.sum() == pytest.approx(1.0)


def test_contexts_are_whole_words(spark):
    """baking and making have one class, so only their own restaurants can tell what follows them."""
    assert pitman_yor.context_class(b"baking") == pitman_yor.context_class(b"making")
    ids = [[i for i in range(400) if (zlib.crc32(str(i).encode()) % 5 == 1) == held] for held in (False, True)]
    rows = [(i, "making bread now baking cars now" if i % 2 else "baking cars now making bread now") for i in ids[0][:200]]
    asked = ["making bread now", "making cars now", "baking cars now", "baking bread now"]
    docs = spark.createDataFrame(rows + list(zip(ids[1], asked, strict=False)), "doc_id long, text string")
    got = {r["text"]: r["score"] for r in pitman_yor.score(docs).join(docs, "doc_id").where("held_out").collect()}
    assert got["making bread now"] > got["making cars now"] + 1 and got["baking cars now"] > got["baking bread now"] + 1


def test_word_contexts_add_up_to_one_over_parts():
    """Totals of contexts whose words lie in several parts are those of all parts, as the owners' sums give them."""
    words = "a b c d the of be me".split()
    texts = [(i, True, "a b a c d the the of a b be me " * (i + 1)) for i in range(5)]
    texts += [(9, False, " ".join(f"{x} {y}" for x in words for y in words)), *((9, False, x) for x in words), (9, False, "")]
    parts = [pitman_yor.Part.merged(r[1], [r[3]]) for r in pitman_yor.block_rows(0, texts, 3) if r[1] >= 0]
    assert len(parts) == 3 and sum(p.n_words for p in parts) == len(words) + 1
    at = [np.searchsorted(np.unique(np.concatenate([p.contexts for p in parts])), p.contexts) for p in parts]

    def summed(found):
        total = np.bincount(np.concatenate(at), np.concatenate(found))
        return [total[x] for x in at]

    for number in range(2):
        totals, tables = sum(p.totals() for p in parts), summed([p.by_context(p.t3) for p in parts])
        for p, t in zip(parts, tables, strict=True):
            p.sweep(totals, number, t)
    totals, tables, customers = sum(p.totals() for p in parts), summed([p.by_context(p.t3) for p in parts]), summed([p.by_context(p.c3) for p in parts])
    assert totals[-1] == sum(len(t.split()) + 1 for _, train, t in texts if train)
    m, got = pitman_yor.Totals(totals), Counter()
    for k, (p, t, c) in enumerate(zip(parts, tables, customers, strict=True)):
        asked = np.array([*range(p.n_words), *([-1] if k == 0 else [])])
        for x, h in enumerate(p.contexts.tolist()):
            p2 = pitman_yor.look_up(p, m, *p.predictive(totals), asked, np.full(len(asked), p.classes[x]))
            got[h] += pitman_yor.look_up_word(p, t, c, asked, np.full(len(asked), x), p2).sum()
    everywhere = set.intersection(*(set(p.contexts.tolist()) for p in parts))
    assert len(everywhere) >= len(words) and all(got[h] == pytest.approx(1.0) for h in everywhere)


def test_seating_keeps_its_bounds():
    rng = np.random.default_rng(1)
    c = np.array([0, 1, 2, 50, 5000, 3_000_000])
    t = pitman_yor.seat(rng, c, np.full(6, 0.5), 0.7)
    assert (t[c > 0] >= 1).all() and (t <= c).all() and t[0] == 0
    many = np.mean([pitman_yor.seat(rng, np.full(200, 30), np.full(200, 1.0), 0.0).mean() for _ in range(20)])
    assert many == pytest.approx(sum(1.0 / (1.0 + i) for i in range(30)), rel=0.03)


def test_language_model_without_training(spark):
    one = spark.createDataFrame([(4, "a b"), (2, None)], "doc_id long, text string").where("false")
    assert pitman_yor.score(one).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = pitman_yor.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and math.isfinite(r["score"])
