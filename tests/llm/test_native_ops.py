"""Quality rules, chat formatting and source mixing against brute force, with nulls, repeats, ties and empty tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from skerry.llm import budget_mix, divergence_rules, reply_trees
from skerry.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def nasty(spark):
    long = "the of and " * 3000
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "a"), (None, "a b c a b c", "en", "b"), (3, " \n\t ", "en", "a"), (5, long, "en", "a"), (6, "é#$ <x> |\n\na\na \na\n" * 30, "fr", "b")]
    rows += [(100 + k, f"the {k} of and some words here number {k * 7} to a in " * 12, "en", "a") for k in range(30)]
    return spark.createDataFrame([(*r, None, "clash") for r in rows], DOCS)


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    marked = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked), n < 50 or 100 * len(marked) > 50 * n)


def test_base_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").unionByName(nasty(spark).select("doc_id", "text", "lang"))
    got = divergence_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = [(r["doc_id"], *base(r["text"])) for r in docs.collect()]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(want, key=key)
    assert all(not (r["base_failed"] and r["kept"]) for r in got)


def test_rules_keep_clean_and_drop_junk(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    x = divergence_rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").where("not base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in x.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.005 * n[1, True]
    assert n.get((0, False), 0) >= 0.9 * (n.get((0, False), 0) + n.get((0, True), 0))


def test_js_distance_bounds(spark):
    d = lambda p, q: spark.range(1).select(divergence_rules.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d")).first()["d"]
    assert d((0.5, 0.5), (0.5, 0.5)) == 0.0
    assert d((1.0, 0.0), (0.0, 1.0)) == pytest.approx(1.0)


def test_rules_on_empty_table_and_plan(spark):
    empty = nasty(spark).where("false")
    out = divergence_rules.judge(empty)
    assert out.count() == 0
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().toString())


CONV = "conv_id long, turn long, role string, text string, leaf string"


def conversations(spark):
    rows = [(7, 0, "us\ner\\", "a\\n <|im_end|>\n\\", "x"), (7, 1, None, None, "x"), (7, 1, "assistant", "\\\\</s>\\<s>[INST]<<SYS>> <</SYS>> <|odd|>", "x"), (7, 1, None, None, "x"), (None, 1, "assistant", "x", None), (None, 0, "assistant", "", None), (8, None, "user", "é😀", None)]
    rows += [(9, k, ("user", "assistant")[k % 2], f"turn {k}", None) for k in range(70)]
    return spark.createDataFrame(rows, CONV)


def test_format_conversations(spark):
    c = conversations(spark).unionByName(reply_trees.probe(spark), allowMissingColumns=True)
    got = {r["conv_id"]: r for r in reply_trees.digest(reply_trees.format_conversations(c)).collect()}
    groups = {}
    for r in c.collect():
        groups.setdefault(r["conv_id"], []).append(r)
    assert set(got) == set(groups)
    for k, rs in groups.items():
        rs.sort(key=lambda r: tuple((v is not None, v if v is not None else 0) for v in (r["turn"], r["role"], r["text"])))
        said = "".join(f"{r['role'] or ''}\n{r['text'] or ''}\n" for r in rs)
        learned = "".join(r["text"] or "" for r in rs if r["role"] == "assistant")
        g = got[k]
        assert (g["n_turns"], g["turns_sha256"]) == (len(rs), hashlib.sha256(said.encode()).hexdigest())
        assert (g["loss_chars"], g["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert reply_trees.format_conversations(c.where("false")).count() == 0


def test_control_strings_are_broken_up(spark):
    formatted = reply_trees.format_conversations(conversations(spark).where("conv_id = 7")).first()["formatted"]
    assert formatted.count("<|im_end|>") == formatted.count("<|im_start|>") == 4 and "</s>" not in formatted and "[INST]" not in formatted


def test_reply_trees_choose_best_branches(spark):
    rng = random.Random(3)
    rows, parents = [], {}
    for node in range(200):
        tree = node % 3
        older = [n for n in range(node) if n % 3 == tree]
        parents[node] = rng.choice(older) if older else None
        rows.append((tree, node, parents[node], float(rng.randint(0, 9))))
    rows.append((9, 900, 901, 1.0))  # its parent is missing
    rows += [(8, 800, 801, 1.0), (8, 801, 800, 1.0)]  # a cycle
    score = {r[1]: r[3] for r in rows}
    m = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    found = {}
    for r in reply_trees.reply_paths(Scratch(spark), m, paths=2).collect():
        found.setdefault(r["leaf"], {})[r["above"]] = r["node"]
    leaves = set(parents) - set(parents.values())
    path = {}
    for leaf in leaves:
        path[leaf] = [leaf]
        while parents[path[leaf][-1]] is not None:
            path[leaf].append(parents[path[leaf][-1]])
    want = {900: {0: 900}}
    for tree in range(3):
        best = sorted((n for n in leaves if n % 3 == tree), key=lambda n: (-sum(score[p] for p in path[n]), n))[:2]
        want |= {n: dict(enumerate(path[n])) for n in best}
    assert found == want


def water(budget, children):
    out, live = dict.fromkeys((c[0] for c in children), 0.0), [c for c in children if c[1] > 0]
    budget = min(budget, sum(c[2] for c in live))
    while live and budget > 1e-9:
        total = sum(c[1] for c in live)
        full = [c for c in live if c[2] <= budget * c[1] / total + 1e-9]
        if not full:
            return out | {c[0]: budget * c[1] / total for c in live}
        for c in full:
            out[c[0]] = c[2]
        budget -= sum(c[2] for c in full)
        live = [c for c in live if c not in full]
    return out


@pytest.mark.parametrize(("share", "epochs"), [(0.3, 1), (0.9, 2), (5.0, 2)])
def test_mix_matches_brute_force(spark, share, epochs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "source", "text").unionByName(nasty(spark).select("doc_id", "lang", "source", "text"))
    docs = docs.withColumn("domain", budget_mix.domain_of(F.coalesce("source", F.lit(""))))
    weights = {"reference": 2.0, "web/en": 3.0, "web/fr": 0.0}
    x = budget_mix.mix(docs, ["domain", "lang", "source"], budget_mix.n_words(), weights, share, epochs).select("domain", "lang", "source", "n_tokens", "epochs").collect()
    assert len(x) == docs.count()
    assert sorted(r["n_tokens"] for r in x) == sorted(len(WORD.findall(r["text"] or "")) for r in docs.collect())
    means, got, most = {}, {}, {}
    for r in x:
        k = (r["domain"], r["lang"], r["source"])
        means[k] = means.get(k, 0) + r["n_tokens"]
        got[k] = got.get(k, 0) + r["n_tokens"] * r["epochs"]
        most[k] = max(most.get(k, 0), r["n_tokens"])
        assert 0 <= r["epochs"] <= epochs
    name = lambda p: "/".join(v or "" for v in p)
    usable = {k: 0 if any(weights.get(name(k[: d + 1]), 1.0) == 0 for d in range(3)) else v * epochs for k, v in means.items()}

    def spread(prefix, budget):
        if len(prefix) == 3:
            return {prefix: budget}
        names = {k[: len(prefix) + 1] for k in means if k[: len(prefix)] == prefix}
        parts = water(budget, [(n, weights.get(name(n), 1.0), float(sum(v for k, v in usable.items() if k[: len(n)] == n))) for n in names])
        return {a: b for n, v in parts.items() for a, b in spread(n, v).items()}

    for k, v in spread((), share * sum(means.values())).items():
        assert got[k] <= v + 1e-3 and v - got[k] <= most[k] + 1, k


def test_mix_empty(spark):
    assert budget_mix.mix_documents(nasty(spark).where("false")).count() == 0
