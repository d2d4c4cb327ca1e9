"""The stages on their own and together."""

from pyspark.sql import functions as F

import corpus_pipeline
from skerry.llm import queries


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf).persist()
        last = k == len(corpus_pipeline.STAGES) - 1
        assert last or sorted(out.columns) == sorted(columns), name
        if name in ("quality_rules", "near_duplicates"):
            assert 0 < out.count() < n
            assert out.exceptAll(docs.select(out.columns)).count() == 0
        if name == "secret_scans":
            assert out.count() == docs.count() and out.where(F.col("text").rlike("[0-9a-f]{24,}")).count() == 0
        if last:
            assert out.count() == docs.count() and out.where("not round_trip").count() == 0
        docs, n = out, out.count()


def test_run_and_registration(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def odd(spark):
    """Null, empty, blank, long, repeated and copied texts beside ordinary ones, and columns whose names others use."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = " ".join(f"w{k % 9973}" for k in range(150_000))
    some = docs.where("lang = 'en'").orderBy("doc_id").first()
    rows = [(70_001, None), (70_002, ""), (70_003, " \n "), (None, some["text"]), (70_004, long), (70_005, long + " end"), (70_006, some["text"]), (70_006, some["text"]), (70_007, some["text"] + " token=abcdefgh12")]
    more = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], docs.schema)
    return docs.unionByName(more).withColumn("row", F.lit("clash")).withColumn("class_id", F.lit(3)).withColumn("h", F.col("doc_id"))


def test_stages_on_odd_rows_against_brute_force(spark):
    import hashlib
    import itertools
    import re

    import public_tokenizers as P
    import tiktoken

    from skerry.llm import bpe_transducer, budget_mix, divergence_rules

    stages, docs = dict(corpus_pipeline.STAGES), odd(spark).persist()
    key = lambda rows: sorted(repr(tuple(r)) for r in rows)
    # 1: rows that fail the base rules go, whole rows stay
    kept = stages["quality_rules"](spark, docs, "").persist()
    told = divergence_rules.judge(docs.select("doc_id", "text", "lang")).groupBy("kept").count().collect()
    assert kept.columns == docs.columns and kept.count() == {r["kept"]: r["count"] for r in told}[True]
    assert all(len((r["text"] or "").split()) >= 50 for r in kept.collect()) and not set(key(kept.collect())) - set(key(docs.collect()))
    # 2: of each group of texts linked by a similarity of 0.8 one row of the smallest id
    rows = docs.collect()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) else set() for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-12:
            root[find(i)] = find(j)
    first = {}
    for i, r in enumerate(rows):
        at = (r["doc_id"] is None, r["doc_id"] or 0)
        first[find(i)] = min(first.get(find(i), (at, i)), (at, i))
    one = stages["near_duplicates"](spark, docs, "").persist()
    assert one.columns == docs.columns and key(one.collect()) == key(rows[i] for _, i in first.values())
    # 3: every row stays, all base matches are masked, clean texts are as they were
    masked = stages["secret_scans"](spark, docs, "").persist()
    assert masked.columns == docs.columns and masked.count() == len(rows)
    for r in masked.collect():
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        assert not re.search(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}|token=[A-Za-z0-9]{6,}", r["text"] or "")
    clean = sorted(r["text"] for r in rows if r["text"] and not re.search(r"(?i)password|passwd|secret|token|api_?key|AKIA|[0-9a-f]{24,}", r["text"]))
    assert not set(clean) - {r["text"] for r in masked.collect()}
    # 4: each leaf gives whole epochs and a prefix in the order of the seeded hash within its budget
    plan = budget_mix.mix_documents(docs).persist()
    leaf = lambda r: (r["domain"], r["lang"], r["source"])
    tokens = {}
    for r in plan.collect():
        tokens.setdefault(leaf(r), []).append(r["n_tokens"])
    leaves = spark.createDataFrame([(*k, float(sum(v) * budget_mix.MAX_EPOCHS)) for k, v in tokens.items()], "domain string, lang string, source string, means double")
    given = {leaf(r): r["budget"] for r in budget_mix.allocate(leaves, list(budget_mix.TREE), budget_mix.BUDGET_SHARE * sum(map(sum, tokens.values())), budget_mix.WEIGHTS).collect()}
    whole = {k: int((given[k] + 1e-6) // sum(v)) if sum(v) else 0 for k, v in tokens.items()}
    asked = plan.withColumn("whole", F.element_at(F.create_map(*[F.lit(x) for k, v in whole.items() for x in (str(k), v)]), F.concat(F.lit("('"), F.col("domain"), F.lit("', '"), F.col("lang"), F.lit("', '"), F.col("source"), F.lit("')"))).cast("long"))
    asked = asked.withColumn("h", F.xxhash64(F.lit(budget_mix.SEED), "whole", "row.doc_id", "row.text").bitwiseAND(F.lit((1 << 63) - 1))).collect()
    for k, n in tokens.items():
        rest, total = int(given[k] + 1e-6) - whole[k] * sum(n), 0
        mine = sorted((r for r in asked if leaf(r) == k), key=lambda r: r["h"])
        for _, same in itertools.groupby(mine, key=lambda r: r["h"]):
            same = list(same)
            prefixes = []
            for r in same:
                total += r["n_tokens"]
                prefixes.append(whole[k] + (total <= rest))
            assert sorted(r["epochs"] for r in same) == sorted(prefixes), k
    mixed = stages["source_mix"](spark, docs, "")
    assert mixed.columns == docs.columns and mixed.count() == sum(r["epochs"] for r in asked)
    # 5: the ids are those of the reference tokenizer
    ranks = bpe_transducer.parse_ranks(bpe_transducer.read_vocabulary(P.path("byte_bpe_50k.tiktoken")))
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mark = lambda i, ids: (str(i), hashlib.sha256(repr(list(ids)).encode()).hexdigest())
    got = stages["token_ids"](spark, docs, "").collect()
    assert sorted(mark(r["doc_id"], r["ids"]) for r in got) == sorted(mark(r["doc_id"], theirs.encode_ordinary(r["text"] or "")) for r in rows)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
