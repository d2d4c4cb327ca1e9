"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Leaves of a tree (domain, then language, then source, or any columns) hold documents and can give their tokens up to
`max_epochs` times. A budget of tokens goes down from the root: each node divides its own among its children by weight.
A child that can't use its share, since all leaves below it can't supply it, takes what it can, and the rest is divided
among its siblings by weight, again and again; only what a whole subtree can't use reaches the siblings of its root. As
a child's means are those of its whole subtree, this is one division per level: with children in the order of means per
weight, those in front are filled up and the others get equal amounts per weight, found by running sums.

A leaf takes whole epochs while its budget lasts and from the next one a prefix: the documents of that epoch in the
order of a seeded hash of id and text, as long as their running sum of tokens stays within what is left. The order is cut into `SLICES`
ranges of the hash; slices are summed before any shuffle, and only the documents of the one slice in which a leaf's
prefix ends are put in order. So a leaf that holds a third of all documents is never in one task.

Defined cases: null values of a tree column are a node of their own. A null or empty text has no tokens; it is taken
with the prefix it falls in. Nodes without a stated weight weigh 1, nodes of weight 0 get nothing. A budget above all
that the tree can give takes all. Repeated rows count each for itself; ties of the hash go by id, then text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small
from .divergence_rules import words_of

SLICES, SEED = 4096, 6
TREE = ("domain", "lang", "source")


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.size(words_of(F.col(text))), F.lit(0)).cast("long")


def path_key(columns: list[str]) -> Column:
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def same(left: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for c in left:
        out = out & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return out


def allocate(leaves: DataFrame, tree: list[str], budget: float, weights: dict[str, float]) -> DataFrame:
    """`leaves` (tree columns, means) with `budget`, each leaf's part of the whole budget, as a double."""
    stated = F.create_map(*[F.lit(v) for pair in weights.items() for v in (pair[0], float(pair[1]))]) if weights else None
    level = leaves
    usable = F.col("means").cast("double")
    for k in range(1, len(tree) + 1):
        weight = F.coalesce(F.element_at(stated, path_key(tree[:k])), F.lit(1.0)) if stated is not None else F.lit(1.0)
        level = level.withColumn(f"w{k}", weight)
        usable = F.when(F.col(f"w{k}") > 0, usable).otherwise(F.lit(0.0))
    level = level.withColumn("usable", usable)
    given = None
    for k in range(1, len(tree) + 1):
        up, own = tree[: k - 1], tree[:k]
        x = level.groupBy(*own).agg(F.sum("usable").alias("usable"), F.max(f"w{k}").alias("w"))
        if given is None:
            x = x.withColumn("b", F.least(F.lit(float(budget)), F.sum("usable").over(Window.partitionBy(F.lit(0)))))
        else:
            above = given.select(*[F.col(c).alias(f"up_{c}") for c in up], F.col("budget").alias("b"))
            x = x.join(above, same(up, "up_")).drop(*[f"up_{c}" for c in up])
        ratio = F.when(F.col("w") > 0, F.col("usable") / F.when(F.col("w") > 0, F.col("w")))
        x = x.withColumn("ratio", ratio)
        group = Window.partitionBy(*(up or [F.lit(0)]))
        order = group.orderBy(F.col("ratio").asc_nulls_first(), *own)
        x = x.withColumn("filled", F.coalesce(F.sum("usable").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        x = x.withColumn("weights", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        x = x.withColumn("level", F.when(F.col("weights") > 0, (F.col("b") - F.col("filled")) / F.when(F.col("weights") > 0, F.col("weights"))).otherwise(F.lit(0.0)))
        # the first child that isn't filled up sets the amount per weight of all behind it
        amount = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(group)
        x = x.withColumn("amount", amount["level"])
        budget_of = F.when(F.col("ratio").isNull(), 0.0).when(F.col("amount").isNull() | (F.col("ratio") <= F.col("level")), F.col("usable")).otherwise(F.least(F.col("usable"), F.col("w") * F.col("amount")))
        given = x.select(*own, F.greatest(budget_of, F.lit(0.0)).alias("budget"))
    return given


def mix(docs: DataFrame, tree: list[str], tokens: Column, weights: dict[str, float], budget_share: float, max_epochs: int, seed: int = SEED) -> DataFrame:
    """`row` (the document's columns), the tree columns, n_tokens and epochs: how often the document is taken.

    The budget is `budget_share` of all tokens. `docs` must have the tree columns, doc_id and text.
    """
    scratch = Scratch(docs.sparkSession)
    x = docs.select(F.struct("*").alias("row"), *tree, tokens.alias("n_tokens"), F.col("doc_id").alias("order_id"))
    leaves, _ = scratch.cut(x.groupBy(*tree).agg(F.sum("n_tokens").alias("tokens")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    given = allocate(leaves.withColumn("means", F.col("tokens") * max_epochs), tree, budget_share * total, weights)
    joined = leaves.join(given.select(*[F.col(c).alias(f"g_{c}") for c in tree], "budget"), same(tree, "g_")).drop(*[f"g_{c}" for c in tree])
    whole = F.when(F.col("tokens") > 0, F.floor((F.col("budget") + 1e-6) / F.when(F.col("tokens") > 0, F.col("tokens")))).otherwise(F.lit(0)).cast("long")
    plan = joined.withColumn("whole", whole).withColumn("rest", F.floor(F.col("budget") + 1e-6).cast("long") - F.col("whole") * F.col("tokens"))
    plan, _ = scratch.cut(plan.withColumn("leaf", F.monotonically_increasing_id()))
    leaf = small(plan.select(*[F.col(c).alias(f"p_{c}") for c in tree], "leaf", "whole", "rest"), 20_000)
    x = x.join(leaf, same(tree, "p_")).drop(*[f"p_{c}" for c in tree])
    x = x.withColumn("h", F.xxhash64(F.lit(seed), "whole", "order_id", "row.text").bitwiseAND(F.lit((1 << 63) - 1)))
    x = x.withColumn("slice", F.shiftright("h", 51))
    sums = x.where("rest > 0").groupBy("leaf", "slice").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    before = F.sum("n").over(Window.partitionBy("leaf").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = sums.withColumn("upto", before).where(F.col("upto") > F.col("rest"))
    ends = ends.groupBy("leaf").agg(F.min(F.struct("slice", (F.col("upto") - F.col("n")).alias("before"))).alias("end"))
    ends, _ = scratch.cut(ends.select(F.col("leaf").alias("end_leaf"), F.col("end.slice").alias("end_slice"), F.col("end.before").alias("before")))
    x = x.join(small(ends, 20_000), F.col("leaf") == F.col("end_leaf"), "left").drop("end_leaf")
    at_end = (F.col("slice") == F.col("end_slice")) & (F.col("rest") > 0)
    told = lambda more: F.col("whole") + more.cast("long")
    clear = x.where(~F.coalesce(at_end, F.lit(False)))
    clear = clear.withColumn("epochs", told((F.col("rest") > 0) & (F.col("end_slice").isNull() | (F.col("slice") < F.col("end_slice")))))
    order = Window.partitionBy("leaf").orderBy("h", "order_id", F.xxhash64("row.text")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # only the documents of one slice of each leaf come here
    last = x.where(at_end).withColumn("epochs", told(F.col("before") + F.sum("n_tokens").over(order) <= F.col("rest")))
    out = ["row", *tree, "n_tokens", "epochs"]
    return clear.select(*out).unionByName(last.select(*out))


def domain_of(source: Column) -> Column:
    """The domains of the synthetic sources: the first five are reference works, the rest is web text."""
    return F.when(source.rlike("^src[0-4]$"), F.lit("reference")).otherwise(F.lit("web"))


#: Production weights: by domain, then language, then source.
WEIGHTS = {"reference": 3.0, "web": 7.0, "web/en": 4.0, "web/de": 1.0, "web/fr": 1.0, "web/es": 2.0, "reference/en": 2.0}
BUDGET_SHARE, MAX_EPOCHS = 0.8, 2


def mix_documents(docs: DataFrame, weights: dict[str, float] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """`mix` over documents with lang, source and text; the domain follows from the source."""
    rows = docs.select(F.struct("*").alias("all"), "doc_id", "lang", "source", "text").withColumn("domain", domain_of(F.col("source")))
    return mix(rows, list(TREE), n_words(), weights, budget_share, max_epochs, seed)
