"""Chat formatting over reply trees, in DataFrame functions only.

`reply_paths` finds root-to-leaf paths by iterative self-joins with doubling: round k knows each message's ancestor
2^k steps up with the summed score in between, so a thread of n messages takes log2(n) rounds, each written to the
shared folder. Leaves are ranked within their tree by the summed score of their path (ties to the smaller leaf), and
only the chosen paths are spelled out, again by doubling, from the same tables.

`format_paths` writes a path as one text, a turn as `<|im_start|>role\\ntext<|im_end|>\\n`. Inside texts and roles a
backslash is doubled and control strings get a backslash behind their first character, which `parse` undoes.

Defined cases: null texts and roles are empty ones. A message whose parent is missing starts a path of its own; messages
in a cycle have no root and give no path. Rows of one conversation with the same turn are told apart by role and text,
and full repeats are turns of their own. A null conversation id is a conversation of its own. Extra columns are ignored.
A conversation is one row of the result by definition, so its turns meet in one row there; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, let

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates; the last character classes catch all of their kind.
CONTROL = r"([<\[])(/?s>|/?INST\]|</?SYS>>|/?\|[^|<>\n]*\|>|\|[^|<>\n]*\|>)"
SLOTS = 32


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    part = lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit(""))
    return F.array_join(F.transform(F.split(role, r"\\\\", -1), part), "\\")


def numbered(scratch: Scratch, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with `node`, their place in one order over all rows, and `parent`, the row before if it has the same keys.

    The order is a range partitioning, so a key with a large share of all rows is spread over many tasks.
    """
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    placed, _ = scratch.cut(placed.withColumn("at", F.monotonically_increasing_id()))
    block = F.shiftright("at", 33)
    per = placed.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    start = per.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row per partition of the line above, so at most as many rows as shuffle partitions
    node = placed.withColumn("block", block).join(F.broadcast(start.drop("n")), "block").withColumn("node", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    node = node.drop("block", "start", "at")
    last = node.select((F.col("node") + 1).alias("node"), F.lit(True).alias("has"), *[F.col(k).alias(f"last_{k}") for k in keys])
    same = F.col("has")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"last_{k}"))
    out = node.join(last, "node", "left").withColumn("parent", F.when(same, F.col("node") - 1))
    return out.drop("has", *[f"last_{k}" for k in keys])


def reply_paths(scratch: Scratch, messages: DataFrame, paths: int = 1) -> DataFrame:
    """(leaf, node, above): the messages of each chosen path, `above` counting steps up from the leaf.

    `messages` has tree, node (unique), parent (null or missing: a root) and score. The best `paths` leaves of each tree
    are chosen.
    """
    known = messages.select(F.col("node").alias("parent"))
    up = messages.where("parent is not null").select("node", "parent").join(known, "parent", "left_semi")
    now = messages.select("node", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("acc")).join(up.select("node", F.col("parent").alias("up")), "node", "left")
    now, _ = scratch.cut(now)
    jumps, before = [], None
    while True:
        going = now.where("up is not null")
        n = going.count()
        if n == 0 or n == before:
            break
        before = n
        jumps.append(going.select("node", "up"))
        top = now.select(F.col("node").alias("up"), F.col("acc").alias("more"), F.col("up").alias("next"))
        moved = going.join(top, "up").select("node", (F.col("acc") + F.col("more")).alias("acc"), F.col("next").alias("up"))
        now, _ = scratch.cut(now.where("up is null").select("node", "acc", "up").union(moved))
    rooted = now.where("up is null").select("node", "acc")
    leaves = rooted.join(jumps[0].select(F.col("up").alias("node")).distinct(), "node", "left_anti") if jumps else rooted
    leaves = leaves.join(messages.select("node", "tree"), "node")
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("acc"), "node"))
    best = leaves.withColumn("slot", F.pmod(F.xxhash64("node"), F.lit(SLOTS)))
    best = best.withColumn("r", rank("tree", "slot")).where(F.col("r") <= paths)
    best = best.withColumn("r", rank("tree")).where(F.col("r") <= paths)
    found, _ = scratch.cut(best.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above")))
    for k in range(len(jumps) - 1, -1, -1):
        step = found.join(jumps[k], "node").select("leaf", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        found, _ = scratch.cut(found.unionByName(step))
    return found


def format_paths(turns: DataFrame, keys: list[str], order: str = "place") -> DataFrame:
    """One row per path: its keys, `formatted`, and `loss`, the code-point spans of assistant texts in it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escape_role(role), F.lit("\n"))
    piece = F.struct(F.col(order).alias("o"), head.alias("head"), escape(text).alias("body"), (role == "assistant").alias("learn"))
    held = turns.groupBy(*keys).agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    tail = F.lit(CLOSE + "\n")
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, tail)), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    size = F.transform("turns", lambda t: F.struct(F.length(t.head).cast("long").alias("h"), F.length(t.body).cast("long").alias("b"), t.learn.alias("learn")))

    def add(acc: Column, t: Column) -> Column:
        a, b = acc.at + t.h, acc.at + t.h + t.b
        span = F.struct(a.alias("start"), b.alias("end"))
        return F.struct((b + len(CLOSE) + 1).alias("at"), F.when(t.learn, F.array_append(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    return held.select(*keys, formatted.alias("formatted"), F.aggregate(size, start, add, lambda acc: acc.spans).alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text again: array of (role, text)."""
    inner = F.regexp_extract_all(formatted, F.lit(r"(?s)<\|im_start\|>(.*?)<\|im_end\|>\n"), F.lit(1))

    def turn(s: Column) -> Column:
        role = F.substring_index(s, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(s, F.length(role) + 2, F.length(s))).alias("text"))

    return F.transform(inner, turn)


def under_mask(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, span after span."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")


def format_conversations(conversations: DataFrame, paths: int = 1) -> DataFrame:
    """conv_id, formatted, loss: each conversation as the reply tree in which a turn answers the turn before."""
    scratch = Scratch(conversations.sparkSession)
    rows = numbered(scratch, conversations.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn", "role", "text"])
    rows, _ = scratch.cut(rows)
    chosen = reply_paths(scratch, rows.select(F.struct("conv_id").alias("tree"), "node", "parent", F.lit(0.0).alias("score")), paths)
    turns = chosen.join(rows, "node").withColumn("place", -F.col("above"))
    return format_paths(turns, ["conv_id", "leaf"]).drop("leaf")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1: a user, then an assistant row, both of control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them."""
    told = lambda turns: F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    x = formatted.withColumn("turns", parse(F.col("formatted"))).withColumn("learned", under_mask(F.col("formatted"), F.col("loss")))
    return x.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told(F.col("turns")).cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
