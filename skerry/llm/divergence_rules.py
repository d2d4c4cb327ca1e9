"""Quality rules by distribution divergence, in DataFrame functions only.

Two histograms are taken from each whole text: shares of character classes over its non-blank characters, and shares
of the commonest words of its language over its words. Each is compared with its language's reference by the
Jensen-Shannon distance (base 2, so 0 to 1). The references are counted over all texts: the common words are the
`n_words` words found in most documents of the language, and a reference histogram is the mean of its documents'
histograms, so that one long text weighs no more than another. A text is kept when it passes the base rules and both
distances are under their limits; a histogram is judged only when the text is long enough for it. A histogram of n draws
strays from its source by about 1/sqrt(n), so each limit is a floor plus a part that shrinks with the square root of the
words or characters: short texts aren't blamed for noise, and long ones are held to more.

Defined cases: a null text is an empty one (no words: base_failed, not kept). A null language is a language of its
own. A language with fewer than `min_docs` texts has no reference of its own and is held against the pool of all
languages by character classes only. Repeated rows and repeated ids are scored each for itself. Columns of the input
other than the named ones play no part in results and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, let, small

#: Character classes by Java pattern; the last class is all that is left.
CLASSES = (r"\p{Ll}", r"\p{Lu}", r"[\p{L}\p{M}&&[^\p{Lu}\p{Ll}]]", r"\p{Nd}", r"[.,]", r"[#*$%&|<>]", r"[!?:;'\"()\-]")
#: The class that is also the contract's symbol count.
SYMBOL_CLASS = 5
#: Limits: a floor and what is divided by the square root of characters or words; the class limit has a ceiling too.
CLASS_FLOOR, CLASS_NOISE, MAX_CLASS_DISTANCE = 0.09, 4.4, 0.30
WORD_FLOOR, WORD_NOISE = 0.10, 1.6
MIN_CHARS = 200
MIN_WORDS = 50
MIN_DOCS = 20
N_WORDS = 12


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(WORD))
    return let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def n_repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more; a word under several such windows counts once.

    Windows are compared by a 64-bit hash of their three words. Where a text has equal ones, they are sorted with their
    positions, so equal ones stand together; the positions with an equal neighbour are sorted again, and each covers
    three words less what the next one covers. Nothing here is quadratic in the length of a text.
    """
    n = F.greatest(F.size(words) - 2, F.lit(0))

    def windows(h: Column) -> Column:
        two = F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda x, y: F.xxhash64(x, y))
        return F.zip_with(two, F.slice(h, 3, n), lambda x, y: F.xxhash64(x, y))

    def marked(s: Column) -> Column:
        none = F.struct(F.lit(None).cast("bigint").alias("w"), F.lit(None).cast("int").alias("i"))
        after = F.concat(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.array(none))
        same = F.zip_with(s, after, lambda x, y: F.struct(x.i.alias("i"), y.i.alias("j"), x.w.eqNullSafe(y.w).alias("same")))
        hit = F.filter(same, lambda x: x.same)
        return F.sort_array(F.array_distinct(F.concat(F.transform(hit, lambda x: x.i), F.transform(hit, lambda x: x.j))))

    def covered(p: Column) -> Column:
        after = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.array(F.lit(None).cast("int")))
        steps = F.zip_with(p, after, lambda x, y: F.coalesce(F.least(y - x, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def count(h: Column) -> Column:
        rows = F.transform(h, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(F.sort_array(rows), marked), covered))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count)


def shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda n: F.when(total > 0, n.cast("double") / total).otherwise(F.lit(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits of two histograms of one length."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: 0.5 * part(x, (x + y) / 2) + 0.5 * part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def class_counts(words: Column) -> Column:
    """Characters of each class in the words, class after class; what is of no class comes last."""

    def rest(s: Column, patterns: tuple[str, ...]) -> Column:
        if not patterns:
            return F.array(F.length(s))
        fewer = F.regexp_replace(s, f"{patterns[0]}+", "")
        return let(fewer, lambda t: F.concat(F.array(F.length(s) - F.length(t)), rest(t, patterns[1:])))

    return let(F.array_join(words, ""), lambda s: rest(s, CLASSES))


def common_words(docs: DataFrame, n_words: int = N_WORDS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, common): for each language with enough texts the words found in most of its documents, commonest first.

    Words are lower-cased; each counts once per document, is added up before the shuffle, and ties go to the smaller
    word. The ranking keeps `n_words` rows per partial group, so no language is gathered in one task.
    """
    one = F.explode(F.array_distinct(F.transform(words_of(F.coalesce("text", F.lit(""))), F.lower)))
    n = docs.select("lang", one.alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    n = n.where(F.col("n") >= F.lit(min_docs))
    slot = F.pmod(F.xxhash64("word"), F.lit(64))
    part = n.withColumn("slot", slot)
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("lang", "slot").orderBy(F.desc("n"), "word"))).where(F.col("r") <= n_words)
    best = part.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= n_words)
    ranked = best.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", "word"))).alias("a"))
    return ranked.select("lang", F.transform("a", lambda x: x.word).alias("common"))


def features(docs: DataFrame, scratch: Scratch, n_words: int = N_WORDS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Base measures and histograms of each document; no text leaves this step."""
    source = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    lists, _ = scratch.cut(common_words(source, n_words, min_docs).withColumnRenamed("lang", "list_lang"))
    lists = small(lists)
    x = source.join(lists, F.col("lang").eqNullSafe(F.col("list_lang")), "left").drop("list_lang")
    x = x.withColumn("words", words_of(F.col("text")))
    place = F.transform("words", lambda w: F.array_position("common", F.lower(w)))
    counted = let(F.filter(place, lambda i: i > 0), lambda a: F.transform("common", lambda c, k: F.size(a) - F.size(F.array_remove(a, (k + 1).cast("long")))))
    return x.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        n_dup_lines(F.col("text")).alias("n_dup_lines"),
        n_repeat_words(F.col("words")).alias("n_repeat_words"),
        class_counts(F.col("words")).alias("classes"),
        counted.alias("counted"),
    )


def judge(docs: DataFrame, n_words: int = N_WORDS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Measures, both distances and the verdict `kept` for each row of documents.

    Two scans of the texts: one for the common words, one for the measures, which are written to the shared folder
    (a few numbers per row) since both the references and the verdicts are taken from them.
    """
    scratch = Scratch(docs.sparkSession)
    x, _ = scratch.cut(features(docs, scratch, n_words, min_docs))
    x = x.withColumn("word_chars", F.aggregate("classes", F.lit(0), lambda a, n: a + n).cast("long"))
    x = x.withColumn("n_symbols", F.get("classes", F.lit(SYMBOL_CLASS)).cast("long"))
    other = F.greatest(F.col("n_words") - F.aggregate("counted", F.lit(0), lambda a, n: a + n), F.lit(0)).cast("int")
    x = x.withColumn("class_share", shares(F.col("classes"), F.col("word_chars")))
    x = x.withColumn("word_share", F.when(F.col("counted").isNotNull(), shares(F.concat("counted", F.array(other)), F.col("n_words"))))
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    x = x.withColumn("base_failed", failed)
    good = ~F.col("base_failed")
    means = [F.avg(F.when(good, F.get("class_share", F.lit(i)))).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    means += [F.avg(F.when(good, F.get("word_share", F.lit(i)))).alias(f"w{i}") for i in range(n_words + 1)]
    by_lang = x.groupBy("lang").agg(F.count(F.when(good, 1)).alias("n"), *means)
    class_ref = F.array(*[f"c{i}" for i in range(len(CLASSES) + 1)])
    word_ref = F.filter(F.array(*[f"w{i}" for i in range(n_words + 1)]), lambda v: v.isNotNull())
    refs = by_lang.where(F.col("n") >= min_docs).select(F.col("lang").alias("ref_lang"), class_ref.alias("class_ref"), word_ref.alias("word_ref"))
    pool = x.agg(*means[: len(CLASSES) + 1]).select(class_ref.alias("pool_ref"))
    x = x.join(small(refs), F.col("lang").eqNullSafe(F.col("ref_lang")), "left").crossJoin(F.broadcast(pool))  # pool: one row
    by_class = js_distance(F.col("class_share"), F.coalesce("class_ref", "pool_ref"))
    by_word = F.when(F.size("word_share") == F.size("word_ref"), js_distance(F.col("word_share"), F.col("word_ref")))
    x = x.withColumn("class_distance", F.when(F.col("word_chars") >= MIN_CHARS, by_class))
    x = x.withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS, by_word))
    class_limit = F.least(F.lit(MAX_CLASS_DISTANCE), F.lit(CLASS_FLOOR) + F.lit(CLASS_NOISE) / F.sqrt("word_chars"))
    word_limit = F.lit(WORD_FLOOR) + F.lit(WORD_NOISE) / F.sqrt("n_words")
    near = F.coalesce(F.col("class_distance") <= class_limit, F.lit(True)) & F.coalesce(F.col("word_distance") <= word_limit, F.lit(True))
    return x.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (good & near).alias("kept"), "class_distance", "word_distance",
    )
