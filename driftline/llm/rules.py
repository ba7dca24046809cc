"""Quality rules: how far a document's histograms are from those of its language (DataFrame functions only).

Base figures per document: words are runs of characters other than \\x20 and \\x09-\\x0D. `n_repeat_words` counts the words
in five-word windows that occur twice or more in the document, the first time included. `base_failed` is
n_words < 10 or 100 * n_repeat_words > 20 * n_words.

Method: two histograms for each document and each language,
* classes of its characters: capitals, digits, sentence marks, symbols, white space, and all others;
* its common words, unchanged, and one cell for all other words. Common words of a language make up at least COMMON of
  its words each, so there are at most 1 / COMMON of them.
A language's reference is summed over all its documents. The distance is the square root of the Jensen-Shannon
divergence to base 2, between 0 and 1. A document fails if its class distance exceeds CLASS_LIMIT or its word distance
WORD_LIMIT; the distances count from CLASS_LEAST characters and WORD_LEAST words on, because short texts stray by
chance. Documents without a language form a language of their own.

Null and empty texts have no words and fail the base rules. Repeated rows give repeated results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, join_small, words

COMMON = 0.005
CLASS_LIMIT, CLASS_LEAST = 0.25, 400
WORD_LIMIT, WORD_LEAST = 0.28, 120
SHINGLE = 5
SYMBOLS = "[^#*$%&|<>]+"
#: What is taken out to count the characters of a class: capitals, digits, sentence marks.
CLASSES = (r"[^\p{Lu}]+", "[^0-9]+", r"[^.,;:!?'\"()\-]+")
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Languages whose references may be broadcast; a reference has at most 1 / COMMON words.
LANGUAGES = 2000


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"),
                       F.coalesce("text", F.lit("")).alias("body"))


def _with_rest(parts: Column, total: Column) -> Column:
    return F.concat(parts, F.array(total - F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts with the same cells; 0 if either is empty."""
    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))

    def part(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    n, m = total(p), total(q)
    terms = F.zip_with(p, q, lambda x, y: part(x / n, y / m) + part(y / m, x / n))
    return F.when((n > 0) & (m > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))).otherwise(F.lit(0.0))


def common_words(docs: DataFrame) -> DataFrame:
    """A row for each language: lang, common (its common words), ref_words (their counts, then that of all others)."""
    each = _texts(docs).select("lang", F.explode_outer(words(F.col("body"))).alias("word"))
    counts = each.groupBy("lang", "word").agg(F.count("word").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all_words"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    # No filter on words here: it would move below one use of the counts, and the texts would be read twice.
    frequent = counts.withColumn("rank", rank).where(F.col("rank") <= math.ceil(1 / COMMON))
    common = (frequent.join(totals, "lang").where((F.col("n") >= COMMON * F.col("all_words")) & (F.col("n") > 0))
              .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("cells")))
    return totals.join(common, "lang", "left").select(
        "lang", F.coalesce(F.col("cells.word"), F.expr("cast(array() as array<string>)")).alias("common"),
        _with_rest(F.coalesce(F.col("cells.n"), F.expr("cast(array() as array<bigint>)")), F.col("all_words")).alias("ref_words"))


def _neighbours(name: str) -> Column:
    """Those of the sorted pairs (w, i) in a column whose w stands beside them once more."""
    def equal(x: Column, at: Column) -> Column:
        return F.coalesce(F.get(name, at)["w"] == x["w"], F.lit(False))

    return F.filter(name, lambda x, at: equal(x, at - 1) | equal(x, at + 1))


def base_figures(d: DataFrame, *keep: str) -> DataFrame:
    """The base figures of rows with `body` (the text, never null) and `words`, beside the columns `keep`."""
    last = F.size("words") - SHINGLE + 1
    d = d.withColumn("at", F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.expr("cast(array() as array<int>)")))
    # Hashes tell the many texts without a repeated window from the rest. There, only windows whose hash equals another's
    # are compared themselves: sorted, a repeated one equals a neighbour; their starts in order give the words that they cover.
    room = F.greatest(last, F.lit(0))
    d = d.withColumn("ones", F.transform("words", lambda w: F.xxhash64(w)))
    d = d.withColumn("twos", F.zip_with(F.slice("ones", 1, room + 2), F.slice("ones", 2, room + 2), lambda x, y: F.xxhash64(x, y)))
    d = d.withColumn("fours", F.zip_with(F.slice("twos", 1, room), F.slice("twos", 3, room), lambda x, y: F.xxhash64(x, y)))
    d = d.withColumn("fives", F.zip_with("fours", F.slice("ones", 5, room), lambda x, y: F.xxhash64(x, y)))
    d = d.withColumn("again", F.size(F.array_distinct("fives")) < F.size("fives"))
    d = d.withColumn("hashed", F.when(F.col("again"), F.sort_array(F.arrays_zip(F.col("fives").alias("w"), F.col("at").alias("i")))))
    d = d.withColumn("ordered", F.sort_array(F.transform(_neighbours("hashed"), lambda x: F.struct(
        F.array_join(F.slice("words", x["i"], SHINGLE), " ").alias("w"), x["i"].alias("i")))))
    starts = F.sort_array(_neighbours("ordered")["i"])
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-SHINGLE).alias("last")), lambda a, i: F.struct(
        (a["n"] + F.least(F.lit(SHINGLE), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    d = d.withColumn("lines", F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select(
        *keep, "body", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("body", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def judge(docs: DataFrame, store: Store | None = None) -> DataFrame:
    """doc_id, the base figures, base_failed, class_distance, word_distance, kept: a row for each document."""
    store = store or Store(docs.sparkSession)
    frequent = store.put(common_words(docs))
    d = _texts(docs).withColumn("words", words(F.col("body")))
    d = join_small(base_figures(d, "doc_id", "lang"), frequent, "lang", most=LANGUAGES)
    # Common words are short: the length rules out most others.
    d = d.withColumn("longest", F.coalesce(F.array_max(F.transform("common", F.octet_length)), F.lit(0)))
    d = d.withColumn("hits", F.concat(F.lit(" "), F.array_join(F.filter(
        "words", lambda w: (F.octet_length(w) <= F.col("longest")) & F.array_contains("common", w)), "  "), F.lit(" ")))
    counts = F.transform("common", lambda w: F.floor(
        (F.length("hits") - F.length(F.replace(F.col("hits"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.length(w) + 2)).cast("long"))
    size = F.length("body").cast("long")
    classes = F.array(*[F.length(F.regexp_replace("body", p, "")).cast("long") for p in CLASSES], F.col("n_symbols"), size - F.col("word_chars"))
    d = d.withColumn("classes", classes).select(
        "doc_id", "lang", *FIGURES, "base_failed", size.alias("size"), _with_rest(F.col("classes"), size).alias("classes"),
        "ref_words", _with_rest(counts, F.col("n_words")).alias("word_cells"))
    d = d.withColumn("word_distance", F.when(F.col("n_words") >= WORD_LEAST, distance(F.col("word_cells"), F.col("ref_words"))).otherwise(0.0))
    rows = store.put(d.drop("ref_words", "word_cells"))

    sums = F.array(*[F.sum(F.get("classes", i)) for i in range(len(CLASSES) + 3)])
    refs = store.put(rows.groupBy("lang").agg(sums.alias("ref_classes")))
    d = join_small(rows, refs, "lang", most=LANGUAGES)
    d = d.withColumn("class_distance", F.when(F.col("size") >= CLASS_LEAST, distance(F.col("classes"), F.col("ref_classes"))).otherwise(0.0))
    fine = (F.col("class_distance") <= CLASS_LIMIT) & (F.col("word_distance") <= WORD_LIMIT)
    return d.select("doc_id", *FIGURES, "base_failed", F.round("class_distance", 6).alias("class_distance"),
                    F.round("word_distance", 6).alias("word_distance"), (~F.col("base_failed") & fine).alias("kept"))
