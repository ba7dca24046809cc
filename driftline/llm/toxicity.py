"""Toxicity grades by cumulative-link (proportional odds) regression on sparse word features.

A document's grade is one of 0..K-1. The model has one weight per feature, shared by all thresholds, and K-1 ordered
thresholds: P(grade > k) = sigmoid(w.x - t_k). The output is the expected grade, the sum of these.

Features: lower-cased words without sentence marks, and the first PREFIX characters of longer ones, which also speak for
forms not seen before. One is a feature if its document frequencies among the labelled documents tell grades apart: at
least SEEN labelled documents have it, and its log-odds between grades above 0 and grade 0, damped by one document on
either side, is at least APART in size; the WORDS strongest (ties by text) are kept. These counts cover all labelled
documents, copies of a text once. A feature is 1 if the document has it. The weights are fitted on at most SAMPLE labelled documents,
those whose doc_id and text hash lowest; only their feature numbers and grades come to the driver. Fitting is full-batch
gradient descent with a quadratic penalty, without random numbers.

Null and empty texts have no features and get the grade that the thresholds give. Labels without a grade or without
a document are left out; with no labelled document of a grade above 0 every expected grade is 0. Repeated rows get
repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Store, join_small, text_key, words

SAMPLE, WORDS, SEEN, APART, PREFIX = 20_000, 4096, 10, 2.0, 4
#: Texts whose keys may be broadcast.
TEXTS = 2_000_000
STEPS, RATE, PENALTY = 600, 0.5, 2e-5
MARKS = ".,;:!?'\"()"


def tokens(text: Column) -> Column:
    """Distinct words of a text, lower-cased, without sentence marks, and `^` with the first characters of longer ones."""
    plain = F.array_distinct(words(F.lower(F.translate(F.coalesce(text, F.lit("")), MARKS, ""))))
    starts = F.transform(F.filter(plain, lambda w: F.length(w) > PREFIX), lambda w: F.concat(F.lit("^"), F.left(w, F.lit(PREFIX))))
    return F.concat(plain, F.array_distinct(starts))


def unique_texts(labelled: DataFrame, store: Store) -> DataFrame:
    """One row of `labelled` (doc_id, text, grade) for each text: that of the least doc_id."""
    keyed = labelled.where("grade IS NOT NULL").withColumn("key", text_key(F.col("text")))
    firsts = store.put(keyed.groupBy(F.col("key").alias("k")).agg(F.min("doc_id").alias("d")))
    return join_small(keyed, firsts, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi", TEXTS).drop("key")


def choose_words(labelled: DataFrame, only_for: bool = False) -> list[str]:
    """The features, from `labelled` (text, grade): at most WORDS; `only_for`, those that speak for grades above 0."""
    n = labelled.agg(F.count(F.when(F.col("grade") == 0, 1)).alias("none"), F.count(F.when(F.col("grade") > 0, 1)).alias("some")).first()
    if not n["some"]:
        return []
    seen = labelled.select("grade", F.explode(tokens(F.col("text"))).alias("word")).groupBy("word").agg(
        F.count(F.when(F.col("grade") == 0, 1)).alias("none"), F.count(F.when(F.col("grade") > 0, 1)).alias("some"))

    def odds(k: str) -> Column:
        return F.log((F.col(k) + 1) / (F.lit(n[k]) - F.col(k) + 1))

    apart = odds("some") - odds("none")
    apart = apart if only_for else F.abs(apart)
    best = seen.where((F.col("none") + F.col("some") >= SEEN) & (apart >= APART)).orderBy(apart.desc(), "word").limit(WORDS)
    return sorted(r["word"] for r in best.select("word").collect())


def graded(labelled: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Grades for labels that only say yes (1) or no (0): a yes is graded by how many features speak for it.

    1, 2 or 3 for a document with up to 2, up to 4, or more of the words of `vocabulary`.
    """
    known = F.array(*[F.lit(w) for w in vocabulary]).cast("array<string>")
    n = F.size(F.array_intersect(tokens(F.col("text")), known))
    return labelled.withColumn("grade", F.when(F.col("grade") == 0, 0).otherwise(F.when(n <= 2, 1).when(n <= 4, 2).otherwise(3)))


def fit(features: list[np.ndarray], grades: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient descent on the mean log loss of all cumulative events."""
    levels = int(grades.max()) if len(grades) else 0
    weights, base, gaps = np.zeros(width), 0.0, np.zeros(max(levels - 1, 0))
    if not levels:
        return weights, np.zeros(0)
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    column = np.concatenate(features).astype(np.int64) if len(row) else np.zeros(0, np.int64)
    above = grades[:, None] > np.arange(levels)
    speed = [np.zeros(width), 0.0, np.zeros_like(gaps)]
    for _ in range(STEPS):
        thresholds = base + np.r_[0.0, np.cumsum(np.exp(gaps))]
        score = np.bincount(row, weights[column], minlength=len(features))
        p = 1 / (1 + np.exp(np.clip(thresholds - score[:, None], -30, 30)))
        error = (p - above) / len(features)
        # Thresholds are a first one and positive gaps, so they stay in order.
        by_level = -error.sum(axis=0)
        later = np.cumsum(by_level[::-1])[::-1]
        slopes = [np.bincount(column, error.sum(axis=1)[row], minlength=width) + PENALTY * weights, by_level.sum(), later[1:] * np.exp(gaps)]
        new = []
        for i, (x, g) in enumerate(zip((weights, base, gaps), slopes)):
            speed[i] = speed[i] + g * g
            new.append(x - RATE * g / (np.sqrt(speed[i]) + 1e-12))
        weights, base, gaps = new
    return weights, base + np.r_[0.0, np.cumsum(np.exp(gaps))]


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Features, weights and thresholds from `labelled` (doc_id, text, grade), best of unique texts."""
    vocabulary = choose_words(labelled)
    if not vocabulary:
        return [], np.zeros(0), np.zeros(0)
    known = F.array(*[F.lit(w) for w in vocabulary])
    order = F.xxhash64("doc_id", "text")        # ties are rows of the same content
    found = labelled.select("grade", order.alias("order"), F.array_intersect(tokens(F.col("text")), known).alias("found"))
    sample = found.orderBy("order").limit(SAMPLE).toPandas()
    place = {w: i for i, w in enumerate(vocabulary)}
    features = [np.array([place[w] for w in f], dtype=np.int64) for f in sample["found"]]
    weights, thresholds = fit(features, sample["grade"].to_numpy(), len(vocabulary))
    return vocabulary, weights, thresholds


def score(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, severity (the expected grade), grade (the likeliest one by its cumulative probabilities): a row for each document."""
    vocabulary, weights, thresholds = model
    shared = docs.sparkSession.sparkContext.broadcast((dict(zip(vocabulary, weights.tolist())), thresholds))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, bounds = shared.value
        drop, split = str.maketrans("", "", MARKS), re.compile(SPACE).split
        for batch in batches:
            totals = []
            for t in batch["text"]:
                found = set(split((t or "").translate(drop).lower()))
                found |= {"^" + w[:PREFIX] for w in found if len(w) > PREFIX}
                totals.append(sum([weight[w] for w in found if w in weight]))
            p = 1 / (1 + np.exp(np.clip(bounds - np.array(totals)[:, None], -30, 30)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "severity": p.sum(axis=1).round(6), "grade": (p > 0.5).sum(axis=1)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, severity double, grade int")
