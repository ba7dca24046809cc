"""From raw documents to token ids: reject bad quality, keep one of each near-duplicate group, drop documents that hold
benchmark passages, remove secrets from texts, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns
of documents. What each does with nulls, empty texts, ties and repeated rows is stated in its operator's module.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftline.llm import bpe, decontaminate, minhash, quality, secrets
from driftline.llm.common import Store, read

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def reject_bad_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", reject_bad_quality),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scan", remove_secrets),
    ("byte-level BPE", encode),
]

#: A trained classifier, signatures and merges are not expressible in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip: a row for each document that is left."""
    store = Store(spark)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
