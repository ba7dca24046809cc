"""Registered queries of the operators, and the SQL they are checked against where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, decontaminate, minhash, mixing, quality, rules, secrets, sql, substring, toxicity, trie, urls, wrapper
from .common import Store, join_small, read

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


@query("op1_quality")
def quality_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.posteriors(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), Store(spark)).drop("key")


@query("op2_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                public_tokenizers.PATTERN, digests=True)


#: Rows of two numbers that may be broadcast.
LABELS = 2_000_000
#: Expected grade from which a document counts as toxic.
TOXIC = 0.3


@query("op3_toxicity")
def ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    marks = read(spark, sf_dir, "labels").where("toxic IS NOT NULL").select("doc_id", F.col("toxic").alias("grade"))
    labelled = toxicity.unique_texts(join_small(docs, marks, "doc_id", "inner", LABELS), Store(spark))
    labelled = toxicity.graded(labelled, toxicity.choose_words(labelled, only_for=True))
    scored = toxicity.score(docs, toxicity.train(labelled))
    return scored.withColumn("toxic", F.col("severity") >= TOXIC)


@query("op4_wrapper")
def wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(read(spark, sf_dir, "pages"))


@query("op5_divergence", sql.DIVERGENCE)
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents"))


#: Fixed values of the contract: action, host and path.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

URL_SQL = f"""
WITH urls AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '\\A([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host,
         regexp_extract(rest, '\\A[^/?#]*([^?#]*)', 1) AS path FROM urls),
seen AS (
  SELECT host, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad
  FROM p JOIN labels ON try_cast(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1) AS BIGINT) = doc_id
  WHERE quality IS NOT NULL AND toxic IS NOT NULL),
h AS (
  SELECT host, sum(pages) AS pages, sum(bad) AS bad, split_part(host, '.', -1) AS suffix,
         CASE WHEN strpos(host, '.') > 0 THEN split_part(host, '.', -2) || '.' || split_part(host, '.', -1) ELSE host END AS domain
  FROM (SELECT host, 0 AS pages, 0 AS bad FROM p UNION ALL SELECT host, 1, bad FROM seen) GROUP BY host),
d AS (SELECT domain, suffix, sum(pages) AS pages, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(pages) AS pages, sum(bad) AS bad FROM d GROUP BY suffix),
levels AS (
  SELECT 0 AS level, '' AS name, pages, bad FROM s UNION ALL SELECT 1, suffix, pages, bad FROM d UNION ALL SELECT 2, domain, pages, bad FROM h),
sums AS (
  SELECT level, name, sum(pages) AS pages, sum(bad) AS bad, count(CASE WHEN pages > 0 THEN 1 END) AS children,
         sum(CASE WHEN pages > 0 THEN bad * bad / pages ELSE 0 END) AS squares, (sum(bad) + 0.5::DOUBLE) / (sum(pages) + 1) AS rate
  FROM levels GROUP BY level, name),
between_ AS (
  SELECT *, CASE WHEN pages > 0 THEN (squares - 2 * rate * bad + rate * rate * pages) / pages - rate * (1 - rate) * children / pages ELSE 0 END AS v FROM sums),
prior AS (
  SELECT level, name, rate, CASE WHEN pages > 0 AND v > 0 THEN least({urls.MOST}::DOUBLE, greatest({urls.LEAST}::DOUBLE, rate * (1 - rate) / v - 1)) ELSE {urls.MOST}::DOUBLE END AS n FROM between_),
s2 AS (SELECT s.suffix, (s.bad + a.n * a.rate) / (s.pages + a.n) AS m FROM s JOIN prior a ON a.level = 0),
d2 AS (SELECT d.domain, (d.bad + a.n * s2.m) / (d.pages + a.n) AS m FROM d JOIN s2 USING (suffix) JOIN prior a ON a.level = 1 AND a.name = d.suffix),
h2 AS (SELECT h.host, h.pages, a.n, (h.bad + a.n * d2.m) / (h.pages + a.n) AS rate FROM h JOIN d2 USING (domain) JOIN prior a ON a.level = 2 AND a.name = h.domain),
h3 AS (SELECT host, rate, rate - {urls.Z} * sqrt(rate * (1 - rate) / (pages + n + 1)) AS bound FROM h2),
r(action, rule) AS (VALUES {", ".join(f"('{a}', '{r}')" for a, r in URL_RULES)}),
fit AS (
  SELECT page_id, host, path, max({{'size': length(rule), 'rule': rule, 'action': action}}) AS f FROM p JOIN r
  ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY ALL)
SELECT p.page_id, p.host, p.path, f.rule AS rule, coalesce(f.action, CASE WHEN bound > {urls.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       round(rate, 6) AS rate, round(bound, 6) AS bound
FROM p JOIN h3 USING (host) LEFT JOIN fit ON p.page_id = fit.page_id AND p.host = fit.host AND p.path = fit.path
"""


@query("op6_url_reputation", URL_SQL)
def url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = read(spark, sf_dir, "pages").select("page_id", "url"), read(spark, sf_dir, "labels")
    # A page shows the document whose number its path ends in; the document's labels are the page's outcome.
    number = F.expr("try_cast(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1) AS bigint)")
    shown = pages.select("url", urls.parsed(F.col("url"))[1].alias("path")).select("url", number.alias("doc_id"))
    outcomes = shown.join(labels, "doc_id").where("quality IS NOT NULL AND toxic IS NOT NULL").select(
        "url", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return urls.judge(pages, outcomes, URL_RULES)


@query("op7_secrets")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


@query("op8_superminhash", sql.NEAR_DUPLICATES)
def superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op9_decontaminate")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.flag(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op10_substring", sql.REPEATED)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op11_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents"))


@query("op12_trie", sql.TRIE)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(read(spark, sf_dir, "conversations"))


@query("op13_alignment")
def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
