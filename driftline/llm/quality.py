"""Quality by hierarchical empirical Bayes: evidence of the document itself, on the prior of the site it comes from.

1. Evidence: ten ratios of a text (capitals, symbols, repeated words and lines, ...) are put into bins. The labelled
   documents give each bin's log-likelihood ratio of bad against good, damped by half a document; a document's evidence is the sum
   of its bins.
2. Sites: every document, labelled or not, counts as bad with the probability that its evidence gives under the global rate
   (a labelled one with its label). Grouped sums give each host's and each path's rate, shrunk through beta-binomial
   priors: host toward the global rate, path toward its host. A prior's strength comes from how much the rates below it
   differ beyond chance, so sparse sites stay near their prior.
3. A document's posterior odds are its evidence on the odds of its path's rate. From REJECT on it is rejected.

Null and empty texts have a bin of their own in every ratio. A null host or path is a site of its own. A doc_id with several
labels is bad if one of them says so; labels without a document or without a value are left out. Without bad or without good
labels there is no evidence and nothing is rejected. Repeated rows get the same posterior.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store, fresh, join_small, text_key

REJECT = 0.9
LEAST, MOST = 2.0, 200.0
#: Rows of labels, sites or rejected documents that may be broadcast.
ROWS = 2_000_000
#: Sites, with names of any length, that may be broadcast.
SITES = 200_000
EDGES = (0.001, 0.003, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9)
LENGTHS = (3, 6, 10, 20, 50, 100, 200, 400, 800, 1600, 5000)
WIDTHS = (2, 3, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 15)
RATIOS = 10

_CLASS = np.zeros(256, np.uint8)
for _i, _members in enumerate((range(65, 91), range(97, 123), b"#*$%&<>~^\\", b"!?", b"|", range(48, 58), b" \t\n\x0b\x0c\r"), 1):
    _CLASS[list(_members)] = _i


def bins(text: str | None) -> list[int]:
    """The bin of each ratio; 0 in all of them for a text without words."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        return [0] * RATIOS
    other, upper, lower, symbol, bang, pipe, digit, space = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8).tolist()
    n, size = len(words), len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ratios = (upper / max(1, upper + lower), symbol / size, bang / size, pipe / n, digit / size,
              1 - len(set(words)) / n, sum(map(operator.eq, words, words[1:])) / n, 1 - len(set(lines)) / len(lines))
    place = [1 + int(np.searchsorted(EDGES, r, side="right")) for r in ratios]
    return [*place, 1 + int(np.searchsorted(LENGTHS, n, side="right")), 1 + int(np.searchsorted(WIDTHS, (size - space) / n, side="right"))]


def _binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([bins(t.as_py()) for t in batch["text"]], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("doc_id", "key", "host", "path")], found], names=["doc_id", "key", "host", "path", "bins"])


def _chance(odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))


def _odds(rate: Column) -> Column:
    return F.log(rate / (1 - rate))


def _shrunk(children: DataFrame, key: list[str]) -> DataFrame:
    """`children` (n, bad, the parent's rate as `prior`, and its name, `key`) with `rate`, their posterior mean."""
    moments = children.groupBy(*key, "prior").agg(
        F.sum("n").alias("all"), F.count("*").alias("k"), F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), F.lit(2))).alias("spread"))
    chance = F.col("prior") * (1 - F.col("prior"))
    between = F.col("spread") / F.col("all") - chance * F.col("k") / F.col("all")
    strength = F.when(between > 0, F.least(F.lit(MOST), F.greatest(F.lit(LEAST), chance / between - 1))).otherwise(F.lit(MOST))
    known = moments.select(*key, "prior", strength.alias("strength"))
    if key:
        children = children.join(known.drop("prior"), key)
    else:
        only = known.first()
        children = children.withColumn("strength", F.lit(only["strength"] if only else MOST))
    return children.withColumn("rate", (F.col("bad") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength")))


def posteriors(docs: DataFrame, labels: DataFrame, store: Store, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, key, evidence, host_rate, path_rate, posterior, kept: a row for each of `docs`.

    `host` and `path` name the columns that say where a document comes from. `labels` has doc_id and quality, 1 good or 0 bad.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text",
                       F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"))
    marks = store.put(labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("label")))
    found = rows.mapInArrow(_binned, "doc_id long, key binary, host string, path string, bins array<int>")
    d = store.put(join_small(found, marks, "doc_id", most=ROWS))

    # At most RATIOS x 14 cells, whatever the number of documents.
    cells = (d.where("label IS NOT NULL").select("label", F.posexplode("bins").alias("ratio", "bin"))
             .groupBy("ratio", "bin").agg(F.count(F.when(F.col("label") == 1, 1)).alias("bad"), F.count(F.when(F.col("label") == 0, 1)).alias("good")).collect())
    all_bad, all_good = (sum(c[k] for c in cells if c["ratio"] == 0) for k in ("bad", "good"))
    width = max(len(EDGES), len(LENGTHS), len(WIDTHS)) + 2
    table = np.zeros((RATIOS, width))
    if all_bad and all_good:
        for c in cells:
            table[c["ratio"], c["bin"]] = np.log((c["bad"] + 0.5) / (all_bad + 1) / ((c["good"] + 0.5) / (all_good + 1)))
    rate = (all_bad + 0.5) / (all_bad + all_good + 1) if all_bad and all_good else 1e-6
    ratio = F.array(*[F.array(*[F.lit(float(x)) for x in line]) for line in table])
    evidence = F.aggregate(F.zip_with("bins", ratio, lambda b, line: F.get(line, b)), F.lit(0.0), lambda a, x: a + x)
    d = d.withColumn("evidence", evidence)

    bad = F.coalesce(F.col("label").cast("double"), _chance(F.col("evidence") + _odds(F.lit(rate))))
    paths = store.put(d.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(bad).alias("bad")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")).first()
    hosts = hosts.withColumn("prior", F.lit((total["bad"] + 0.5) / (total["n"] + 1)))
    hosts = _shrunk(hosts, []).select("host", F.col("rate").alias("prior"))
    sites = store.put(_shrunk(paths.join(hosts, "host"), ["host"]).select("host", "path", F.col("prior").alias("host_rate"), F.col("rate").alias("path_rate")))
    d = join_small(d, sites, ["host", "path"], most=SITES)
    d = d.withColumn("posterior", _chance(F.col("evidence") + _odds(F.col("path_rate"))))
    return d.select("doc_id", "key", *[F.round(c, 6).alias(c) for c in ("evidence", "host_rate", "path_rate", "posterior")],
                    (F.col("posterior") < REJECT).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, store: Store | None = None, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of `docs` that are not rejected, all columns."""
    store = store or Store(docs.sparkSession)
    key, gone_id, gone_key = (fresh(docs, c) for c in ("text_key", "gone_id", "gone_key"))
    out = store.put(posteriors(docs, labels, store, host, path).where(~F.col("kept")).select(
        F.col("doc_id").alias(gone_id), F.col("key").alias(gone_key)).distinct())
    same = (F.col(key) == F.col(gone_key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id))
    return join_small(docs.withColumn(key, text_key(F.col("text"))), out, same, "left_anti", ROWS).select(*docs.columns)
