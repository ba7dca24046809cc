"""Benchmark passages in documents (DataFrame functions only).

Words are lower-cased runs of characters other than \\x20 and \\x09-\\x0D; shingles are five words. A document holds an
item of n words if some window of n of its words has a weighted Jaccard similarity of 0.75 or more with it (a shingle
weighs as often as it occurs). A document shorter than the item is one window.

1. Seeds: a window that similar shares most of the item's shingles, in any order, so only windows of the item's size with
   that many shared shingles can hold it. All of them are looked at, but of a window equal to the item only one.
2. Fingerprints: 64-bit SimHash of each window and item, weighted as above. Of RADIUS + 1 blocks of bits at least one
   is equal in any two fingerprints within RADIUS, so a join on (size, block, value) finds them all.
3. Exact similarity of the shingles decides.

The benchmark is the query set. Its shingles are broadcast if they are measured to be few, else in blocks, one pass over
the documents for each. Texts are known by a 128-bit key, so copies are searched once from step 2 on.
An item of fewer than five words is one shingle, its whole sequence: a document holds it where the same words stand in a row.
Items without words are in no document. Items of the same words share their result. Null and empty documents hold nothing. At similarity 0.75 fingerprints differ in 11 of 64 bits on average with
a deviation of 3, so RADIUS 23 is four deviations away; equal passages have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, Store, fresh, join_small, text_key, words

SHINGLE = 5
SIMILAR = (75, 100)
BITS, RADIUS = 64, 23


def _with_shingles(df: DataFrame) -> DataFrame:
    """Adds the words and the hashes of the five-word shingles in order; none for fewer words.

    The hashes must not be filtered on: a filter would move below and split the text again for each word.
    """
    df = df.withColumn("tokens", words(F.lower("text")))
    last = F.size("tokens") - SHINGLE + 1
    at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.expr("cast(array() as array<int>)"))
    return df.withColumn("hashes", F.transform(at, lambda i: F.xxhash64(F.slice("tokens", i, SHINGLE))))


def simhash(hashes: Column) -> Column:
    """A bit is set if more of the hashes have it than not."""
    set_bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.aggregate(
        hashes, F.lit(0), lambda a, h: a + F.call_function("getbit", h, b).cast("int") * 2 - 1))
    return F.aggregate(F.transform(set_bits, lambda v, b: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))),
                       F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _blocks(fingerprint: Column) -> Column:
    """(number, value) of each block of bits."""
    count = RADIUS + 1
    edges = [BITS * i // count for i in range(count + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("value"))
                     for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def common_weight(a: Column, b: Column) -> Column:
    """Sum over shingles of the lesser of their weights in both."""
    def times(x: Column, v: Column) -> Column:
        return F.size(F.filter(x, lambda y: y == v))

    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, v: n + F.least(times(a, v), times(b, v)))


def _items(benchmark: DataFrame) -> DataFrame:
    """item (a key of the words), item_ids, size in words, hashes, fingerprint"""
    d = _with_shingles(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"))
    d = d.groupBy(text_key(F.array_join("tokens", " ")).alias("item")).agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.first("hashes").alias("item_hashes")).where("size(item_hashes) > 0")
    return d.withColumn("size", F.size("item_hashes") + SHINGLE - 1).withColumn("fingerprint", simhash(F.col("item_hashes")))


def _begins(places: Column, total: Column, wanted: Column, least: Column) -> Column:
    """Where windows of `wanted` shingles begin that hold at least `least` of `places` (sorted), each once.

    Such a window holds places j to j + least - 1 for some j, so it begins at place j or before, near enough to reach the
    last of them. Windows that begin at place j - 1 or before and reach it as well were counted with j - 1.
    """
    end = F.greatest(total - wanted, F.lit(0))

    def run(j: Column) -> Column:
        low = F.greatest(F.get(places, j + least - 1) - wanted + 1, F.lit(0), F.coalesce(F.get(places, j - 1) + 1, F.lit(0)))
        high = F.least(F.get(places, j), end)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<int>)"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places) - least), run))


def _windows(docs: DataFrame, items: DataFrame, seeds: DataFrame, store: Store) -> DataFrame:
    """key, size, begin, hashes: the windows to look at for the items of `seeds` (item, size, hash), which is broadcast."""
    texts = docs.select("text", text_key(F.col("text")).alias("key"))
    d = _with_shingles(texts).select("key", "hashes", F.size("hashes").alias("total"))
    d = d.select("key", "total", F.posexplode_outer("hashes").alias("p", "hash")).join(F.broadcast(seeds), "hash")
    met = d.groupBy("key", "item", "size").agg(F.collect_set("p").alias("places"), F.first("total").alias("total"))
    wanted = F.col("size") - SHINGLE + 1
    # The weight in common at the least, of what window and item weigh together.
    least = F.ceil((F.least("total", wanted) + wanted) * SIMILAR[0] / F.lit(sum(SIMILAR))).cast("int")
    met = met.withColumn("least", least).where(F.size("places") >= F.col("least"))
    met = met.withColumn("places", F.array_sort("places"))
    begins = store.put(met.select("key", "item", "size", _begins(F.col("places"), F.col("total"), wanted, F.col("least")).alias("begins"))
                       .where("size(begins) > 0"))
    held = store.put(begins.select("key").distinct())
    once = join_small(texts, held, "key", "left_semi").groupBy("key").agg(F.first("text", ignorenulls=True).alias("text"))
    each = (_with_shingles(once).select("key", "hashes").join(begins, "key")
            .join(items.select("item", "item_hashes"), "item"))
    # Nothing is more similar than an equal window.
    each = each.withColumn("equal", F.filter("begins", lambda b: F.slice("hashes", b + 1, wanted) == F.col("item_hashes")))
    each = each.withColumn("begins", F.when(F.size("equal") > 0, F.slice("equal", 1, 1)).otherwise(F.col("begins")))
    each = each.select("key", "size", "hashes", F.explode("begins").alias("begin"))
    return each.select("key", "size", "begin", F.slice("hashes", F.col("begin") + 1, wanted).alias("hashes")).dropDuplicates(["key", "size", "begin"])


def _holding_short(docs: DataFrame, benchmark: DataFrame, store: Store) -> DataFrame | None:
    """key, item_ids, similarity of texts with the words of an item that is shorter than a shingle; None without such items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.lower("text")).alias("item_words"))
    items = items.where(F.size("item_words").between(1, SHINGLE - 1)).groupBy(F.array_join("item_words", " ").alias("phrase")).agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.first(F.size("item_words")).alias("n"))
    items = store.put(items)
    sizes = [r["n"] for r in items.select("n").distinct().collect()]        # four at most
    if not sizes:
        return None
    texts = docs.select(text_key(F.col("text")).alias("key"), words(F.lower("text")).alias("tokens"))

    def phrases(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size("tokens") - n + 1), lambda i: F.array_join(F.slice("tokens", i, n), " "))
        return F.when(F.size("tokens") >= n, runs).otherwise(F.expr("cast(array() as array<string>)"))

    each = F.explode(F.array_distinct(F.flatten(F.array(*map(phrases, sizes))))).alias("phrase")
    met = join_small(texts.select("key", each), items.drop("n"), "phrase", "inner")
    return met.select("key", "item_ids", F.lit(1.0).alias("similarity"))


def matches(docs: DataFrame, benchmark: DataFrame, store: Store) -> DataFrame:
    """key (of the text), item_ids, similarity: the texts that hold an item. Stored."""
    short = _holding_short(docs, benchmark, store)
    items = store.put(_items(benchmark))
    seeds = store.put(items.select("item", "size", F.explode(F.array_distinct("item_hashes")).alias("hash")))
    parts = max(1, -(-seeds.count() // SMALL_ROWS))
    found = []
    for i in range(parts):
        own = seeds if parts == 1 else seeds.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == i)
        found.append(_windows(docs, items, own, store))
    windows = found[0]
    for more in found[1:]:
        windows = windows.unionByName(more)
    windows = store.put(windows.withColumn("fingerprint", simhash(F.col("hashes"))))

    index = items.select("item", "size", F.col("fingerprint").alias("item_fingerprint"), F.inline(_blocks(F.col("fingerprint"))))
    probes = windows.select("key", "begin", "size", "fingerprint", F.inline(_blocks(F.col("fingerprint"))))
    near = (probes.join(index, ["size", "block", "value"])
            .where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= RADIUS)
            .select("key", "begin", "size", "item").distinct())
    both = (near.join(windows.select("key", "begin", "size", "hashes"), ["key", "begin", "size"])
            .join(items.select("item", "item_ids", "item_hashes"), "item")
            .select("key", "item_ids", common_weight(F.col("hashes"), F.col("item_hashes")).alias("both"),
                    (F.size("hashes") + F.size("item_hashes")).alias("sum")))
    close = both.where(F.col("both") * SIMILAR[1] >= SIMILAR[0] * (F.col("sum") - F.col("both")))
    close = close.select("key", "item_ids", (F.col("both") / (F.col("sum") - F.col("both"))).alias("similarity"))
    return store.put((close if short is None else close.unionByName(short)).groupBy("key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
        F.round(F.max("similarity"), 6).alias("similarity")))


def flag(docs: DataFrame, benchmark: DataFrame, store: Store | None = None) -> DataFrame:
    """doc_id, contaminated, kept, item_ids, similarity (null for none): a row for each document."""
    store = store or Store(docs.sparkSession)
    found = matches(docs, benchmark, store)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"))
    hit = F.col("item_ids").isNotNull()
    return join_small(rows, found, "key").select(
        "doc_id", hit.alias("contaminated"), (~hit).alias("kept"),
        F.coalesce("item_ids", F.expr("cast(array() as array<bigint>)")).alias("item_ids"), "similarity")


def keep_clean(docs: DataFrame, benchmark: DataFrame, store: Store | None = None) -> DataFrame:
    """The rows of `docs` that hold no item, all columns."""
    found = matches(docs, benchmark, store or Store(docs.sparkSession))
    key = fresh(docs, "text_key")
    gone = found.select(F.col("key").alias(key))
    return join_small(docs.withColumn(key, text_key(F.col("text"))), gone, key, "left_anti").select(*docs.columns)
