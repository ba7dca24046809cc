"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree, with built-in functions only.

1. `targets`: sources in code point order, null last, weigh 1, 2, 3, 1, ...; they share the words of all documents by
   weight, none beyond TIMES times its own words, the excess going to the others by weight until none is above.
2. The documents of a source, in the order of a hash, are a line of words (`lines`). Its target, rounded to whole words,
   is that line read from the start, again from the start at its end, and cut into blocks of BLOCK_WORDS words, the last
   one shorter: so many blocks are the source's quota.
3. `shard_quotas`: a node of the tree is a range of output shards with a block quota for each source. Its left half gets a
   multivariate hypergeometric draw of as many blocks as its shards hold, the right half what is left, until nodes are
   single shards. The draw goes through the sources one by one, each a hypergeometric draw by inversion of a hash. So each
   shard is a random sample of the mix, and the shards together have exactly the quotas.
4. `mix`: the blocks of a source are dealt to the shards' quotas by an affine permutation, each block once, and stand in
   their shard in the order of a hash. A block is the pieces of documents in it: first and last word.

The words taken from a source are its target rounded, exactly. A document whose part of the line is passed by the last
read's end is cut there, so no document is taken more than TIMES times over. All draws are hashes of SEED: reruns agree.

A null text has no words; a document without words is in no piece. Repeated and null doc_ids are documents of their own:
a document is known by its place in its source's line, and equal rows are interchangeable. Extra columns are ignored. An
empty table gives empty results. The line is numbered in two levels, buckets of hashes and rows inside a bucket, so a
source with most of the rows is many tasks. A node's row holds GROUP sources; more are several rows of the same node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Store, join_small, words

TIMES = 3
WEIGHTS = 3
SEED = 11
BLOCK_WORDS = 512
SHARD_BLOCKS = 8192
#: Documents of a bucket of a line, about.
BUCKET = 4096
#: Sources of a row of a node.
GROUP = 512
#: Steps from the middle at which a draw's weights are left out: standard deviations, and a number on top.
TAIL, TAIL_MORE = 12, 16
#: Factors of the affine permutation: primes, the second one for numbers of blocks that the first one divides.
PRIMES = (15485863, 15485867)


def named(column: Column, fn) -> Column:
    """fn(value), with the value worked out once though fn uses it several times."""
    return F.transform(F.array(column), fn)[0]


# -- sources and targets ----------------------------------------------------

def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, and the hash that orders a source's line."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.size(words(F.col("text"))).cast("long").alias("size"),
                       F.xxhash64(F.lit(SEED), "doc_id", text).alias("h"))


def numbered(sources: DataFrame, store: Store) -> DataFrame:
    """`sources` with their rank (from 0) in code point order, null last: ranges of sources, then places in a range."""
    order = F.col("source").asc_nulls_last()
    parts = store.put(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    before = parts.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return parts.join(F.broadcast(before), "part").select(
        *sources.columns, (F.col("ahead") + inside - 1).alias("source_no"))       # a row for each range of the shuffle


def targets(docs: DataFrame, store: Store) -> DataFrame:
    """source, source_no, weight, docs, source_size, target, quota_words of each source; a stored table. `docs` from `sized`."""
    sums = docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    table = store.put(numbered(sums, store).withColumn("weight", F.pmod("source_no", F.lit(WEIGHTS)) + 1))
    cap = F.col("source_size") * TIMES
    total, weights = table.agg(F.sum("source_size"), F.sum("weight")).first()
    share = (total or 0) / (weights or 1)
    while True:
        above = F.col("weight") * F.lit(share) > cap
        held, free = table.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        new = (total - (held or 0)) / free if free else share
        if new == share:
            break
        share = new
    target = F.least(F.col("weight") * F.lit(share), cap.cast("double"))
    return store.put(table.withColumn("target", target).withColumn("quota_words", F.floor(F.col("target") + 0.5).cast("long")))


def lines(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with words: source_no, doc_id, size, and `start`, the words before it in its source's line."""
    buckets = sources.select("source", "source_no", F.ceil(F.col("docs") / BUCKET).alias("buckets"))
    rows = docs.where("size > 0").withColumn("_null", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    buckets = buckets.withColumn("_null", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    # The bucket comes from the upper bits, the order inside it from the whole hash.
    rows = join_small(rows, buckets, ["source", "_null"], "inner").withColumn("bucket", F.pmod(F.shiftright("h", 20), F.col("buckets")))
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("ahead"))
    earlier = Window.partitionBy("source_no", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(sums, ["source_no", "bucket"]).select(
        "source_no", "doc_id", "size", (F.col("ahead") + F.coalesce(F.sum("size").over(earlier), F.lit(0))).alias("start"))


# -- the splitting tree -----------------------------------------------------

def uniform(*parts) -> Column:
    """A number between 0 and 1, a hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11).cast("double") + 0.5) * F.lit(2.0 ** -53)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` items out of `total` are among the `marked`: inversion of u, from the mode up, then down.

    Weights are relative to the mode's. Beyond TAIL standard deviations they are below double precision and left out.
    """
    one = F.lit(1.0)

    def up(k):          # weight of k + 1 over that of k
        return one * (marked - k) * (drawn - k) / (one * (k + 1) * (total - marked - drawn + k + 1))

    def down(k):        # weight of k - 1 over that of k
        return one * k * (total - marked - drawn + k) / (one * (marked - k + 1) * (drawn - k + 1))

    def walked(mode, steps, ratio, sign, goal):
        """Weights beyond the mode added up: (sum, last k needed to reach the goal)."""
        start = F.struct(one.alias("w"), F.lit(0.0).alias("sum"), mode.alias("k"), F.lit(False).alias("hit"))

        def step(s, i):
            w = s["w"] * ratio(mode + (i - 1) * sign)
            total_ = s["sum"] + w
            return F.struct(w.alias("w"), total_.alias("sum"), F.when(s["hit"], s["k"]).otherwise(mode + i * sign).alias("k"),
                            (s["hit"] | (total_ >= goal)).alias("hit"))

        path = F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(path, start, step)

    low = F.greatest(F.lit(0).cast("long"), drawn - (total - marked))
    high = F.least(drawn, marked)
    middle = F.floor((drawn + 1) * one * (marked + 1) / (total + 2)).cast("long")
    spread = F.sqrt(drawn * one * marked / total * (total - marked) / total * (total - drawn) / F.greatest(total - 1, F.lit(1)))
    reach = F.ceil(spread * TAIL).cast("long") + TAIL_MORE

    def draw(mode):
        def chosen(sums):
            above = walked(mode, F.least(high - mode, reach), up, 1, sums["goal"] - 1)
            below = walked(mode, F.least(mode - low, reach), down, -1, sums["goal"] - 1 - sums["above"])
            return (F.when(sums["goal"] <= 1, mode).when(sums["goal"] <= 1 + sums["above"], above["k"]).otherwise(below["k"]))

        above = walked(mode, F.least(high - mode, reach), up, 1, F.lit(float("inf")))["sum"]
        below = walked(mode, F.least(mode - low, reach), down, -1, F.lit(float("inf")))["sum"]
        both = named(F.struct(above.alias("above"), below.alias("below")),
                     lambda s: F.struct(s["above"].alias("above"), (u * (1 + s["above"] + s["below"])).alias("goal")))
        return named(both, chosen)

    return F.when(low == high, low).otherwise(named(F.greatest(low, F.least(high, middle)), draw))


def drawn_parts(counts: Column, drawn: Column, *parts) -> Column:
    """Multivariate hypergeometric: how many of `drawn` items come from each of `counts`, one after the other."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    start = F.struct(total.alias("total"), drawn.cast("long").alias("drawn"), F.array().cast("array<bigint>").alias("out"))

    def take(s, count):
        u = uniform(*parts, F.size(s["out"]))
        return named(hypergeometric(s["total"], count, s["drawn"], u),
                     lambda k: F.struct((s["total"] - count).alias("total"), (s["drawn"] - k).alias("drawn"),
                                        F.concat(s["out"], F.array(k)).alias("out")))

    return F.aggregate(counts, start, take, lambda s: s["out"])


def shard_quotas(quotas: DataFrame, store: Store, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(shard, source_no, blocks) of every shard and source with blocks in it; `quotas` has source_no and blocks."""
    total = quotas.agg(F.sum("blocks")).first()[0] or 0
    shards = max(1, -(-total // shard_blocks))
    grouped = quotas.groupBy(F.floor(F.col("source_no") / GROUP).alias("grp")).agg(
        F.array_sort(F.collect_list(F.struct("source_no", "blocks"))).alias("rows"))
    nodes = store.put(grouped.select(F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("behind"), "grp",
                                     F.col("rows.source_no").alias("source_nos"), F.col("rows.blocks").alias("counts")))
    share, rest = divmod(total, shards)

    def blocks_before(shard):       # the shards' sizes differ by one block at most
        return shard * share + F.least(shard, F.lit(rest))

    widest = shards
    while widest > 1:
        node = nodes.where("behind - first > 1").withColumn("middle", F.floor((F.col("first") + F.col("behind") + 1) / 2))
        left = blocks_before(F.col("middle")) - blocks_before(F.col("first"))
        one = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
        tops = node.groupBy("first", "middle").agg(F.array_sort(F.collect_list(F.struct("grp", one.alias("n")))).alias("tops"))
        tops = tops.select("first", "middle", F.arrays_zip(
            F.col("tops.grp").alias("grp"), drawn_parts(F.col("tops.n"), left, F.lit(-1), "first", "middle").alias("n")).alias("tops"))
        tops = tops.select("first", F.explode("tops").alias("t")).select("first", "t.grp", F.col("t.n").alias("to_left"))
        split = node.join(tops, ["first", "grp"]).withColumn("lefts", drawn_parts(F.col("counts"), F.col("to_left"), "grp", "first", "middle"))
        children = F.explode(F.array(
            F.struct("first", F.col("middle").alias("behind"), F.col("lefts").alias("counts")),
            F.struct(F.col("middle").alias("first"), "behind", F.zip_with("counts", "lefts", lambda a, b: a - b).alias("counts"))))
        halves = split.select("grp", "source_nos", children.alias("c")).select("c.first", "c.behind", "grp", "source_nos", "c.counts")
        new = store.put(halves.unionByName(nodes.where("behind - first = 1")))
        store.drop(nodes)
        nodes, widest = new, -(-widest // 2)
    each = nodes.select(F.col("first").alias("shard"), F.explode(F.arrays_zip(F.col("source_nos"), F.col("counts"))).alias("q"))
    return each.select("shard", F.col("q.source_nos").alias("source_no"), F.col("q.counts").alias("blocks")).where("blocks > 0")


# -- the mix ----------------------------------------------------------------

def plan_shards(sources: DataFrame, store: Store, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(source_no, block, shard, place) of every block of the mix; `sources` from `targets`."""
    quotas = sources.select("source_no", F.ceil(F.col("quota_words") / block_words).cast("long").alias("n")).where("n > 0")
    dealt = store.put(shard_quotas(quotas.withColumnRenamed("n", "blocks"), store, shard_blocks))
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    slots = dealt.withColumn("ahead", F.coalesce(F.sum("blocks").over(before), F.lit(0))).select(
        "source_no", "shard", F.explode(F.expr("sequence(ahead, ahead + blocks - 1)")).alias("slot"))
    slots = join_small(slots, quotas, "source_no", "inner")
    # Slot s holds block (prime * s + shift) modulo n: prime and n have no common factor, so each block comes once.
    prime = F.when(F.col("n") % PRIMES[0] != 0, F.lit(PRIMES[0])).otherwise(F.lit(PRIMES[1])).cast("long")
    block = F.pmod(F.pmod(prime, F.col("n")) * F.col("slot") + F.pmod(F.xxhash64(F.lit(SEED), "source_no"), F.col("n")), F.col("n"))
    blocks = slots.select("source_no", "shard", block.alias("block"))
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED), "source_no", "block"), "source_no", "block")
    return blocks.withColumn("place", F.row_number().over(order) - 1)


def pieces(line: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """source_no, block, doc_id, start, and words `first` to `last` (from 0, inclusive) of every part of a document in a block."""
    facts = sources.select("source_no", "source_size", "quota_words").where("quota_words > 0")
    rows = join_small(line, facts, "source_no", "inner").where("start < quota_words")
    rows = rows.withColumn("again", F.explode(F.expr("sequence(0L, (quota_words - 1 - start) div source_size)")))
    rows = rows.withColumn("at", F.col("again") * F.col("source_size") + F.col("start"))
    rows = rows.withColumn("end", F.least(F.col("at") + F.col("size"), F.col("quota_words")))
    rows = rows.withColumn("block", F.explode(F.expr(f"sequence(at div {block_words}, (end - 1) div {block_words})")))
    first = F.greatest(F.col("at"), F.col("block") * block_words) - F.col("at")
    last = F.least(F.col("end"), (F.col("block") + 1) * block_words) - F.col("at") - 1
    return rows.select("source_no", "block", "doc_id", "start", first.alias("first"), last.alias("last"))


def mix(docs: DataFrame, store: Store | None = None, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS):
    """Stored targets, sizes and lines, and the mix: shard, place, source_no, block, doc_id, start, first, last of each piece."""
    store = store or Store(docs.sparkSession)
    rows = store.put(sized(docs))
    sources = targets(rows, store)
    line = store.put(lines(rows, sources))
    blocks = plan_shards(sources, store, block_words, shard_blocks)
    return sources, rows, line, pieces(line, sources, block_words).join(blocks, ["source_no", "block"])


def taken(docs: DataFrame, store: Store | None = None, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document."""
    sources, rows, line, dealt = mix(docs, store, block_words, shard_blocks)
    by = ["source_no", "start"]
    sums = dealt.groupBy(*by).agg(F.sum(F.col("last") - F.col("first") + 1).alias("taken"))
    with_words = line.join(sums, by, "left").select("source_no", "doc_id", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    facts = sources.select("source", "source_no", "source_size", "target")
    without = rows.where("size = 0").select(F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("_null"), "doc_id", "size")
    keyed = facts.withColumn("_null", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    parts = join_small(with_words, facts.drop("source"), "source_no", "inner").select(columns)
    none = join_small(without, keyed, ["source", "_null"], "inner").withColumn("taken", F.lit(0).cast("long"))
    return parts.unionByName(none.select(columns))


def piece_texts(docs: DataFrame, dealt: DataFrame, line_no: str = "place") -> DataFrame:
    """The mix itself: shard, place, doc_id and the words of each piece, joined by one space.

    For tables whose doc_ids are not null and not repeated. The order inside a block is that of `first` and `start`.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_remove(F.split("text", SPACE), "").alias("_words"))
    cut = F.slice("_words", (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first") + 1).cast("int"))
    return dealt.join(texts, "doc_id").select("shard", line_no, "source_no", "block", "start", "first", "doc_id", F.concat_ws(" ", cut).alias("text"))
