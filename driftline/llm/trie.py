"""Prefix trie of conversations by hashing blocks of turns.

A node is a distinct sequence of first turns (role, text); its members are the conversations that start with it. A prefix is
known by 128 bits: the sums, modulo 2^32, of four hashes of each turn and its place. So prefixes add up from blocks.

1. `placed` numbers the turns of each conversation; a conversation with most of the rows is many ranges of rows.
2. `blocks` packs BLOCK successive turns of a conversation into a row with the prefix before and behind it.
3. `edges` groups conversations by the prefixes before and behind a block: whole blocks are counted, not turns.
4. `nodes`: where all that reach a block go on with the same one, its turns are nodes with the members of the block. Only
   where blocks differ behind one prefix, turn boundaries inside them are grouped as well.
5. `subtree_sums`: sums over subtrees by doubling: after round k a node has what lies less than 2^k below it, and sends it to
   the node 2^k above. Nodes without one drop out, so the rounds are the logarithm of the greatest depth.
6. `end_hashes`: ids of a node's ends are joined in ranges of ids, which bounds a row, and hashed range by range in order.

Turns go by `turn`, null first, equal ones by a hash of role and text. A null role or text counts as empty. Rows without
conv_id belong to no conversation and are left out. A repeated row is a repeated turn. An empty table has no nodes, not even
the root; a conversation without turns ends in the root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, words

#: Turns of a block, and blocks of a conversation that are numbered together.
BLOCK, STRETCH = 8, 1024
#: Ids of a range whose text is one row.
IDS = 4096
#: Fixed values of the contract: conversations that share a start, and the turns taken from it.
FAMILY, SHARED = 20, 4

LOW = 0xFFFFFFFF
TAGS = ("t1", "t2", "t3", "t4")
ID = ["id1", "id2"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest of role and text, words of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"),
        F.size(words(text)).cast("long").alias("words"))


def placed(rows: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, pos, digest, words) with places from 0, and (conv_id, part, ahead, total); both stored."""
    order = [F.col("turn").asc_nulls_first(), F.col("digest").asc()]
    ranged = store.put(rows.repartitionByRange(F.col("conv_id").asc(), *order).withColumn("part", F.spark_partition_id()))
    whole = Window.partitionBy("conv_id")
    parts = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    parts = store.put(parts.select(
        "conv_id", "part", (F.sum("n").over(whole.orderBy("part")) - F.col("n")).alias("ahead"), F.sum("n").over(whole).alias("total")))
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    out = ranged.withColumn("pos", (inside - 1).cast("long")).join(parts.drop("total"), ["conv_id", "part"])
    return store.put(out.select("conv_id", "part", (F.col("pos") + F.col("ahead")).alias("pos"), "digest", "words")), parts


def rebuilt(conversations: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, length, digest, words) of the rebuilt conversations, and (conv_id, length) of all of them.

    Conversation c starts with the first h turns of the first of its FAMILY, then has its own turns after its first h.
    """
    rows, parts = placed(turns(conversations), store)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = rows.where(f"conv_id % {FAMILY} = 0 AND pos < {SHARED - 1}").groupBy(F.col("conv_id").alias("family")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("head"))       # three turns at most
    convs = parts.groupBy("conv_id").agg(F.max("total").alias("total")).withColumns({"h": h, "family": family}).join(heads, "family", "left")
    convs = convs.withColumn("given", F.least("h", F.coalesce(F.size("head"), F.lit(0)).cast("long")))
    convs = convs.withColumn("given", F.greatest("given", F.lit(0).cast("long")))
    convs = store.put(convs.withColumn("length", F.col("given") + F.greatest(F.col("total") - F.col("h"), F.lit(0).cast("long"))))
    start = convs.where("given > 0").select("conv_id", "length", F.explode(F.expr("slice(head, 1, CAST(given AS INT))")).alias("t")).select(
        "conv_id", "t.pos", "length", "t.digest", "t.words")
    shift = parts.select("conv_id", "part").join(convs.select("conv_id", "h", "given", "length"), "conv_id")
    own = rows.join(shift, ["conv_id", "part"]).where("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "length", "digest", "words")
    return store.put(start.unionByName(own)), convs.select("conv_id", "length")


# -- blocks and nodes -------------------------------------------------------

def tags(pos: Column, digest: Column) -> list[Column]:
    """Four 32-bit hashes of a turn in its place."""
    out = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), pos, digest)
        out += [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(LOW))]
    return out


def packed(parts: list[Column]) -> list[Column]:
    """Four sums as the two numbers of an id."""
    a, b, c, d = (p.bitwiseAND(F.lit(LOW)) for p in parts)
    return [F.shiftleft(a, 32).bitwiseOR(b), F.shiftleft(c, 32).bitwiseOR(d)]


def blocks(rows: DataFrame, store: Store) -> DataFrame:
    """conv_id, block, length, its turns in order, the sums before it (b1 to b4) and its own (t1 to t4)."""
    tagged = rows.withColumns(dict(zip(TAGS, tags(F.col("pos"), F.col("digest")))))
    grouped = store.put(tagged.groupBy("conv_id", F.expr(f"pos div {BLOCK}").alias("block")).agg(
        F.max("length").alias("length"), F.array_sort(F.collect_list(F.struct("pos", "digest", "words", *TAGS))).alias("turns"),
        *[F.sum(t).alias(t) for t in TAGS]))
    grouped = grouped.withColumn("stretch", F.expr(f"block div {STRETCH}"))
    inside = Window.partitionBy("conv_id", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = grouped.groupBy("conv_id", "stretch").agg(*[F.sum(t).alias(t) for t in TAGS])
    ahead = sums.select("conv_id", "stretch", *[F.sum(t).over(earlier).alias(f"a{t[1]}") for t in TAGS]).where("stretch > 0")
    zero = F.lit(0).cast("long")
    out = grouped.withColumns({f"b{t[1]}": F.coalesce(F.sum(t).over(inside), zero) for t in TAGS}).join(ahead, ["conv_id", "stretch"], "left")
    return out.select("conv_id", "block", "length", "turns", *TAGS,
                      *[(F.col(f"b{i}") + F.coalesce(f"a{i}", zero)).bitwiseAND(F.lit(LOW)).alias(f"b{i}") for i in range(1, 5)])


def edges(table: DataFrame) -> DataFrame:
    """Different blocks behind different prefixes: how many conversations have one, the least of them, and the turns."""
    before = packed([F.col(f"b{i}") for i in range(1, 5)])
    behind = packed([F.col(f"b{i}") + F.col(f"t{i}") for i in range(1, 5)])
    keyed = table.select("conv_id", "block", "turns", *[f"b{i}" for i in range(1, 5)], *[c.alias(n) for c, n in zip(before, ("top1", "top2"))],
                         *[c.alias(n) for c, n in zip(behind, ("end1", "end2"))])
    return keyed.groupBy("block", "top1", "top2", "end1", "end2").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns"),
        *[F.first(f"b{i}").alias(f"b{i}") for i in range(1, 5)])


def nodes(table: DataFrame, convs: DataFrame, store: Store) -> DataFrame:
    """id1, id2, depth, above1, above2 (the parent's id), conv_id, n_convs, words of every node; stored."""
    found = store.put(edges(table))
    reached = found.groupBy("block", "top1", "top2").agg(F.count(F.lit(1)).alias("ways"))
    found = found.join(reached, ["block", "top1", "top2"])
    first = F.struct(*[F.col(f"b{i}").alias(f"t{i}") for i in range(1, 5)])

    def add(path, turn):
        last = F.element_at(path, -1)
        return F.concat(path, F.array(F.struct(*[(last[t] + turn[t]).alias(t) for t in TAGS])))

    path = F.aggregate("turns", F.array(first), add)
    step = found.withColumn("path", path).select(
        "ways", "n_convs", "conv_id", "path", F.posexplode("turns").alias("i", "turn"))
    ids = [c for at in ("path[i + 1]", "path[i]") for c in packed([F.expr(f"{at}.{t}") for t in TAGS])]
    each = store.put(step.select("ways", "n_convs", "conv_id", (F.col("turn.pos") + 1).alias("depth"), F.col("turn.words").alias("words"),
                                 *[c.alias(n) for c, n in zip(ids, (*ID, "above1", "above2"))]))
    straight = each.where("ways = 1").drop("ways")
    # Only here blocks differ behind one prefix: their turns are compared one by one.
    refined = each.where("ways > 1").groupBy("depth", *ID).agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.first(c).alias(c) for c in ("words", "above1", "above2")])
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        "n_convs", "conv_id", zero.alias("depth"), zero.alias("words"), zero.alias("id1"), zero.alias("id2"), none.alias("above1"), none.alias("above2"))
    return store.put(straight.unionByName(refined).unionByName(root))


# -- what lies below a node -------------------------------------------------

def subtree_sums(table: DataFrame, values: list[str], store: Store) -> DataFrame:
    """id1, id2 and the sums of `values` over all nodes below each node that has some; `table` has the ids and the values."""
    keep = [*ID, "above1", "above2", *values]
    live = table.where("above1 IS NOT NULL").select(*keep)
    sent = []
    while not live.isEmpty():
        up = store.put(live.groupBy(F.col("above1").alias("id1"), F.col("above2").alias("id2")).agg(*[F.sum(v).alias(v) for v in values]))
        sent.append(up)
        more = up.select(*ID, *[F.col(v).alias(f"_{v}") for v in values])
        # The next pointer is that of the node pointed at; a node whose pointer has none is done.
        next_ = live.select(F.col("id1").alias("above1"), F.col("id2").alias("above2"), F.col("above1").alias("_1"), F.col("above2").alias("_2"))
        moved = live.join(next_, ["above1", "above2"]).join(more, ID, "left")
        new = store.put(moved.select(*ID, F.col("_1").alias("above1"), F.col("_2").alias("above2"),
                                     *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]))
        if len(sent) > 1:
            store.drop(live)
        live = new
    if not sent:
        return table.select(*ID, *values).limit(0)
    return reduce(DataFrame.unionByName, sent).groupBy(*ID).agg(*[F.sum(v).alias(v) for v in values])


def end_hashes(table: DataFrame, convs: DataFrame) -> DataFrame:
    """id1, id2, ends_sha256 of nodes where conversations end; `table` from `blocks`."""
    behind = packed([F.col(f"b{i}") + F.col(f"t{i}") for i in range(1, 5)])
    last = table.where("length = element_at(turns, -1).pos + 1").select("conv_id", *[c.alias(n) for c, n in zip(behind, ID)])
    zero = F.lit(0).cast("long")
    last = last.unionByName(convs.where("length = 0").select("conv_id", zero.alias("id1"), zero.alias("id2")))
    ranges = last.groupBy(*ID, F.expr(f"conv_id div {IDS}").alias("bucket")).agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for id1, id2, ids in zip(*(batch[c].to_pylist() for c in (*ID, "ids"))):
                if (id1, id2) != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (id1, id2), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield _hashes(done)
        if now is not None:
            yield _hashes([(*now, digest.hexdigest())])

    return ranges.repartition(*ID).sortWithinPartitions(*ID, "bucket").select(*ID, "ids").mapInArrow(run, "id1 long, id2 long, ends_sha256 string")


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=[*ID, "ends_sha256"])


def prefix_trie(rows: DataFrame, convs: DataFrame, store: Store) -> DataFrame:
    """A row for each node; `rows` (conv_id, pos, length, digest, words) and `convs` (conv_id, length) are stored."""
    table = blocks(rows, store)
    table = store.put(table)
    all_nodes = nodes(table, convs, store)
    children = all_nodes.where("depth > 0").groupBy(F.col("above1").alias("id1"), F.col("above2").alias("id2")).agg(F.count(F.lit(1)).alias("n_children"))
    zero = F.lit(0).cast("long")
    valued = store.put(all_nodes.join(children, ID, "left").withColumn("n_children", F.coalesce("n_children", zero)).withColumns({
        "leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}))
    below = subtree_sums(valued, ["leaves", "saved"], store).select(*ID, F.col("leaves").alias("_leaves"), F.col("saved").alias("_saved"))
    above = all_nodes.select(F.col("id1").alias("above1"), F.col("id2").alias("above2"), F.col("conv_id").alias("parent_conv_id"))
    out = valued.join(above, ["above1", "above2"], "left").join(below, ID, "left").join(end_hashes(table, convs), ID, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.coalesce("_leaves", zero)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("_saved", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame, store: Store | None = None) -> DataFrame:
    """The trie of the rebuilt conversations."""
    store = store or Store(conversations.sparkSession)
    return prefix_trie(*rebuilt(conversations, store), store)
