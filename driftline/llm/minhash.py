"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find.

Words are runs of characters other than \\x20 and \\x09-\\x0D after lower-casing A-Z. A document's set holds its distinct
five-word shingles; with fewer words, the whole sequence; without words (null or empty text) it is empty and
the document is linked with nothing. Two documents are linked if |A and B| >= 0.75 |A or B|.

1. `signatures`: documents of one word sequence are one node (a 128-bit key), so copies meet in a partial
   aggregate and not in a bucket. A SuperMinHash signature of 128 slots gives 32 bands of 4 slots, and a sketch of two bits per slot. A parity map
   of the set, 1024 bits, bounds how far two sets differ: an exact bound, sharp up to some thousand shingles.
2. `near_links`: nodes that share a band are candidates. They are tested in rounds against samples of each bucket
   that grow until they are the whole bucket, and only across components found so far. A group of thousands of
   variants is thus joined by a few tests each; every pair not already joined by a path is tested in the end.
   Sizes, sketches or parity maps that the similarity rules out end a test within the join of the buckets, so documents
   that only share a common passage, or variants too far apart, do not become pairs.
3. A test then compares the full sets of both documents.
4. `components` joins the links.

A pair at similarity 0.75 shares no band with probability 5e-6 and fails by its sketch with 1e-7; less above it.

Shingles are 64-bit hashes; two of a document collide with probability 1e-11 at 20,000 words.
Repeated rows get the same result. A null doc_id takes part but never becomes a component's name, unless no
document of the component has a name; then component_id is null and kept is true.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, components, fresh, join_small, text_key
from .hashing import U, STEP, gram_hashes, mix, word_hashes

SLOTS, BANDS, SHINGLE = 128, 32, 5
#: Similarity as a fraction of whole numbers.
SIMILAR = (75, 100)
#: Two sketches of linked nodes differ in at most so many slots: 24 on average at similarity 0.75, deviation under 4.4.
DIFFER = 47
#: A bucket is first tested against about so many of its nodes; each round takes so many times more.
FIRST, FACTOR = 8, 32
#: Bits of a set's parity map.
PARITY = 1024
#: What a text with words holds.
WORD = r"[^\x20\x09-\x0D]"
#: Shingles that a task handles at once.
CHUNK = 100_000


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(gram_hashes(word_hashes(tokens(text)), SHINGLE))


def superminhash(elements: np.ndarray, owner: np.ndarray, count: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (count x slots) of several sets at once; `owner` tells each element's set.

    Each element walks its own random permutation of the slots; step j puts a value from [j, j + 1) into the j-th slot of
    the walk, and a slot keeps its least value. All elements take step j together; after it an element goes on
    only if some slot of its set still exceeds j + 1, so what is left out could not change a value.
    """
    best = np.full(count * slots, np.inf)
    state, places = elements, None
    for j in range(slots):
        state = mix(state + STEP)
        value = j + (state >> U(11)) * 2.0 ** -53
        pick = j + ((mix(state ^ STEP) >> U(32)) * U(slots - j) >> U(32)).astype(np.int64)
        if places is None:
            slot = pick
        else:
            rows = np.arange(len(state))
            slot = places[rows, pick]
            places[rows, pick] = places[:, j]
        np.minimum.at(best, owner * slots + slot, value)
        go = best.reshape(count, slots).max(axis=1)[owner] > j + 1
        if places is None:
            places = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (int(go.sum()), 1))
            places[np.arange(len(places)), pick[go]] = 0
        elif not go.all():
            places = places[go]
        state, owner = state[go], owner[go]
        if not len(state):
            break
    return best.reshape(count, slots)


def _band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    n = len(signature)
    cells = signature.view(U).reshape(n, BANDS, SLOTS // BANDS)
    out = np.tile(np.arange(BANDS, dtype=U), (n, 1))
    for i in range(cells.shape[2]):
        out = mix(out * STEP + cells[:, :, i])
    return out.view(np.int64)


def _sketches(signature: np.ndarray) -> np.ndarray:
    """Two bits of each slot, as two 64-bit numbers for every 64 slots: the first bits, then the second."""
    bits = mix(signature.view(U))
    out = []
    for at in range(0, SLOTS, 64):
        for shift in (U(0), U(1)):
            plane = (bits[:, at:at + 64] >> shift) & U(1)
            out.append((plane << np.arange(64, dtype=U)).sum(axis=1, dtype=U))
    return np.stack(out, axis=1).view(np.int64)


def _parities(elements: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """A map of PARITY bits for each set: whether an odd number of its elements falls on a bit.

    The maps of two sets differ in at most as many bits as the sets in elements.
    """
    odd = np.bincount(owner * PARITY + (elements & U(PARITY - 1)).astype(np.int64), minlength=count * PARITY) & 1
    return np.packbits(odd.astype(np.uint8).reshape(count, PARITY), axis=1).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, key -> doc_id, key, node, n_shingles, bands, sketch"""
    for batch in batches:
        ids, keys, texts = batch["doc_id"], batch["key"], batch["text"]
        start = 0
        while start < len(texts):
            sets, nodes, size, at = [], [], 0, start
            while at < len(texts) and size < CHUNK:
                words = tokens(texts[at].as_py())
                s = np.unique(gram_hashes(word_hashes(words), SHINGLE))
                sets.append(s)
                nodes.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                size += len(s)
                at += 1
            lengths = np.array([len(s) for s in sets])
            full = np.flatnonzero(lengths)
            bands, sketch = [None] * len(sets), [None] * len(sets)
            if len(full):
                elements, owner = np.concatenate([sets[i] for i in full]), np.repeat(np.arange(len(full)), lengths[full])
                signature = superminhash(elements, owner, len(full))
                drawn = np.concatenate([_sketches(signature), _parities(elements, owner, len(full))], axis=1)
                for i, keys_of, bits in zip(full, _band_keys(signature), drawn):
                    bands[i], sketch[i] = keys_of, bits
            yield pa.RecordBatch.from_arrays(
                [ids.slice(start, at - start), keys.slice(start, at - start), pa.array(nodes, pa.binary()),
                 pa.array(lengths, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                names=["doc_id", "key", "node", "n_shingles", "bands", "sketch"])
            start = at


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), node (of the words; null without words), n_shingles, bands, sketch: a row for each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("key"))
    return rows.mapInArrow(_signed, "doc_id long, key binary, node binary, n_shingles long, bands array<long>, sketch array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, CHUNK * len(batch) * 8 // max(batch.nbytes, 1))
        for start in range(0, len(batch), step):
            part = batch.slice(start, step)
            sets = [shingle_set(t.as_py()).view(np.int64) for t in part["text"]]
            yield pa.RecordBatch.from_arrays([part["node"], pa.array(sets, pa.list_(pa.int64()))], names=["node", "items"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough by their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("a_items"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("b_items"))
    both = F.size(F.array_intersect("a_items", "b_items"))
    return (pairs.join(left, "a").join(right, "b")
            .select("a", "b", both.alias("both"), (F.size("a_items") + F.size("b_items")).alias("sum"))
            .where(F.col("both") * SIMILAR[1] >= SIMILAR[0] * (F.col("sum") - F.col("both"))).select("a", "b"))


def _may_link(a: str, b: str):
    """Sizes and sketches of two nodes, columns named `a` and `b` with _n and _s, allow the similarity."""
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    s, t = F.col(f"{a}_s"), F.col(f"{b}_s")
    odd = [F.bit_count(F.get(s, i).bitwiseXOR(F.get(t, i))) for i in range(SLOTS // 32, SLOTS // 32 + PARITY // 64)]
    differ = [F.bit_count(F.get(s, i).bitwiseXOR(F.get(t, i)).bitwiseOR(F.get(s, i + 1).bitwiseXOR(F.get(t, i + 1))))
              for i in range(0, SLOTS // 32, 2)]
    sizes = (n * SIMILAR[1] >= m * SIMILAR[0]) & (m * SIMILAR[1] >= n * SIMILAR[0])
    # Similar sets of n and m elements differ in at most (n + m) (1 - s) / (1 + s) elements, and so in that many bits.
    return sizes & (sum(differ[1:], differ[0]) <= DIFFER) & (
        sum(odd[1:], odd[0]) * (SIMILAR[1] + SIMILAR[0]) <= (n + m) * (SIMILAR[1] - SIMILAR[0]))


def near_links(docs: DataFrame, signed: DataFrame, store: Store) -> DataFrame:
    """(node, component) of the nodes that are linked with another one. `signed` is the stored result of `signatures`."""
    full = signed.where("node IS NOT NULL")
    banded = full.dropDuplicates(["node"]).select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("least")).where("members > 1")
    live = store.put(banded.join(shared, "bucket"))

    # What the tests need of each node in a shared bucket: size, sketch, and one of its documents.
    wanted = live.select("node").distinct()
    info = store.put(full.select("node", "n_shingles", "sketch", "doc_id", "key").join(wanted, "node", "left_semi").groupBy("node").agg(
        F.first("n_shingles").alias("n"), F.first("sketch").alias("s"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")))
    chosen = info.select("node", F.col("first.doc_id").alias("d"), F.col("first.key").alias("k"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("key"))
    # A repeated row gives its node twice; links are made distinct anyway.
    sets = store.put(texts.join(chosen, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
                     .select("node", "text").mapInArrow(_sets, "node binary, items array<long>"))

    def described(name: str) -> DataFrame:
        return info.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), F.col("s").alias(f"{name}_s"))

    # First one test for each node: the least node of its buckets, which most of a group share.
    nearest = (live.where("node <> least").select(F.col("node").alias("b"), F.col("least").alias("a")).distinct()
               .join(described("a"), "a").join(described("b"), "b").where(_may_link("a", "b")))
    edges = store.put(_verified(nearest.groupBy("b").agg(F.min("a").alias("a")), sets).distinct())
    labels = components(store, edges)

    place = F.conv(F.hex(F.substring("b", 1, 6)), 16, 10).cast("double") / float(2 ** 48)
    members = store.put(live.select("bucket", "members", F.col("node").alias("b")).join(described("b"), "b").withColumn("place", place))
    low, reach = 0, FIRST
    while True:
        known = (members.join(labels.select(F.col("node").alias("b"), "component"), "b", "left")
                 .withColumn("component", F.coalesce("component", "b")))
        open_ = known.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
        now = store.put(known.join(open_, "bucket"))
        most = now.agg(F.max("members")).first()[0]
        if most is None or low >= most:
            store.drop(now)
            break
        # Nodes have a random place in [0, 1); places from low/members to reach/members are this round's sample.
        at = F.col("place") * F.col("members")
        sample = now.where((at >= low) & (at < reach)).select(
            "bucket", F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("b_s").alias("a_s"),
            F.col("component").alias("a_c"), F.col("place").alias("a_place"))
        later = (F.col("place") > F.col("a_place")) | ((F.col("place") == F.col("a_place")) & (F.col("b") > F.col("a")))
        tests = (now.join(sample, "bucket").where((F.col("component") != F.col("a_c")) & later & _may_link("a", "b"))
                 .select("a", "b").distinct())
        found = store.put(_verified(tests, sets).distinct())
        stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        after = components(store, stars.union(found))
        store.drop(now, found, labels)
        labels, low, reach = after, reach, reach * FACTOR
    store.drop(live, info, sets, edges, members)
    return labels


def near_duplicates(docs: DataFrame, store: Store | None = None) -> DataFrame:
    """doc_id, key, node, n_shingles, component_id, kept: a row for each document."""
    store = store or Store(docs.sparkSession)
    signed = store.put(signatures(docs))
    labels = near_links(docs, signed, store)
    rows = signed.select("doc_id", "key", "node", "n_shingles")
    # One row for each word sequence, then for each component: copies meet in partial aggregates.
    groups = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    groups = groups.join(labels, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    names = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    named = store.put(groups.join(names, "component").select("node", "component_id"))
    out = rows.join(named, "node", "left").select(
        "doc_id", "key", "node", "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_first(docs: DataFrame, store: Store | None = None) -> DataFrame:
    """One row of `docs` for each component, all columns: that of the least doc_id, of repeated rows the first by text.

    Rows without words are in no component and stay, repeated ones as well. Where no document of a component has a doc_id,
    each of its word sequences stays once.
    """
    store = store or Store(docs.sparkSession)
    found = near_duplicates(docs, store).where("kept AND node IS NOT NULL")
    key, k, i = (fresh(docs, c) for c in ("text_key", "chosen_key", "chosen_id"))
    chosen = store.put(found.groupBy(F.col("doc_id").alias(i), "node").agg(F.min("key").alias(k), F.count("*").alias("rows")).select(i, k, "rows"))
    some = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    d = docs.where(some).withColumn(key, text_key(F.col("text")))
    same = (F.col(key) == F.col(k)) & F.col("doc_id").cast("long").eqNullSafe(F.col(i))
    single = d.join(chosen.where("rows = 1").select(i, k), same, "left_semi")
    # Only rows that stand there more than once need to be told apart; they meet in partial aggregates.
    order = F.struct(*[F.col(c).cast("string") for c in docs.columns])
    again = join_small(d, chosen.where("rows > 1").select(i, k), same, "left_semi").groupBy("doc_id", key).agg(
        F.min_by(F.struct(*docs.columns), order).alias(k))
    return docs.where(~some).union(single.select(*docs.columns)).union(again.select(*[F.col(f"{k}.`{c}`") for c in docs.columns]))
