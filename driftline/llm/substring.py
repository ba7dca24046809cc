"""Repeated passages across documents, by seed and extend.

Words are runs of characters other than \\x20 and \\x09-\\x0D, unchanged. A word is removed if it lies in a window of 35
words whose word sequence also starts elsewhere, in another document or the same one.

* Seeds: of the 28 eight-word grams of a window the one with the least hash is its anchor (winnowing), so equal
  windows have equal anchors at equal places. An anchor stands for a run of up to 28 consecutive windows; its region is
  all the words of that run.
* Join on anchors: anchors that occur once are dropped. Occurrences with the same region are equal in all their
  windows, so a class of equal regions with two members or more is repeated as a whole, however large it is.
* Extension: where an anchor has several regions, one member of each is extended to every window of its run, to the
  left and to the right of the anchor, and equal windows are matched by 128-bit hashes. No pairs are formed:
  work is in proportion to the occurrences, and groups meet in partial aggregates.
* Maximal repeats: overlapping repeated windows join into maximal spans, which are cut out.

Null and empty texts have no words. A text shorter than a window loses nothing. Repeated rows are occurrences of
their own, so all words of such a text of 35 words or more go. The hashes of a region are compared only under the same
anchor (64 bits each), those of windows by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, text_key
from .hashing import U, RunHash, STEP, gram_hashes, mix, word_hashes

LENGTH, GRAM = 35, 8
#: Characters of text that a task handles at once.
PART = 1_000_000
#: What an anchor's run is for a document: repeated as a whole; the same, and it also shows its windows to others; open.
WHOLE, SHOWN, OPEN = 0, 1, 2


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def anchors(hashes: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """For each anchor: its hash, a hash of its region, the first window it stands for, and how many windows."""
    grams = gram_hashes(hashes, gram)
    width = length - gram + 1
    place = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(hashes) - length + 1)
    low = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    count = np.diff(np.r_[low, len(place)])
    at = place[low]
    one, two = RunHash(hashes)(low, low + count + length - 1)
    region = mix(one ^ (two * STEP) ^ ((at - low) * 64 + count).astype(U))
    return grams[at], region, low, count


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, PART * len(batch) // max(batch.nbytes, 1))
        for start in range(0, len(batch), step):
            yield batch.slice(start, step)


def _seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        n, digest, found = [], [], ([], [], [], [])
        for t in batch["text"]:
            words = tokens(t.as_py())
            n.append(len(words))
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            columns = anchors(word_hashes(words)) if len(words) >= LENGTH else [np.zeros(0, U)] * 4
            for into, c, kind in zip(found, columns, ("<i8", "<i8", "<i4", "<i4")):
                into.append(c.view(kind) if c.dtype == U and kind == "<i8" else c.astype(kind))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["key"], pa.array(n, pa.int64()), pa.array(digest),
             pa.array(found[0], pa.list_(pa.int64())), pa.array(found[1], pa.list_(pa.int64())),
             pa.array(found[2], pa.list_(pa.int32())), pa.array(found[3], pa.list_(pa.int32()))],
            names=["doc_id", "key", "n_words", "sha256", "anchor", "region", "low", "count"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, text, runs -> a row for each window of a run that is open or shown: its hashes, row, start, open"""
    for batch in _parts(batches):
        out = [[], [], [], [], []]
        for row, t, runs in zip(batch["row"], batch["text"], batch["runs"]):
            runs = [r for r in runs.as_py() if r["kind"] != WHOLE]
            if not runs:
                continue
            start = np.concatenate([np.arange(r["low"], r["low"] + r["count"]) for r in runs])
            one, two = RunHash(word_hashes(tokens(t.as_py())))(start, start + LENGTH)
            for into, x in zip(out, (one.view(np.int64), two.view(np.int64), np.full(len(start), row.as_py()), start.astype(np.int32),
                                     np.repeat([r["kind"] == OPEN for r in runs], [r["count"] for r in runs]))):
                into.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["one", "two", "row", "start", "open"])


def covered(n: int, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of n words lie in a window that begins at one of `starts`."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge)[:n] > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, text, runs, starts -> row, n_removed, sha256, spans of words that went, text that stays"""
    for batch in _parts(batches):
        removed, digest, spans, rest = [], [], [], []
        for t, runs, more in zip(batch["text"], batch["runs"], batch["starts"]):
            words = tokens(t.as_py())
            starts = [np.arange(r["low"], r["low"] + r["count"]) for r in runs.as_py() if r["kind"] != OPEN]
            gone = covered(len(words), np.concatenate([*starts, np.array(more.as_py() or [], np.int64)]).astype(np.int64))
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
            kept = b" ".join([w for w, g in zip(words, gone) if not g])
            removed.append(int(gone.sum()))
            digest.append(hashlib.sha256(kept).hexdigest())
            spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
            rest.append(kept.decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays(
            [batch["row"], pa.array(removed, pa.int64()), pa.array(digest),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(rest)],
            names=["row", "n_removed", "sha256", "spans", "rest"])


def _runs(seeded: DataFrame) -> DataFrame:
    """(row, low, count, kind) of each anchor that may be repeated."""
    each = seeded.select("row", F.inline(F.arrays_zip("anchor", "region", "low", "count")))
    met = each.groupBy("anchor").agg(F.count("*").alias("met"), F.min("region").alias("lo"), F.max("region").alias("hi")).where("met > 1")
    again = each.join(met.select("anchor", (F.col("lo") != F.col("hi")).alias("several")), "anchor")
    return again


def _classed(again: DataFrame) -> DataFrame:
    """Occurrences of repeated anchors -> row, low, count, kind"""
    several = again.where("several")
    classes = several.groupBy("anchor", "region").agg(F.count("*").alias("members"), F.min(F.struct("row", "low")).alias("first"))
    kind = (F.when(F.col("members") == 1, F.lit(OPEN))
            .when((F.col("first.row") == F.col("row")) & (F.col("first.low") == F.col("low")), F.lit(SHOWN)).otherwise(F.lit(WHOLE)))
    rest = several.join(classes, ["anchor", "region"]).select("row", "low", "count", kind.alias("kind"))
    return again.where("NOT several").select("row", "low", "count", F.lit(WHOLE).alias("kind")).union(rest)


def repeated_passages(docs: DataFrame, store: Store | None = None, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (of removed words): a row for each document.

    With `texts`, also `kept_text`, the words that stay, joined by one space: null where nothing was removed.
    """
    store = store or Store(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("key"))
    seeded = store.put(base.mapInArrow(
        _seeded, "doc_id long, key binary, n_words long, sha256 string, anchor array<long>, region array<long>, low array<int>, count array<int>"
    ).withColumn("row", F.monotonically_increasing_id()))
    again = store.put(_runs(seeded))
    runs = _classed(again).groupBy("row").agg(F.collect_list(F.struct("low", "count", "kind")).alias("runs"))

    # A text with a copy is repeated as a whole; it is read again only if it shows windows to others.
    copies = seeded.where(F.col("n_words") >= LENGTH).groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    rows = seeded.select("row", "doc_id", "key", "n_words", "sha256").join(copies, "key", "left")
    shows = F.exists("runs", lambda r: r["kind"] != WHOLE)
    named = (runs.join(rows, "row").where(F.col("copies").isNull() | shows)
             .select("row", "runs", "copies", F.col("doc_id").alias("d"), F.col("key").alias("k")))
    work = store.put(base.join(named, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("row", "text", "runs", "copies"))

    windows = store.put(work.mapInArrow(_windows, "one long, two long, row long, start int, open boolean"))
    met = windows.groupBy("one", "two").agg(F.min(F.struct("row", "start")).alias("lo"), F.max(F.struct("row", "start")).alias("hi")).where("lo <> hi")
    starts = (windows.where("open").join(met, ["one", "two"]).groupBy("row").agg(F.collect_set("start").alias("starts")))
    cut = (work.where("copies IS NULL").join(starts, "row", "left")
           .mapInArrow(_cut, "row long, n_removed long, sha256 string, spans array<struct<start:int,end:int>>, rest string")
           .select("row", "n_removed", F.col("sha256").alias("cut_sha256"), "spans", *["rest"] * texts))
    whole = F.col("copies").isNotNull()
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return rows.join(cut, "row", "left").select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("cut_sha256", "sha256")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))))
        .otherwise(F.coalesce("spans", none)).alias("spans"),
        *[F.when(whole, F.lit("")).otherwise(F.col("rest")).alias("kept_text")] * texts)
