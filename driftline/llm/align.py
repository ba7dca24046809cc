"""Alignment of two tokenizers by their common byte ends, with pair counts over the whole corpus by external spilling.

1. `encode` runs both tokenizers over each text. Byte offsets where a token of A and one of B both end cut the two
   sequences into groups; each such offset links the two tokens that end there. The links of about SEGMENT_LINKS
   consecutive ones of a task are a segment: its records (B id, A id, document, times) are radix-partitioned by the low
   bits of the B id, sorted and written as one zstd run for each radix, to the shared folder.
2. `count_pairs` merges the runs of a radix with a heap, FAN_IN at a time, level by level, reading only their pairs. A run
   holds each of its pairs once, with its total, so that a pair in a third of all links is as many numbers as there are
   runs, and one when they are merged. The last merge of a radix is B-major: all pairs of a B id pass together, and the
   highest count among them is marked.
3. `contributions` streams the runs once more, beside the counts of their radix. The runs of a radix are dealt by segment
   to as many tasks as their records need, whatever the ids in them. Each task sends one row of sums for a document.

Memory: a task holds the tokens of one batch of texts, or the compressed runs of one merge, or the different pairs of
one radix, never a number of records that grows with the corpus. Documents are known by segment and place, so repeated
and null doc_ids are documents of their own. A null or empty text, and one whose tokens do not spell a space and the text
byte for byte, has no tokens: zeros and '' for the hash. No token of either vocabulary is empty, so each common end links
exactly one pair. Ties for the highest count are all marked. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import Store

#: Links of a segment; a text with more is a segment by itself.
SEGMENT_LINKS = 1 << 20
#: Bits of the B id that choose a radix.
RADIX_BITS = 4
#: Bits of an id, and of a document's place in its segment.
ID_BITS = 20
#: Keys of a compressed frame; frames of a row.
FRAME, ROW_FRAMES = 1 << 16, 16
#: Runs of a merge, and records whose contributions one task sends.
FAN_IN, TASK_RECORDS = 64, 1 << 23
#: Characters of a batch of texts that is tokenized at once.
PART = 500_000
#: Characters of a word, and of white space beyond one between words, up to which a text is encoded by rank.
LONG_RUN = 1000
#: Fixed value: the pattern of a byte-level pre-tokenizer.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

FIGURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
ENCODED = "segment long, place int, doc_id long, " + FIGURES + ", radix int, records long, pairs array<binary>, owners array<binary>"
MERGED = "radix int, run long, chunk int, pairs array<binary>"


# -- compressed frames ------------------------------------------------------

def pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers, equal bytes of the numbers side by side, compressed."""
    head = np.array([len(columns), *[x for c in columns for x in (len(c), c.itemsize)]], "<u4").tobytes()
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack(frame: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(frame)
    n = int.from_bytes(raw[:4], "little")
    sizes = np.frombuffer(raw, "<u4", 2 * n, 4).reshape(n, 2).tolist()
    out, at = [], 4 + 8 * n
    for count, width in sizes:
        planes = np.frombuffer(raw, np.uint8, count * width, at).reshape(width, count)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += count * width
    return out


def _pair_frame(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)), *columns)


def _pair_columns(frame: bytes) -> list[np.ndarray]:
    first, *rest = unpack(frame)
    return [np.cumsum(first, dtype=np.uint64), *rest]


# -- texts -> links -> runs -------------------------------------------------

class Aligner:
    """Both tokenizers, and for each id its bytes and the text it has in the description of the groups."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.by_rank = _by_rank(json.loads(a_json))
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        back = {c: b for b, c in enumerate(byte_letters())}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            plain = token not in vocabulary or any(c not in back for c in token)
            self.a_bytes[i] = token.encode() if plain else bytes(back[c] for c in token)
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = self._spelled(len(self.a_bytes), b"|"), self._spelled(len(self.b_bytes), b";")

    @staticmethod
    def _spelled(n: int, last: bytes) -> np.ndarray:
        """Row 0: an id inside a group, row 1: the last id of its side."""
        out = np.empty((2, n), object)
        for row, mark in enumerate((b",", last)):
            out[row] = [b"%d%b" % (i, mark) for i in range(n)]
        return out

    def _encode_a(self, text: str) -> list[int]:
        """Ids of a space and the text: by rank, where that is the same; long runs go to the tokenizer's own code."""
        if self.by_rank is not None:
            parts = text.split()
            if max(map(len, parts), default=0) <= LONG_RUN and len(text) - sum(map(len, parts)) - len(parts) <= LONG_RUN:
                return self.by_rank.encode_ordinary(" " + text)
        return self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids

    def links(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, str]]:
        """For each text: tokens of A, of B, linked A ids, linked B ids, hash of the groups."""
        none = np.zeros(0, np.int64)
        full = [t for t in texts if t]
        of_b = iter(self.b.encode(full, out_type=int, num_threads=1) if full else [])
        for text in texts:
            if not text:
                yield 0, 0, none, none, ""
                continue
            a, b, raw = self._encode_a(text), next(of_b), (" " + text).encode()
            if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
                yield 0, 0, none, none, ""
                continue
            yield self._align(np.array(a, np.int64), np.array(b, np.int64), len(raw))

    def _align(self, a: np.ndarray, b: np.ndarray, size: int):
        a_end, b_end = self.a_size[a].cumsum(), self.b_size[b].cumsum()
        seen = np.zeros(size + 1, bool)
        seen[b_end] = True
        a_last = seen[a_end]
        seen[:] = False
        seen[a_end] = True
        b_last = seen[b_end]
        a_cut, b_cut = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
        # A token stands behind its side's earlier ones and the other side's of earlier groups (B: of its own, too).
        order = np.empty(len(a) + len(b), object)
        a_group, b_group = a_last.cumsum() - a_last, b_last.cumsum() - b_last
        order[np.arange(len(a)) + np.concatenate([[0], b_cut])[a_group]] = self.a_text[a_last.astype(np.int8), a]
        order[np.arange(len(b)) + a_cut[b_group]] = self.b_text[b_last.astype(np.int8), b]
        digest = hashlib.sha256(b"".join(order.tolist())[:-1]).hexdigest()
        return len(a), len(b), a[a_last], b[b_last], digest


def _by_rank(spec: dict):
    """The same byte-level BPE as a rank encoder, several times faster; None where the file is of another kind.

    A merge whose result has the next id merges by rank: the vocabulary must be its bytes, then its merges in order.
    """
    import tiktoken

    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False:
        return None
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    letters, vocabulary = {c: b for b, c in enumerate(byte_letters())}, model["vocab"]
    if any(vocabulary.get(t) != 256 + i for i, t in enumerate(merges)) or {vocabulary.get(c) for c in letters} != set(range(256)):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(key: str, shared) -> Aligner:
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*shared.value)
    return _ALIGNERS[key]


def _runs(segment: int, links: list[tuple[int, np.ndarray, np.ndarray]]) -> list[dict]:
    """The runs of a segment: for each radix its pairs with their records and totals, and the records' owners."""
    bits, radixes = np.uint64(ID_BITS), np.uint64((1 << RADIX_BITS) - 1)
    codes = []
    for place, a, b in links:
        a, b = a.astype(np.uint64), b.astype(np.uint64)
        codes.append((((b & radixes) << bits | b) << bits | a) << bits | np.uint64(place))
    code, times = np.unique(np.concatenate(codes), return_counts=True)
    key, place = code >> bits, (code & np.uint64((1 << ID_BITS) - 1)).astype("<u4")
    firsts = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    cuts = np.searchsorted(key[firsts] >> np.uint64(2 * ID_BITS), np.arange((1 << RADIX_BITS) + 1, dtype=np.uint64))
    ends = np.append(firsts, len(key))
    totals = np.add.reduceat(times, firsts).astype("<u8")
    key = key[firsts] & np.uint64((1 << 2 * ID_BITS) - 1)
    out = []
    for radix in range(1 << RADIX_BITS):
        lo, hi = int(cuts[radix]), int(cuts[radix + 1])
        if lo == hi:
            continue
        pairs, owners = [], []
        for i in range(lo, hi, FRAME):
            j = min(i + FRAME, hi)
            rows = slice(ends[i], ends[j])
            pairs.append(_pair_frame(key[i:j], totals[i:j], np.diff(ends[i:j + 1]).astype("<u4")))
            owners.append(pack(place[rows], times[rows].astype("<u4")))
        out.append({"segment": segment, "radix": radix, "records": int(ends[hi] - ends[lo]), "pairs": pairs, "owners": owners})
    return out


def _arrow(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def encode(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """A row of figures for each document (place set) and the runs of the segments (radix set).

    The vocabularies are files on the driver; their sizes do not depend on the data and they go to tasks as a broadcast.
    """
    with open(a_file, encoding="utf-8") as f, open(b_file, "rb") as g:
        files = f.read(), g.read()
    key = hashlib.sha256(files[0].encode() + files[1]).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(files)
    schema = pa.schema([("segment", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("radix", pa.int32()),
                        ("records", pa.int64()), ("pairs", pa.list_(pa.binary())), ("owners", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = _aligner(key, shared)
        segment = TaskContext.get().partitionId() << 32
        held, n, place = [], 0, 0
        for batch in batches:
            step = max(1, PART * len(batch) // max(batch.nbytes, 1))
            for start in range(0, len(batch), step):
                part = batch.slice(start, step)
                rows = []
                for doc_id, found in zip(part["doc_id"].to_pylist(), aligner.links(part["text"].to_pylist())):
                    n_a, n_b, a, b, digest = found
                    rows.append({"segment": segment, "place": place, "doc_id": doc_id, "n_a": n_a, "n_b": n_b, "n_groups": len(a),
                                 "n_links": len(a), "groups_sha256": digest})
                    if len(a):
                        held.append((place, a, b))
                    n, place = n + len(a), place + 1
                    if n >= SEGMENT_LINKS or place == 1 << ID_BITS:
                        rows += _runs(segment, held) if held else []
                        segment, held, n, place = segment + 1, [], 0, 0
                yield _arrow(schema, rows)
        if held:
            yield _arrow(schema, _runs(segment, held))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


# -- counting ---------------------------------------------------------------

def merged(runs: list[Iterator[list[np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different keys in order with their totals, from sorted runs of (keys, totals, ...) frames.

    The heap holds the last key of each run's current frame: up to the least of them all runs are known.
    """
    heap, now = [], {}

    def advance(i: int) -> None:
        frame = next(runs[i], None)
        if frame is None:
            now.pop(i, None)
        else:
            now[i] = (frame[0], frame[1])
            heapq.heappush(heap, (int(frame[0][-1]), i))

    for i in range(len(runs)):
        advance(i)
    while heap:
        bound = heap[0][0]
        keys, totals, used = [], [], []
        for i, (k, t) in now.items():
            cut = int(np.searchsorted(k, np.uint64(bound), "right"))
            if cut:
                keys.append(k[:cut])
                totals.append(t[:cut])
                now[i] = (k[cut:], t[cut:])
                if cut == len(k):
                    used.append(i)
        while heap and heap[0][0] == bound:
            heapq.heappop(heap)
        for i in used:
            advance(i)
        keys, totals = np.concatenate(keys), np.concatenate(totals)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        firsts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        yield keys[firsts], np.add.reduceat(totals[order], firsts)


def _by_other(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The blocks, cut so that the pairs of a B id are never apart, with a mark on its highest counts."""
    keys, totals = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    shift = np.uint64(ID_BITS)

    def marked(k, t):
        firsts = np.flatnonzero(np.diff(k >> shift, prepend=~(k[:1] >> shift)))
        top = np.repeat(np.maximum.reduceat(t, firsts), np.diff(np.append(firsts, len(k))))
        return k, t, (t == top).astype(np.uint8)

    for k, t in blocks:
        keys, totals = np.concatenate([keys, k]), np.concatenate([totals, t])
        cut = int(np.searchsorted(keys, keys[-1] >> shift << shift))
        if cut:
            yield marked(keys[:cut], totals[:cut])
            keys, totals = keys[cut:], totals[cut:]
    if len(keys):
        yield marked(keys, totals)


def _frames(blocks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[bytes]:
    for block in blocks:
        for i in range(0, len(block[0]), FRAME):
            yield _pair_frame(*[np.ascontiguousarray(c[i:i + FRAME]) for c in block])


def _merge(last: bool):
    schema = pa.schema([("radix", pa.int32()), ("run", pa.int64()), ("chunk", pa.int32()), ("pairs", pa.list_(pa.binary()))])

    def run(key: tuple, group: Iterator[pa.RecordBatch] | pa.Table) -> pa.Table:
        radix, split = key[0].as_py(), key[1].as_py()
        rows: dict[int, list] = {}
        for r, c, p in zip(group["run"].to_pylist(), group["chunk"].to_pylist(), group["pairs"].to_pylist()):
            rows.setdefault(r, []).append((c, p))
        runs = [(_pair_columns(f) for _, p in sorted(parts, key=lambda x: x[0]) for f in p) for parts in rows.values()]
        blocks = merged(runs)
        out, frames = [], []
        for frame in _frames(_by_other(blocks) if last else blocks):
            frames.append(frame)
            if len(frames) == ROW_FRAMES:
                out.append({"radix": radix, "run": split, "chunk": len(out), "pairs": frames})
                frames = []
        if frames:
            out.append({"radix": radix, "run": split, "chunk": len(out), "pairs": frames})
        return pa.Table.from_pylist(out, schema=schema)
    return run


def count_pairs(runs: DataFrame, store: Store) -> DataFrame:
    """One run of each radix with the count of each pair and a mark on the highest of each B id; `runs` is stored."""
    left = runs.groupBy("radix").count().agg(F.max("count")).first()[0] or 0
    level = runs.select("radix", F.col("segment").alias("run"), F.lit(0).alias("chunk"), "pairs")
    while True:
        splits = max(1, -(-left // FAN_IN))
        dealt = level.withColumn("split", F.pmod(F.xxhash64("run"), F.lit(splits)))
        out = store.put(dealt.groupBy("radix", "split").applyInArrow(_merge(splits == 1), MERGED))
        if left and getattr(level, "_stored_at", None):
            store.drop(level)
        if splits == 1:
            return out
        level, left = out, splits


def contributions(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(segment, place, n_best, count_sum): sums over the links of a document, in parts by radix; `runs` is stored."""
    sizes = {r["radix"]: r["n"] for r in runs.groupBy("radix").agg(F.sum("records").alias("n")).collect()}   # a row for each radix
    tasks = F.array(*[F.lit(max(1, -(-sizes.get(r, 0) // TASK_RECORDS))) for r in range(1 << RADIX_BITS)])
    tasks = F.element_at(tasks, F.col("radix") + 1)
    dealt = runs.select("radix", F.pmod(F.xxhash64("segment"), tasks).cast("int").alias("split"), "segment", "pairs", "owners")
    beside = counts.select("radix", F.explode(F.sequence(F.lit(0), tasks.cast("int") - 1)).alias("split"), "chunk", "pairs")
    schema = pa.schema([("segment", pa.int64()), ("place", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunks = sorted(zip(right["chunk"].to_pylist(), right["pairs"].to_pylist()), key=lambda x: x[0])
        known = [_pair_columns(f) for _, p in chunks for f in p]
        keys, totals, marks = (np.concatenate(c) for c in zip(*known)) if known else (np.zeros(0, np.uint64),) * 3
        del known
        out: dict[int, np.ndarray] = {}
        for segment, pairs, owners in zip(left["segment"].to_pylist(), left["pairs"].to_pylist(), left["owners"].to_pylist()):
            for frame, owner in zip(pairs, owners):
                k, _, records = _pair_columns(frame)
                place, times = (c.astype(np.int64) for c in unpack(owner))
                at = np.repeat(np.searchsorted(keys, k), records)
                sums = out.setdefault(segment, np.zeros((2, 0), np.int64))
                if place.max() >= sums.shape[1]:
                    sums = out[segment] = np.pad(sums, ((0, 0), (0, int(place.max()) + 1 - sums.shape[1])))
                np.add.at(sums[0], place, marks[at].astype(np.int64) * times)
                np.add.at(sums[1], place, totals[at].astype(np.int64) * times)
        parts = []
        for segment, sums in out.items():
            place = np.flatnonzero(sums[1])
            parts.append(pa.table([np.full(len(place), segment), place.astype(np.int32), sums[0][place], sums[1][place]], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    by = ["radix", "split"]
    return dealt.groupBy(*by).cogroup(beside.groupBy(*by)).applyInArrow(run, "segment long, place int, n_best long, count_sum long")


def align(docs: DataFrame, a_file: str, b_file: str, store: Store | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of `docs` (doc_id, text)."""
    store = store or Store(docs.sparkSession)
    encoded = store.put(encode(docs, a_file, b_file))
    runs = encoded.where("radix IS NOT NULL").select("segment", "radix", "records", "pairs", "owners")
    sums = contributions(runs, count_pairs(runs, store)).groupBy("segment", "place").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = encoded.where("radix IS NULL").select("segment", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("long")
    return rows.join(sums, ["segment", "place"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
