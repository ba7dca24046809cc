"""Byte-level BPE by a sentencepiece model that is written directly from a vocabulary of ranks.

`model_bytes` writes the model: one piece for each rank, its bytes mapped one to one to printable characters, its
score the negative rank; identity normalisation, no added prefix, no change to white space. Merging the best-scored
pair first is then merging the lowest rank first. A text is split into pre-tokens by the vocabulary's pattern; a
pre-token that is a piece is that piece, any other is merged by sentencepiece. Ids are the ranks, so decoding looks
up each id's bytes by the inverse of the byte mapping.

A null text counts as empty and has no ids. Any Unicode text comes back byte for byte.
Each task keeps a table of pre-tokens it has seen, emptied when it reaches MEMO entries.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

#: Entries of a task's table of pre-tokens.
MEMO = 200_000
#: A pre-token longer than this is not remembered.
LONG = 64
#: Texts per batch that goes to a task's Python process, by their size in characters.
PART = 2_000_000


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else the next one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in order of rank. Runs on the driver; the list goes to tasks as a broadcast."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose ids are the ranks; the unknown piece that it must have comes last."""
    letters = byte_letters()
    model = proto.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(letters[b] for b in token), score=-float(rank), type=proto.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = proto.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(tokens) + 1
    model.trainer_spec.unk_id = len(tokens)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.trainer_spec.byte_fallback = False
    spec = model.normalizer_spec
    spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class Codec:
    """Encodes and decodes texts; ids are kept as little-endian 32-bit bytes."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.split = regex.compile(pattern).findall
        self.tokens = tokens
        letters = byte_letters()
        self.letter = {b: c for b, c in enumerate(letters)}
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
        back = {c: b for b, c in enumerate(letters)}
        self.bytes_of = [bytes(back[c] for c in self.processor.id_to_piece(i)) for i in range(len(tokens))]
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.memo: dict[str, bytes] = {}

    def _learn(self, new: list[str], into: dict[str, bytes]) -> None:
        rest, spelled = [], []
        for t in new:
            raw = t.encode("utf-8", "surrogatepass")
            rank = self.rank.get(raw)
            if rank is not None:
                into[t] = rank.to_bytes(4, "little")
            else:
                rest.append(t)
                spelled.append(raw.decode("latin-1").translate(self.letter))
        if rest:
            for t, ids in zip(rest, self.processor.encode(spelled, out_type=int, num_threads=1)):
                into[t] = np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        parts = self.split(text) if text else []
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = {t for t in parts if t not in memo}
        if new:
            brief = [t for t in new if len(t) <= LONG]
            self._learn(brief, memo)
            if len(brief) < len(new):
                memo = dict(memo)
                self._learn([t for t in new if len(t) > LONG], memo)
        return b"".join([memo[t] for t in parts])

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


@cache
def _codec(key: str, holder) -> Codec:
    return Codec(*holder.value)


class _Held:
    """The broadcast vocabulary, hashed by its id so that a Python process builds the model once."""

    def __init__(self, shared, key: str):
        self.shared, self.key = shared, key

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key

    @property
    def value(self):
        return self.shared.value


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, digests: bool = False) -> DataFrame:
    """Each row of `docs` (doc_id, text): doc_id, n_tokens, then ids (array<int>) and round_trip, or the digests of both.

    The vocabulary is a file on the driver; its size does not depend on the data and it goes to tasks as a broadcast.
    """
    tokens = read_ranks(vocabulary)
    key = hashlib.sha256(b"".join(tokens) + pattern.encode()).hexdigest()
    held = _Held(docs.sparkSession.sparkContext.broadcast((tokens, pattern)), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, held)
        for batch in batches:
            step = max(1, PART * len(batch) // max(batch.nbytes, 1))
            for start in range(0, len(batch), step):
                part = batch.slice(start, step)
                texts = [t.as_py() for t in part["text"]]
                ids = [codec.encode(t) for t in texts]
                back = [codec.decode(i) for i in ids]
                n = pa.array([len(i) // 4 for i in ids], pa.int64())
                if digests:
                    more = [pa.array([hashlib.sha256(x).hexdigest() for x in each]) for each in (ids, back)]
                else:
                    more = [pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32())),
                            pa.array([b == (t or "").encode("utf-8", "surrogatepass") for b, t in zip(back, texts)], pa.bool_())]
                names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "round_trip"]
                yield pa.RecordBatch.from_arrays([part["doc_id"], n, *more], names=["doc_id", "n_tokens", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, " + (
        "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, round_trip boolean"))
