"""Tokenizer alignment against a plain version with dictionaries, with runs small enough for several merges."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from driftline.llm import align as A
from driftline.llm.bpe import byte_letters
from tests.llm.conftest import prose

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def brute(rows, tokenizers):
    a_tok, b_tok = tokenizers
    back = {c: b for b, c in enumerate(byte_letters())}
    docs, pairs = [], collections.Counter()
    for doc_id, text in rows:
        a, b, groups, links = [], [], [], []
        if text:
            a = a_tok.encode(" " + text, add_special_tokens=False).ids
            b = b_tok.encode(text)
            a_raw = [bytes(back[c] for c in a_tok.id_to_token(i)) for i in a]
            b_raw = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i)
                     else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
                a, b = [], []
        if a:
            ends = []
            for raw in (a_raw, b_raw):
                at, here = 0, []
                for x in raw:
                    at += len(x)
                    here.append(at)
                ends.append(here)
            common = sorted(set(ends[0]) & set(ends[1]))
            links = [(x, y) for x, i in zip(a, ends[0]) for y, j in zip(b, ends[1]) if i == j]
            low = 0
            for high in common:
                groups.append("|".join(",".join(str(x) for x, i in zip(ids, e) if low < i <= high) for ids, e in zip((a, b), ends)))
                low = high
        pairs.update(links)
        docs.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = collections.Counter()
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    return sorted((str((d, n_a, n_b, g, len(links), sum(pairs[p] == best[p[1]] for p in links), sum(pairs[p] for p in links), h))
                   for d, n_a, n_b, g, links, h in docs))


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment(spark, awkward, tokenizers, monkeypatch):
    texts = ["<|endoftext|> <s> </s> <0x41> <unk>", "two  spaces", " lead", "trail ", "\n\n\t x", "▁ mark", "日本語のテキスト 🙂🙂", "\x00 zero", "é é", "a", " "]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    more = more.union(spark.createDataFrame([(200 + i, "the same words again and again") for i in range(60)], more.schema))
    table = awkward.where("doc_id IS NULL OR doc_id <> 9").select("doc_id", "text").union(more)
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    want = brute(rows, tokenizers)
    plain = A.align(awkward.where("doc_id IS NULL OR doc_id <> 9"), *FILES).collect()
    assert len(plain) == awkward.count() - 1
    for links, frame, fan_in, records in ((1 << 20, 1 << 16, 64, 1 << 23), (50, 7, 2, 40)):
        for name, value in (("SEGMENT_LINKS", links), ("FRAME", frame), ("FAN_IN", fan_in), ("TASK_RECORDS", records), ("ROW_FRAMES", 2)):
            monkeypatch.setattr(A, name, value)
        got = sorted(str(tuple(r[c] for c in COLUMNS)) for r in A.align(table.repartition(3), *FILES).collect())
        assert got == want


def test_long_text_and_nothing(spark, nothing, tokenizers):
    text = prose(20000, 2, 10 ** 6)
    got = A.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), *FILES).first()
    assert got["n_a"] == len(tokenizers[0].encode(" " + text, add_special_tokens=False).ids) and got["n_links"] == got["n_groups"] > 10000
    assert A.align(nothing, *FILES).count() == 0
    assert set(A.align(nothing, *FILES).columns) == set(COLUMNS)


def test_frames_and_merge():
    rng = np.random.default_rng(1)
    keys = [np.unique(rng.integers(0, 500, 300).astype(np.uint64)) for _ in range(5)]
    frames = [[A._pair_frame(k[i:i + 40], np.ones(len(k[i:i + 40]), "<u8")) for i in range(0, len(k), 40)] for k in keys]
    out = list(A.merged([(A._pair_columns(f) for f in fs) for fs in frames]))
    got = dict(zip(np.concatenate([k for k, _ in out]).tolist(), np.concatenate([t for _, t in out]).tolist()))
    assert list(got) == sorted(got) and got == collections.Counter(np.concatenate(keys).tolist())


def test_clashing_columns(spark, awkward):
    table = awkward.limit(3).selectExpr("*", "'x' AS segment", "'x' AS place", "'x' AS radix")
    assert A.align(table, *FILES).count() == 3


def test_both_encoders_agree(tokenizers):
    """Every character beside a letter, a space and a digit; and runs on both sides of the bound."""
    with open(FILES[0], encoding="utf-8") as f, open(FILES[1], "rb") as g:
        aligner = A.Aligner(f.read(), g.read())
    assert aligner.by_rank is not None
    texts = ["".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}\n" for c in range(low, low + 64) if not 0xD800 <= c < 0xE000) for low in range(0, 0x30000, 64)]
    texts += ["x" * n + " y" * 3 for n in (A.LONG_RUN, A.LONG_RUN + 1, 30000)] + ["a" + " " * n + "b" for n in (A.LONG_RUN, 5000)]
    texts += ["can't we'll I'd they're \u2019s 'S 'LL", "<|endoftext|>", "\t\r\n \u00a0\u3000 x"]
    want = [e.ids for e in tokenizers[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [aligner._encode_a(t) for t in texts] == want


def test_other_vocabularies_have_no_rank_encoder():
    import json
    with open(FILES[0], encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"pre_tokenizer": None}, {"normalizer": {"type": "NFC"}}, {"model": {**spec["model"], "merges": spec["model"]["merges"][::-1]}}):
        assert A._by_rank({**spec, **change}) is None
