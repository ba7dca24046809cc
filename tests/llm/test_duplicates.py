import collections
import random

import numpy as np

from driftline.llm import minhash, substring
from driftline.llm.common import Store, components
from tests.llm import brute
from tests.llm.conftest import prose


def variants():
    """Groups of near copies, chains that link only through the middle, and unlike texts with one common passage."""
    r = random.Random(8)
    rows, passage = [], prose(30, 99)
    for g in range(6):
        base = prose(100, 100 + g).split()
        for _ in range(8):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"new{r.randrange(10 ** 6)}"
            rows.append(" ".join(w))
    chain = prose(100, 55).split()
    for i in range(0, 24, 3):
        rows.append(" ".join([f"x{i}{j}" for j in range(i)] + chain[i:]))
    rows += [passage + " " + prose(40, 1000 + i) for i in range(30)]
    rows += [rows[0], rows[0].upper(), "  " + rows[0].replace(" ", "\n"), "a b", "A B", "c"]
    r.shuffle(rows)
    return list(enumerate(rows, 1))


def test_components_match_brute_force(spark):
    rows = variants()
    want = brute.components(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[(r["doc_id"], rows[r["doc_id"] - 1][1])]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_awkward_documents(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    want = collections.Counter((d, *brute.components(rows)[(d, t)]) for d, t in rows)
    got = minhash.near_duplicates(awkward).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    kept = minhash.keep_first(awkward)
    assert kept.columns == awkward.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[3] == 0 and ids[7] == 1 and ids[8] == 0 and ids[4] == ids[5] == ids[6] == 1
    assert ids[11] == 2 and ids[None] == 2          # two texts of one doc_id; one text without any doc_id, one empty
    assert minhash.near_duplicates(nothing).count() == 0 and minhash.keep_first(nothing).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2 ** 63, 400).astype("u8")
    b = np.concatenate([a[:300], rng.integers(0, 2 ** 63, 100).astype("u8")])
    s = minhash.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 400), 2, 256)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.12
    alone = minhash.superminhash(a[::-1].copy(), np.zeros(400, int), 1, 256)
    assert (alone[0] == s[0]).all()


def test_early_stopping_changes_nothing():
    """The signature of a set is the slotwise least of its elements' own signatures."""
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2 ** 63, 50).astype("u8")
    own = minhash.superminhash(a, np.arange(50), 50, 128)
    assert np.isfinite(own).all()
    assert (minhash.superminhash(a, np.zeros(50, int), 1, 128)[0] == own.min(axis=0)).all()


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    got = components(Store(spark), spark.createDataFrame(edges, "a long, b long")).collect()
    groups = collections.defaultdict(set)
    for r in got:
        groups[r["component"]].add(r["node"])
    assert sorted(map(len, groups.values())) == [100, 201]


def test_repeats_match_brute_force(spark, awkward, nothing):
    r = random.Random(5)
    passage, rows = prose(60, 7), []
    for i in range(40):
        parts = [prose(r.randrange(60), 500 + i)]
        if i % 2:
            p = passage.split()
            a = r.randrange(20)
            parts.append(" ".join(p[a:a + r.randrange(30, 45)]))
        if i % 5 == 0:
            parts.append("same " * r.randrange(30, 80))
        parts.append(prose(r.randrange(40), 900 + i))
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, prose(35, 77)), (102, prose(35, 77)), (103, prose(34, 78)), (104, prose(34, 78))]
    for table in (spark.createDataFrame(rows, "doc_id long, text string"), awkward):
        given = [(x["doc_id"], x["text"]) for x in table.select("doc_id", "text").collect()]
        got = substring.repeated_passages(table).collect()
        assert collections.Counter((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got) == collections.Counter(brute.repeated(given))
        assert all(sum(s["end"] - s["start"] for s in x["spans"]) == x["n_removed"] for x in got)
    assert substring.repeated_passages(nothing).count() == 0


def test_rows_without_words_all_stay(spark):
    rows = [(1, "", "en"), (1, "", "en"), (1, None, "en"), (2, " \n", "en"), (None, None, None), (None, None, None), (None, "", "x"),
            (3, "some words that repeat here", "b"), (3, "some words that repeat here", "a"), (3, "some words that repeat here", None)]
    kept = minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = collections.Counter((r["doc_id"], r["text"], r["lang"]) for r in kept.collect())
    assert got == collections.Counter(rows[:7] + [(3, "some words that repeat here", None)])
