"""The trie against a plain version with tuples, with blocks that differ inside, before and behind their ends."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from driftline.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string, id1 string, block string, pos string"


def rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + mine[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = collections.defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    leaves, saved, kids = collections.Counter(), collections.Counter(), collections.Counter(p[:-1] for p in members if p)
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    return sorted(str((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids[p], leaves[p], saved[p],
                       hashlib.sha256(",".join(str(c) for c in sorted(who) if len(convs[c]) == len(p)).encode()).hexdigest()))
                  for p, who in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations():
    r = random.Random(5)
    rows = []
    shared = [("user" if i % 2 else "assistant", f"turn {i} said " + "x " * (i % 5)) for i in range(30)]
    for c in range(140):
        n = r.choice([1, 2, 7, 8, 9, 16, 17, 30])
        said = shared[:r.choice([0, 3, 8, 12, 16, 30])]
        said = (said + [(r.choice(["user", "system"]), f"own {c % 7} {i}") for i in range(n)])[:n]
        rows += [(c, i, role, text, "x", "y", "z") for i, (role, text) in enumerate(said)]
    rows += [(1000, i, *shared[i % 30], "x", "y", "z") for i in range(300)]                 # a long one
    rows += [(1001, i, *shared[i % 30], "x", "y", "z") for i in range(290)]
    rows += [(2000, None, "user", "first"), (2000, 0, None, None), (2000, 1, "user", None), (2000, 1, None, "tie"), (2000, 2, "user", ""),
             (2001, 5, "user", "again"), (2001, 5, "user", "again"), (None, 1, "user", "nobody"), (None, None, None, None),
             (2002, 0, "user", "w " * 20000), (2003, 0, "a:b", "c"), (2004, 0, "a", "b:c"), (2005, 0, None, "alone")]
    rows += [(c, 0, "user", "short") for c in range(9990, 10000)]
    return [tuple(x) + ("x", "y", "z") * (len(x) == 4) for x in rows]


@pytest.mark.parametrize("block,stretch,ids", [(8, 1024, 4096), (4, 2, 16)])
def test_trie(spark, monkeypatch, block, stretch, ids):
    for name, value in (("BLOCK", block), ("STRETCH", stretch), ("IDS", ids)):
        monkeypatch.setattr(T, name, value)
    rows = conversations()
    rows = [x for x in rows if x[0] != 2000] + [(2000, None, "user", "first", "", "", ""), (2000, 0, None, None, "", "", ""), (2000, 1, "user", "one", "", "", "")]
    got = sorted(str(tuple(r[c] for c in COLUMNS)) for r in T.rebuilt_trie(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())
    assert got == brute(rows)


def test_ties_and_nothing(spark):
    rows = [(2000, 1, "user", None), (2000, 1, None, "tie"), (2000, 1, "user", None)] * 2
    df = spark.createDataFrame([r + ("", "", "") for r in rows], SCHEMA)
    first, second = ([tuple(r) for r in T.rebuilt_trie(df.repartition(n)).orderBy("depth").collect()] for n in (1, 4))
    assert first == second and len(first) > 1
    assert T.rebuilt_trie(df.limit(0)).count() == 0
    assert T.rebuilt_trie(df.limit(0)).columns == COLUMNS
    assert T.rebuilt_trie(spark.createDataFrame([(None, 1, "a", "b", "", "", "")], SCHEMA)).count() == 0


def test_one_conversation_is_many_ranges(spark):
    from driftline.llm.common import Store
    df = spark.range(20000, numPartitions=8).selectExpr("7L AS conv_id", "id AS turn", "'user' AS role", "concat('t', id) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows, parts = T.placed(T.turns(df), Store(spark))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts.count() > 1 and [r["pos"] for r in rows.select("pos").orderBy("pos").collect()] == list(range(20000))
