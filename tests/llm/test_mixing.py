"""Mixing: targets and sizes against plain code and SQL, the tree against its quotas and the distribution it draws from."""

import collections
from math import comb

import duckdb
import pytest
from pyspark.sql import functions as F

from driftline.llm import mixing as M
from driftline.llm.common import Store, read
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def shares(sizes):
    """Targets of sources given in order: by weight, none above three times its size."""
    weight = {s: i % 3 + 1 for i, s in enumerate(sizes)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(w for s, w in weight.items() if s not in capped)
        share = (total - sum(3 * sizes[s] for s in capped)) / free if free else 0
        more = {s for s in sizes if s not in capped and weight[s] * share > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in capped else weight[s] * share for s in sizes}
        capped |= more


def checked(rows, got):
    """`got` is right for `rows` of (doc_id, text, source)."""
    size = collections.Counter()
    for _, text, source in rows:
        size[source] += len(brute.words(text))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    target = shares({s: size[s] for s in order})
    want = sorted(str((d, len(brute.words(t)), size[s], round(float(target[s]), 6))) for d, t, s in rows)
    assert sorted(str((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6))) for r in got) == want
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    taken, sizes = collections.Counter(), collections.Counter()
    for r in got:
        taken[r["target"], r["source_size"]] += r["taken"]
    for s in order:
        sizes[float(target[s]), size[s]] += int(target[s] + 0.5)
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in sizes.items() if v}


@pytest.mark.parametrize("sizes", [{}, {"block_words": 16, "shard_blocks": 5}])
def test_awkward_table(spark, awkward, sizes):
    more = awkward.where("doc_id = 11").select("text", F.lit("").alias("source"), F.lit(50).cast("long").alias("doc_id"))
    table = awkward.unionByName(more, allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in table.collect()]
    got = M.taken(table, **sizes).collect()
    checked(rows, got)
    again = M.taken(table.repartition(7), **sizes).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_capped_sources_and_nothing(spark, nothing):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 9}" if i > 20 else "ünï") for i in range(400)] + [(900, "few words", "a tiny one"), (901, "", "no words"), (902, None, "Z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.taken(table, block_words=4, shard_blocks=16).collect()
    checked(rows, got)
    assert next(r for r in got if r["doc_id"] == 900)["taken"] == 6
    assert M.taken(nothing).count() == 0 and M.taken(nothing).columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert [r["taken"] for r in M.taken(table.where("doc_id > 900")).collect()] == [0, 0]


def test_sizes_and_targets_by_sql(spark):
    """The documents of the smallest test table; none of their sources reaches its bound."""
    con = duckdb.connect()
    want = con.execute(f"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM '{FOLDER}/documents.parquet'),
        s AS (SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
        t AS (SELECT *, w * (sum(source_size) OVER () / sum(w) OVER ()) AS target FROM s)
        SELECT doc_id, size, source_size, target, target > 3 * source_size AS above FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source ORDER BY doc_id""").fetchall()
    assert not any(r[4] for r in want)
    got = M.taken(read(spark, FOLDER, "documents")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got] == [(*map(int, r[:3]), round(r[3], 6)) for r in want]


def test_shards(spark):
    table = read(spark, FOLDER, "documents")
    store = Store(spark)
    sources, rows, line, dealt = M.mix(table, store, 64, 50)
    assert not any(p in dealt._jdf.queryExecution().toString() for p in ("Python", "Pandas", "Arrow"))
    quota = {r["source_no"]: r["quota_words"] for r in sources.collect()}
    parts = dealt.collect()
    blocks = {(r["source_no"], r["block"]): (r["shard"], r["place"]) for r in parts}
    assert all((blocks[r["source_no"], r["block"]]) == (r["shard"], r["place"]) for r in parts)     # each block in one place
    held = collections.Counter(s for s, _ in blocks)
    assert held == {s: -(-q // 64) for s, q in quota.items()}
    full = collections.defaultdict(list)
    for shard, place in blocks.values():
        full[shard].append(place)
    assert all(sorted(p) == list(range(len(p))) for p in full.values())
    assert len(full) == -(-sum(held.values()) // 50) and max(map(len, full.values())) - min(map(len, full.values())) <= 1
    words = collections.Counter()
    for r in parts:
        words[r["source_no"], r["block"]] += r["last"] - r["first"] + 1
    assert all(n == min(64, quota[s] - 64 * b) for (s, b), n in words.items())
    texts = M.piece_texts(table, dealt).collect()
    assert len(texts) == len(parts) and all(len(brute.words(r["text"])) > 0 for r in texts)
    whole = {r["doc_id"]: brute.words(r["text"]) for r in table.collect()}
    assert all(" " + r["text"] + " " in " " + " ".join(whole[r["doc_id"]]) + " " for r in texts)


@pytest.mark.parametrize("total,marked,drawn", [(100, 30, 20), (9, 9, 4), (10, 3, 10), (7, 0, 3), (2000, 1900, 1500)])
def test_hypergeometric(spark, total, marked, drawn):
    long = lambda x: F.lit(x).cast("long")
    n = 4000
    got = spark.range(n).select(M.hypergeometric(long(total), long(marked), long(drawn), M.uniform("id")).alias("k")).groupBy("k").count().collect()
    chance = {k: comb(marked, k) * comb(total - marked, drawn - k) / comb(total, drawn)
              for k in range(max(0, drawn - total + marked), min(marked, drawn) + 1)}
    assert all(r["k"] in chance for r in got)
    expected = {k: n * p for k, p in chance.items() if n * p >= 5}
    seen = {r["k"]: r["count"] for r in got}
    chi = sum((seen.get(k, 0) - e) ** 2 / e for k, e in expected.items())
    assert chi < len(expected) + 5 * (2 * len(expected)) ** 0.5 + 1


def test_quotas_with_many_sources(spark, monkeypatch):
    monkeypatch.setattr(M, "GROUP", 4)
    counts = {i: i * i % 13 for i in range(11)}
    quotas = spark.createDataFrame([(k, v) for k, v in counts.items() if v], "source_no long, blocks long")
    out = M.shard_quotas(quotas, Store(spark), 6).collect()
    got, by = collections.Counter(), collections.Counter()
    for r in out:
        got[r["source_no"]] += r["blocks"]
        by[r["shard"]] += r["blocks"]
    assert got == {k: v for k, v in counts.items() if v}
    total = sum(counts.values())
    assert len(by) == -(-total // 6) and set(by.values()) <= {total // len(by), total // len(by) + 1}
