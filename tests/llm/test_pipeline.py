import random

import corpus_pipeline
from driftline.llm import quality
from driftline.llm.common import Store
from tests.llm import brute
from tests.llm.conftest import prose
from tests.llm.test_models import corpus

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_run_matches_brute_force(spark, tmp_path):
    r = random.Random(9)
    items = [(i, prose(30, 50 + i)) for i in range(5)]
    rows = [(x[0], x[1], x[2], x[3], len(x[1])) for x in corpus(200)]
    for i in range(20):
        t = rows[r.randrange(200)][1]
        rows.append((1000 + i, t if i % 2 else t + " extra", "en", "s1", len(t)))
    for i, t in items:
        text = f"{prose(60, 700 + i)} {t} {prose(10, 800 + i)}"
        rows.append((2000 + i, text, "en", "s2", len(text)))
    rows += [(3000, prose(50, 901) + " password=hunter22 end", "en", "s2", 1), (3001, None, None, None, None), (3002, "", "en", "s2", 0)]
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = spark.createDataFrame([(x[0], 1 - x[4], 0) for x in corpus(200) if x[0] % 2], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    good = {x["doc_id"] for x in quality.posteriors(docs, labels, Store(spark)).where("kept").collect()}
    left = [(d, t) for d, t, *_ in rows if d in good]
    names = brute.components(left)
    left = [(d, t) for d, t in left if names[(d, t)][1] == d]
    left = [(d, t) for d, t in left if not brute.held_items(t, items)]
    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(d for d, _ in left)
    assert all(x["round_trip"] for x in got.values()) and got[3001]["n_tokens"] == got[3002]["n_tokens"] == 0
    assert not {2000, 2001, 2002, 2003, 2004} & set(got)


def test_stages_keep_columns_and_awkward_rows(spark, awkward, tmp_path):
    awkward.limit(0).select("doc_id").selectExpr("doc_id", "1 AS quality", "0 AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(30, 50))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (awkward, awkward.limit(0)):
        docs, store = start, Store(spark)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = store.put(stage(spark, docs, str(tmp_path)))
            assert docs.columns == awkward.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
