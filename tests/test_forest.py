"""Forests of many groups: both ways of growing give the same trees; trees against plain code; they learn."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.operators import forest as T

FEATURES = [f"f{i}" for i in range(9)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    parts = []
    for g, n in (("a", 900), ("b", 400), ("small", 30), ("flat", 200)):
        x = rng.normal(size=(n, 9))
        x[:, 3] = np.round(x[:, 3])                    # few different values
        x[:, 4] = np.exp(x[:, 2])                      # the same splits as f2
        y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + 0.5 * x[:, 1] + rng.normal(size=n) * 0.2 if g != "flat" else np.full(n, 1.5)
        pdf = pd.DataFrame(x, columns=FEATURES).assign(g=g, y=y, ts=pd.date_range("2024-01-01", periods=n, freq="30min"))
        parts.append(pdf)
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).cache()


def nodes(forests):
    rows = forests.select("g", F.explode(F.arrays_zip("node", "feature", "threshold", "value")).alias("n")).select("g", "n.*")
    return rows.toPandas().sort_values(["g", "node"]).reset_index(drop=True)


def fit(df, trees=12, depth=4, leaf=10):
    return T.fit_forests(df, "g", "y", FEATURES, trees, depth, leaf, 7, 100)


def test_levels_equal_whole(data, monkeypatch):
    _, df = data
    one = nodes(fit(df))
    monkeypatch.setattr(T, "CHUNK", 64)
    monkeypatch.setattr(T, "WORK", 2000)
    parts = nodes(fit(df))
    monkeypatch.setattr(T, "WHOLE", 0)
    levels = nodes(fit(df))
    assert set(one.g) == {"a", "b", "flat"}
    for other in (parts, levels):
        pd.testing.assert_frame_equal(one, other, check_exact=False, rtol=1e-9, atol=1e-12)
    assert (one[one.g == "flat"].feature == -1).all() and np.allclose(one[one.g == "flat"].value, 1.5)


def plain_tree(pdf, tree, seed, depth, leaf):
    """Places -> (feature, threshold, value) of one tree, by lists and loops."""
    second = pdf.ts.astype("datetime64[us]").astype("int64").to_numpy() // 1_000_000
    w = T.row_weights(second, [tree], seed)[0]
    y = ((pdf.y - pdf.y.mean()) / pdf.y.std(ddof=0)).to_numpy()
    n = len(pdf)
    cuts = [sorted({np.sort(pdf[f].to_numpy())[math.ceil(i / 32 * n) - 1] for i in range(1, 32)}) for f in FEATURES]
    out = {}

    def grow(place, rows, level):
        total = w[rows].sum()
        out[place] = [-1, 0.0, pdf.y.mean() + pdf.y.std(ddof=0) * (w[rows] * y[rows]).sum() / total]
        best = (0.0,)
        if level == depth:
            return
        for j in T.node_features([tree], [place], len(FEATURES), seed)[0, 0]:
            x = pdf[FEATURES[j]].to_numpy()[rows]
            for c in cuts[j]:
                left, right = rows[x <= c], rows[x > c]
                if min(w[left].sum(), w[right].sum()) >= leaf:
                    score = lambda r: (w[r] * y[r]).sum() ** 2 / w[r].sum()
                    gain = round(score(left) + score(right) - score(rows), 6)
                    if gain > best[0]:
                        best = (gain, j, c, left, right)
        if best[0] > 0:
            out[place][:2] = best[1:3]
            grow(2 * place + 1, best[3], level + 1)
            grow(2 * place + 2, best[4], level + 1)

    grow(0, np.arange(n), 0)
    return out


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_trees_against_plain_code(data, depth):
    pdf, df = data
    got = nodes(fit(df, 3, depth))
    for g in ("a", "b"):
        rows = got[got.g == g]
        for tree in range(3):
            mine = rows[rows.node // T.nodes_of(depth) == tree]
            want = plain_tree(pdf[pdf.g == g].reset_index(drop=True), tree, 7, depth, 10)
            assert dict(zip(mine.node % T.nodes_of(depth), mine.feature)) == {p: v[0] for p, v in want.items()}
            assert np.allclose(mine.sort_values("node").threshold, [want[p][1] for p in sorted(want)])
            assert np.allclose(mine.sort_values("node").value, [want[p][2] for p in sorted(want)])


def test_predictions(data, monkeypatch):
    pdf, df = data
    forests = fit(df, 60, 5)
    rows = df.withColumn("more", F.when(F.col("f1") > 0, F.lit(3)))
    whole = T.predict_forests(rows, forests, "g", FEATURES, 5).toPandas()
    assert len(whole) == 1500 and set(whole.columns) == {*pdf.columns, "more", "pred"}
    for g in ("a", "b"):
        own = whole[whole.g == g]
        assert np.corrcoef(own.y, own.pred)[0, 1] > 0.9
    monkeypatch.setattr(T, "ASKED", 50)
    cut = T.predict_forests(rows, forests, "g", FEATURES, 5).toPandas()
    key = ["g", "ts"]
    assert np.allclose(whole.sort_values(key).pred, cut.sort_values(key).pred)
    few = nodes(forests).query("g == 'b'")
    x = pdf[pdf.g == "b"][FEATURES].to_numpy()
    trees = {n: (f, t, v) for n, f, t, v in zip(few.node, few.feature, few.threshold, few.value)}

    def one(row, tree):
        place = 0
        while (f := trees[tree * 63 + place][0]) >= 0:
            place = 2 * place + 1 + (row[f] > trees[tree * 63 + place][1])
        return trees[tree * 63 + place][2]

    want = [np.mean([one(r, t) for t in range(60)]) for r in x[:40]]
    assert np.allclose(whole[whole.g == "b"].sort_values("ts").pred[:40], want)


def test_no_group_is_large_enough(spark, data):
    _, df = data
    none = T.fit_forests(df, "g", "y", FEATURES, 5, 2, 5, 7, 10 ** 6)
    assert none.count() == 0 and T.predict_forests(df, none, "g", FEATURES, 2).count() == 0


def test_weights_are_poisson():
    w = T.row_weights(np.arange(0, 300 * 2000, 300), np.arange(40), 42)
    share = np.bincount(w.ravel(), minlength=5)[:5] / w.size
    assert np.allclose(share, [math.exp(-1) / math.factorial(i) for i in range(5)], atol=0.01)
    assert abs(np.corrcoef(w)[np.triu_indices(40, 1)]).mean() < 0.03
