"""The chunked model against the recursions over whole sequences."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.config import RunConfig
from driftline.operators import hmm as H

K, D, N = 3, 2, 500


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    a = np.array([[.95, .03, .02], [.04, .92, .04], [.02, .08, .9]])
    rows = []
    for s in ("a|b", "c"):
        st = 0
        for t in range(N):
            st = rng.choice(K, p=a[st])
            rows.append((s, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=5 * t), t,
                         *(rng.normal(size=D) * (0.3 + 0.5 * st) + [st * 2 - 2, st])))
    pdf = pd.DataFrame(rows, columns=["series_id", "ts", "idx", "x", "y"])
    return pdf, spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def whole(pdf, r):
    x = pdf[["x", "y"]].to_numpy()[None]
    a = lambda c, *s: np.asarray(r[c]).reshape((1,) + s)
    logb = H.log_density(x, a("means", K, D), a("covars", K, D, D))
    gamma, pairs, alpha, ll = H.forward_backward(
        logb, a("start", K), a("trans", K, K), np.array([True]), np.full((1, K), 1 / K), np.ones((1, K)))
    la = np.log(np.maximum(a("trans", K, K)[0], 1e-300))
    v, back = np.log(np.maximum(a("start", K)[0], 1e-300)) + logb[0, 0], []
    for t in range(1, len(pdf)):
        c = v[:, None] + la
        back.append(c.argmax(0))
        v = c.max(0) + logb[0, t]
    path = [v.argmax()]
    for b in reversed(back):
        path.append(b[path[-1]])
    return gamma[0], alpha[0], float(ll[0]), np.array(path[::-1])


def test_fit_and_decode(spark, data, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 64)
    pdf, df = data
    models = df.select("series_id").distinct().withColumns(
        {"seed": F.lit(1).cast("long"), "model_id": F.concat(F.lit("m"), "series_id")})
    ll = []
    for it in (1, 3):
        params = H.fit_gaussian_hmm(df, ["x", "y"], models, K, RunConfig(), max_iter=it)
        ll.append(params.toPandas().set_index("model_id").loglik.sort_index())
    assert (ll[1] > ll[0]).all()
    aligned = H.align_states(params, K, D)
    rows = aligned.withColumn("series_id", F.get_json_object("seq", "$.series_id")).toPandas()
    got = H.decode(H.segments(df, None, 0), ["x", "y"], aligned, K).toPandas()
    assert len(got) == len(pdf)
    for r in rows.to_dict("records"):
        cov = np.asarray(r["covars"]).reshape(K, D, D)
        assert (np.diff(np.trace(cov, axis1=1, axis2=2)) >= 0).all()
        gamma, alpha, _, path = whole(pdf[pdf.series_id == r["series_id"]], r)
        g = got[got.series_id == r["series_id"]].sort_values("ts")
        assert (g.state.to_numpy() == path).all()
        assert np.allclose(np.stack(g.smoothed), gamma, atol=1e-10)
        assert np.allclose(np.stack(g.filtered), alpha, atol=1e-10)

    # Long sequences, chunk by chunk, give the same.
    with monkeypatch.context() as m:
        m.setattr(H, "WHOLE", 0)
        parts = H.decode(H.segments(df, None, 0), ["x", "y"], aligned, K).toPandas().sort_values(["series_id", "ts"])
        m.setattr(H, "FAN", 2)          # and groups of chunks over several levels
        tree = H.decode(H.segments(df, None, 0), ["x", "y"], aligned, K).toPandas().sort_values(["series_id", "ts"])
        paths = H.decode(H.segments(df, None, 0), ["x", "y"], aligned, K, path_only=True).toPandas().sort_values(["series_id", "ts"])
    one = got.sort_values(["series_id", "ts"])
    assert (parts.state.to_numpy() == one.state.to_numpy()).all() and (paths.state.to_numpy() == one.state.to_numpy()).all()
    assert (tree.state.to_numpy() == one.state.to_numpy()).all()
    for other in (parts, tree):
        assert np.allclose(np.stack(other.smoothed), np.stack(one.smoothed), atol=1e-10)

    # The trade part is decoded on its own, with a warm-up that is not reported.
    cut = pdf.ts[300]
    start = df.select("series_id").distinct().withColumn("trade_start", F.lit(str(cut)).cast("timestamp_ntz"))
    seg = H.decode(H.segments(df, start, 50), ["x", "y"], aligned, K).toPandas()
    assert len(seg) == len(pdf) and seg.groupby("seg").size().to_dict() == {0: 600, 1: 400}
    r = rows.to_dict("records")[0]
    own = pdf[pdf.series_id == r["series_id"]]
    g = seg[seg.series_id == r["series_id"]].sort_values("ts")
    assert (g[g.seg == 0].state.to_numpy() == whole(own[own.ts < cut], r)[3]).all()
    assert (g[g.seg == 1].state.to_numpy() == whole(own.iloc[250:], r)[3][50:]).all()


def test_posterior_metrics(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([1.0, 0.0],)], "smoothed array<double>")
    out = H.posterior_metrics(df, 2).toPandas()
    assert np.allclose(out.stability_score, [0.0, 1.0]) and np.allclose(out.posterior_maxp, [0.5, 1.0])


def test_broken_covariance_turns_diagonal():
    row = {"model_id": "m", "seq": "s", "seed": 1, "start": [0.5, 0.5], "trans": [0.5] * 4, "kind": "full",
           "means": [0.0] * 4, "covars": list(np.tile(np.eye(2).ravel(), 2)), "loglik": 0.0, "done": False, "iters": 0}
    gxx = np.array([[[1.0, 5.0], [5.0, 1.0]]] * 2) * 10      # not a covariance
    row["stats"] = np.concatenate([[1.0], [1, 0], [10, 10], np.zeros(4), gxx.ravel(), np.ones(4)])
    out = H._maximise(row, 2, 2, 1e-3, 1e-2)
    assert out["kind"] == "diag" and H._positive(out["covars"].reshape(2, 2, 2))


def models_of(df, seeds):
    models = df.select("series_id").distinct().withColumn("seed", F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])))
    return models.withColumn("model_id", F.concat_ws("#", "series_id", "seed"))


def test_batches_equal_chunks(spark, data, monkeypatch):
    """Many models in one batch, in several, and in jobs over chunks: the same parameters."""
    _, df = data
    models, got = models_of(df.filter("series_id = 'c' OR idx < 300"), range(5)), []
    rows = df.filter("series_id = 'c' OR idx < 300")
    for chunk, whole, together in ((1024, 64, 1 << 16), (64, 64, 700), (64, 0, 1 << 16), (1024, 64, -1)):
        monkeypatch.setattr(H, "CHUNK", chunk)
        monkeypatch.setattr(H, "WHOLE", whole)
        monkeypatch.setattr(H, "TOGETHER", together if together > 0 else 1 << 16)
        monkeypatch.setattr(H, "MANY", 48 if together > 0 else 1)
        got.append(H.fit_gaussian_hmm(rows, ["x", "y"], models, K, RunConfig(), max_iter=4).toPandas().set_index("model_id").sort_index())
    for other in got[1:]:
        assert list(other.index) == list(got[0].index) and (other.kind == got[0].kind).all() and (other.iters == got[0].iters).all()
        for name in ("start", "trans", "means", "covars"):
            assert np.allclose(np.stack(got[0][name]), np.stack(other[name]), atol=1e-8)
        assert np.allclose(got[0].loglik, other.loglik, atol=1e-6)


def test_models_leave_on_their_own(spark, data):
    """Together or alone, a model takes the same number of steps to the same place."""
    _, df = data
    some = H.fit_gaussian_hmm(df, ["x", "y"], models_of(df, [3, 4]), K, RunConfig()).toPandas().set_index("model_id").sort_index()
    alone = H.fit_gaussian_hmm(df, ["x", "y"], models_of(df, [4]), K, RunConfig()).toPandas().set_index("model_id").sort_index()
    assert some.done.all() and (some.loc[alone.index].iters == alone.iters).all()
    assert np.allclose(some.loc[alone.index].loglik, alone.loglik, atol=1e-6)


@pytest.mark.parametrize("whole", [64, 0])
def test_ladder(spark, monkeypatch, whole):
    """Values too large to square break the full model and the diagonal ones; other values do not."""
    monkeypatch.setattr(H, "WHOLE", whole)
    rng = np.random.default_rng(1)
    n = 80
    big = rng.normal(size=n) * 1e160
    pdf = pd.concat([pd.DataFrame({"series_id": s, "ts": pd.date_range("2024-01-01", periods=n, freq="D"), "x": x, "y": rng.normal(size=n)})
                     for s, x in (("big", big), ("fine", rng.normal(size=n)))])
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = H.fit_gaussian_hmm(df, ["x", "y"], models_of(df, [1]), 2, RunConfig(), max_iter=3).toPandas().set_index("model_id")
    assert got.loc["big#1"].kind == "wide" and got.loc["fine#1"].kind == "full"


def test_each_rung():
    """A model climbs one rung for each break-down and starts from its first parameters; on the last one it stays."""
    first = {"start": np.array([[0.5, 0.5]]), "trans": np.full((1, 2, 2), 0.5), "means": np.array([[[1.0], [2.0]]]), "covars": np.full((1, 2, 1, 1), 0.05)}
    model = {**{n: v + 1 for n, v in first.items()}, "kind": np.array([0]), "loglik": np.array([3.0]), "done": np.array([False]), "iters": np.array([7])}
    stats = np.full((1, 1 + 2 + 2 + 2 + 2 + 4), np.nan)
    for kind, floor in ((1, 0.05), (2, 0.1)):
        H._maximise_all(model, first, stats, 1e-3, 1e-2)
        assert model["kind"][0] == kind and model["iters"][0] == 0 and model["loglik"][0] == -np.inf and not model["done"][0]
        assert (model["means"] == first["means"]).all() and np.allclose(model["covars"], floor)
    H._maximise_all(model, first, stats, 1e-3, 1e-2)
    assert model["kind"][0] == 2 and model["done"][0]


def test_sampled_rows(spark, data, monkeypatch):
    """The rows that start a model are those of the least hashes, whatever the chunks."""
    monkeypatch.setattr(H, "CHUNK", 50)
    pdf, df = data
    models = models_of(df, [1, 9]).withColumn("seq", H.sequence_key(["series_id"]))
    got = H.sampled_rows(H.chunk_rows(df, ["x", "y"]), models, K, 2).toPandas()
    for r in models.toPandas().to_dict("records"):
        own = pdf[pdf.series_id == r["series_id"]]
        second = own.ts.astype("datetime64[us]").astype("int64").to_numpy() // 1_000_000
        best = np.argsort(H.mix32(H.mix32(second) ^ H.mix32(r["seed"])))[:K]
        mine = got[got.model_id == r["model_id"]].sort_values("place")
        assert np.allclose(np.stack(mine.v), own[["x", "y"]].to_numpy()[best])
