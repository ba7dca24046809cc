"""Path statistics and exits against row-by-row restatements of the rules."""

import json
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.config import RunConfig
from driftline.operators import blocks as K
from driftline.operators import paths as P
from driftline.operators import trading as G
from driftline.streaming import paths as SP


def label_table(n=2500, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for s, stay in (("calm", 0.97), ("busy", 0.3), ("still", 1.0)):
        state = [0]
        for _ in range(n - 1):
            state.append(state[-1] if rng.random() < stay else int(rng.integers(0, 7)))
        out.append(pd.DataFrame({"series_id": s, "ts": pd.date_range("2024-01-01", periods=n, freq="5min"),
                                 "idx": np.arange(n), "state": state}))
    return pd.concat(out, ignore_index=True)


def by_rule(labels, cfg):
    st, out = SP.new_state(), []
    for s in labels:
        out.append(SP.advance(st, int(s), cfg))
    return pd.DataFrame(out, columns=["run_len_so_far", "avg_run_local", "exhaustion_ratio", "switch_rate_local"])


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@pytest.mark.parametrize("prior", [True, False])
def test_path_metrics(spark, monkeypatch, prior):
    monkeypatch.setattr(K, "BLOCK", 256)       # runs and windows cross many blocks
    cfg = replace(RunConfig(), use_prior=prior)
    pdf = label_table()
    df = to_spark(spark, pdf)
    got = P.path_metrics(df, "state", cfg).toPandas().sort_values(["series_id", "idx"])
    for s, g in got.groupby("series_id"):
        want = by_rule(pdf[pdf.series_id == s]["state"], cfg)
        for c in want.columns:
            assert np.allclose(g[c].astype(float), want[c].astype(float), equal_nan=True), (s, c)


def test_seed_continues(spark):
    cfg = RunConfig()
    pdf = label_table(600)
    head = to_spark(spark, pdf[pdf.idx < 400])
    seeds = {r["series_id"]: r["seed"] for r in P.path_seed(P.with_runs(head), "state", cfg).collect()}
    for s, g in pdf.groupby("series_id"):
        want = by_rule(g["state"], cfg).iloc[400:].astype(float).to_numpy()
        st = SP.from_seed(seeds[s])
        got = np.array([SP.advance(st, int(x), cfg) for x in g["state"].iloc[400:]], dtype=float)
        assert np.allclose(got, want)
        assert json.loads(seeds[s])["seed_n"] == 400


def random_bars(n, seed):
    rng = np.random.default_rng(seed)
    close = np.round(100 + np.cumsum(rng.normal(size=n)), 2)
    return pd.DataFrame({
        "series_id": f"s{seed}", "ts": pd.date_range("2024-01-01", periods=n, freq="5min"), "idx": np.arange(n),
        "close": close, "high": close + rng.random(n).round(2), "low": close - rng.random(n).round(2),
        "atr_14": 0.4 + rng.random(n), "gate_on": True,
        "entry_signal": rng.choice([-1.0, 0.0, 1.0], n, p=[0.25, 0.5, 0.25])})


def walk(b, cfg):
    """Bar by bar: the open trade is judged first, then the bar's signal."""
    trades, held, pos = [], None, np.zeros(len(b))
    for i in range(len(b) - 1):
        r = b.iloc[i]
        if held is not None:
            d, e = held
            px, atr = b.close[e], b.atr_14[e]
            stop, take = px - d * cfg.stop_mult * atr, px + d * cfg.take_mult * atr
            reason = None
            if i - e >= cfg.horizon:
                reason, out = "time_exit", r.close
            elif (r.low <= stop) if d > 0 else (r.high >= stop):
                reason, out = "stop_loss", stop
            elif (r.high >= take) if d > 0 else (r.low <= take):
                reason, out = "take_profit", take
            elif r.entry_signal == -d:
                reason, out = "signal_flip", r.close
            if reason:
                trades.append((e, i, d, out, reason))
                held = None
        if held is None and r.entry_signal != 0:
            held = (r.entry_signal, i)
        pos[i] = held[0] if held else 0.0
    pos[-1] = held[0] if held else 0.0
    return trades, pos


@pytest.mark.parametrize("horizon", [1, 4])
def test_exits_and_chain(spark, monkeypatch, horizon):
    monkeypatch.setattr(G, "CHAIN_BLOCK", 16)
    cfg = replace(RunConfig(), horizon=horizon, stop_mult=1.0, take_mult=1.5)
    bars = [random_bars(n, s) for s, n in ((1, 400), (2, 37), (3, 5), (4, 1))]
    df = to_spark(spark, pd.concat(bars, ignore_index=True))
    chain = K.stage(G.non_overlapping_trades(G.first_touch_exit(df, cfg), horizon))
    rows = chain.toPandas()
    held = G.positions_from_trades(df, chain).toPandas().sort_values(["series_id", "idx"])
    for b in bars:
        s = b.series_id[0]
        trades, pos = walk(b, cfg)
        got = rows[(rows.series_id == s) & rows.exit_idx.notna()].sort_values("idx")
        assert [(r.idx, int(r.exit_idx), r.dir, r.exit_reason) for r in got.itertuples()] == [
            (e, i, d, why) for e, i, d, _, why in trades]
        assert np.allclose(got.exit_px, [t[3] for t in trades])
        assert np.array_equal(held[held.series_id == s].position, pos)


def test_degenerate_barriers_leave_after_one_bar(spark):
    b = random_bars(120, 7)
    preds = b[["series_id", "ts", "gate_on"]].assign(pred=b.entry_signal)
    _, trades = G.backtest(to_spark(spark, b.drop(columns=["gate_on", "entry_signal"])), to_spark(spark, preds),
                           RunConfig(), barriers="degenerate")
    t = trades.filter("exit_idx IS NOT NULL").toPandas()
    assert len(t) and ((t.exit_idx - t.idx) == 1).all() and np.allclose(t.exit_px, t.entry_px)


def test_empty_good_list_closes_the_gate(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 5.0, 0.1, 1.0)],
                               "series_id string, super_state int, stability_score double, avg_run_local double, "
                               "switch_rate_local double, exhaustion_ratio double")
    none = df.select("super_state").limit(0)
    th = G.gate_thresholds(df, none, RunConfig())
    assert G.gate_mask(df, th).filter("gate_on").count() == 0


def test_chain_by_tree(spark, monkeypatch):
    """Maps composed a few at a time over several levels: the trades of a plain walk, also across blocks without signals."""
    rng = np.random.default_rng(5)
    horizon, rows, want = 30, [], set()
    for s, n, share in (("dense", 900, 0.5), ("sparse", 3000, 0.01), ("open", 700, 0.3), ("one", 1, 1.0)):
        free = 0
        for i in np.flatnonzero(rng.random(n) < share):
            leave = int(i + rng.integers(1, horizon + 1)) if s != "open" or i < 500 else None
            rows.append((s, int(i), leave))
            if free is not None and i >= free:
                want.add((s, int(i)))
                free = leave
    signals = spark.createDataFrame(rows, "series_id string, idx long, exit_idx long")
    monkeypatch.setattr(G, "CHAIN_BLOCK", 4)
    for fan in (2, 5, 1024):
        monkeypatch.setattr(G, "CHAIN_FAN", fan)
        got = G.non_overlapping_trades(signals, horizon).toPandas()
        assert set(zip(got.series_id, got.idx)) == want and len(got) == len(want)
