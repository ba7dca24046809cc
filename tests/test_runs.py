"""A whole run on one synthetic series: labels, forecasts, equity, pack."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from driftline.plans import runs as U
from driftline.plans.q_runs import SMALL
from driftline.sources import writers as S
from tests.test_paths_trading import to_spark


def test_one_run(spark, tmp_path):
    n = 30 * 288
    rng = np.random.default_rng(3)
    close = 100 * np.exp(np.cumsum(rng.normal(size=n) * (0.001 + 0.002 * (np.arange(n) // 700 % 2))))
    pdf = pd.DataFrame({"series_id": "x", "ts": pd.date_range("2024-01-01 00:05", periods=n, freq="5min"),
                        "open": close, "high": close * 1.001, "low": close * 0.999, "close": close,
                        "volume": rng.integers(1, 50, n).astype(float)})
    t = lambda v: F.lit(v).cast("timestamp_ntz")
    runs = spark.createDataFrame([("x", 0, "run", 5, 7, 11)],
                                 "series_id string, cycle_no int, run_id string, rs_5m long, rs_30m long, rs_1d long")
    runs = runs.withColumns({"trade_start": t("2024-01-24 09:35:00"), "trade_end": t("2024-01-29 15:00:00"),
                             "data_end": t("2024-01-29 15:00:00")})
    feats = U.feature_tables(to_spark(spark, pdf), SMALL, U.BASE_FEATURES)
    parameters = {}
    table = U.label_runs(feats, runs, SMALL, 2, parameters)
    got = table.toPandas()
    assert got.ts.max() == pd.Timestamp("2024-01-29 15:00:00") and got.super_state.between(0, 2).all()
    assert (got.run_len_so_far >= 1).all() and (got.avg_run_local >= 1).all()
    assert got.stability_score.between(-1e-9, 1 + 1e-9).all() and got.switch_rate_local.dropna().between(0, 1).all()
    assert not got.duplicated(["series_id", "ts"]).any()

    stats, equity, trades, pack = U.forecast_runs(table, runs, SMALL)
    s = stats.toPandas().iloc[0]
    eq = equity.toPandas().sort_values("idx")
    assert (eq.equity > 0).all() and np.isclose(s.final_equity, eq.equity.iloc[-1])
    assert s.n_trades == trades.filter("exit_idx IS NOT NULL").count() and s.max_drawdown <= 0
    assert s.active_bars == (eq.position != 0).sum()

    folder = str(tmp_path / "pack")
    U.export_pack(folder, table, pack, parameters, SMALL)
    assert S.read_pack(spark, folder, "base_models").count() == 3
    assert S.read_pack(spark, folder, "super_models").count() == 1
    assert S.read_pack(spark, folder, "path_seed").count() == 1


def test_registered_runs_are_whole(monkeypatch):
    from dataclasses import fields
    from unittest.mock import MagicMock

    import pytest

    from driftline.config import RunConfig
    from driftline.plans import q_runs

    class Stop(Exception):
        pass

    for name in ("K", "M", "U", "daily_features", "events_bars", "event_windows"):
        monkeypatch.setattr(q_runs, name, MagicMock())
    monkeypatch.setattr("driftline.operators.labels.quantile_states", MagicMock())
    q_runs.U.sweep.side_effect = q_runs.U.walk_forward.side_effect = q_runs.M.fit_per_state.side_effect = Stop
    usual = RunConfig()

    def shortened(cfg):
        return {f.name for f in fields(cfg) if getattr(cfg, f.name) != getattr(usual, f.name)}

    for run, called in ((q_runs.sweep, q_runs.U.sweep), (q_runs.walk_forward, q_runs.U.walk_forward)):
        with pytest.raises(Stop):
            run(None, None)
        cfg, seeds = called.call_args[0][2:4]
        assert shortened(cfg) <= set(q_runs.WINDOWS) and (seeds or cfg.n_sweeps) == usual.n_sweeps
    with pytest.raises(Stop):
        q_runs.forecast_by_state(None, None)
    assert shortened(q_runs.M.fit_per_state.call_args[0][2]) <= {"history_start", "trade_days"}


def _bars(spark, days, series=("x",)):
    n = days * 288
    rng = np.random.default_rng(7)
    parts = []
    for name in series:
        close = 100 * np.exp(np.cumsum(rng.normal(size=n) * 0.002))
        parts.append(pd.DataFrame({"series_id": name, "ts": pd.date_range("2024-01-01 00:05", periods=n, freq="5min"),
                                   "open": close, "high": close, "low": close, "close": close, "volume": 1.0}))
    return to_spark(spark, pd.concat(parts))


def test_cycles_without_a_selected_run_are_flat(spark, monkeypatch):
    """No run is traded where none is selected: the curve is the flat one, and no model is fitted for it."""
    from driftline.operators import calendar as C

    bars = _bars(spark, 7)
    windows = C.walk_forward_windows(C.trading_days(bars), 2)
    evals = windows.select("series_id", "cycle_no").selectExpr(
        "*", "0 AS sweep_i", "'S000' AS run_id", "1 AS rs_5m", "2 AS rs_30m", "3 AS rs_1d", "cast(null AS double) AS eval_sharpe_daily",
        "0D AS eval_max_dd", "0L AS eval_trades", "0L AS eval_active_bars", "cast(null AS double) AS eval_gate_coverage",
        "true AS engine_ok", "cast(null AS string) AS engine_err", "true AS fit_fallback")

    def refuse(*args, **more):
        raise AssertionError("nothing was selected")

    monkeypatch.setattr(U, "sweep", lambda *args, **more: (evals, None))
    monkeypatch.setattr(U, "feature_tables", lambda *args, **more: None)
    monkeypatch.setattr(U, "label_runs", refuse)
    monkeypatch.setattr(U, "forecast_runs", refuse)
    picked, curve, _, debug = U.walk_forward(bars, windows, SMALL)
    inside = bars.select("ts").toPandas().ts.sort_values()
    wins = windows.toPandas()
    times = [t for t in inside if ((wins.trade_start <= t) & (t <= wins.trade_end)).any()]
    got = curve.toPandas().sort_values("ts")
    assert len(wins) >= 2 and got.ts.to_list() == times and (got.eq_global == 1.0).all()
    assert picked.count() == 0 and debug.count() == 0


def test_regimes_number_their_rows_once(spark, monkeypatch):
    """The places found for the scaled rows serve to fit and to decode, and come out with the labels."""
    from driftline.config import RunConfig
    from driftline.operators import hmm as H

    written = []

    def noted(stage):
        def run(df, name="stage"):
            if not getattr(df, "_staged", False):
                written.append(name)
            return stage(df, name)
        return run

    rng = np.random.default_rng(1)
    n = 400
    pdf = pd.concat([pd.DataFrame({"series_id": s, "ts": pd.date_range("2024-01-01", periods=n, freq="30min"),
                                   "a": rng.normal(size=n) * (1 + np.arange(n) // 50 % 2), "b": rng.normal(size=n)}) for s in ("x", "y")])
    cuts = F.when(F.col("series_id") == "x", F.lit("2024-01-07 12:00:00")).otherwise(F.lit("2024-01-01 05:00:00"))
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("trade_start", cuts.cast("timestamp_ntz"))
    models = df.select("series_id").distinct().withColumns({"seed": F.lit(5).cast("long"), "model_id": F.col("series_id")})
    segments = []
    decode = H.decode
    monkeypatch.setattr(H, "stage", noted(H.stage))
    monkeypatch.setattr(U, "stage", noted(U.stage))
    monkeypatch.setattr("driftline.operators.blocks.stage", noted(U.stage))
    monkeypatch.setattr(H, "decode", lambda segs, *more: segments.append((segs, more)) or decode(segs, *more))
    labels, _ = U.regimes(df, ("a", "b"), models, 2, RunConfig(), ["series_id"], F.lit(20), 100, 3, 48)
    assert not {"sequence", "bars", "placed"} & set(written)

    got = labels.toPandas().sort_values(["series_id", "ts"])
    assert len(got) == 2 * n and got.idx.to_list() == 2 * list(range(n))
    # Segments that are numbered by themselves are decoded the same, also where the warm-up is longer than the history (y).
    segs, more = segments[0]
    own = decode(segs.drop("pos", "idx"), *more).toPandas().sort_values(["series_id", "ts"])
    assert own.seg.to_list() == got.seg.to_list() and own.state.to_list() == got.state.to_list()
    assert np.allclose(np.stack(own.smoothed), np.stack(got.smoothed), atol=1e-12)
