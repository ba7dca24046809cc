"""Queries without an SQL counterpart: model fitting and whole runs.

They work on the whole tables and all cycles, and models are fitted until they converge. Sweeps and forests have the
default seeds, trees and limits. What they are made of has SQL beside it in `q_models`, `q_walk` and `q_trading`.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import blocks as K
from ..operators import calendar as C
from ..operators import forecast as M
from ..operators import hmm as H
from ..operators import indicators as I
from ..sources import readers as R
from . import runs as U
from .q_bars import daily_bars, events_bars
from .registry import long, query, rounded, time_text

# Shorter windows and fewer states than the defaults: the events cover 30 days, so the
# daily timeframe has 30 bars.
SMALL = replace(
    RunConfig(), ma_fast=5, ma_slow=10, vol_short=5, vol_long=10, n_states=3, k_super=3, min_count_30m=1,
    history_start="2024-01-01 00:00:00", n_trees=10, min_leaf=5, min_train_rows=50, min_test_rows=10,
    min_ic=-1.0, min_r2=-1e9, stability_min=0.0, clamp_run_max=1.0, clamp_switch_min=1.0, exhaustion_min=0.0,
    exhaustion_max=1e9, step_days=5, min_trades_eval=1, min_active_eval=1, max_dd_eval=1.0, max_coverage_eval=1.0)
ITERATIONS = None
# The sweeps: shorter windows as well, but states, trees, seeds and limits as by default.
WINDOWS = ("ma_fast", "ma_slow", "vol_short", "vol_long", "min_count_30m", "history_start", "step_days")
FULL = replace(RunConfig(), **{name: getattr(SMALL, name) for name in WINDOWS})


def daily_features(spark, folder):
    return I.make_features(daily_bars(spark, folder), RunConfig(), "1d", rows_per_day=1)


@query("hmm_regimes")
def hmm_regimes(spark, folder):
    """Six regimes per series on daily features, decoded up to a trade window and in it."""
    rows = daily_features(spark, folder).withColumn("trade_start", F.lit("2000-06-01").cast("timestamp_ntz"))
    rows = K.stage(rows, "features")
    models = rows.select("series_id").distinct().withColumns(
        {"seed": F.lit(52).cast("long"), "model_id": F.col("series_id")})
    labels, _ = U.regimes(rows, U.BASE_FEATURES, models, 6, RunConfig(), ["series_id"], F.lit(60), 200, ITERATIONS, 1)
    out = H.posterior_metrics(labels, 6)
    return out.select("series_id", time_text().alias("ts"), long("state").alias("state"),
                      *rounded(4, "posterior_maxp", "posterior_entropy", "stability_score", "mixed_signals"))


@query("hmm_models")
def hmm_models(spark, folder):
    """Log likelihood and state frequencies of two seeds per series."""
    rows = daily_features(spark, folder).withColumn("trade_start", F.lit(None).cast("timestamp_ntz"))
    rows = K.stage(rows, "features")
    models = rows.select("series_id").distinct().withColumn("seed", F.explode(F.array(F.lit(5).cast("long"), F.lit(18).cast("long"))))
    models = models.withColumn("model_id", F.concat_ws("|", "series_id", "seed"))
    _, params = U.regimes(rows, U.BASE_FEATURES, models, 4, RunConfig(), ["series_id"], F.lit(60), 200, ITERATIONS, 1)
    return params.select("model_id", "kind", long("iters").alias("iters"), *rounded(3, "loglik"))


@query("super_regimes")
def super_regimes(spark, folder):
    """Three timeframes of events: base regimes, overlay, second-level regimes, path metrics."""
    feats = U.feature_tables(events_bars(spark, folder, "5 minutes"), SMALL, U.BASE_FEATURES)
    t = lambda text: F.lit(text).cast("timestamp_ntz")
    runs = feats.select("series_id").distinct().select(
        "series_id", F.lit(0).alias("cycle_no"), F.lit("run").alias("run_id"), F.lit(52).alias("rs_5m"),
        F.lit(53).alias("rs_30m"), F.lit(54).alias("rs_1d"), t("2024-01-22 09:35:00").alias("trade_start"),
        t("2024-01-30 15:00:00").alias("trade_end"), t("2024-01-30 15:00:00").alias("data_end"))
    table = U.label_runs(feats, runs, SMALL, ITERATIONS)
    return table.select("series_id", time_text().alias("ts"), long("super_state").alias("super_state"), "overlay_tuple",
                        *rounded(4, "stability_score", "avg_run_local", "exhaustion_ratio", "switch_rate_local"))


@query("forecast_by_state")
def forecast_by_state(spark, folder):
    """A forest per quantile state on daily features; validation metrics per state."""
    from ..operators.labels import quantile_states
    cfg = replace(RunConfig(), history_start="1995-01-01 00:00:00", trade_days=200)
    names = tuple(c for c in U.FORECAST_FEATURES if c in I.INDICATORS) + ("ma_gap",)
    feats = K.stage(daily_features(spark, folder).drop("idx"), "features")
    rows = quantile_states(feats, "log_ret_1", 6, "super_state", rows_per_day=1)
    rows = M.forward_label(K.position_bars(rows, 1), cfg.horizon, "y")
    rows = K.stage(M.forecast_features(rows, names, keep=("y",)), "rows")
    split = K.stage(M.time_split(rows, M.last_days_window(rows, cfg.trade_days), cfg, rows_per_day=1), "split")
    models = M.fit_per_state(split.filter("split = 'train'"), "y", cfg, names)
    pred = M.predict_per_state(split.filter("split = 'validation'"), models, names, cfg=cfg)
    m = M.regression_metrics(pred, "y", "pred")
    return m.select(long("super_state").alias("super_state"), "test_n", *rounded(4, "rmse", "mae", "r2", "ic"))


def event_windows(spark, folder):
    days = C.trading_days(R.ticks_events(spark, folder))
    return C.walk_forward_windows(days, SMALL.step_days)


@query("sweep")
def sweep(spark, folder):
    """All seed triplets evaluated in every cycle, with the selector's tier flags."""
    from ..operators import walkforward as W
    bars = K.stage(events_bars(spark, folder, "5 minutes"), "bars")
    # The other indicators need up to 60 bars, more than the daily timeframe has.
    evals, _ = U.sweep(bars, event_windows(spark, folder), FULL, None, ITERATIONS, U.BASE_FEATURES)
    out = W.robust_score(W.candidate_tiers(evals, FULL), FULL)
    return out.select("series_id", long("cycle_no").alias("cycle_no"), "run_id", "strict", "relaxed", "engine_ok", "engine_err", "fit_fallback",
                      *[long(c).alias(c) for c in ("eval_trades", "eval_active_bars")],
                      *rounded(4, "eval_sharpe_daily", "eval_max_dd", "eval_gate_coverage", "robust_score"))


@query("walk_forward")
def walk_forward(spark, folder):
    """All cycles and seed triplets: selection, trading of the next window, compounding."""
    bars = K.stage(events_bars(spark, folder, "5 minutes"), "bars")
    _, curve, _, _ = U.walk_forward(bars, event_windows(spark, folder), FULL, None, ITERATIONS, U.BASE_FEATURES)
    return curve.select("series_id", time_text().alias("ts"), long("cycle_no").alias("cycle_no"), *rounded(6, "eq_global"))
