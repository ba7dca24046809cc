"""Whole runs: regimes on three timeframes, overlay, forecasts, gate and equity.

A run is a row of a `runs` table: series_id, cycle_no, run_id, the seeds rs_5m, rs_30m,
rs_1d, and trade_start, trade_end, data_end.  Bars and indicators are computed once for
all runs; every step below handles all runs of all series in the same jobs.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FORECAST_FEATURES, SUPER_FEATURES, RunConfig
from ..operators import forecast as M
from ..operators import hmm as H
from ..operators import indicators as I
from ..operators import labels as L
from ..operators import overlay as O
from ..operators import paths as P
from ..operators import trading as G
from ..operators import walkforward as W
from ..operators.bars import resample_ohlcv
from ..sources.writers import publish_pack
from ..operators.blocks import attach, day_bucket, stage, stored, with_position

# Inputs of the base model, and the seed of the overlay model.
BASE_FEATURES = ("vol_ratio", "rsi_14", "atr_14", "adx_14", "ret_1", "trend_strength")
SUPER_SEED = 123
TIMEFRAMES = {"5m": ("5 minutes", 288), "30m": ("30 minutes", 48), "1d": ("1d", 1)}
RUN = ("series_id", "cycle_no", "run_id")
CYCLE = ("series_id", "cycle_no")


def feature_tables(bars: DataFrame, cfg: RunConfig = RunConfig(), required=I.INDICATORS) -> DataFrame:
    """Indicators of the three timeframes in one table with column tf."""
    counts = {"5m": cfg.min_count_5m, "30m": cfg.min_count_30m, "1d": 1}
    out = None
    bars = stage(bars, "base_bars")
    for tf, (rule, per_day) in TIMEFRAMES.items():
        f = I.make_features(resample_ohlcv(bars, rule, counts[tf]), cfg, tf, per_day, complete=False)
        f = f.dropna(subset=list(required)).drop("idx")
        out = f if out is None else out.unionByName(f)
    return stage(out, "features")


def fit_rows(df: DataFrame, k: int, least: int, cfg: RunConfig, keys) -> DataFrame:
    """Mark `fit`: rows before the trade window, without one all but the last day.

    Too few such rows: all rows are used and `fit_fallback` is set.
    """
    keys = list(keys)
    facts = df.groupBy(*keys).agg(F.max(F.col("ts").cast("date")).alias("_last_day"))
    out = attach(df, facts, keys)
    mask = F.when(F.col("trade_start").isNotNull(), F.col("ts") < F.col("trade_start")).otherwise(
        F.col("ts").cast("date") < F.col("_last_day"))
    out = out.withColumn("fit", mask).drop("_last_day")
    few = out.groupBy(*keys).agg((F.count_if("fit") < max(least, 50 * k)).alias("fit_fallback"))
    out = attach(out, few, keys)
    return out.withColumn("fit", F.col("fit") | F.col("fit_fallback"))


def regimes(df: DataFrame, features, models: DataFrame, k: int, cfg: RunConfig, keys, warmup, least: int = 200,
            max_iter: int | None = None, rows_per_day: int = 288, state: str = "state", path_only: bool = False):
    """Fit, align and decode a hidden-Markov model per row of `models`.

    `df` has the keys, ts, trade_start and the features; returns (labels, parameters).
    The labels carry the keys, ts, model_id, the state, the state probabilities and idx, the place of the row.
    """
    keys, features = list(keys), list(features)
    rows = stored(stage(df, "regime_in").select(*keys, "ts", "trade_start", *features).dropna(subset=features))
    scaled = [f + "_z" for f in features]
    marked = L.standardize(fit_rows(rows, k, least, cfg, keys), features, F.col("fit"), keys).drop(*features)
    # Rows to fit on are the first of their sequence, or all, so one numbering serves to fit and to decode.
    rows = stage(with_position(marked, keys, ["ts"], day_bucket(rows_per_day), counted=rows), "scaled")
    fit = stored(rows.filter("fit").select(*keys, "ts", F.col("idx").alias("pos"), *scaled))
    if cfg.num_inits > 1:
        inits = F.explode(F.sequence(F.lit(0), F.lit(cfg.num_inits - 1)))
        trials = models.withColumn("base_id", F.col("model_id")).withColumn("_i", inits)
        trials = trials.withColumns({"seed": F.col("seed") + F.col("_i"),
                                     "model_id": F.concat_ws("#", "model_id", "_i")}).drop("_i")
        params = H.fit_gaussian_hmm(fit, scaled, trials, k, cfg, keys, rows_per_day, max_iter)
        params = H.best_models(params, trials, ["base_id"])
        params = params.withColumn("model_id", F.regexp_replace("model_id", r"#\d+$", ""))
    else:
        params = H.fit_gaussian_hmm(fit, scaled, models, k, cfg, keys, rows_per_day, max_iter)
    # The parameters say if too short a history made the fit use all rows.
    short = rows.select(H.sequence_key(keys).alias("seq"), "fit_fallback").distinct()
    params = stage(attach(H.align_states(params, k, len(features)), short, ["seq"]), "aligned")
    placed = stored(rows.select(*keys, "ts", "idx", "trade_start", *scaled))
    starts = placed.groupBy(*keys).agg(F.max("trade_start").alias("trade_start"))
    segs = H.segments(placed.drop("trade_start"), starts, warmup, keys)
    return H.decode(segs, scaled, params, k, keys, rows_per_day, state, path_only), params


def label_runs(features: DataFrame, runs: DataFrame, cfg: RunConfig = RunConfig(), max_iter: int | None = None,
               parameters: dict | None = None) -> DataFrame:
    """The 30-minute table of every run: overlay, second-level state, path metrics.

    The fitted parameter tables are put into `parameters` when it is given, and `fit_fallback` of each run: whether one
    of its models had too short a history and was fitted on all rows, those of its trade window included.
    """
    runs = stage(runs, "runs")
    cycles = runs.select(*CYCLE, "trade_start", "data_end").distinct()
    rows = attach(features, cycles, ["series_id"], salt_on=["ts"])
    rows = stage(rows.filter("data_end IS NULL OR ts <= data_end").drop("data_end"), "run_rows")

    # Base regimes: one sequence per cycle and timeframe, one model per seed.
    keys = [*CYCLE, "tf"]
    seeds = F.explode(F.array(*[F.struct(F.lit(tf).alias("tf"), F.col(f"rs_{tf}").cast("long").alias("seed"))
                                for tf in TIMEFRAMES]))
    models = runs.select(*CYCLE, seeds.alias("m")).select(*CYCLE, "m.tf", "m.seed").distinct()
    models = models.withColumn("model_id", F.concat_ws("|", *keys, "seed"))
    warm = (F.when(F.col("tf") == "5m", cfg.warmup_5m).when(F.col("tf") == "30m", cfg.warmup_30m)
            .otherwise(cfg.warmup_1d))
    labels, fitted = regimes(rows, BASE_FEATURES, models, cfg.n_states, cfg, keys, warm, 200, max_iter,
                             path_only=True)
    if parameters is not None:
        parameters["base_models"] = fitted
    labels = stage(labels.join(models, [*keys, "model_id"]).select(*keys, "seed", "ts", "state"), "base_labels")

    def of(tf):
        return labels.filter(F.col("tf") == tf).select(
            *CYCLE, F.col("seed").alias(f"rs_{tf}"), "ts", F.col("state").alias(f"state_{tf}"))

    # Bins and days are prepared per seed, then given to the runs that use the seed.
    who = runs.select(*RUN, *[F.col(f"rs_{tf}").cast("long").alias(f"rs_{tf}") for tf in TIMEFRAMES])
    bins = O.mode_last_by_bin(of("5m"), "30 minutes", "state_5m", [*CYCLE, "rs_5m"])
    bins = bins.join(who.select(*RUN, "rs_5m"), [*CYCLE, "rs_5m"]).drop("rs_5m")
    daily = of("1d").join(who.select(*RUN, "rs_1d"), [*CYCLE, "rs_1d"]).drop("rs_1d")
    s30 = of("30m").join(who.select(*RUN, "rs_30m"), [*CYCLE, "rs_30m"]).drop("rs_30m")
    base = rows.filter("tf = '30m'").drop("tf").join(s30, [*CYCLE, "ts"])
    overlay = stage(O.build_overlay(base, bins, daily, keys=RUN), "overlay")
    parameters = {} if parameters is None else parameters
    table = super_regimes(overlay, cfg, RUN, max_iter, parameters=parameters)
    used = F.explode(F.array(*[F.concat_ws("|", *CYCLE, F.lit(tf), F.col(f"rs_{tf}").cast("long")) for tf in TIMEFRAMES],
                             F.concat_ws("|", *RUN)))
    both = fitted.select("model_id", "fit_fallback").unionByName(parameters["super_models"].select("model_id", "fit_fallback"))
    parameters["fallbacks"] = runs.select(*RUN, used.alias("model_id")).join(both, "model_id").groupBy(*RUN).agg(
        F.bool_or("fit_fallback").alias("fit_fallback"))
    return table


def super_regimes(overlay: DataFrame, cfg: RunConfig = RunConfig(), keys=("series_id",), max_iter: int | None = None,
                  seed: int = SUPER_SEED, rows_per_day: int = 48,
                  parameters: dict | None = None) -> DataFrame:
    """Second-level regimes of an overlay table, their certainty and path metrics."""
    keys = list(keys)
    if "trade_start" not in overlay.columns:
        overlay = overlay.withColumn("trade_start", F.lit(None).cast("timestamp_ntz"))
    overlay = stored(stage(overlay, "overlay").dropna(subset=list(SUPER_FEATURES)))
    models = overlay.select(*keys).distinct().withColumns(
        {"seed": F.lit(seed).cast("long"), "model_id": F.concat_ws("|", *keys)})
    labels, fitted = regimes(overlay, SUPER_FEATURES, models, cfg.k_super, cfg, keys, F.lit(cfg.warmup_super), 300,
                        max_iter, rows_per_day, "super_state")
    if parameters is not None:
        parameters["super_models"] = fitted
    labels = H.posterior_metrics(labels, cfg.k_super).drop("smoothed", "filtered", "model_id", "seg")
    # Run statistics need the labels only; the wide rows join at the end.
    paths = P.path_metrics(labels, "super_state", cfg, keys)
    return stage(overlay.drop("overlay_struct", "idx").join(paths, [*keys, "ts"]), "super")


def forecast_runs(table: DataFrame, runs: DataFrame, cfg: RunConfig = RunConfig(), pool_series: bool = False):
    """Forecast, gate and trade every run: (statistics, equity, trades, pack).

    The pack holds what is needed to go on from here: the forests (`models`), the good
    labels, the gate thresholds and the trade rows with their predictions.

    `table` comes from `label_runs`.  Statistics have a row for every run; `engine_ok` is false for
    one without training or without trade rows, and `engine_err` says which.  Forests, good labels
    and thresholds belong to a series, cycle and run, as a label of one series has nothing to do
    with that of another.  With `pool_series` the series of a run share them; for a single series
    both settings are the same.
    """
    keys = list(RUN)
    group = [k for k in RUN if k != "series_id"] if pool_series else keys
    y = f"y_ret_{cfg.horizon}"
    rows = M.forecast_features(M.forward_label(table, cfg.horizon, y, keys), keep=(y, "super_state"))
    window = runs.select(*RUN, "trade_start", "trade_end")
    split = M.time_split(rows.drop("trade_start", "trade_end"), window, cfg, rows_per_day=48, keys=keys)
    split = stage(split.withColumn("model_key", F.concat_ws("|", *group, "super_state")), "split")
    train, validation = split.filter("split = 'train'"), split.filter("split = 'validation'")

    models = M.fit_per_state(train, y, cfg, state="model_key")
    checked = M.predict_per_state(validation, models, state="model_key", cfg=cfg)
    good = M.select_states(M.regression_metrics(checked, y, "pred", [*group, "super_state"]), cfg)
    good = stage(good.select(*group, "super_state"), "good")
    thresholds = G.gate_thresholds(train, good, cfg, group)
    trade = stage(G.gate_mask(split.filter("split = 'trade'"), thresholds, group), "trade")
    predicted = M.predict_per_state(trade.join(good, [*group, "super_state"], "left_semi"), models, state="model_key", cfg=cfg)
    predicted = stage(predicted.select(*keys, "ts", "super_state", "gate_on", "pred"), "predicted")
    bars = trade.select(*keys, "ts", "high", "low", "close", "atr_14")
    # A run without a prediction does not trade.
    bars = bars.join(predicted.select(*keys).distinct(), keys, "left_semi")
    equity, trades = G.backtest(bars, predicted, cfg, rows_per_day=48, keys=keys)
    equity = stage(equity, "equity")
    stats = G.run_stats(equity, trades, keys)
    seen = split.groupBy(*keys).agg(F.bool_or(F.col("split") == "train").alias("_train"),
                                    F.bool_or(F.col("split") == "trade").alias("_trade"))
    stats = runs.select(*RUN).join(stats, keys, "left").join(seen, keys, "left")
    problem = (F.when(~F.coalesce("_train", F.lit(False)), F.lit("no training rows"))
               .when(~F.coalesce("_trade", F.lit(False)), F.lit("no rows in the trade window")))
    stats = stats.withColumn("engine_err", problem).withColumn("engine_ok", F.col("engine_err").isNull())
    stats = stats.drop("_train", "_trade").fillna(
        {"final_equity": 1.0, "max_drawdown": 0.0, "n_trades": 0, "active_bars": 0, "gated_n": 0})
    pack = {"models": models, "good_states": good, "gate_thresholds": thresholds,
            "trade_snapshot": M.trade_snapshot(trade, predicted, keys)}
    return stats, equity, trades, pack


def export_pack(folder: str, table: DataFrame, pack: dict, parameters: dict, cfg: RunConfig = RunConfig(),
                selection: DataFrame | None = None) -> None:
    """Overwrite the pack in `folder`: settings, model parameters, forests, good labels,
    thresholds, trade snapshot, path seeds and, if given, the selection of runs.

    Runs with fewer than 20 rows get no path seed.
    """
    spark = table.sparkSession
    keys = list(RUN)
    long_enough = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 20").drop("_n")
    rows = table.select(*keys, "ts", "idx", "super_state").join(long_enough, keys, "left_semi")
    tables = {
        "meta": spark.createDataFrame([(str(k), str(v)) for k, v in asdict(cfg).items()], "name string, value string"),
        "path_seed": P.path_seed(P.with_runs(rows, "super_state", keys), "super_state", cfg, keys),
        **parameters, **pack,
    }
    if selection is not None:
        tables["selection"] = selection
    publish_pack(folder, tables)


def sweep(bars: DataFrame, windows: DataFrame, cfg: RunConfig = RunConfig(), n_sweeps: int | None = None,
          max_iter: int | None = None, required=I.INDICATORS, features: DataFrame | None = None,
          pool_series: bool = False):
    """Evaluate seed triplets 0 ... n-1 in every cycle; (evaluation table, equity).

    `windows` has series_id, cycle_no, eval_start and eval_end.
    """
    from ..functions import seed_triplet

    n = n_sweeps or cfg.n_sweeps
    runs = windows.withColumn("sweep_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    runs = stage(runs.select(
        *CYCLE, "sweep_i", F.format_string("S%03d", "sweep_i").alias("run_id"), seed_triplet("sweep_i").alias("t"),
        F.col("eval_start").alias("trade_start"), F.col("eval_end").alias("trade_end"),
        F.col("eval_end").alias("data_end")).select("*", "t.*").drop("t"), "runs")
    if features is None:
        features = feature_tables(bars, cfg, required)
    parameters: dict = {}
    table = label_runs(features, runs, cfg, max_iter, parameters)
    stats, equity, _, _ = forecast_runs(table, runs, cfg, pool_series=pool_series)
    evals = runs.join(stats, list(RUN), "left").join(parameters["fallbacks"], list(RUN), "left").select(
        *CYCLE, "sweep_i", "run_id", "rs_5m", "rs_30m", "rs_1d",
        F.col("sharpe_daily").alias("eval_sharpe_daily"), F.col("max_drawdown").alias("eval_max_dd"),
        F.col("n_trades").alias("eval_trades"), F.col("active_bars").alias("eval_active_bars"),
        F.col("gate_coverage").alias("eval_gate_coverage"), "engine_ok", "engine_err", "fit_fallback")
    return evals, equity


def walk_forward(bars: DataFrame, windows: DataFrame, cfg: RunConfig = RunConfig(), n_sweeps: int | None = None,
                 max_iter: int | None = None, required=I.INDICATORS, pool_series: bool = False):
    """Sweep every cycle, select runs, trade them in the next window, combine and compound.

    Returns (selection, global curve per series, evaluation table, which selected runs of
    a cycle delivered a curve).  Cycles do not wait for each other: the smoothed score and
    the compounding are windows over cycles.
    """
    features = feature_tables(bars, cfg, required)
    windows = stage(windows, "windows")
    evals, _ = sweep(bars, windows, cfg, n_sweeps, max_iter, required, features, pool_series)
    evals = stage(evals, "evals")
    chosen = W.choose_candidates(W.candidate_tiers(evals, cfg), cfg, cycle=CYCLE)
    scored = W.ema_score(stage(W.robust_score(chosen, cfg), "scores"), cfg, by=("series_id",))
    picked = stage(W.top_k(scored, cfg.top_k, CYCLE), "picked")

    live = stage(picked.join(windows.select(*CYCLE, "cycle_id", "trade_start", "trade_end"), list(CYCLE)).select(
        *CYCLE, F.format_string("LIVE%d", "place").alias("run_id"), "rs_5m", "rs_30m", "rs_1d", "trade_start",
        "trade_end", F.col("trade_end").alias("data_end"), "place", "seed_triplet", "cycle_id"), "live")
    if live.isEmpty():
        # No cycle has a run to trade: there is no curve, and all windows are idle.
        curves = stored(live.select(*CYCLE, F.col("run_id").alias("member"), F.col("trade_start").alias("ts"), F.lit(None).cast("double").alias("equity")))
        whole = stage(W.flat_curve(bars, windows), "combined")
    else:
        table = label_runs(features, live, cfg, max_iter)
        _, equity, _, _ = forecast_runs(table, live, cfg, pool_series=pool_series)
        curves = equity.select(*CYCLE, F.col("run_id").alias("member"), "ts", "equity")
        curves = stage(W.rescale_to_1(curves, [*CYCLE, "member"]), "live_curves")
        combined = W.combine_curves(curves, rows_per_day=48, cycle=CYCLE)
        idle = windows.join(curves.select(*CYCLE).distinct(), list(CYCLE), "left_anti")
        whole = stage(combined.unionByName(W.flat_curve(bars, idle)), "combined")
    curve = W.stitch(W.compound_cycles(whole, by=("series_id",)), by=("series_id",))
    debug = W.cycle_debug(picked.withColumn("member", F.format_string("LIVE%d", "place")), curves, CYCLE)
    return W.selection_history(picked, windows, CYCLE), curve, evals, debug
