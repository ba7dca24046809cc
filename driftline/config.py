"""Settings shared by the operators.  One frozen object, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values -------------------------------------------------------------
BAR_COLUMNS = ("open", "high", "low", "close", "volume")

# Opening bars 09:35 ... 10:00 and the factor applied to each in turn.
OPENING_TIMES = ("09:35", "09:40", "09:45", "09:50", "09:55", "10:00")
OPENING_FACTORS = (0.25, 0.4, 0.5, 0.625, 0.714, 0.833)
OPENING_COLUMNS = ("volume_ratio_15", "vol_short", "volatility_15", "volume")

# Tiny number added to denominators, floor for logs of probabilities.
EPS = 1e-12

# Features of the base regime model and of the second (overlay) model.
SUPER_FEATURES = (
    "ret_1", "vol_short", "trend_strength", "adx_14", "rsi_14", "atr_14",
    "overlay_s5", "overlay_s30", "overlay_sd",
)

# Inputs of the per-regime forecast; ma_gap replaces the two averages.
FORECAST_FEATURES = (
    "log_ret_1", "momentum_10", "momentum_30", "momentum_60", "range_pct",
    "price_change_15", "vol_short", "vol_ratio", "atr_pct_14", "volatility_15",
    "trend_strength", "adx_14", "rsi_14", "volume_ratio_15", "posterior_maxp",
    "posterior_entropy", "stability_score", "mixed_signals", "avg_run_local",
    "switch_rate_local", "ma_gap",
)

EQUITY_NAMES = ("equity", "eq", "equity_net", "equity_curve", "eq_net")
# End of fixed values ------------------------------------------------------


@dataclass(frozen=True)
class RunConfig:
    # indicators
    ma_fast: int = 20
    ma_slow: int = 60
    vol_short: int = 20
    vol_long: int = 60
    rsi_n: int = 14
    atr_n: int = 14
    adx_n: int = 14
    min_count_5m: int = 1
    min_count_30m: int = 6
    opening_scope: str = "day"          # "day" or "global"

    # regimes
    n_states: int = 6
    k_super: int = 7
    min_covar: float = 1e-3
    max_iter: int = 500
    tol: float = 1e-2
    num_inits: int = 1
    warmup_5m: int = 400
    warmup_30m: int = 200
    warmup_1d: int = 60
    warmup_super: int = 200

    # path statistics
    run_window: int = 200
    switch_window: int = 50
    switch_min_periods: int = 10
    run_alpha: float = 0.15
    min_hist_runs: int = 3
    use_prior: bool = True

    # forecast
    horizon: int = 4
    trade_days: int = 44
    train_frac: float = 0.8
    history_start: str = "2022-04-11 10:00:00"
    min_train_rows: int = 300
    min_test_rows: int = 80
    min_ic: float = 0.005
    min_r2: float = -1.0
    n_trees: int = 500
    tree_depth: int = 6
    min_leaf: int = 50
    forest_seed: int = 42

    # gate
    gate_q_run: float = 0.65
    gate_q_switch: float = 0.65
    stability_min: float = 0.95
    clamp_run_max: float = 4.0
    clamp_switch_min: float = 0.35
    exhaustion_min: float = 0.2
    exhaustion_max: float = 1.2

    # exits and costs
    stop_mult: float = 2.0
    take_mult: float = 8.0
    cost_bps: float = 3.0
    leverage_max: float = 1.0
    charge_first_bar: bool = False

    # walk-forward
    step_days: int = 22
    n_sweeps: int = 30
    top_k: int = 5
    min_trades_eval: int = 8
    min_active_eval: int = 60
    min_coverage_eval: float = 0.03
    max_coverage_eval: float = 0.90
    max_dd_eval: float = 0.08
    lambda_dd: float = 3.0
    lambda_low_trades: float = 0.15
    ema_alpha: float = 0.6
    reject_fallback: bool = False       # leave out runs whose models saw their trade window
