"""Per-regime forecasts of the forward return."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FORECAST_FEATURES, RunConfig
from ..functions import coerce_numeric, day_of, log_return, ratio
from .blocks import attach, block_window, close_blocks, day_bucket, open_blocks, stage, with_position
from .calendar import last_n_days, trading_days
from .forest import fit_forests, predict_forests


def forward_label(df: DataFrame, horizon: int = 4, out: str | None = None, keys=("series_id",)) -> DataFrame:
    """Log return over the next `horizon` rows; NULL on the last ones.  Needs `idx`."""
    out = out or f"y_ret_{horizon}"
    w = block_window(keys)
    opened = open_blocks(df, after=horizon)
    return close_blocks(opened.withColumn(out, log_return(F.lead("close", horizon).over(w), "close")))


def forecast_features(df: DataFrame, features=FORECAST_FEATURES, keep=()) -> DataFrame:
    """The model inputs as numbers; absent columns are an error, rows with a gap are dropped.

    Other columns of `keep` pass through and must be present as well.
    """
    if "ma_gap" in features and "ma_gap" not in df.columns:
        df = df.withColumn("ma_gap", ratio(coerce_numeric("ma_fast"), coerce_numeric("ma_slow")) - 1)
    absent = [c for c in features if c not in df.columns]
    if absent:
        raise ValueError(f"missing forecast features {absent}")
    types = dict(df.dtypes)
    others = [c for c in df.columns if c not in features]
    out = df.select(*others, *[F.col(c) if types[c] == "double" else F.col(c).try_cast("double").alias(c) for c in features])
    # One comparison drops NULL, NaN and infinite values alike.
    for c in features:
        out = out.filter(F.abs(c) < float("inf"))
    return out.dropna(subset=list(keep))


def last_days_window(df: DataFrame, n: int, keys=("series_id",)) -> DataFrame:
    """(keys, trade_start, trade_end, problem) covering the last n days of each series.

    A series with fewer days has no window but a `problem`; its rows have no split.
    """
    keys = list(keys)
    days = last_n_days(trading_days(df, keys=keys), n, keys)
    first = days.groupBy(*keys).agg(F.min("day").alias("_d0"), F.max("problem").alias("problem"))
    inside = F.when(day_of() >= F.col("_d0"), F.col("ts"))
    return attach(df.select(*keys, "ts"), first, keys).groupBy(*keys).agg(
        F.min(inside).alias("trade_start"), F.max(inside).alias("trade_end"), F.max("problem").alias("problem"))


def time_split(df: DataFrame, window: DataFrame, cfg: RunConfig = RunConfig(), purge_bars: int = 0,
               rows_per_day: int = 288, keys=("series_id",)) -> DataFrame:
    """Column `split`: trade rows, and the history before them cut into train and
    validation after the first `train_frac` of its rows.  Other rows are left out.

    `window` gives trade_start and trade_end per key.  `purge_bars` drops that many
    rows before each boundary, whose labels would look across it.
    """
    keys = list(keys)
    df = attach(df, window.select(*keys, "trade_start", "trade_end"), keys)
    start = F.lit(cfg.history_start).cast("timestamp_ntz")
    role = F.when((F.col("ts") >= F.col("trade_start")) & (F.col("ts") <= F.col("trade_end")), "trade").when(
        (F.col("ts") >= start) & (F.col("ts") < F.col("trade_start")), "history")
    df = df.withColumn("_role", role).filter("_role IS NOT NULL").drop("trade_start", "trade_end")
    # Only the times of the history are numbered; the rows then compare their time with those of the cuts.
    history = stage(df.filter("_role = 'history'").select(*keys, "ts"), "history")
    placed = with_position(history, keys, ["ts"], day_bucket(rows_per_day), "_pos")
    sizes = history.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    cut = F.floor(F.col("_size") * cfg.train_frac)

    def time_at(place):
        return F.coalesce(F.min(F.when(F.col("_pos") >= place, F.col("ts"))), F.lit("9999-12-31").cast("timestamp_ntz"))

    cuts = attach(placed, sizes, keys).groupBy(*keys).agg(
        time_at(cut - purge_bars).alias("_train"), time_at(cut).alias("_validation"), time_at(F.col("_size") - purge_bars).alias("_end"))
    split = (
        F.when(F.col("_role") == "trade", "trade")
        .when(F.col("ts") < F.col("_train"), "train")
        .when((F.col("ts") >= F.col("_validation")) & (F.col("ts") < F.col("_end")), "validation")
    )
    out = attach(df, cuts, keys, "left").withColumn("split", split)
    return out.filter("split IS NOT NULL").drop("_role", "_train", "_validation", "_end")


def fit_per_state(train: DataFrame, label: str, cfg: RunConfig = RunConfig(), features=FORECAST_FEATURES,
                  state: str = "super_state") -> DataFrame:
    """One random forest per label with enough rows: a table of their nodes, see `forest`.

    `state` names the column that tells the forests apart; all of them grow in the same jobs.
    """
    rows = stage(train.select(state, "ts", label, *features), "train")
    return fit_forests(rows, state, label, features, cfg.n_trees, cfg.tree_depth, cfg.min_leaf, cfg.forest_seed, cfg.min_train_rows)


def predict_per_state(df: DataFrame, models: DataFrame, features=FORECAST_FEATURES, state: str = "super_state",
                      out: str = "pred", cfg: RunConfig = RunConfig()) -> DataFrame:
    """Rows of the labels that have a model, with its prediction."""
    return predict_forests(df, models, state, features, cfg.tree_depth, out)


def regression_metrics(df: DataFrame, y: str, pred: str, group=("super_state",)) -> DataFrame:
    """rmse, mae, r2, ic and n per group, in one pass."""
    e = F.col(y) - F.col(pred)
    n = F.count(F.lit(1))
    spread = F.var_pop(y) * n
    constant = (F.var_pop(y) == 0) | (F.var_pop(pred) == 0)
    return df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull()).groupBy(*group).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.sum(e * e) / F.nullif(spread, F.lit(0.0))).alias("r2"),
        F.when((n > 2) & ~constant, F.corr(y, pred)).alias("ic"), n.alias("test_n"),
    )


def select_states(metrics: DataFrame, cfg: RunConfig = RunConfig(), max_states: int | None = None,
                  state: str = "super_state", keys=()) -> DataFrame:
    """Labels whose validation metrics pass; optionally the best few by ic of each group of `keys`."""
    good = metrics.filter(
        (F.col("test_n") >= cfg.min_test_rows) & (F.col("ic") > cfg.min_ic) & (F.col("r2") > cfg.min_r2))
    if max_states:
        place = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("ic"), state))
        good = good.withColumn("_place", place).filter(F.col("_place") <= max_states).drop("_place")
    return good


def trade_snapshot(trade: DataFrame, predictions: DataFrame, keys=("series_id",), state: str = "super_state",
                   pred: str = "pred") -> DataFrame:
    on = [*keys, "ts", state]
    return trade.join(predictions.select(*on, pred), on, "left")
