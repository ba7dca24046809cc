"""Rolling and recursive indicators.

Each `add_*` function takes a table opened with `open_blocks` and its block window
`w`, so several of them share one shuffle and one sort.  `make_features` is the
whole feature table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BAR_COLUMNS, EPS, OPENING_COLUMNS, OPENING_FACTORS, OPENING_TIMES, RunConfig
from ..functions import day_of, finite, ratio, safe_log
from . import blocks
from .blocks import attach, block_window, close_blocks, last_rows, open_blocks, position_bars

INDICATORS = (
    "ret_1", "log_ret_1", "ma_fast", "ma_slow", "trend_strength", "vol_short", "vol_long",
    "vol_ratio", "rsi_14", "atr_14", "atr_pct_14", "adx_14", "price_change_15", "volatility_15",
    "volume_mean_15", "volume_ratio_15", "momentum_10", "momentum_30", "momentum_60", "range_pct",
)


# -- building blocks -------------------------------------------------------

def pct_change(x: str, n: int, w) -> Column:
    return ratio(F.col(x), F.lag(x, n).over(w)) - 1


def rolling(fn, x: str, n: int, w) -> Column:
    """fn over the last n rows, NULL unless all of them have a value."""
    frame = last_rows(w, n)
    return F.when(F.count(x).over(frame) >= n, fn(x).over(frame))


def rolling_mean(x: str, n: int, w) -> Column:
    return rolling(F.avg, x, n, w)


def rolling_vol(x: str, n: int, w) -> Column:
    return rolling(F.stddev_samp, x, n, w)


def memory(alpha: float) -> int:
    """Rows after which an exponential average has forgotten its start (below 1e-17)."""
    return math.ceil(40 / -math.log1p(-alpha))


def ewma_block(alpha: float) -> int:
    """Longest run of rows whose weights stay inside the range of a double."""
    return int(600 / -math.log1p(-alpha))


def ewma(x: str, alpha: float, w, step: str = "_step") -> Column:
    """y = (1 - alpha) y + alpha x, starting at the first value.

    Written as one running sum of weighted values: y_j = q^j * sum_i u_i q^-i with
    u_0 = x_0 and u_i = alpha x_i.  `step` counts the values of the block from 0 and
    is NULL before the first; `memory(alpha)` rows of halo make blocks agree with the
    recursion over the whole series to double precision.
    """
    q = 1.0 - alpha
    i = F.col(step)
    weighted = F.when(i == 0, F.col(x)).otherwise(F.col(x) * alpha * F.pow(F.lit(q), -i))
    total = F.sum(weighted).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(i >= 0, F.pow(F.lit(q), i) * total)


def true_range_of(high, low, prev_close) -> Column:
    high, low, prev = (F.col(c) for c in (high, low, prev_close))
    return F.greatest(F.abs(high - low), F.abs(high - prev), F.abs(low - prev))


# -- indicator groups ------------------------------------------------------

def add_lags(df: DataFrame, w) -> DataFrame:
    row = F.row_number().over(w) - 1
    return df.withColumns({
        "_pc": F.lag("close").over(w), "_ph": F.lag("high").over(w), "_pl": F.lag("low").over(w),
        "_step": row, "_step1": F.when(row >= 1, row - 1),
    })


def add_returns(df: DataFrame, w) -> DataFrame:
    return df.withColumns({
        "ret_1": ratio("close", "_pc") - 1,
        "log_ret_1": safe_log("close") - safe_log("_pc"),
        "price_change_15": pct_change("close", 15, w),
        "momentum_10": pct_change("close", 10, w),
        "momentum_30": pct_change("close", 30, w),
        "momentum_60": pct_change("close", 60, w),
    })


def add_rolling(df: DataFrame, w, cfg: RunConfig) -> DataFrame:
    df = df.withColumns({
        "ma_fast": rolling_mean("close", cfg.ma_fast, w),
        "ma_slow": rolling_mean("close", cfg.ma_slow, w),
        "vol_short": rolling_vol("ret_1", cfg.vol_short, w),
        "vol_long": rolling_vol("ret_1", cfg.vol_long, w),
        "volatility_15": rolling_vol("ret_1", 15, w),
        "volume_mean_15": rolling_mean("volume", 15, w),
    })
    return df.withColumns({
        "trend_strength": ratio(F.col("close") - F.col("ma_slow"), F.col("ma_slow") + EPS),
        "vol_ratio": ratio("vol_short", F.col("vol_long") + EPS),
        "volume_ratio_15": ratio("volume", F.col("volume_mean_15") + EPS),
        "range_pct": ratio(F.col("high") - F.col("low"), F.col("close") + EPS),
    })


def add_rsi(df: DataFrame, w, n: int, out: str = "rsi_14") -> DataFrame:
    delta = F.col("close") - F.col("_pc")
    df = df.withColumns({"_up": F.greatest(delta, F.lit(0.0)), "_down": F.greatest(-delta, F.lit(0.0))})
    df = df.withColumns({"_up": F.when(F.col("_pc").isNotNull(), F.col("_up")),
                         "_down": F.when(F.col("_pc").isNotNull(), F.col("_down"))})
    df = df.withColumns({"_eup": ewma("_up", 1 / n, w, "_step1"), "_edown": ewma("_down", 1 / n, w, "_step1")})
    return df.withColumn(out, 100.0 - 100.0 / (1.0 + F.col("_eup") / (F.col("_edown") + EPS)))


def add_atr(df: DataFrame, w, n: int, out: str = "atr_14") -> DataFrame:
    df = df.withColumn("_tr", true_range_of("high", "low", "_pc"))
    return df.withColumn(out, ewma("_tr", 1 / n, w))


def add_adx(df: DataFrame, w, n: int, out: str = "adx_14", tr_average: str | None = None) -> DataFrame:
    """Average directional index; `tr_average` names an average true range already there."""
    up, down = F.col("high") - F.col("_ph"), F.col("_pl") - F.col("low")
    df = df.withColumns({
        "_tr": true_range_of("high", "low", "_pc"),
        "_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "_mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
    })
    averages = {f"_e{x}": ewma(f"_{x}", 1 / n, w) for x in ("tr", "pdm", "mdm")}
    if tr_average:
        averages["_etr"] = F.col(tr_average)
    df = df.withColumns(averages)
    pdi = 100.0 * F.col("_epdm") / (F.col("_etr") + EPS)
    mdi = 100.0 * F.col("_emdm") / (F.col("_etr") + EPS)
    df = df.withColumn("_dx", 100.0 * F.abs(pdi - mdi) / ((pdi + mdi) + EPS))
    return df.withColumn(out, ewma("_dx", 1 / n, w))


def is_opening_bar(ts: str = "ts") -> Column:
    return F.date_format(ts, "HH:mm").isin(*OPENING_TIMES)


def opening_shrink(df: DataFrame, columns=OPENING_COLUMNS, scope: str = "day", keys=("series_id",)) -> DataFrame:
    """Scale volume features of the first bars of a session.

    scope "day": the n-th opening bar of each day gets the n-th factor.
    scope "global": only the first six opening bars of the whole history are scaled.
    """
    keys = list(keys)
    opening = df.select(*keys, "ts").filter(is_opening_bar())
    per = [*keys, day_of("ts")] if scope == "day" else keys
    order = F.row_number().over(Window.partitionBy(*per).orderBy("ts"))
    # The row_number limit is applied before the shuffle, so a long series sends
    # at most six rows per task.
    first = opening.withColumn("_ord", order).filter(F.col("_ord") <= len(OPENING_FACTORS))
    factors = F.array(*[F.lit(v) for v in OPENING_FACTORS])
    first = first.select(*keys, "ts", F.element_at(factors, F.col("_ord")).alias("_factor"))
    scale = F.coalesce("_factor", F.lit(1.0))
    out = df.join(first, keys + ["ts"], "left")
    return out.withColumns({c: F.col(c).cast("double") * scale for c in columns if c in df.columns}).drop("_factor")


def add_opening_shrink(df: DataFrame, columns=OPENING_COLUMNS, keys=("series_id",)) -> DataFrame:
    """The day-wise scaling on opened blocks: no join, as the halo holds the day's start."""
    day = block_window(keys, "_day").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_day": day_of("ts"), "_opens": is_opening_bar().cast("int")})
    df = df.withColumn("_nth", F.when(F.col("_opens") == 1, F.sum("_opens").over(day)))
    factors = F.array(*[F.lit(v) for v in OPENING_FACTORS])
    scale = F.coalesce(F.get(factors, F.col("_nth") - 1), F.lit(1.0))
    return df.withColumns({c: F.col(c).cast("double") * scale for c in columns if c in df.columns})


# -- the feature table -----------------------------------------------------

def feature_halo(cfg: RunConfig) -> int:
    """Rows of history a feature can depend on: two exponential averages in a row."""
    slowest = 1 / max(cfg.rsi_n, cfg.atr_n, cfg.adx_n)
    return max(2 * memory(slowest), cfg.ma_slow + 1, cfg.vol_long + 1, 61) + 1


def feature_block(cfg: RunConfig) -> int:
    fastest = 1 / min(cfg.rsi_n, cfg.atr_n, cfg.adx_n)
    return max(1, min(blocks.BLOCK, ewma_block(fastest) - feature_halo(cfg)))


def make_features(bars: DataFrame, cfg: RunConfig = RunConfig(), tf: str = "5m",
                  rows_per_day: int = 288, complete: bool = True) -> DataFrame:
    """All indicators of a bar table; `complete` drops rows with a missing one."""
    opened = open_blocks(position_bars(bars, rows_per_day), before=feature_halo(cfg), size=feature_block(cfg))
    w = block_window()
    df = add_returns(add_lags(opened, w), w)
    df = add_rolling(df, w, cfg)
    df = add_adx(add_atr(add_rsi(df, w, cfg.rsi_n), w, cfg.atr_n), w, cfg.adx_n,
                 tr_average="atr_14" if cfg.atr_n == cfg.adx_n else None)
    df = df.withColumn("atr_pct_14", ratio("atr_14", F.col("close") + EPS))
    if tf == "1d":                    # daily bars carry no time of day
        df = close_blocks(df)
    elif cfg.opening_scope == "day":
        df = close_blocks(add_opening_shrink(df))
    else:
        df = opening_shrink(close_blocks(df), scope=cfg.opening_scope)
    df = df.select("series_id", "ts", "idx", *BAR_COLUMNS, *[finite(c).alias(c) for c in INDICATORS],
                   F.lit(tf).alias("tf"))
    return df.dropna(subset=list(INDICATORS)) if complete else df
