"""Queries: returns, rolling statistics, recursive indicators, feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import BAR_COLUMNS, RunConfig
from ..operators import blocks as K
from ..operators import indicators as I
from . import sql
from .q_bars import daily_bars, events_bars
from .registry import long, query, rnd, rounded, sql_rnd, sql_rounded, sql_time, time_text

CFG = RunConfig()
DAILY = sql.bars("orders", None)
FEATURES = f"{DAILY}, {sql.features()}"
HEAD = f"series_id, {sql_time()}"


def opened_daily(spark, folder):
    bars = K.position_bars(daily_bars(spark, folder), rows_per_day=1)
    df = K.open_blocks(bars, before=I.feature_halo(CFG), size=I.feature_block(CFG))
    w = K.block_window()
    return I.add_returns(I.add_lags(df, w), w), w


def out(df, *cols):
    return df.select("series_id", time_text().alias("ts"), *cols)


@query("returns_momentum", f"""WITH RECURSIVE {FEATURES}
SELECT {HEAD}, {sql_rounded(6, 'ret_1', 'log_ret_1', 'price_change_15', 'momentum_10', 'momentum_30', 'momentum_60')}
FROM feat""")
def returns_momentum(spark, folder):
    df, _ = opened_daily(spark, folder)
    return out(K.close_blocks(df), *rounded(6, "ret_1", "log_ret_1", "price_change_15", "momentum_10",
                                            "momentum_30", "momentum_60"))


@query("rolling_stats", f"""WITH RECURSIVE {FEATURES}
SELECT {HEAD}, {sql_rounded(4, 'ma_fast', 'ma_slow')}, {sql_rounded(6, 'vol_short', 'vol_long', 'vol_ratio',
 'trend_strength', 'volatility_15', 'volume_mean_15', 'volume_ratio_15', 'range_pct')} FROM feat""")
def rolling_stats(spark, folder):
    df, w = opened_daily(spark, folder)
    df = K.close_blocks(I.add_rolling(df, w, CFG))
    return out(df, *rounded(4, "ma_fast", "ma_slow"),
               *rounded(6, "vol_short", "vol_long", "vol_ratio", "trend_strength", "volatility_15",
                        "volume_mean_15", "volume_ratio_15", "range_pct"))


@query("true_range", f"WITH RECURSIVE {FEATURES} SELECT {HEAD}, {sql_rnd('tr', 4, 'true_range')} FROM feat")
def true_range(spark, folder):
    df, _ = opened_daily(spark, folder)
    df = df.withColumn("true_range", I.true_range_of("high", "low", "_pc"))
    return out(K.close_blocks(df), *rounded(4, "true_range"))


@query("ewma", f"""WITH RECURSIVE {DAILY}, {sql.ewmas('bars', {'"close"': 'ewma_fast'}, 0.2, 'e1')},
{sql.ewmas('bars', {'volume': 'ewma_slow'}, 1 / 14, 'e2')}
SELECT {HEAD}, {sql_rounded(2, 'ewma_fast')}, {sql_rounded(6, 'ewma_slow')}
FROM bars JOIN e1 USING (series_id, idx) JOIN e2 USING (series_id, idx)""")
def ewma(spark, folder):
    bars = K.position_bars(daily_bars(spark, folder), rows_per_day=1)
    size = min(K.BLOCK, I.ewma_block(0.2) - I.memory(1 / 14))
    w = K.block_window()
    df = I.add_lags(K.open_blocks(bars, before=I.memory(1 / 14), size=size), w)
    df = df.withColumns({"ewma_fast": I.ewma("close", 0.2, w), "ewma_slow": I.ewma("volume", 1 / 14, w)})
    return out(K.close_blocks(df), *rounded(2, "ewma_fast"), *rounded(6, "ewma_slow"))


@query("rsi", f"WITH RECURSIVE {FEATURES} SELECT {HEAD}, {sql_rounded(6, 'rsi_14')} FROM feat")
def rsi(spark, folder):
    df, w = opened_daily(spark, folder)
    return out(K.close_blocks(I.add_rsi(df, w, 14)), *rounded(6, "rsi_14"))


@query("atr", f"WITH RECURSIVE {FEATURES} SELECT {HEAD}, {sql_rounded(2, 'atr_14')}, {sql_rounded(6, 'atr_pct_14')} FROM feat")
def atr(spark, folder):
    df, w = opened_daily(spark, folder)
    df = I.add_atr(df, w, 14).withColumn("atr_pct_14", F.col("atr_14") / (F.col("close") + 1e-12))
    return out(K.close_blocks(df), *rounded(2, "atr_14"), *rounded(6, "atr_pct_14"))


@query("adx", f"WITH RECURSIVE {FEATURES} SELECT {HEAD}, {sql_rounded(6, 'adx_14')} FROM feat")
def adx(spark, folder):
    df, w = opened_daily(spark, folder)
    return out(K.close_blocks(I.add_adx(df, w, 14)), *rounded(6, "adx_14"))


OPENING_ROW = "strftime(ts, '%H:%M') IN ('09:35', '09:40', '09:45', '09:50', '09:55', '10:00')"
FACTOR = "coalesce(list_extract([0.25, 0.4, 0.5, 0.625, 0.714, 0.833], CAST(ord AS INT)), 1.0)"


def opening_sql(scope):
    per = "series_id, CAST(ts AS DATE)" if scope == "day" else "series_id"
    return f"""WITH {sql.bars('events', 5)},
o AS (SELECT *, CASE WHEN {OPENING_ROW} THEN row_number() OVER (PARTITION BY {per}, {OPENING_ROW} ORDER BY ts) END AS ord
      FROM bars)
SELECT {HEAD}, {sql_rnd(f'volume * {FACTOR}', 6, 'volume')} FROM o"""


@query("opening_shrink_day", opening_sql("day"))
def opening_shrink_day(spark, folder):
    df = I.opening_shrink(events_bars(spark, folder, "5 minutes"), ["volume"], "day")
    return out(df, *rounded(6, "volume"))


@query("opening_shrink_global", opening_sql("global"))
def opening_shrink_global(spark, folder):
    df = I.opening_shrink(events_bars(spark, folder, "5 minutes"), ["volume"], "global")
    return out(df, *rounded(6, "volume"))


SMALL = [c for c in I.INDICATORS if c not in ("ma_fast", "ma_slow", "atr_14")]


def feature_output(df):
    return out(df, long("idx").alias("idx"), *rounded(4, *BAR_COLUMNS, "ma_fast", "ma_slow"),
               *rounded(2, "atr_14"), *rounded(6, *SMALL))


FEATURE_SQL = (f"SELECT {HEAD}, CAST(idx AS BIGINT) AS idx, {sql_rounded(4, *BAR_COLUMNS, 'ma_fast', 'ma_slow')}, "
               f"{sql_rounded(2, 'atr_14')}, {sql_rounded(6, *SMALL)} FROM feat WHERE {sql.COMPLETE}")


@query("features_daily", f"WITH RECURSIVE {FEATURES} {FEATURE_SQL}")
def features_daily(spark, folder):
    return feature_output(I.make_features(daily_bars(spark, folder), CFG, "1d", rows_per_day=1))


OPENING_FACTOR_SQL = f"""CASE WHEN {OPENING_ROW} THEN coalesce(list_extract([0.25, 0.4, 0.5, 0.625, 0.714, 0.833],
  CAST(row_number() OVER (PARTITION BY series_id, CAST(ts AS DATE), {OPENING_ROW} ORDER BY ts) AS INT)), 1.0) ELSE 1.0 END"""


@query("features_5m", f"WITH RECURSIVE {sql.bars('events', 5)}, {sql.features(opening=OPENING_FACTOR_SQL)} {FEATURE_SQL}")
def features_5m(spark, folder):
    return feature_output(I.make_features(events_bars(spark, folder, "5 minutes"), CFG, "5m"))
