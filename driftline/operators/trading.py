"""Gate, exits, positions, profit and loss, risk figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import clip, coerce_numeric, day_of, log_return, ratio
from .blocks import (attach, block_window, carry, close_blocks, day_bucket, exact_quantiles, last_rows, open_blocks,
                     own_rows, position_bars, stage, with_position)

CHAIN_BLOCK = 512
#: Maps of blocks that become one map.
CHAIN_FAN = 1024
NEVER = 1 << 62


# -- gate ------------------------------------------------------------------

def gate_thresholds(train: DataFrame, good: DataFrame, cfg: RunConfig = RunConfig(), keys=(),
                    state: str = "super_state") -> DataFrame:
    """Thresholds from the train rows of the good labels; one row per key.

    `good` has the keys and the label; the row also lists the good labels.
    """
    keys = list(keys)
    if not keys:
        train, good = train.withColumn("_one", F.lit(1)), good.withColumn("_one", F.lit(1))
        return gate_thresholds(train, good, cfg, ["_one"], state).drop("_one")
    # At most one entry per label of the model.
    allowed = good.groupBy(*keys).agg(F.array_sort(F.collect_set(state)).alias("good_states"))
    rows = attach(train, allowed, keys).filter(F.array_contains("good_states", F.col(state)))
    rows = rows.select(*keys, coerce_numeric("avg_run_local").alias("_run"),
                       coerce_numeric("switch_rate_local").alias("_switch"))
    run = exact_quantiles(rows, keys, "_run", {"_run_q": cfg.gate_q_run})
    switch = exact_quantiles(rows, keys, "_switch", {"_switch_q": 1.0 - cfg.gate_q_switch})
    return run.join(switch, keys, "full").join(allowed, keys).select(
        *keys, "good_states", F.lit(cfg.stability_min).alias("stability_min"),
        F.least("_run_q", F.lit(cfg.clamp_run_max)).alias("avg_run_min"),
        F.greatest("_switch_q", F.lit(cfg.clamp_switch_min)).alias("switch_rate_max"),
        F.lit(cfg.exhaustion_min).alias("exhaustion_min"), F.lit(cfg.exhaustion_max).alias("exhaustion_max"),
    )


def gate_mask(df: DataFrame, thresholds: DataFrame, keys=(), state: str = "super_state",
              use_exhaustion: bool = True, out: str = "gate_on") -> DataFrame:
    """Boolean gate; anything missing closes it."""
    names = ("good_states", "stability_min", "avg_run_min", "switch_rate_max", "exhaustion_min", "exhaustion_max")
    t = thresholds.select(*keys, *[F.col(n).alias(f"_t_{n}") for n in names])
    df = attach(df, t, list(keys), "left")
    on = (
        F.array_contains("_t_good_states", F.col(state))
        & (coerce_numeric("stability_score") >= F.col("_t_stability_min"))
        & (coerce_numeric("avg_run_local") >= F.col("_t_avg_run_min"))
        & (coerce_numeric("switch_rate_local") <= F.col("_t_switch_rate_max"))
    )
    if use_exhaustion:
        ex = coerce_numeric("exhaustion_ratio")
        on = on & (ex >= F.col("_t_exhaustion_min")) & (ex <= F.col("_t_exhaustion_max"))
    return df.withColumn(out, F.coalesce(on, F.lit(False))).drop(*[f"_t_{n}" for n in names])


# -- signals ---------------------------------------------------------------

def entry_signal(bars: DataFrame, predictions: DataFrame, restrict: bool = True, pred: str = "pred",
                 rows_per_day: int = 288, keys=("series_id",)) -> DataFrame:
    """Sign of the prediction where the gate is open, else 0; rows are numbered anew.

    With `restrict` only bars between the first and last prediction of the series stay.
    """
    keys = list(keys)
    p = predictions.filter("ts IS NOT NULL").select(*keys, "ts", "gate_on", pred)
    rows = bars.drop("idx", "gate_on", pred).filter("ts IS NOT NULL AND close IS NOT NULL")
    if restrict:
        span = p.groupBy(*keys).agg(F.min("ts").alias("_t0"), F.max("ts").alias("_t1"))
        rows = attach(rows, span, keys, "left").filter("_t0 IS NULL OR ts BETWEEN _t0 AND _t1").drop("_t0", "_t1")
    rows = rows.join(p, keys + ["ts"], "left").withColumn("gate_on", F.coalesce("gate_on", F.lit(False)))
    signal = F.when(F.col("gate_on") & F.col(pred).isNotNull(), F.signum(F.col(pred))).otherwise(0.0)
    return position_bars(rows.withColumn("entry_signal", signal), rows_per_day, keys)


def fill_bar_columns(df: DataFrame, n: int = 14, keys=("series_id",)) -> DataFrame:
    """Missing high/low become the close; a missing atr_14 becomes the mean range of
    n bars, or 0.  Needs `idx`."""
    for c in ("high", "low"):
        df = df.withColumn(c, F.coalesce(F.col(c), F.col("close")) if c in df.columns else F.col("close"))
    if "atr_14" in df.columns:
        return df
    w = last_rows(block_window(keys), n)
    opened = open_blocks(df, before=n).withColumn("_range", F.col("high") - F.col("low"))
    mean = F.when(F.col("idx") >= n - 1, F.avg("_range").over(w))
    return close_blocks(opened.withColumn("atr_14", F.coalesce(mean, F.lit(0.0))))


# -- exits -----------------------------------------------------------------

def first_touch_exit(df: DataFrame, cfg: RunConfig = RunConfig(), keys=("series_id",)) -> DataFrame:
    """One row per signal with the exit a trade opened there would have.

    The first of the next `horizon` bars, never the last bar of the series, that hits a
    rule.  On one bar the rules rank: time, stop, take, opposite signal.  Stop and take
    sit at the entry price minus/plus multiples of the ATR at entry.  No exit: NULLs.
    """
    h = cfg.horizon
    w = block_window(keys)
    opened = open_blocks(df, after=h + 1)
    d, px = F.col("entry_signal"), F.col("close")
    stop = px - d * cfg.stop_mult * F.col("atr_14")
    take = px + d * cfg.take_mult * F.col("atr_14")
    opened = opened.withColumn("final", F.lead("idx").over(w).isNull())
    ahead = {}
    for k in range(1, h + 1):
        for c in ("ts", "close", "high", "low", "entry_signal", "final"):
            ahead[f"_{c}_{k}"] = F.lead(c, k).over(w)
    opened = opened.withColumns(ahead)
    signals = opened.filter((d != 0) & ~F.col("final") & F.col("_own"))

    exits = []
    for k in range(1, h + 1):
        close, high, low, sig = (F.col(f"_{c}_{k}") for c in ("close", "high", "low", "entry_signal"))
        usable = F.coalesce(~F.col(f"_final_{k}"), F.lit(False))

        def leave(price, reason, k=k):
            return F.struct(F.lit(k).alias("bars"), F.col(f"_ts_{k}").alias("ts"),
                            price.cast("double").alias("px"), F.lit(reason).alias("reason"))

        if k == h:
            found = F.when(usable, leave(close, "time_exit"))
        else:
            found = (
                F.when(usable & F.when(d > 0, low <= stop).otherwise(high >= stop), leave(stop, "stop_loss"))
                .when(usable & F.when(d > 0, high >= take).otherwise(low <= take), leave(take, "take_profit"))
                .when(usable & (sig != 0) & (F.signum(sig) != F.signum(d)), leave(close, "signal_flip"))
            )
        exits.append(found)
    out = signals.withColumn("_exit", F.coalesce(*exits))
    return out.select(
        *keys, "idx", F.col("ts").alias("entry_time"), d.alias("dir"), px.alias("entry_px"),
        (F.col("idx") + F.col("_exit.bars")).alias("exit_idx"), F.col("_exit.ts").alias("exit_time"),
        F.col("_exit.px").alias("exit_px"), F.col("_exit.reason").alias("exit_reason"),
    )


def _block_starts(maps: DataFrame, horizon: int, keys) -> DataFrame:
    """For each block, how many of its first bars are still covered by an earlier trade.

    `maps` has one short array per block: entry offset -> offset into the next block.  Maps of CHAIN_FAN blocks are
    composed into one, and so on until a series has one group; the starts then come down the tree.  No task sees more
    than CHAIN_FAN maps of a series.
    """
    import numpy as np
    import pandas as pd

    types = ", ".join(f"{k} {maps.schema[k].dataType.simpleString()}" for k in keys)
    closed = horizon + 1

    def passed(start, bars: int):
        """Offsets after `bars` bars without a signal, which use up an open trade."""
        return np.where(start == closed, closed, np.maximum(0, start - bars))

    def compose(size: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_blk")
            group = pdf["_grp"].iloc[0]
            now, before = np.arange(closed + 1), group * CHAIN_FAN - 1
            for blk, step in zip(pdf["_blk"], pdf["_map"]):
                now = np.append(step, closed)[passed(now, size * (blk - before - 1))]
                before = blk
            now = passed(now, size * ((group + 1) * CHAIN_FAN - 1 - before))
            return pdf[keys].iloc[:1].assign(_blk=group, _map=[now[:-1].astype(np.int32)])
        return run

    def walk(size: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_blk")
            start, before, starts = np.int64(pdf["_given"].iloc[0]), pdf["_grp"].iloc[0] * CHAIN_FAN - 1, []
            for blk, step in zip(pdf["_blk"], pdf["_map"]):
                start = int(passed(start, size * (blk - before - 1)))
                starts.append(start)
                start = np.int64(closed if start == closed else step[start])
                before = blk
            return pdf[[*keys, "_blk"]].assign(_start=starts)
        return run

    levels, size = [maps], CHAIN_BLOCK
    last = maps.agg(F.max("_blk")).first()[0] or 0
    while last >= CHAIN_FAN:
        grouped = levels[-1].withColumn("_grp", F.expr(f"_blk div {CHAIN_FAN}"))
        levels.append(stage(grouped.groupBy(*keys, "_grp").applyInPandas(compose(size), f"{types}, _blk bigint, _map array<int>"), "maps"))
        last, size = last // CHAIN_FAN, size * CHAIN_FAN
    given = levels[-1].select(*keys).distinct().withColumns({"_grp": F.lit(0).cast("long"), "_given": F.lit(0)})
    for level in reversed(levels):
        grouped = level.withColumn("_grp", F.expr(f"_blk div {CHAIN_FAN}")).join(given, [*keys, "_grp"])
        starts = grouped.groupBy(*keys, "_grp").applyInPandas(walk(size), f"{types}, _blk bigint, _start int")
        given = starts.withColumnsRenamed({"_blk": "_grp", "_start": "_given"})
        size //= CHAIN_FAN
    return starts


def non_overlapping_trades(signals: DataFrame, horizon: int, keys=("series_id",)) -> DataFrame:
    """The trades actually taken: a signal inside an open trade is ignored.

    Which signal is taken depends on the trade before it, so signals are folded in
    order, inside blocks of CHAIN_BLOCK bars.  A trade ends at most `horizon` bars
    later, so all a block needs to know is an offset of 0 ... horizon into it.  Each
    block is summarised as a map between such offsets, the maps (one per block) are
    chained per series, and the blocks are then folded again from their true start.
    """
    keys = list(keys)
    names = [c for c in signals.columns if c not in keys and c != "idx"]
    leave = F.coalesce("exit_idx", F.lit(NEVER))
    entry = F.struct(F.col("idx"), leave.alias("_leave"), *names)
    blocks = stage(
        signals.groupBy(*keys, F.expr(f"idx div {CHAIN_BLOCK}").alias("_blk"))
        .agg(F.array_sort(F.collect_list(entry)).alias("_signals")), "signals")
    first = F.col("_blk") * CHAIN_BLOCK

    def after(start):
        return F.aggregate("_signals", start, lambda free, s: F.when(s["idx"] >= free, s["_leave"]).otherwise(free))

    offsets = []
    for o in range(horizon + 1):
        free = after(first + F.lit(o).cast("long"))
        nxt = F.greatest(free - first - CHAIN_BLOCK, F.lit(0).cast("long"))
        offsets.append(F.when(free >= NEVER, F.lit(horizon + 1)).otherwise(nxt).cast("int"))
    maps = blocks.select(*keys, "_blk", F.array(*offsets).alias("_map"))
    starts = _block_starts(maps, horizon, keys)
    # A block after a trade without exit is closed altogether.
    free0 = F.when(F.col("_start") > horizon, F.lit(NEVER)).otherwise(first + F.col("_start"))
    state = F.struct(free0.alias("free"), F.array().cast("array<bigint>").alias("taken"))

    def fold(acc, s):
        take = F.struct(s["_leave"].alias("free"),
                        F.concat(acc["taken"], F.array(s["idx"])).alias("taken"))
        return F.when(s["idx"] >= acc["free"], take).otherwise(acc)

    chosen = blocks.join(starts, keys + ["_blk"]).withColumn(
        "_taken", F.aggregate("_signals", state, fold)["taken"])
    kept = F.filter("_signals", lambda s: F.array_contains(F.col("_taken"), s["idx"]))
    return chosen.select(*keys, F.explode(kept).alias("_s")).select(
        *keys, F.col("_s.idx").alias("idx"), *[F.col(f"_s.{n}").alias(n) for n in names])


def trades_table(trades: DataFrame, keys=("series_id",)) -> DataFrame:
    """Closed trades with their log return."""
    return trades.filter("exit_idx IS NOT NULL").select(
        *keys, "entry_time", "exit_time", "dir", "entry_px", "exit_px",
        (log_return("exit_px", "entry_px") * F.col("dir")).alias("logret"), "exit_reason")


def positions_from_trades(bars: DataFrame, trades: DataFrame, leverage_max: float | None = 1.0,
                          keys=("series_id",)) -> DataFrame:
    """Column `position`: the direction from entry up to the bar before the exit.

    A trade covers at most horizon + 1 bars (one without exit starts that close to the
    end), so its bars are simply listed.
    """
    keys = list(keys)
    end = bars.groupBy(*keys).agg(F.max("idx").alias("_end"))
    held = attach(trades.select(*keys, "idx", "exit_idx", "dir"), end, keys)
    last = F.coalesce(F.col("exit_idx") - 1, F.col("_end"))
    held = held.select(*keys, F.explode(F.sequence("idx", last)).alias("idx"), F.col("dir").alias("position"))
    out = bars.join(held, keys + ["idx"], "left")
    pos = F.coalesce("position", F.lit(0.0))
    if leverage_max is not None:
        pos = clip(pos, -float(leverage_max), float(leverage_max))
    return out.withColumn("position", pos)


# -- profit and loss -------------------------------------------------------

def pnl(df: DataFrame, cfg: RunConfig = RunConfig(), keys=("series_id",)) -> DataFrame:
    """ret_1, turnover, cost, strategy_ret and equity per bar.  Needs `position`."""
    keys = list(keys)
    df = stage(df, "positions")
    w = block_window(keys)
    opened = open_blocks(df, before=1)
    held = F.lag("position").over(w)
    opened = opened.withColumns({
        "ret_1": F.coalesce(log_return(F.col("close"), F.lag("close").over(w)), F.lit(0.0)),
        "turnover": F.coalesce(F.abs(F.col("position") - held),
                               F.abs("position") if cfg.charge_first_bar else F.lit(0.0)),
        "_held": F.coalesce(held, F.lit(0.0)),
    })
    opened = opened.withColumn("cost", F.col("turnover") * cfg.cost_bps / 10000.0)
    opened = opened.withColumn("strategy_ret", F.col("_held") * F.col("ret_1") - F.col("cost"))
    rows = own_rows(opened).drop("_held")
    out = carry(rows, keys, {"_sum": ("sum", F.col("strategy_ret"))})
    return out.withColumn("equity", F.exp("_sum")).drop("_sum")


def daily_sharpe(df: DataFrame, ret: str = "strategy_ret", keys=("series_id",)) -> DataFrame:
    """Annualised Sharpe ratio of daily sums; NULL below 10 rows or without spread."""
    r = F.coalesce(coerce_numeric(ret), F.lit(0.0))
    days = df.filter("ts IS NOT NULL").groupBy(*keys, day_of().alias("day")).agg(
        F.sum(r).alias("_r"), F.count(F.lit(1)).alias("_n"))
    sd = F.stddev_samp("_r")
    return days.groupBy(*keys).agg(
        F.when((F.sum("_n") >= 10) & (sd > 0), F.avg("_r") / sd * F.sqrt(F.lit(252.0))).alias("sharpe_daily"))


def drawdown(df: DataFrame, equity: str = "equity", keys=("series_id",)) -> DataFrame:
    """Column `drawdown` from the running maximum.  Needs `idx`."""
    df = carry(stage(df, "equity"), list(keys), {"_peak": ("max", F.col(equity))})
    return df.withColumn("drawdown", ratio(F.col(equity) - F.col("_peak"), "_peak")).drop("_peak")


def max_drawdown(df: DataFrame, equity: str = "equity", keys=("series_id",)) -> DataFrame:
    return drawdown(df, equity, keys).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def equity_sharpe(df: DataFrame, equity: str = "equity", keys=("series_id",)) -> DataFrame:
    """Net value (last / first) and Sharpe ratio of daily closing equity; no spread gives 0."""
    keys = list(keys)
    daily = df.groupBy(*keys, day_of().alias("day")).agg(
        F.max_by(equity, "ts").alias("_last"), F.min_by(equity, "ts").alias("_first"))
    w = Window.partitionBy(*keys).orderBy("day")     # one row per calendar day
    daily = daily.withColumn("_r", F.coalesce(ratio("_last", F.lag("_last").over(w)) - 1, F.lit(0.0)))
    sd = F.stddev_samp("_r")
    return daily.groupBy(*keys).agg(
        ratio(F.max_by("_last", "day"), F.min_by("_first", "day")).alias("net_value"),
        F.when(sd > 0, F.avg("_r") / sd * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"))


def run_stats(df: DataFrame, trades: DataFrame, keys=("series_id",)) -> DataFrame:
    """All run figures per key: Sharpe, final equity, drawdown, trades, activity, gate."""
    keys = list(keys)
    df = stage(df, "equity")
    base = df.groupBy(*keys).agg(
        F.max_by("equity", "idx").alias("final_equity"),
        F.count_if(F.col("position") != 0).alias("active_bars"),
        F.avg(F.col("gate_on").cast("double")).alias("gate_coverage"),
        F.count_if("gate_on").alias("gated_n"),
    )
    n = trades.filter("exit_idx IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trades"))
    out = base.join(daily_sharpe(df, keys=keys), keys, "left").join(max_drawdown(df, keys=keys), keys, "left")
    return out.join(n, keys, "left").fillna(0, ["n_trades"])


def backtest(bars: DataFrame, predictions: DataFrame, cfg: RunConfig = RunConfig(), barriers: str = "real",
             rows_per_day: int = 288, pred: str = "pred", keys=("series_id",)):
    """Signals, trades and equity in one call: (bar table, trades with open ones).

    barriers="degenerate" drops high, low and ATR first, which makes every trade leave
    on the next bar at its entry price.
    """
    if barriers == "degenerate":
        bars = bars.drop("high", "low", "atr_14")
    table = stage(fill_bar_columns(entry_signal(bars, predictions, pred=pred, rows_per_day=rows_per_day, keys=keys),
                                   keys=keys), "signals")
    trades = stage(non_overlapping_trades(first_touch_exit(table, cfg, keys), cfg.horizon, keys), "trades")
    return pnl(positions_from_trades(table, trades, cfg.leverage_max, keys), cfg, keys), trades
