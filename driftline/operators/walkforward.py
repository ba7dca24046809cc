"""Selection of runs per cycle and combination of their equity curves.

An evaluation table has one row per cycle and seed triplet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import finite, triplet_text
from .bars import dedupe_time
from . import blocks
from .blocks import (attach, block_window, carry, close_blocks, day_bucket, open_blocks, stage, with_position)
from .indicators import ewma, ewma_block, memory


def drawdown_size(cfg: RunConfig):
    """Magnitude of the drawdown; unknown counts as twice the limit."""
    return F.coalesce(F.abs(finite("eval_max_dd")), F.lit(2 * cfg.max_dd_eval))


def candidate_tiers(evals: DataFrame, cfg: RunConfig = RunConfig()) -> DataFrame:
    """Booleans `strict`, `relaxed` (drawdown not judged) and `last_resort`.

    With `reject_fallback` a run whose models were fitted on their trade window as well is none of them.
    """
    ok = F.coalesce("engine_ok", F.lit(False))
    if cfg.reject_fallback and "fit_fallback" in evals.columns:
        ok = ok & ~F.coalesce("fit_fallback", F.lit(False))
    trades = F.coalesce("eval_trades", F.lit(0))
    coverage = finite("eval_gate_coverage")
    relaxed = (
        ok & finite("eval_sharpe_daily").isNotNull() & (trades >= cfg.min_trades_eval)
        & (F.coalesce("eval_active_bars", F.lit(0)) >= cfg.min_active_eval)
        & (coverage.isNull() | coverage.between(cfg.min_coverage_eval, cfg.max_coverage_eval))
    )
    return evals.withColumns({
        "strict": relaxed & (drawdown_size(cfg) <= cfg.max_dd_eval),
        "relaxed": relaxed,
        "last_resort": ok & (trades > 0),
    })


def choose_candidates(tiers: DataFrame, cfg: RunConfig = RunConfig(), mode: str = "relax", cycle=("cycle_no",)) -> DataFrame:
    """Rows of the tier each cycle uses, named in `tier`.

    Strict when it has top_k rows; else relaxed if there are any; else the last resort.
    """
    cycle = list(cycle)
    sizes = tiers.groupBy(*cycle).agg(
        F.count_if("strict").alias("_strict"), F.count_if("relaxed").alias("_relaxed"),
        F.count_if("last_resort").alias("_last"))
    if mode == "relax":
        tier = (F.when(F.col("_strict") >= cfg.top_k, "strict").when(F.col("_relaxed") > 0, "relaxed")
                .when(F.col("_last") > 0, "last_resort").otherwise("strict"))
    else:
        tier = F.lit("strict")
    out = attach(tiers, sizes.select(*cycle, tier.alias("tier")), cycle)
    keep = (F.when(F.col("tier") == "strict", F.col("strict")).when(F.col("tier") == "relaxed", F.col("relaxed"))
            .otherwise(F.col("last_resort")))
    return out.filter(keep)


def robust_score(evals: DataFrame, cfg: RunConfig = RunConfig()) -> DataFrame:
    few = F.greatest(F.lit(0), F.lit(cfg.min_trades_eval) - F.coalesce("eval_trades", F.lit(0)))
    score = finite("eval_sharpe_daily") - cfg.lambda_dd * drawdown_size(cfg) - cfg.lambda_low_trades * few
    return evals.withColumn("robust_score", F.coalesce(finite(score), F.lit(-1e9)))


def ema_score(candidates: DataFrame, cfg: RunConfig = RunConfig(), cycle: str = "cycle_no", by=()) -> DataFrame:
    """Score smoothed over the cycles in which a triplet was a candidate.

    The candidates of a cycle do not depend on the smoothed score, so it is an
    exponential average along the cycles and needs no loop over them.
    """
    keys = [*by, "seed_triplet"]
    rows = candidates.withColumn("seed_triplet", triplet_text())
    rows = with_position(rows, keys, [cycle], F.expr(f"{cycle} div 4096"))
    reach = memory(cfg.ema_alpha)
    opened = open_blocks(rows, before=reach, size=min(blocks.BLOCK, ewma_block(cfg.ema_alpha) - reach))
    w = block_window(keys)
    opened = opened.withColumn("_step", F.row_number().over(w) - 1)
    out = close_blocks(opened.withColumn("ema_score", ewma("robust_score", cfg.ema_alpha, w)))
    return out.drop("idx")


def top_k(scored: DataFrame, k: int = 5, cycle=("cycle_no",)) -> DataFrame:
    """The k best of each cycle with their `place` (1 is best).

    Spark applies the limit before the shuffle, so a large sweep sends k rows per task.
    """
    w = Window.partitionBy(*cycle).orderBy(
        F.desc("ema_score"), F.desc("robust_score"), F.desc("eval_sharpe_daily"), "rs_5m", "rs_30m", "rs_1d")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def select_runs(evals: DataFrame, cfg: RunConfig = RunConfig(), mode: str = "relax") -> DataFrame:
    """The selection of every cycle at once."""
    chosen = choose_candidates(candidate_tiers(stage(evals, "evals"), cfg), cfg, mode)
    scored = ema_score(stage(robust_score(chosen, cfg), "scores"), cfg)
    return top_k(scored, cfg.top_k)


# -- curves: (cycle, member, ts, equity) -----------------------------------

def rescale_to_1(curves: DataFrame, keys=("cycle_no", "member")) -> DataFrame:
    """Divide each curve by its first value; a curve starting at 0 stays as it is."""
    keys = list(keys)
    base = curves.groupBy(*keys).agg(F.min_by("equity", "ts").alias("_base"))
    out = attach(curves, base, keys)
    scaled = F.when(F.col("_base") != 0, F.col("equity") / F.nullif("_base", F.lit(0.0)))
    return out.withColumn("equity", F.when(F.col("_base") == 0, F.col("equity")).otherwise(scaled)).drop("_base")


def combine_curves(curves: DataFrame, pad_to: int | None = None, rows_per_day: int = 288,
                   cycle=("cycle_no",), out: str = "eq_rel_combo") -> DataFrame:
    """Mean of a cycle's curves on the union of their times.

    Every curve is carried forward over the times it lacks and is 1 before it starts.
    `pad_to` adds constant curves up to that number.
    """
    cycle = list(cycle)
    curves = stage(curves, "curves")
    times = with_position(curves.select(*cycle, "ts").distinct(), cycle, ["ts"], day_bucket(rows_per_day))
    # A cycle trades at most top_k members.
    members = curves.groupBy(*cycle).agg(F.collect_set("member").alias("_members"))
    grid = attach(times, members, cycle).withColumn("member", F.explode("_members")).drop("_members")
    long = stage(grid.join(curves.select(*cycle, "member", "ts", "equity"), [*cycle, "member", "ts"], "left"), "grid")
    filled = carry(long, [*cycle, "member"], {"_eq": ("last", F.col("equity"))})
    value = F.coalesce("_eq", F.lit(1.0))
    if pad_to:
        n = F.count(F.lit(1))
        mean = (F.sum(value) + F.greatest(F.lit(pad_to) - n, F.lit(0))) / F.greatest(F.lit(pad_to), n)
    else:
        mean = F.avg(value)
    return filled.groupBy(*cycle, "ts").agg(mean.alias(out))


def flat_curve(bars: DataFrame, windows: DataFrame, value: float = 1.0, keys=("series_id",),
               out: str = "eq_rel_combo") -> DataFrame:
    """Constant curve on the bar times of each window (cycle_no, trade_start, trade_end).

    A window without bars gets its two end points.
    """
    keys = list(keys)
    wins = windows.select(*keys, "cycle_no", "trade_start", "trade_end")
    # Windows of a series do not overlap: a day belongs to at most one of them.
    days = F.sequence(F.col("trade_start").cast("date"), F.col("trade_end").cast("date"))
    by_day = wins.withColumn("_day", F.explode(days))
    t = bars.select(*keys, "ts").distinct().withColumn("_day", F.col("ts").cast("date"))
    inside = t.join(by_day, [*keys, "_day"]).filter("ts BETWEEN trade_start AND trade_end")
    points = inside.select(*keys, "cycle_no", "ts")
    empty = wins.join(points.select(*keys, "cycle_no").distinct(), [*keys, "cycle_no"], "left_anti")
    ends = empty.select(*keys, "cycle_no", F.explode(F.array("trade_start", "trade_end")).alias("ts"))
    return points.unionByName(ends).withColumn(out, F.lit(float(value)))


def compound_cycles(combined: DataFrame, cycle: str = "cycle_no", by=(), value: str = "eq_rel_combo") -> DataFrame:
    """eq_global: each cycle's curve times the final values of the cycles before it."""
    by = list(by)
    finals = combined.groupBy(*by, cycle).agg(F.max_by(value, "ts").alias("_final"))
    # One row per cycle.
    w = Window.partitionBy(*by).orderBy(cycle).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.exp(F.sum(F.log("_final")).over(w)), F.lit(1.0))
    starts = finals.select(*by, cycle, start.alias("_start"))
    return attach(combined, starts, by + [cycle]).withColumn("eq_global", F.col(value) * F.col("_start")).drop("_start")


def stitch(curves: DataFrame, cycle: str = "cycle_no", by=()) -> DataFrame:
    """One curve; where cycles overlap in time the later cycle counts."""
    return dedupe_time(curves, order=cycle, keep="last", keys=(*by, "ts"))


def selection_history(selected: DataFrame, windows: DataFrame, cycle=("cycle_no",)) -> DataFrame:
    return selected.join(windows.select(*cycle, "cycle_id", "trade_start", "trade_end"), list(cycle))


def cycle_debug(selected: DataFrame, curves: DataFrame, cycle=("cycle_no",)) -> DataFrame:
    """Per cycle: which selected runs delivered a curve and which did not."""
    cycle = list(cycle)
    have = curves.select(*cycle, "member").distinct().withColumn("_ok", F.lit(True))
    rows = selected.withColumn("live_id", F.concat(F.lit("LIVE"), F.col("place"), F.lit("_"), triplet_text()))
    rows = rows.join(have, [*cycle, "member"], "left")
    return rows.groupBy(*cycle).agg(
        F.array_sort(F.collect_list(F.when(F.col("_ok"), F.col("live_id")))).alias("live_ok"),
        F.array_sort(F.collect_list(F.when(F.col("_ok").isNull(), F.col("live_id")))).alias("live_missing"),
        F.count("_ok").alias("valid"))

