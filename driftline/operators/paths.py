"""Causal run-length statistics of a label stream.

Input tables have the keys, `idx` (0-based position) and a label column.  Runs may be
as long as the series: the start of a run is carried from block to block, and rows of
a long run meet their run's values in parts of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RunConfig
from . import blocks
from .blocks import (attach, block_window, carry, close_blocks, last_rows, open_blocks, own_rows, stage,
                     with_position)
from .indicators import ewma, ewma_block, memory


def with_runs(df: DataFrame, state: str = "state", keys=("series_id",)) -> DataFrame:
    """Add `switch` (1 on a change and on the first row), `run_start` and `run_len`."""
    df = stage(df, "labels")
    opened = open_blocks(df, before=1)
    prev = F.lag(state).over(block_window(keys))
    changed = (F.col("idx") == 0) | ~F.col(state).eqNullSafe(prev)
    rows = own_rows(opened.withColumn("switch", changed.cast("int")))
    out = carry(rows, keys, {"run_start": ("max", F.when(F.col("switch") == 1, F.col("idx")))})
    return out.withColumn("run_len", F.col("idx") - F.col("run_start") + 1)


def with_recent_runs(df: DataFrame, state: str, window: int, keys=("series_id",),
                     switch_window: int | None = None, min_periods: int = 10) -> DataFrame:
    """Count and mean length of the completed runs of the current label that ended
    within the last `window` rows; with `switch_window` also the switch rate."""
    reach = max(window + 1, switch_window or 0)
    w = block_window(keys)
    df = open_blocks(df, before=reach)
    if switch_window:
        rate = F.avg("switch").over(last_rows(w, switch_window))
        df = df.withColumn("switch_rate_local", F.when(F.col("idx") >= min_periods - 1, rate))
    ended = F.when(F.lead("run_start").over(w) != F.col("run_start"), F.col("run_len"))
    df = df.withColumn("_ended", ended)
    recent = block_window(keys, state).rangeBetween(-window, -1)
    df = df.withColumns({"recent_runs": F.count("_ended").over(recent),
                         "recent_mean": F.avg("_ended").over(recent)})
    return close_blocks(df)


def expected_life(df: DataFrame, state: str, window: int, out: str = "avg_run_local", keys=("series_id",)) -> DataFrame:
    """Mean length of recent completed runs of the label, else the current age.

    Needs `with_runs`.
    """
    recent = with_recent_runs(df, state, window, keys)
    return recent.withColumn(out, F.coalesce("recent_mean", F.col("run_len").cast("double"))).drop(
        "recent_runs", "recent_mean")


def run_table(df: DataFrame, state: str, keys=("series_id",)) -> DataFrame:
    """One row per run: start, label, length.  Counted before the shuffle."""
    return df.groupBy(*keys, "run_start").agg(F.max(state).alias(state), F.max("run_len").alias("len"))


def run_averages(runs: DataFrame, state: str, alpha: float, keys=("series_id",)) -> DataFrame:
    """Exponential average of run lengths per label, after each run (`after`) and
    before it (`before`); `nth` counts the runs of the label from 0."""
    keys = list(keys)
    group = keys + [state]
    placed = with_position(runs, group, ["run_start"], F.expr("run_start div 65536"))
    opened = open_blocks(placed, before=memory(alpha), size=min(blocks.BLOCK, ewma_block(alpha) - memory(alpha)))
    w = block_window(group)
    opened = opened.withColumn("_step", F.row_number().over(w) - 1)
    opened = opened.withColumn("after", ewma("len", alpha, w))
    opened = opened.withColumn("before", F.lag("after").over(w))
    return close_blocks(opened).withColumnRenamed("idx", "nth")


def run_priors(runs: DataFrame, state: str, alpha: float, keys=("series_id",)) -> DataFrame:
    """Prior expectation for each run: the label's own average so far, or for a label
    seen for the first time the mean of the other labels' averages."""
    keys = list(keys)
    avg = stage(run_averages(runs, state, alpha, keys), "runavg")
    # A series has one first run per label, so this list is as short as the label set.
    firsts = avg.filter((F.col("nth") == 0) & (F.col("run_start") > 0)).groupBy(*keys).agg(
        F.collect_list("run_start").alias("_firsts"))
    earlier = attach(avg, firsts, keys).withColumn(
        "_at", F.explode(F.filter("_firsts", lambda s: s > F.col("run_start"))))
    others = (
        earlier.groupBy(*keys, "_at", state).agg(F.max_by("after", "run_start").alias("_last"))
        .groupBy(*keys, F.col("_at").alias("run_start")).agg(F.avg("_last").alias("_others"))
    )
    out = avg.join(others, keys + ["run_start"], "left")
    return out.select(*keys, "run_start", "len", F.coalesce("before", "_others").alias("prior"))


def expected_life_ewma(df: DataFrame, state: str, cfg: RunConfig = RunConfig(), out: str = "avg_run_local",
                       keys=("series_id",), switch_rate: bool = False) -> DataFrame:
    """Mean of recent completed runs, blended with a slow average when there are few.

    Needs `with_runs`.
    """
    keys = list(keys)
    window, least = max(20, cfg.run_window), max(1, cfg.min_hist_runs)
    df = stage(df, "runs")
    rows = with_recent_runs(df, state, window, keys, cfg.switch_window if switch_rate else None,
                            cfg.switch_min_periods)
    age = F.col("run_len").cast("double")
    n, mean, prior = F.col("recent_runs"), F.col("recent_mean"), F.col("_prior")
    if cfg.use_prior and cfg.run_alpha > 0:
        runs = stage(run_table(df, state, keys), "runtable")
        priors = run_priors(runs, state, cfg.run_alpha, keys)
        # A run meets its rows in parts of BLOCK rows, however long it is.
        priors = priors.withColumn("_part", F.explode(F.sequence(F.lit(0), F.expr(f"cast((len - 1) div {blocks.BLOCK} as int)"))))
        priors = priors.select(*keys, "run_start", "_part", F.col("prior").alias("_prior"))
        part = F.expr(f"cast((idx - run_start) div {blocks.BLOCK} as int)")
        rows = rows.withColumn("_part", part).join(priors, keys + ["run_start", "_part"], "left")
    else:
        rows = rows.withColumn("_prior", F.lit(None).cast("double"))
    weight = F.greatest(F.lit(1), F.lit(least) - n)
    value = (
        F.when((n >= least) & mean.isNotNull(), mean)
        .when(prior.isNull() | (prior <= 0), age)
        .when(mean.isNull(), prior)
        .otherwise((mean * n + prior * weight) / (n + weight))
    )
    return rows.withColumn(out, F.greatest(F.lit(1.0), value)).drop("_part", "_prior", "recent_runs", "recent_mean")


def switch_rate(df: DataFrame, window: int = 50, min_periods: int = 10, keys=("series_id",)) -> DataFrame:
    """Rolling share of rows on which the label changed.  Needs `with_runs`."""
    w = block_window(keys)
    rate = F.avg("switch").over(last_rows(w, window))
    opened = open_blocks(df, before=window)
    return close_blocks(opened.withColumn("switch_rate_local", F.when(F.col("idx") >= min_periods - 1, rate)))


def path_metrics(df: DataFrame, state: str = "super_state", cfg: RunConfig = RunConfig(), keys=("series_id",)) -> DataFrame:
    """avg_run_local, run_len_so_far, exhaustion_ratio and switch_rate_local.

    A missing label counts as the label -1.
    """
    df = df.withColumn(state, F.coalesce(F.col(state), F.lit(-1)))
    rows = expected_life_ewma(with_runs(df, state, keys), state, cfg, keys=keys, switch_rate=True)
    rows = rows.withColumnRenamed("run_len", "run_len_so_far").drop("run_start", "switch")
    return rows.withColumn("exhaustion_ratio",
                           F.col("run_len_so_far") / F.greatest("avg_run_local", F.lit(1e-6)))


def path_seed_by_state(df: DataFrame, state: str, cfg: RunConfig = RunConfig(), keys=("series_id",)) -> DataFrame:
    """Per label: the completed runs still in its window, their sum, and the average.

    A label's runs are judged at its own last visit.  Needs `with_runs`.
    """
    keys = list(keys)
    window = max(20, cfg.run_window)
    runs = stage(run_table(stage(df, "runs"), state, keys), "runtable")
    avg = run_averages(runs, state, cfg.run_alpha, keys).withColumn("end", F.col("run_start") + F.col("len") - 1)
    ends = runs.withColumn("end", F.col("run_start") + F.col("len") - 1)
    visit = ends.groupBy(*keys, state).agg(F.max("end").alias("_visit"))
    final = ends.groupBy(*keys).agg(F.max("end").alias("_final"))
    rows = attach(avg, visit.join(final, keys), keys + [state])
    done = rows.filter(F.col("end") < F.col("_final"))
    kept = F.col("end") >= F.col("_visit") - window
    # At most `window` runs can end within `window` rows.
    return done.groupBy(*keys, state).agg(
        F.array_sort(F.collect_list(F.when(kept, F.struct("end", "len")))).alias("runs"),
        F.sum(F.when(kept, F.col("len")).otherwise(0)).alias("sum_len"),
        F.max_by("after", "run_start").alias("ewma_mean"), F.count(F.lit(1)).alias("ewma_n"),
    )


def path_seed(df: DataFrame, state: str, cfg: RunConfig = RunConfig(), keys=("series_id",)) -> DataFrame:
    """One JSON document per series from which the statistics can be continued."""
    keys = list(keys)
    df = stage(df, "runs")
    per_state = path_seed_by_state(df, state, cfg, keys).withColumn("_s", F.col(state).cast("string"))
    maps = per_state.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_s", "runs"))).alias("per_state_runs"),
        F.map_from_entries(F.collect_list(F.struct("_s", "sum_len"))).alias("per_state_sums"),
        F.map_from_entries(F.collect_list(F.struct("_s", F.struct(
            F.col("ewma_mean").alias("mean"), F.col("ewma_n").alias("n"))))).alias("ewma"),
    )
    end = df.groupBy(*keys).agg(
        F.max("idx").alias("_end"), F.max_by(state, "idx").alias("last_state"),
        F.max_by("run_len", "idx").alias("cur_run_len"), F.max("ts").alias("seed_until_time"))
    tail = attach(df, end.select(*keys, "_end"), keys).filter(F.col("idx") > F.col("_end") - cfg.switch_window)
    buf = tail.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "switch"))), lambda s: s["switch"]).alias("switch_buf"))
    doc = end.join(maps, keys, "left").join(buf, keys)
    mode = "expected_life_online_ewma" if cfg.use_prior and cfg.run_alpha > 0 else "expected_life"
    fixed = {
        "path_metric_mode": F.lit(mode), "avg_run_window": F.lit(max(20, cfg.run_window)),
        "switch_window": F.lit(cfg.switch_window), "switch_min_periods": F.lit(cfg.switch_min_periods),
        "min_hist_runs": F.lit(cfg.min_hist_runs), "use_ewma_prior": F.lit(cfg.use_prior),
        "ewma_alpha_run": F.lit(cfg.run_alpha), "seed_n": F.col("_end") + 1,
    }
    doc = doc.withColumns(fixed)
    fields = [*fixed, "per_state_runs", "per_state_sums", "ewma", "last_state", "cur_run_len", "switch_buf",
              "seed_until_time"]
    return doc.select(*keys, F.to_json(F.struct(*fields)).alias("seed"))
