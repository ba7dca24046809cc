"""Label streams without a model, and summaries of label streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import day_of
from .blocks import attach, block_window, close_blocks, open_blocks, ranked


def quantile_states(df: DataFrame, column: str, q: int = 6, out: str = "state",
                    keys=("series_id",), rows_per_day: int = 288) -> DataFrame:
    """States 0 ... q-1 by rank of `column`; NULL counts as 0, ties go by time."""
    value = df.withColumn("_v", F.coalesce(F.col(column).cast("double"), F.lit(0.0)))
    r = ranked(value, keys, "_v", "ts", rank="_rank", total="_n")
    steps = F.col("_n") - 1
    up = F.expr(f"((_rank - 1) * {q} + _n - 2) div greatest(_n - 1, 1)")
    state = F.when(steps > 0, F.greatest(up, F.lit(1)) - 1).otherwise(0)
    return r.withColumn(out, state.cast("int")).drop("_v", "_rank", "_n")


def fit_mask(df: DataFrame, exclude_last_day: bool = True, start=None, end=None,
             min_rows: int = 0, keys=("series_id",)) -> DataFrame:
    """Boolean `fit`: rows a model may be fitted on.

    With `end`, rows in [start, end]; else all but the last day; else all.  A series
    with fewer than `min_rows` such rows is fitted on everything it has, and says so
    in `fit_fallback`.  A series without any row in [start, end] says so in `problem`,
    a column that only a date range adds.
    """
    keys = list(keys)
    facts = df.groupBy(*keys).agg(F.max(day_of()).alias("_last_day"))
    out = attach(df, facts, keys)
    if end is not None:
        mask = F.col("ts") <= F.lit(str(end)).cast("timestamp_ntz")
        if start is not None:
            mask = mask & (F.col("ts") >= F.lit(str(start)).cast("timestamp_ntz"))
    elif exclude_last_day:
        mask = day_of() < F.col("_last_day")
    else:
        mask = F.lit(True)
    out = out.withColumn("fit", mask).drop("_last_day")
    if end is not None:
        none = out.groupBy(*keys).agg(F.count_if("fit").alias("_fit"))
        text = F.format_string("no rows from %s to %s", F.lit(str(start or "the first")), F.lit(str(end)))
        out = attach(out, none, keys).withColumn("problem", F.when(F.col("_fit") == 0, text)).drop("_fit")
    if not min_rows:
        return out.withColumn("fit_fallback", F.lit(False))
    enough = out.groupBy(*keys).agg((F.count_if("fit") < min_rows).alias("fit_fallback"))
    out = attach(out, enough, keys)
    return out.withColumn("fit", F.col("fit") | F.col("fit_fallback"))


def scaling(df: DataFrame, columns, fit: Column | None = None, keys=("series_id",)) -> DataFrame:
    """Mean and population deviation of each column over the fit rows."""
    chosen = fit if fit is not None else F.lit(True)
    aggs = []
    for c in columns:
        x = F.when(chosen, F.col(c))
        sd = F.stddev_pop(x)
        aggs += [F.avg(x).alias(f"_m_{c}"), F.when(sd > 0, sd).otherwise(1.0).alias(f"_s_{c}")]
    return df.groupBy(*keys).agg(*aggs)


def standardize(df: DataFrame, columns, fit: Column | None = None, keys=("series_id",), suffix: str = "_z") -> DataFrame:
    """z-scores with the mean and population deviation of the fit rows."""
    out = attach(df, scaling(df, columns, fit, keys), keys)
    out = out.withColumns({c + suffix: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in columns})
    return out.drop(*[f"_{p}_{c}" for c in columns for p in "ms"])


def align_labels(df: DataFrame, state: str, value: str, out: str = "state_aligned", keys=("series_id",)) -> DataFrame:
    """Renumber labels so that 0 has the smallest variance of `value`."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col("_var").asc_nulls_first(), F.col(state))
    order = (
        df.groupBy(*keys, state).agg(F.var_pop(value).alias("_var"))
        .withColumn(out, (F.row_number().over(w) - 1).cast("int")).drop("_var")
    )
    return attach(df, order, keys + [state])


def previous_label(df: DataFrame, state: str, out: str, keys=("series_id",)) -> DataFrame:
    """Label of the preceding row of the series; needs `idx`."""
    opened = open_blocks(df, before=1)
    return close_blocks(opened.withColumn(out, F.lag(state).over(block_window(keys))))


def transition_matrix(df: DataFrame, state: str, n_states: int, keys=("series_id",)) -> DataFrame:
    """Share of moves from each state to each state: one row per pair, zeros included."""
    keys = list(keys)
    moves = (
        previous_label(df.select(*keys, "idx", state), state, "from_state", keys)
        .filter(F.col("from_state").isNotNull() & F.col(state).isNotNull())
        .groupBy(*keys, "from_state", F.col(state).alias("to_state")).agg(F.count(F.lit(1)).alias("_n"))
    )
    states = F.sequence(F.lit(0), F.lit(n_states - 1))
    grid = (
        df.select(*keys).distinct()
        .withColumn("from_state", F.explode(states)).withColumn("to_state", F.explode(states))
    )
    full = grid.join(moves, keys + ["from_state", "to_state"], "left")
    n = F.coalesce("_n", F.lit(0))
    row = F.sum(n).over(Window.partitionBy(*keys, "from_state"))
    return full.select(*keys, "from_state", "to_state", n.alias("moves"),
                       F.when(row > 0, n / row).otherwise(0.0).alias("prob"))


def transition_table(matrix: DataFrame, n_states: int, keys=("series_id",)) -> DataFrame:
    """The matrix with one column per target state."""
    cols = [F.max(F.when(F.col("to_state") == i, F.col("prob"))).alias(f"to_{i}") for i in range(n_states)]
    return matrix.groupBy(*keys, "from_state").agg(*cols)


def state_portrait(df: DataFrame, state: str, tf: str, keys=("series_id",)) -> DataFrame:
    return df.filter(F.col(state).isNotNull()).groupBy(*keys, state).agg(
        F.count(F.lit(1)).alias("count"), F.avg("ret_1").alias("ret_mean"),
        F.stddev_samp("ret_1").alias("ret_std"), F.avg("vol_short").alias("vol_short_mean"),
        F.avg("trend_strength").alias("trend_strength_mean"),
    ).withColumn("tf", F.lit(tf))
