"""Trading days and walk-forward windows.

Everything here works on distinct days, of which a series has at most 366 a year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import at_time, cycle_name, day_of

# Session start and end.
SESSION_START = "09:35"
SESSION_END = "15:00"


def trading_days(bars: DataFrame, start: str | None = None, keys=("series_id",)) -> DataFrame:
    """Distinct days with an ordinal `day_idx` from 0."""
    days = bars.select(*keys, day_of("ts").alias("day"))
    if start is not None:
        days = days.filter(F.col("day") >= F.lit(start).cast("date"))
    w = Window.partitionBy(*keys).orderBy("day")
    return days.distinct().withColumn("day_idx", F.row_number().over(w) - 1)


def backstep_endpoints(days: DataFrame, step: int, min_start: str | None = None, keys=("series_id",)) -> DataFrame:
    """Every `step`-th day counted back from the last one."""
    last = F.max("day_idx").over(Window.partitionBy(*keys))
    out = days.withColumn("_last", last).filter(((F.col("_last") - F.col("day_idx")) % step) == 0)
    if min_start is not None:
        out = out.filter(F.col("day") >= F.lit(min_start).cast("date"))
    return out.drop("_last")


# -- series that cannot take part ---------------------------------------------
# An operator that finds nothing to work on for a series gives it a row with a text in
# `problem`, NULL elsewhere, instead of failing the job of all series.

def accepted(df: DataFrame) -> DataFrame:
    """Rows of the series without a problem."""
    return df.filter("problem IS NULL").drop("problem")


def rejected(df: DataFrame, keys=("series_id",)) -> DataFrame:
    """The other series and what is wrong with them."""
    return df.filter("problem IS NOT NULL").select(*keys, "problem").distinct()


def first_cutoff_in_month(endpoints: DataFrame, month: str, keys=("series_id",)) -> DataFrame:
    """Latest endpoint in a yyyy-MM month, one row per series; a series without one has a `problem` and no cutoff."""
    hit = F.when(F.date_format("day", "yyyy-MM") == month, F.col("day"))
    hit_idx = F.when(F.date_format("day", "yyyy-MM") == month, F.col("day_idx"))
    out = endpoints.groupBy(*keys).agg(F.max(hit).alias("cutoff"), F.max(hit_idx).alias("cutoff_idx"))
    return out.withColumn("problem", F.when(F.col("cutoff").isNull(), F.lit(f"no endpoint falls in {month}")))


def walk_forward_windows(days: DataFrame, step: int, first_idx: DataFrame | None = None,
                         keys=("series_id",)) -> DataFrame:
    """One row per cycle: evaluation window, trade window, cycle id.

    A cycle's cutoff is every `step`-th day from the first cutoff on, as long as a
    whole trade window of `step` days follows.  Without `first_idx` the first cutoff
    is the earliest day on the grid counted back from the last one; a series that has no
    `cutoff_idx` in it has no cycles.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("day_idx")
    every = Window.partitionBy(*keys)
    d = days.withColumns({
        "trade_first": F.lead("day", 1).over(w),
        "trade_last": F.lead("day", step).over(w),
        "eval_first": F.coalesce(F.lag("day", step - 1).over(w), F.min("day").over(every)),
        "_last": F.max("day_idx").over(every),
    })
    if first_idx is None:
        d = d.withColumn("cutoff_idx", F.col("_last") % step)
    else:
        d = d.join(first_idx.select(*keys, "cutoff_idx"), keys)
    d = d.filter((F.col("day_idx") >= F.col("cutoff_idx"))
                 & ((F.col("day_idx") - F.col("cutoff_idx")) % step == 0)
                 & F.col("trade_last").isNotNull())
    d = d.withColumn("cycle_no", ((F.col("day_idx") - F.col("cutoff_idx")) / step).cast("int"))
    return d.select(
        *keys, "cycle_no",
        cycle_name("cycle_no", "day", "trade_last").alias("cycle_id"),
        F.col("day").alias("cutoff_day"),
        at_time("eval_first", SESSION_START).alias("eval_start"),
        at_time("day", SESSION_END).alias("eval_end"),
        at_time("trade_first", SESSION_START).alias("trade_start"),
        at_time("trade_last", SESSION_END).alias("trade_end"),
    )


def next_n_days_window(days: DataFrame, data_end: str, n: int = 22, keys=("series_id",)) -> DataFrame:
    """The n days after the last day on or before `data_end`; no row if fewer follow."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("day_idx")
    d = days.withColumns({"_first": F.lead("day", 1).over(w), "_lastday": F.lead("day", n).over(w)})
    end = d.filter(F.col("day") <= F.lit(data_end).cast("date")).groupBy(*keys).agg(
        F.max("day").alias("end_day"), F.max_by("_first", "day").alias("_first"),
        F.max_by("_lastday", "day").alias("_lastday"))
    return end.filter("_lastday IS NOT NULL").select(
        *keys, "end_day", at_time("_first", SESSION_START).alias("trade_start"),
        at_time("_lastday", SESSION_END).alias("trade_end"))


def last_n_days(days: DataFrame, n: int, keys=("series_id",)) -> DataFrame:
    """The last n days of each series; one with too short a history has a single row, without a day and with a `problem`."""
    every = Window.partitionBy(*keys)
    total = F.count(F.lit(1)).over(every)
    d = days.withColumns({"_n": total, "_last": F.max("day_idx").over(every)})
    short = F.col("_n") < n
    d = d.filter(F.when(short, F.col("day_idx") == F.col("_last")).otherwise(F.col("day_idx") > F.col("_last") - n))
    d = d.withColumn("problem", F.when(short, F.format_string("only %d of %d trading days", F.col("_n"), F.lit(n))))
    return d.withColumn("day", F.when(~short, F.col("day"))).drop("_n", "_last")
