"""Cleaning and resampling of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BAR_COLUMNS


def dedupe_time(df: DataFrame, order: str, keep: str = "last", keys=("series_id", "ts")) -> DataFrame:
    """One row per key: the first or last in `order`.

    An aggregate rather than a window, so copies of one time are reduced before the
    shuffle however many there are.
    """
    others = [c for c in df.columns if c not in (*keys, order)]
    pick = F.max_by if keep == "last" else F.min_by
    edge = F.max if keep == "last" else F.min
    out = df.groupBy(*keys).agg(
        *[pick(c, order).alias(c) for c in others], edge(order).alias(order)
    )
    return out.select(*df.columns)


def clip_time_range(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Keep start <= ts <= end; the comparison reaches the file scan."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(str(end)).cast("timestamp_ntz"))
    return df


def is_daily(rule: str) -> bool:
    return rule.strip().lower() in ("1d", "d", "1 day", "day", "1 days")


def bar_time(rule: str, ts: str = "ts") -> Column:
    """Time of the bar a row belongs to.

    Intraday bins are open on the left, closed on the right and named by their end;
    daily bins are closed on the left and named by their start.
    """
    if is_daily(rule):
        return F.col(ts).cast("date").cast("timestamp_ntz")
    return F.window(F.col(ts) - F.expr("INTERVAL 1 MICROSECOND"), rule).getField("end")


def bar_values(order: str = "ts") -> list[Column]:
    """Aggregates that make one bar of many; `_rows` counts them."""
    return [
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", order).alias("close"), F.sum("volume").alias("volume"), F.count("close").alias("_rows"),
    ]


def resample_ohlcv(bars: DataFrame, rule: str, min_count: int = 1, order: str = "ts",
                   keys=("series_id",), count_name: str | None = None) -> DataFrame:
    """Bars of a coarser grid; bins with fewer than `min_count` rows are left out.

    `order` decides first and last inside a bin.  All aggregates combine before the
    shuffle, so a series with most of the rows costs no more than the others.
    """
    out = bars.groupBy(*keys, bar_time(rule).alias("_bin")).agg(*bar_values(order))
    out = out.dropna(subset=list(BAR_COLUMNS))
    if not is_daily(rule):
        out = out.filter(F.col("_rows") >= min_count)
    extra = [F.col("_rows").alias(count_name)] if count_name else []
    return out.select(*keys, F.col("_bin").alias("ts"), *BAR_COLUMNS, *extra)


def normalize_bars(bars: DataFrame, order: str, rule: str = "5 minutes", min_count: int = 1) -> DataFrame:
    """The last row of each time, resampled to the base grid."""
    return resample_ohlcv(dedupe_time(bars, order, keep="last"), rule, min_count)


def resample_mean(df: DataFrame, rule: str, columns, keys=("series_id",)) -> DataFrame:
    return df.groupBy(*keys, bar_time(rule).alias("_bin")).agg(
        *[F.avg(c).alias(c) for c in columns]).withColumnRenamed("_bin", "ts")


def resample_last(df: DataFrame, rule: str, column: str, keys=("series_id",)) -> DataFrame:
    """Last non-NULL value of each bin."""
    present = F.when(F.col(column).isNotNull(), F.col("ts"))
    return df.groupBy(*keys, bar_time(rule).alias("_bin")).agg(
        F.max_by(column, present).alias(column)).withColumnRenamed("_bin", "ts")
