"""Label streams of three timeframes on the 30-minute grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SUPER_FEATURES
from ..functions import day_of, tuple_text
from .bars import bar_time, resample_last, resample_mean, resample_ohlcv
from .blocks import stage
from .labels import quantile_states


def mode_last_by_bin(states: DataFrame, rule: str, state: str, keys=("series_id",)) -> DataFrame:
    """Most frequent label of each bin (first seen wins a tie) and the last label.

    Rows are counted per label before the shuffle, so a bin costs one row per label.
    """
    keys = list(keys)
    seen = F.when(F.col(state).isNotNull(), F.col("ts"))
    counted = states.groupBy(*keys, bar_time(rule).alias("_bin"), state).agg(
        F.count(state).alias("_n"), F.min(seen).alias("_first"), F.max(seen).alias("_last"))
    by_count = Window.partitionBy(*keys, "_bin").orderBy(F.desc("_n"), F.col("_first"))
    top = counted.withColumn("_r", F.row_number().over(by_count))
    return top.groupBy(*keys, F.col("_bin").alias("ts")).agg(
        F.max(F.when(F.col("_r") == 1, F.col(state))).alias(f"{state}_mode"),
        F.max_by(state, "_last").alias(f"{state}_last"),
    )


def previous_day_label(daily: DataFrame, state: str, keys=("series_id",)) -> DataFrame:
    """(keys, day, state_prev): label of the previous available day row.

    A day table has at most one row per calendar day, so a plain window is bounded.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    return daily.select(*keys, day_of().alias("day"), F.lag(state).over(w).alias(f"{state}_prev"))


def build_overlay(base: DataFrame, bins: DataFrame, daily: DataFrame, s5: str = "state_5m",
                  s30: str = "state_30m", s1d: str = "state_1d", keys=("series_id",)) -> DataFrame:
    """Join the 5m mode/last and the previous day's label to the 30m rows.

    Missing labels become -1 in overlay_s5, overlay_s30, overlay_sd.
    """
    keys = list(keys)
    prev = previous_day_label(daily, s1d, keys)
    out = (
        base.join(bins, keys + ["ts"], "left")
        .withColumn("day", day_of())
        .join(prev, keys + ["day"], "left").drop("day")
    )
    for name, src in (("overlay_s5", f"{s5}_mode"), ("overlay_s30", s30), ("overlay_sd", f"{s1d}_prev")):
        out = out.withColumn(name, F.coalesce(F.col(src), F.lit(-1)).cast("int"))
    return out.withColumns({
        "overlay_id": (F.col("overlay_s5") * 10000 + F.col("overlay_s30") * 100 + F.col("overlay_sd")).cast("int"),
        "overlay_tuple": tuple_text("overlay_s5", "overlay_s30", "overlay_sd"),
        "overlay_struct": F.struct(F.col("overlay_s5").alias("s5"), F.col("overlay_s30").alias("s30"),
                                   F.col("overlay_sd").alias("sd")),
    })


AVERAGED = tuple(c for c in SUPER_FEATURES if not c.startswith("overlay"))


def quantile_overlay(features5: DataFrame, min_count_30m: int = 1, q: int = 6, rule: str = "30 minutes",
                     averaged=AVERAGED, rows_per_day: int = 288, keys=("series_id",)) -> DataFrame:
    """Overlay whose labels come from return quantiles instead of a model.

    5m labels are quantiles of the log return; the 30m label is their mode, the daily
    label the last 30m label of the day.
    """
    keys = list(keys)
    states5 = stage(quantile_states(features5, "log_ret_1", q, "state_5m", keys, rows_per_day), "states5")
    bins = stage(mode_last_by_bin(states5.select(*keys, "ts", "state_5m"), rule, "state_5m", keys), "bins")
    bars30 = resample_ohlcv(states5, rule, min_count_30m, keys=keys)
    present = [c for c in averaged if c in features5.columns]
    if present:
        bars30 = bars30.join(resample_mean(states5, rule, present, keys), keys + ["ts"], "left")
    base = bars30.join(
        bins.select(*keys, "ts", F.coalesce("state_5m_mode", F.lit(-1)).alias("state_30m")), keys + ["ts"], "left")
    base = stage(base.fillna(-1, ["state_30m"]), "base30")
    daily = resample_last(base.select(*keys, "ts", F.col("state_30m").alias("state_1d")), "1d", "state_1d", keys)
    return build_overlay(base, bins, daily, keys=keys)


def coalesce_backfill(df: DataFrame, other: DataFrame, fields, keys=("series_id", "ts")) -> DataFrame:
    """Overwrite `fields` on rows that `other` also has, NULLs included."""
    keys, fields = list(keys), [f for f in fields if f in other.columns]
    right = other.select(*keys, F.lit(True).alias("_hit"), *[F.col(f).alias(f"_o_{f}") for f in fields])
    out = df.join(right, keys, "left")
    for f in fields:
        mine = F.col(f) if f in df.columns else F.lit(None)
        out = out.withColumn(f, F.when(F.col("_hit"), F.col(f"_o_{f}")).otherwise(mine))
    return out.drop("_hit", *[f"_o_{f}" for f in fields])
