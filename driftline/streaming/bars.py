"""Bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BAR_COLUMNS
from ..operators.bars import bar_values


def stream_bars(ticks: DataFrame, rule: str, delay: str = "10 minutes", min_count: int = 1, order: str = "ts",
                keys=("series_id",)) -> DataFrame:
    """Right-closed bars, each emitted once when the watermark has passed its end.

    Same bins and aggregates as on a stored table.  Ticks later than `delay` are
    dropped; use append output.
    """
    shifted = F.col("ts").cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")
    timed = ticks.withColumn("_t", shifted).withWatermark("_t", delay)
    out = timed.groupBy(*keys, F.window("_t", rule)).agg(*bar_values(order)).filter(F.col("_rows") >= min_count)
    return out.select(*keys, F.col("window.end").cast("timestamp_ntz").alias("ts"), *BAR_COLUMNS)


def write_stream_table(df: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def bar_ticks(df: DataFrame) -> DataFrame:
    """price/qty ticks as bars of one price."""
    p = F.col("price")
    return df.select("series_id", "ts", p.alias("open"), p.alias("high"), p.alias("low"), p.alias("close"),
                     F.col("qty").alias("volume"))
