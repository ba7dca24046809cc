"""Sinks: stage tables, run documents, parameter packs, the experiment log."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import finite
from ..operators.trading import equity_sharpe


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by=()) -> None:
    """Write a stage table.  CSV gets a header.

    Partitioning is left to the caller: one directory per series suits few, long series.
    """
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column become NULL, in structs and arrays too."""
    def clean(col, dtype):
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return finite(col)
        if isinstance(dtype, T.ArrayType) and _has_float(dtype):
            return F.transform(col, lambda v: clean(v, dtype.elementType))
        if isinstance(dtype, T.MapType) and _has_float(dtype.valueType):
            return F.transform_values(col, lambda _, v: clean(v, dtype.valueType))
        if isinstance(dtype, T.StructType) and _has_float(dtype):
            made = F.struct(*[clean(col[f.name], f.dataType).alias(f.name) for f in dtype.fields])
            return F.when(col.isNotNull(), made)
        return col

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _has_float(dtype) -> bool:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return True
    if isinstance(dtype, T.ArrayType):
        return _has_float(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_float(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_has_float(f.dataType) for f in dtype.fields)
    return False


def run_documents(stats: DataFrame) -> DataFrame:
    """Run figures as one JSON-ready row per run: run_time, run_id, data_end_date, rf_stats."""
    ids = [c for c in ("run_id", "data_end_date") if c in stats.columns]
    figures = [c for c in ("sharpe_daily", "final_equity", "max_drawdown", "n_trades", "active_bars",
                           "gate_coverage", "gated_n") if c in stats.columns]
    rows = stats.select(F.current_timestamp().cast("string").alias("run_time"), *ids,
                        F.struct(*figures).alias("rf_stats"))
    return sanitize(rows)


def write_run_metrics(stats: DataFrame, path: str, mode: str = "append") -> None:
    run_documents(stats).write.mode(mode).json(path)


def publish_pack(folder: str, tables: dict | None = None, models: dict | None = None) -> None:
    """Overwrite a pack of parameter tables (Parquet) and fitted models in place."""
    for name, df in (tables or {}).items():
        df.write.mode("overwrite").parquet(os.path.join(folder, name))
    for name, model in (models or {}).items():
        model.write().overwrite().save(os.path.join(folder, "models", str(name)))


def read_pack(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, name))


def experiment_record(equity: DataFrame, settings: dict, tag: str = "AutoRun", value: str = "eq_global",
                      keys=None) -> DataFrame:
    """One row for each curve: its keys, final net value and Sharpe ratio, with the settings.

    Curves are told apart by `keys`, if not given by series_id where the table has it.
    """
    keys = [c for c in ("series_id",) if c in equity.columns] if keys is None else list(keys)
    figures = equity_sharpe(equity if keys else equity.withColumn("_all", F.lit(0)), value, tuple(keys or ["_all"]))
    return figures.select(
        *keys, F.current_timestamp().alias("timestamp"), F.lit(tag).alias("tag"),
        *[F.lit(v).alias(k) for k, v in settings.items()],
        F.round("net_value", 4).alias("final_net_value"), F.round("sharpe", 4).alias("sharpe_ratio"),
        F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss").alias("run_id"))


def append_experiment_log(equity: DataFrame, path: str, settings: dict, tag: str = "AutoRun",
                          value: str = "eq_global", keys=None) -> None:
    experiment_record(equity, settings, tag, value, keys).write.mode("append").parquet(path)
