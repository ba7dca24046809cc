"""Sources: bar files, equity curves, run metrics, and the tick adapters."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BAR_COLUMNS, EQUITY_NAMES
from ..functions import coerce_numeric, finite
from ..operators.bars import dedupe_time

BAR_SCHEMA = T.StructType(
    [T.StructField("series_id", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in BAR_COLUMNS]
)


#: Where a row of a file source comes from.
PLACE = ("_metadata.file_path", "_metadata.file_block_start")


def _csv_as_text(spark: SparkSession, path) -> DataFrame:
    """CSV with every column as text and the header trimmed and lower-cased."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    names = [c.strip().lstrip("﻿").lower() for c in raw.columns]
    return raw.select("*", *PLACE).toDF(*names, "_file", "_at")


def clean_bars(raw: DataFrame, series_id: str | None = None) -> DataFrame:
    """Checked, typed bars: bad cells drop the row, the first of equal times stays."""
    missing = [c for c in ("time", *BAR_COLUMNS) if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns {missing}, found {raw.columns}")
    key = F.col("series_id") if "series_id" in raw.columns else F.lit(series_id or "series")
    # Order of rows: files by name, then their parts; the id counts within a part, whatever task reads it.
    place = [F.col(c) for c in ("_file", "_at") if c in raw.columns]
    numbered = raw.withColumn("_seq", F.struct(*place, F.monotonically_increasing_id().alias("_id")))
    typed = numbered.select(
        key.alias("series_id"),
        F.expr("try_cast(time AS timestamp_ntz)").alias("ts"),
        *[coerce_numeric(c).alias(c) for c in BAR_COLUMNS],
        "_seq",
    )
    # The time is settled before bad cells are dropped, as a row with a bad cell
    # still occupies its time.
    kept = dedupe_time(typed.filter("ts IS NOT NULL"), order="_seq", keep="first")
    return kept.dropna(subset=list(BAR_COLUMNS)).drop("_seq")


def read_bars(spark: SparkSession, path, series_id: str | None = None, fmt: str = "csv") -> DataFrame:
    if fmt == "csv":
        return clean_bars(_csv_as_text(spark, path), series_id)
    raw = spark.read.format(fmt).load(path)
    raw = raw.select("*", *PLACE).toDF(*raw.columns, "_file", "_at")
    if "ts" in raw.columns and "time" not in raw.columns:
        raw = raw.withColumnRenamed("ts", "time")
    return clean_bars(raw, series_id)


def read_bars_or_empty(spark: SparkSession, path, series_id: str | None = None) -> DataFrame:
    """Like `read_bars`; an absent, empty or unreadable file gives no rows."""
    try:
        raw = _csv_as_text(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], BAR_SCHEMA)
    if "time" not in raw.columns:
        return spark.createDataFrame([], BAR_SCHEMA)
    return clean_bars(raw, series_id)


def equity_columns(columns) -> tuple[str, str]:
    """Names of the time and the equity column of a curve table."""
    time = next((c for c in ("time", "ts") if c in columns), columns[0])
    named = next((c for c in EQUITY_NAMES if c in columns), None)
    return time, named or (columns[1] if len(columns) > 1 else columns[0])


def as_equity(raw: DataFrame, keep=(), drop_bad_equity: bool = True) -> DataFrame:
    """Any curve table as (keep..., ts, equity); rows without a time are dropped."""
    time, equity = equity_columns([c for c in raw.columns if c not in keep])
    out = raw.select(
        *keep,
        F.expr(f"try_cast(`{time}` AS timestamp_ntz)").alias("ts"),
        coerce_numeric(equity).alias("equity"),
    ).filter("ts IS NOT NULL")
    return out.filter("equity IS NOT NULL") if drop_bad_equity else out


def read_equity(spark: SparkSession, path, drop_bad_equity: bool = True) -> DataFrame:
    return as_equity(_csv_as_text(spark, path), drop_bad_equity=drop_bad_equity)


# -- run metrics -----------------------------------------------------------

_STATS = T.StructType([
    T.StructField(n, T.DoubleType()) for n in (
        "sharpe_daily", "final_equity", "max_drawdown", "max_drawdown_daily", "max_dd_daily",
        "n_trades", "trades", "active_bars", "gated_n", "gated_n_trade", "gate_coverage",
        "gate_coverage_trade",
    )
])
RUN_SCHEMA = T.StructType([
    T.StructField("run_time", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("data_end_date", T.StringType()),
    T.StructField("rf_stats", _STATS),
    T.StructField("gate", T.StructType([T.StructField("coverage", T.DoubleType())])),
])


def _first_set(*cols):
    """First value that is neither NULL nor 0 (a zero counts as not given).

    When every value is NULL or 0 the last one is taken, zero included.
    """
    last = F.col(cols[-1])
    return F.coalesce(*[F.when(F.col(c) != 0, F.col(c)) for c in cols[:-1]], last)


def run_metrics(docs: DataFrame) -> DataFrame:
    """Evaluation metrics of run documents (`rf_stats` struct), with defaults."""
    s = "rf_stats."
    return docs.select(
        "run_id",
        F.coalesce(F.col(s + "sharpe_daily"), F.lit(float("-inf"))).alias("eval_sharpe_daily"),
        _first_set(s + "max_drawdown_daily", s + "max_dd_daily", s + "max_drawdown").alias("eval_max_dd"),
        F.coalesce(_first_set(s + "n_trades", s + "trades"), F.lit(0)).cast("long").alias("eval_trades"),
        F.coalesce(_first_set(s + "active_bars", s + "gated_n", s + "gated_n_trade"), F.lit(0))
        .cast("long").alias("eval_active_bars"),
        _first_set(s + "gate_coverage", s + "gate_coverage_trade", "gate.coverage").alias("eval_gate_coverage"),
    )


def collect_run_metrics(spark: SparkSession, path) -> DataFrame:
    """Read many run documents (one JSON object per file) at once."""
    return run_metrics(spark.read.json(path, schema=RUN_SCHEMA, multiLine=True,
                                       allowNonNumericNumbers=True))


# -- ticks from the test tables --------------------------------------------

def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ticks_events(spark: SparkSession, folder: str) -> DataFrame:
    """Intraday ticks: one series per event type, unique times."""
    return _table(spark, folder, "events").select(
        F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("value").alias("price"), F.lit(1.0).alias("qty"), F.col("event_id").alias("seq"))


def ticks_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Daily ticks: one series per order priority."""
    return _table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("series_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        F.col("o_totalprice").alias("price"), F.lit(1.0).alias("qty"), F.col("o_orderkey").alias("seq"))


def ticks_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Daily unit prices: one series per return flag and line status."""
    return _table(spark, folder, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("series_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"),
        # Line numbers repeat within an order; the part number settles the order.
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("decimal(25,0)") * F.lit(10_000_000_000)
         + F.col("l_partkey")).cast("decimal(38,0)").alias("seq"))


def as_bars(ticks: DataFrame) -> DataFrame:
    """A tick is a bar whose four prices are equal."""
    p = F.col("price")
    return ticks.select("series_id", "ts", p.alias("open"), p.alias("high"), p.alias("low"),
                        p.alias("close"), F.col("qty").alias("volume"), "seq")
