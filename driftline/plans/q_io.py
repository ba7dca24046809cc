"""Queries: files written and read again, packs, and path statistics continued on a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import blocks as K
from ..sources import readers as R
from ..sources import writers as S
from ..streaming import paths as SP
from . import q_labels, sql
from .q_bars import SQL_BAR, bar_output, daily_bars, events_bars
from .q_labels import EWMA_RUNS, HEAD, daily_runs, daily_states
from .registry import SQL, long, query, rounded, sql_rounded, time_text


def own_folder(spark, name: str) -> str:
    return f"{K.shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def messy_text(bars):
    """The bars as text, and for some of them a row without a time and one with a cell that is no number."""
    text = bars.select(F.col("ts").cast("string").alias("time"), *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")],
                       "series_id", F.xxhash64("series_id", "ts").alias("h"))
    timeless = text.filter("pmod(h, 10) = 0").withColumn("time", F.lit("no time"))
    priceless = text.filter("pmod(h, 7) = 0").withColumns({"time": F.regexp_replace("time", ":00$", ":01"), "close": F.lit("n/a")})
    rows = text.unionByName(timeless).unionByName(priceless).drop("h")
    return rows.toDF("Time", "OPEN", "High", "low", "CLOSE", "Volume", "Series_Id")


@query("read_bars", f"WITH {sql.bars('events', 30)} SELECT {SQL_BAR} FROM bars")
def read_bars(spark, folder):
    """Bars through CSV files with a mixed header and bad rows."""
    path = own_folder(spark, "csv")
    S.write_table(messy_text(events_bars(spark, folder)), path, "csv")
    return bar_output(R.read_bars(spark, path))


@query("read_bars_or_empty", f"WITH {sql.bars('events', 30)} SELECT {SQL_BAR} FROM bars")
def read_bars_or_empty(spark, folder):
    """The same from a folder with files, and from one that is not there."""
    path = own_folder(spark, "csv")
    S.write_table(messy_text(events_bars(spark, folder)), path, "csv")
    return bar_output(R.read_bars_or_empty(spark, path).unionByName(R.read_bars_or_empty(spark, path + "-absent")))


@query("write_table", SQL["bars_daily"])
def write_table(spark, folder):
    """A stage table in one folder for each series, written twice."""
    path, bars = own_folder(spark, "table"), daily_bars(spark, folder)
    for _ in range(2):
        S.write_table(bars, path, partition_by=["series_id"])
    return bar_output(spark.read.parquet(path))


@query("publish_pack", SQL["path_seed_states"])
def publish_pack(spark, folder):
    """Seeds of the path statistics through a pack that is published twice."""
    path, seeds = own_folder(spark, "pack"), q_labels.path_seed_states(spark, folder)
    for _ in range(2):
        S.publish_pack(path, {"path_seed_states": seeds, "meta": seeds.select("series_id").distinct()})
    return S.read_pack(spark, path, "path_seed_states").join(S.read_pack(spark, path, "meta"), "series_id", "left_semi")


ONLINE = f"""WITH RECURSIVE {EWMA_RUNS} SELECT {HEAD}, CAST(state AS BIGINT) AS state, CAST(run_len AS BIGINT) AS run_len_so_far,
 {sql_rounded(6, 'avg_run_local', 'exhaustion_ratio', 'switch_rate_local')} FROM metrics"""


def _streamed(spark, parts, cfg):
    """Output of the stream when `parts` arrive one after the other."""
    where = own_folder(spark, "stream")
    for part in parts:
        part.write.mode("append").parquet(f"{where}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{where}/in")
        SP.write_path_metrics(SP.online_path_metrics(stream, cfg), f"{where}/out", f"{where}/mark").awaitTermination()
    return spark.read.parquet(f"{where}/out")


def _online_output(df):
    return df.select("series_id", time_text().alias("ts"), long("state").alias("state"), long("run_len_so_far").alias("run_len_so_far"),
                     *rounded(6, "avg_run_local", "exhaustion_ratio", "switch_rate_local"))


@query("online_path_metrics", ONLINE)
def online_path_metrics(spark, folder):
    """Labels that arrive in two parts, continued from the state of the stream."""
    labels = K.stage(SP.with_seed(daily_states(spark, folder)), "labels")
    cut = F.col("ts") < F.lit("1998-06-01").cast("timestamp_ntz")
    return _online_output(_streamed(spark, [labels.filter(cut), labels.filter(~cut)], RunConfig()))


@query("online_from_seed", ONLINE + " WHERE ts >= TIMESTAMP '1999-01-01'")
def online_from_seed(spark, folder):
    """Labels that arrive after the seed of the history before them."""
    from ..operators import paths as P

    cfg, cut = RunConfig(), F.col("ts") < F.lit("1999-01-01").cast("timestamp_ntz")
    runs = K.stage(daily_runs(spark, folder).filter(cut), "history")
    seeds = SP.seed_rows(P.path_seed(runs, "state", cfg))
    live = SP.with_seed(daily_states(spark, folder).filter(~cut))
    return _online_output(_streamed(spark, [K.stage(seeds.unionByName(live), "live")], cfg))
