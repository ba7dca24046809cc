"""Gaps inside frames, groups kept apart, orders that do not depend on how files are read."""

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.config import RunConfig
from driftline.operators import compare as D
from driftline.operators import forecast as M
from driftline.operators import hmm as H
from driftline.operators import indicators as I
from driftline.operators import trading as G
from driftline.sources import readers as R
from driftline.sources import writers as S
from driftline.streaming import paths as SP
from tests.test_paths_trading import to_spark


def test_rolling_needs_every_value(spark):
    x = pd.Series(np.arange(60.0) ** 1.5)
    x[[0, 25, 26, 45]] = np.nan
    df = spark.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "idx long, x double")
    w = Window.partitionBy(F.lit(0)).orderBy("idx")
    got = df.select("idx", I.rolling_mean("x", 5, w).alias("m"), I.rolling_vol("x", 5, w).alias("v")).toPandas().sort_values("idx")
    assert np.allclose(got.m.to_numpy(float), x.rolling(5).mean(), equal_nan=True)
    assert np.allclose(got.v.to_numpy(float), x.rolling(5).std(), equal_nan=True)


def test_trade_longer_than_a_block_stays_open(spark):
    rows = [("a", 0, 1100), ("a", 1030, 1500), ("a", 1100, 1300), ("a", 1290, 1400), ("a", 1300, None), ("b", 700, 701), ("b", 701, 800)]
    signals = spark.createDataFrame(rows, "series_id string, idx long, exit_idx long")
    got = G.non_overlapping_trades(signals, 1200).toPandas()
    assert sorted(zip(got.series_id, got.idx)) == [("a", 0), ("a", 1100), ("a", 1300), ("b", 700), ("b", 701)]


def test_best_labels_of_each_group(spark):
    rows = [(s, i, 0.1 * i, 0.5, 1000) for s in ("a", "b") for i in range(4)]
    m = spark.createDataFrame(rows, "series_id string, super_state int, ic double, r2 double, test_n long")
    cfg = replace(RunConfig(), min_ic=-1.0, min_r2=-1.0)
    got = M.select_states(m, cfg, 2, keys=["series_id"]).toPandas()
    assert sorted(zip(got.series_id, got.super_state)) == [("a", 2), ("a", 3), ("b", 2), ("b", 3)]
    assert M.select_states(m, cfg, 3).count() == 3


def test_experiment_record_of_each_curve(spark):
    ts = pd.date_range("2024-01-01", periods=4, freq="12h")
    both = pd.concat([pd.DataFrame({"series_id": s, "ts": ts, "eq_global": v}) for s, v in (("a", [1, 1.1, 1.2, 1.3]), ("b", [1, 2, 3, 4.0]))])
    got = S.experiment_record(to_spark(spark, both), {"step_days": 22}).toPandas().set_index("series_id")
    assert got.final_net_value.to_dict() == {"a": 1.3, "b": 4.0}


def test_first_row_of_a_time_by_file_order(spark, tmp_path):
    head = "time,open,high,low,close,volume\n"
    (tmp_path / "a.csv").write_text(head + "2024-01-01 09:35:00,1,1,1,1,1\n")
    (tmp_path / "b.csv").write_text(head + "2024-01-01 09:35:00,2,2,2,2,2\n" + "".join(f"2024-01-02 {h:02}:{m:02}:00,3,3,3,3,3\n" for h in range(24) for m in range(60)))
    got = R.read_bars(spark, str(tmp_path), "s").filter("ts < timestamp_ntz'2024-01-02 00:00:00'").collect()
    assert [r["close"] for r in got] == [1.0]


def test_content_hash_covers_every_column(spark):
    df = spark.range(5).select(F.col("id").alias("idx"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("ts"), *[F.col("id").alias(f"c{i}") for i in range(12)])
    one, two = (D.table_profile(x, ["c0"]).first() for x in (df, df.withColumn("c11", F.col("c11") + 1)))
    assert one["content_hash"] != two["content_hash"] and one["edge_hash"] == two["edge_hash"]


def test_null_label_on_a_stream(spark, tmp_path):
    rows = pd.DataFrame({"series_id": "a", "ts": pd.date_range("2024-01-01", periods=4, freq="h"), "state": [1, None, None, 2]})
    SP.with_seed(to_spark(spark, rows)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SP.with_seed(to_spark(spark, rows)).schema).parquet(str(tmp_path / "in"))
    q = SP.online_path_metrics(stream).writeStream.format("memory").queryName("null_labels").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("null_labels").toPandas().sort_values("ts")
    assert got.state.tolist() == [1, -1, -1, 2] and got.run_len_so_far.tolist() == [1, 1, 2, 1]


def test_one_task_fits_like_the_jobs(spark, monkeypatch):
    rng = np.random.default_rng(0)
    state = np.repeat([0, 1, 0, 1, 1, 0], 60)
    pdf = pd.DataFrame({"series_id": "s", "ts": pd.date_range("2024-01-01", periods=360, freq="5min"), "x": rng.normal(size=360) + 3 * state, "y": rng.normal(size=360)})
    df = to_spark(spark, pdf)
    models = df.select("series_id").distinct().withColumns({"seed": F.lit(1).cast("long"), "model_id": F.lit("m")})
    monkeypatch.setattr(H, "CHUNK", 64)
    one = H.fit_gaussian_hmm(df, ["x", "y"], models, 2, RunConfig(), max_iter=3).toPandas().iloc[0]
    monkeypatch.setattr(H, "WHOLE", 0)
    jobs = H.fit_gaussian_hmm(df, ["x", "y"], models, 2, RunConfig(), max_iter=3).toPandas().iloc[0]
    assert one.iters == jobs.iters == 3 and np.isclose(one.loglik, jobs.loglik)
    for c in ("start", "trans", "means", "covars"):
        assert np.allclose(one[c], jobs[c])
    monkeypatch.undo()
    done = H.fit_gaussian_hmm(df, ["x", "y"], models, 2, RunConfig()).toPandas().iloc[0]
    assert done.done and 3 < done.iters < RunConfig().max_iter


def test_fallback_runs_can_be_left_out(spark):
    from driftline.operators import walkforward as W
    rows = [("a", True, 1.0, 20, 90, 0.5, -0.01, None), ("b", True, 1.0, 20, 90, 0.5, -0.01, False), ("c", True, 1.0, 20, 90, 0.5, -0.01, True)]
    evals = spark.createDataFrame(rows, "run_id string, engine_ok boolean, eval_sharpe_daily double, eval_trades long, eval_active_bars long, "
                                        "eval_gate_coverage double, eval_max_dd double, fit_fallback boolean")
    for reject, want in ((False, ["a", "b", "c"]), (True, ["a", "b"])):
        got = W.candidate_tiers(evals, replace(RunConfig(), reject_fallback=reject)).filter("strict AND last_resort").collect()
        assert sorted(r["run_id"] for r in got) == want


def test_rejected_series(spark):
    from driftline.operators import calendar as C
    rows = [("long", i, f"2024-01-{i + 1:02d}") for i in range(20)] + [("short", i, f"2024-02-{i + 1:02d}") for i in range(3)]
    days = spark.createDataFrame(rows, "series_id string, day_idx long, day string").withColumn("day", F.col("day").cast("date"))
    last = C.last_n_days(days, 5)
    assert [r["day_idx"] for r in C.accepted(last).orderBy("day").collect()] == [15, 16, 17, 18, 19]
    assert [tuple(r) for r in C.rejected(last).collect()] == [("short", "only 3 of 5 trading days")]
    cut = C.first_cutoff_in_month(C.backstep_endpoints(days, 5), "2024-01")
    assert [(r["series_id"], r["cutoff_idx"]) for r in C.accepted(cut).collect()] == [("long", 19)]
    assert [tuple(r) for r in C.rejected(cut).collect()] == [("short", "no endpoint falls in 2024-01")]
    bars = days.withColumn("ts", F.col("day").cast("timestamp_ntz"))
    window = {r["series_id"]: r for r in M.last_days_window(bars, 5).collect()}
    assert window["short"]["trade_start"] is None and window["short"]["problem"] and window["long"]["trade_start"].day == 16
    split = M.time_split(bars, M.last_days_window(bars, 5), replace(RunConfig(), history_start="2024-01-01 00:00:00"), rows_per_day=1)
    assert {r["series_id"] for r in split.collect()} == {"long"}
