"""Blocked computations against plain pandas, with blocks far smaller than the data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.config import RunConfig
from driftline.operators import blocks as K
from driftline.operators import indicators as I


def series(n, seed=0, names=("a", "b")):
    rng = np.random.default_rng(seed)
    out = []
    for i, s in enumerate(names):
        m = n // (1 + 9 * i)          # the first series holds nearly all rows
        close = 100 * np.exp(np.cumsum(rng.normal(size=m) / 100))
        out.append(pd.DataFrame({
            "series_id": s, "ts": pd.date_range("2024-01-01", periods=m, freq="5min"),
            "open": close, "high": close * 1.01, "low": close * 0.99, "close": close,
            "volume": rng.integers(1, 50, m).astype(float), "v": rng.normal(size=m).round(1)}))
    return pd.concat(out, ignore_index=True)


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def back(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def test_position(spark):
    pdf = series(3000)
    got = back(K.position_bars(to_spark(spark, pdf), 288), "series_id", "ts")
    assert (got["idx"] == pdf.groupby("series_id").cumcount()).all()


def test_carry(spark):
    pdf = series(1000)
    pdf["idx"] = pdf.groupby("series_id").cumcount()
    pdf["gap"] = pdf["v"].where(pdf["v"] > 1.5)
    df = to_spark(spark, pdf).withColumn("gap", F.when(~F.isnan("gap"), F.col("gap")))
    got = back(K.carry(df, ["series_id"], {
        "s": ("sum", F.col("v")), "m": ("max", F.col("v")), "f": ("last", F.col("gap")),
        "b": ("last_before", F.col("gap"))}, size=37), "series_id", "idx")
    g = pdf.groupby("series_id")
    assert np.allclose(got["s"], g["v"].cumsum())
    assert np.allclose(got["m"], g["v"].cummax())
    assert np.array_equal(got["f"], g["gap"].ffill(), equal_nan=True)
    assert np.array_equal(got["b"], g["gap"].transform(lambda x: x.ffill().shift()), equal_nan=True)


@pytest.mark.parametrize("parts", [None, 16])
@pytest.mark.parametrize("share", [0.0, 0.6])
def test_ranked_with_a_frequent_value(spark, share, parts):
    pdf = series(4000)
    pdf.loc[pdf.index % 100 < share * 100, "v"] = 0.5
    df = to_spark(spark, pdf)
    got = back(K.ranked(df, ["series_id"], "v", "ts", parts=parts), "series_id", "ts")
    want = pdf.groupby("series_id")["v"].rank(method="first")
    assert (got["rank"] == want).all()


def test_ranges_follow_the_rows(spark):
    """Ten times the rows of one series, most of one value, are about ten times the ranges."""
    sizes = {"spark.sql.shuffle.partitions": "600", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1000"}
    before = {k: spark.conf.get(k, None) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        counts = []
        for n in (20000, 200000):
            df = spark.range(n).selectExpr("'one' AS series_id", "if(id % 5 > 0, 0.0D, double(id)) AS v", "id AS ts")
            ranges = K._in_ranges(df, ["series_id", "v", "ts"], None, "ranges").groupBy("_part").count().toPandas()["count"]
            counts.append(len(ranges))
            assert ranges.max() < 4 * n / len(ranges)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert counts[0] > 2 and 5 < counts[1] / counts[0] < 20


@pytest.mark.parametrize("parts", [None, 16])
def test_exact_quantiles(spark, parts):
    pdf = series(4000)
    got = back(K.exact_quantiles(to_spark(spark, pdf), ["series_id"], "v", {"p": 0.65, "q": 0.35}, parts=parts), "series_id")
    want = pdf.groupby("series_id")["v"].quantile([0.65, 0.35]).unstack()
    assert np.allclose(got["p"], want[0.65]) and np.allclose(got["q"], want[0.35])


def test_attach_without_keys(spark):
    df = to_spark(spark, series(100))
    small = df.agg(F.max("v").alias("top"))
    assert K.attach(df, small, []).filter("v > top").count() == 0


def test_features_do_not_depend_on_the_block_size(spark, monkeypatch):
    pdf = series(5000, names=("a",))
    df = to_spark(spark, pdf.drop(columns="v"))
    cfg = RunConfig()
    whole = back(I.make_features(df, cfg), "ts")
    monkeypatch.setattr(K, "BLOCK", 1100)
    cut = back(I.make_features(df, cfg), "ts")
    assert len(whole) == len(cut) == 5000 - 60
    for c in I.INDICATORS:
        assert np.allclose(whole[c], cut[c], rtol=1e-11, atol=1e-11), c
    # against pandas
    c = pdf["close"]
    up, down = c.diff().clip(lower=0), (-c.diff()).clip(lower=0)
    rs = up.ewm(alpha=1 / 14, adjust=False).mean() / (down.ewm(alpha=1 / 14, adjust=False).mean() + 1e-12)
    assert np.allclose(cut["rsi_14"], (100 - 100 / (1 + rs))[60:])
    tr = pd.concat([pdf.high - pdf.low, (pdf.high - c.shift()).abs(), (pdf.low - c.shift()).abs()], axis=1).max(axis=1)
    assert np.allclose(cut["atr_14"], tr.ewm(alpha=1 / 14, adjust=False).mean()[60:])
    assert np.allclose(cut["vol_long"], c.pct_change().rolling(60).std()[60:])


def test_frame_longer_than_a_block_is_refused(spark):
    df = to_spark(spark, series(100)).withColumn("idx", F.lit(0))
    with pytest.raises(ValueError):
        K.open_blocks(df, before=20, size=10)
