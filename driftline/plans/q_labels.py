"""Queries: labels, overlay, path statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import blocks as K
from ..operators import indicators as I
from ..operators import labels as L
from ..operators import overlay as O
from ..operators import paths as P
from . import sql
from .q_bars import ENDED, daily_bars, events_bars
from .registry import long, query, rnd, rounded, sql_rnd, sql_rounded, sql_time, time_text

CFG = RunConfig()
HEAD = f"series_id, {sql_time()}"


def daily_returns(spark, folder):
    """Daily bars with idx, ret_1, vol_short and the 20-day mean `ma`."""
    df = K.open_blocks(K.position_bars(daily_bars(spark, folder), rows_per_day=1), before=64)
    w = K.block_window()
    df = df.withColumns({"ret_1": I.pct_change("close", 1, w), "ma": I.rolling_mean("close", 20, w)})
    df = df.withColumn("vol_short", I.rolling_vol("ret_1", 20, w))
    return K.close_blocks(df)


def daily_states(spark, folder):
    """Slowly changing labels: six quantiles of the 20-day mean."""
    return L.quantile_states(daily_returns(spark, folder), "ma", 6, rows_per_day=1)


STATES = f"""{sql.bars('orders', None)},
st0 AS (SELECT *, "close" / lag("close") OVER w - 1 AS ret_1,
  CASE WHEN idx >= 19 THEN avg("close") OVER (PARTITION BY series_id ORDER BY idx ROWS 19 PRECEDING) END AS ma
  FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
st1 AS (SELECT *, CASE WHEN idx >= 20 THEN stddev_samp(ret_1) OVER (PARTITION BY series_id ORDER BY idx ROWS 19 PRECEDING) END
  AS vol_short, row_number() OVER (PARTITION BY series_id ORDER BY coalesce(ma, 0), ts) AS rk,
  count(*) OVER (PARTITION BY series_id) AS n FROM st0),
st AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE CAST(greatest(ceil((rk - 1) * 6.0 / (n - 1)), 1) - 1 AS BIGINT) END AS state
  FROM st1)"""


@query("quantile_states", f"WITH {STATES} SELECT {HEAD}, CAST(state AS BIGINT) AS state FROM st")
def quantile_states(spark, folder):
    return daily_states(spark, folder).select("series_id", time_text().alias("ts"), long("state").alias("state"))


@query("exact_quantiles", f"""WITH {STATES}
SELECT series_id, {sql_rnd("quantile_cont(ret_1, 0.65)", 8, 'q65')}, {sql_rnd("quantile_cont(ret_1, 0.35)", 8, 'q35')},
 {sql_rnd("quantile_cont(ret_1, 0.01)", 8, 'q01')} FROM st GROUP BY series_id""")
def exact_quantiles(spark, folder):
    q = K.exact_quantiles(daily_returns(spark, folder), ["series_id"], "ret_1", {"q65": 0.65, "q35": 0.35, "q01": 0.01})
    return q.select("series_id", *rounded(8, "q65", "q35", "q01"))


@query("fit_mask", f"""WITH {STATES} SELECT {HEAD},
 CAST(ts AS DATE) < max(CAST(ts AS DATE)) OVER (PARTITION BY series_id) AS by_day,
 ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' AS by_range FROM st""")
def fit_mask(spark, folder):
    df = L.fit_mask(daily_bars(spark, folder)).withColumnRenamed("fit", "by_day")
    df = L.fit_mask(df, start="1996-01-01", end="1999-12-31").withColumnRenamed("fit", "by_range")
    return df.select("series_id", time_text().alias("ts"), "by_day", "by_range")


@query("fit_range_or_problem", f"""WITH {sql.bars('lineitem', None, 'all_bars')},
bars AS (SELECT * FROM all_bars WHERE {ENDED})
SELECT {HEAD}, ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' AS fit,
 CASE WHEN count(*) FILTER (ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31') OVER (PARTITION BY series_id) = 0
  THEN 'no rows from 1997-01-01 to 1997-12-31' END AS problem FROM bars""")
def fit_range_or_problem(spark, folder):
    """A range of dates that one series has no rows in."""
    df = L.fit_mask(daily_bars(spark, folder, "lineitem").filter(ENDED), start="1997-01-01", end="1997-12-31")
    return df.select("series_id", time_text().alias("ts"), "fit", "problem")


@query("standardize", f"""WITH {STATES},
s AS (SELECT series_id, avg("close") AS m, stddev_pop("close") AS s FROM st WHERE ts < TIMESTAMP '2000-01-01' GROUP BY 1)
SELECT {HEAD}, {sql_rnd('("close" - m) / s', 6, 'close_z')} FROM st JOIN s USING (series_id)""")
def standardize(spark, folder):
    fit = F.col("ts") < F.lit("2000-01-01").cast("timestamp_ntz")
    df = L.standardize(daily_bars(spark, folder), ["close"], fit)
    return df.select("series_id", time_text().alias("ts"), *rounded(6, "close_z"))


@query("align_labels", f"""WITH {STATES},
v AS (SELECT series_id, state, row_number() OVER (PARTITION BY series_id ORDER BY var_pop(ret_1), state) - 1 AS aligned
  FROM st GROUP BY 1, 2)
SELECT series_id, {sql_time()}, CAST(aligned AS BIGINT) AS aligned FROM st JOIN v USING (series_id, state)""")
def align_labels(spark, folder):
    df = L.align_labels(daily_states(spark, folder), "state", "ret_1", "aligned")
    return df.select("series_id", time_text().alias("ts"), long("aligned").alias("aligned"))


TRANSITIONS = f"""{STATES},
mv AS (SELECT series_id, lag(state) OVER (PARTITION BY series_id ORDER BY idx) AS from_state, state AS to_state FROM st),
cn AS (SELECT series_id, from_state, to_state, count(*) AS moves FROM mv WHERE from_state IS NOT NULL GROUP BY 1, 2, 3),
grid AS (SELECT series_id, a AS from_state, b AS to_state FROM (SELECT DISTINCT series_id FROM st),
  (SELECT unnest(range(6)) AS a), (SELECT unnest(range(6)) AS b)),
tm AS (SELECT series_id, from_state, to_state, coalesce(moves, 0) AS moves,
  coalesce(moves, 0) / greatest(sum(coalesce(moves, 0)) OVER (PARTITION BY series_id, from_state), 1) AS prob
  FROM grid LEFT JOIN cn USING (series_id, from_state, to_state))"""


@query("transition_matrix", f"""WITH {TRANSITIONS}
SELECT series_id, CAST(from_state AS BIGINT) AS from_state, CAST(to_state AS BIGINT) AS to_state,
  CAST(moves AS BIGINT) AS moves, {sql_rnd('prob', 8, 'prob')} FROM tm""")
def transition_matrix(spark, folder):
    tm = L.transition_matrix(daily_states(spark, folder), "state", 6)
    return tm.select("series_id", *[long(c).alias(c) for c in ("from_state", "to_state", "moves")], *rounded(8, "prob"))


@query("transition_table", f"""WITH {TRANSITIONS}
SELECT series_id, CAST(from_state AS BIGINT) AS from_state,
 {', '.join(sql_rnd(f'max(CASE WHEN to_state = {i} THEN prob END)', 8, f'to_{i}') for i in range(6))}
FROM tm GROUP BY 1, 2""")
def transition_table(spark, folder):
    t = L.transition_table(L.transition_matrix(daily_states(spark, folder), "state", 6), 6)
    return t.select("series_id", long("from_state").alias("from_state"), *rounded(8, *[f"to_{i}" for i in range(6)]))


@query("state_portrait", f"""WITH {STATES},
p AS (SELECT *, ("close" - ma) / (ma + 1e-12) AS trend_strength FROM st)
SELECT series_id, '1d' AS tf, state, count(*) AS "count", {sql_rnd('avg(ret_1)', 6, 'ret_mean')},
 {sql_rnd('stddev_samp(ret_1)', 6, 'ret_std')}, {sql_rnd('avg(vol_short)', 6, 'vol_short_mean')},
 {sql_rnd('avg(trend_strength)', 6, 'trend_strength_mean')} FROM p GROUP BY series_id, state""")
def state_portrait(spark, folder):
    df = daily_states(spark, folder).withColumn("trend_strength", (F.col("close") - F.col("ma")) / (F.col("ma") + 1e-12))
    p = L.state_portrait(df, "state", "1d")
    return p.select("series_id", "tf", long("state").alias("state"), "count",
                    *rounded(6, "ret_mean", "ret_std", "vol_short_mean", "trend_strength_mean"))


# -- overlay ---------------------------------------------------------------

INTRADAY = f"""{sql.bars('events', 5, 'b5')},
l5 AS (SELECT *, coalesce(ln("close") - ln(lag("close") OVER (PARTITION BY series_id ORDER BY idx)), 0) AS lr FROM b5),
r5 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY lr, ts) AS rk,
  count(*) OVER (PARTITION BY series_id) AS n FROM l5),
s5 AS (SELECT *, CAST(greatest(ceil((rk - 1) * 6.0 / (n - 1)), 1) - 1 AS BIGINT) AS state_5m,
  {sql.bin_end(30)} AS bin FROM r5),
c5 AS (SELECT series_id, bin, state_5m, count(*) AS k, min(ts) AS f FROM s5 GROUP BY 1, 2, 3),
m5 AS (SELECT series_id, bin AS ts, state_5m AS state_5m_mode FROM
  (SELECT *, row_number() OVER (PARTITION BY series_id, bin ORDER BY k DESC, f) AS r FROM c5) WHERE r = 1),
e5 AS (SELECT series_id, bin AS ts, arg_max(state_5m, s5.ts) AS state_5m_last FROM s5 GROUP BY 1, 2),
bins AS (SELECT * FROM m5 JOIN e5 USING (series_id, ts))"""


def intraday_features(spark, folder):
    return I.make_features(events_bars(spark, folder, "5 minutes"), CFG, "5m", complete=False)


def intraday_states(spark, folder):
    bars = K.open_blocks(K.position_bars(events_bars(spark, folder, "5 minutes")), before=1)
    prev = F.lag("close").over(K.block_window())
    df = K.close_blocks(bars.withColumn("log_ret_1", F.log("close") - F.log(prev)))
    return L.quantile_states(df, "log_ret_1", 6, "state_5m")


@query("mode_last_by_bin", f"""WITH {INTRADAY}
SELECT {HEAD}, CAST(state_5m_mode AS BIGINT) AS state_5m_mode, CAST(state_5m_last AS BIGINT) AS state_5m_last FROM bins""")
def mode_last_by_bin(spark, folder):
    b = O.mode_last_by_bin(intraday_states(spark, folder), "30 minutes", "state_5m")
    return b.select("series_id", time_text().alias("ts"), long("state_5m_mode").alias("state_5m_mode"),
                    long("state_5m_last").alias("state_5m_last"))


@query("prev_day_join", f"""WITH {STATES},
p AS (SELECT series_id, ts, state, lag(state) OVER (PARTITION BY series_id ORDER BY ts) AS prev FROM st),
t AS (SELECT o_orderpriority AS series_id, o_orderkey, o_orderdate AS ts FROM orders)
SELECT o_orderkey, CAST(coalesce(prev, -1) AS BIGINT) AS prev FROM t LEFT JOIN p USING (series_id, ts)""")
def prev_day_join(spark, folder):
    prev = O.previous_day_label(daily_states(spark, folder), "state")
    ticks = spark.read.parquet(f"{folder}/orders.parquet").select(
        F.col("o_orderpriority").alias("series_id"), "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return ticks.join(prev, ["series_id", "day"], "left").select(
        "o_orderkey", F.coalesce(long("state_prev"), F.lit(-1)).alias("prev"))


OVERLAY = f"""{INTRADAY},
b30 AS (SELECT series_id, bin AS ts, arg_min(open, s5.ts) AS open, max(high) AS high, min(low) AS low,
  arg_max("close", s5.ts) AS "close", sum(volume) AS volume FROM s5 GROUP BY 1, 2),
x30 AS (SELECT *, coalesce(state_5m_mode, -1) AS state_30m FROM b30 LEFT JOIN bins USING (series_id, ts)),
d1 AS (SELECT series_id, CAST(ts AS DATE) AS day, arg_max(state_30m, ts) AS state_1d FROM x30 GROUP BY 1, 2),
d2 AS (SELECT series_id, day, lag(state_1d) OVER (PARTITION BY series_id ORDER BY day) AS state_1d_prev FROM d1),
ov AS (SELECT x30.*, coalesce(state_5m_mode, -1) AS overlay_s5, state_30m AS overlay_s30,
  coalesce(state_1d_prev, -1) AS overlay_sd
  FROM x30 LEFT JOIN d2 ON d2.series_id = x30.series_id AND d2.day = CAST(x30.ts AS DATE))"""


@query("quantile_overlay", f"""WITH {OVERLAY}
SELECT {HEAD}, {sql_rounded(6, 'close', 'volume')}, CAST(overlay_s5 AS BIGINT) AS overlay_s5,
 CAST(overlay_s30 AS BIGINT) AS overlay_s30, CAST(overlay_sd AS BIGINT) AS overlay_sd,
 CAST(overlay_s5 * 10000 + overlay_s30 * 100 + overlay_sd AS BIGINT) AS overlay_id,
 '(' || overlay_s5 || ',' || overlay_s30 || ',' || overlay_sd || ')' AS overlay_tuple FROM ov""")
def quantile_overlay(spark, folder):
    states = intraday_states(spark, folder).drop("state_5m")
    ov = O.quantile_overlay(states)
    return ov.select("series_id", time_text().alias("ts"), *rounded(6, "close", "volume"),
                     *[long(c).alias(c) for c in ("overlay_s5", "overlay_s30", "overlay_sd", "overlay_id")],
                     "overlay_tuple")


@query("coalesce_backfill", f"""WITH {STATES},
o AS (SELECT series_id, ts, state + 10 AS state, CAST(NULL AS DOUBLE) AS ma FROM st WHERE idx % 3 = 0)
SELECT st.series_id, {sql_time('st.ts')}, CAST(coalesce(o.state, st.state) AS BIGINT) AS state,
 {sql_rnd('CASE WHEN o.ts IS NOT NULL THEN o.ma ELSE st.ma END', 4, 'ma')}
FROM st LEFT JOIN o ON o.series_id = st.series_id AND o.ts = st.ts""")
def coalesce_backfill(spark, folder):
    df = K.stage(daily_states(spark, folder).select("series_id", "ts", "idx", "state", "ma"))
    other = df.filter("idx % 3 = 0").select(
        "series_id", "ts", (F.col("state") + 10).alias("state"), F.lit(None).cast("double").alias("ma"))
    out = O.coalesce_backfill(df, other, ["state", "ma", "absent"])
    return out.select("series_id", time_text().alias("ts"), long("state").alias("state"), *rounded(4, "ma"))


# -- path statistics -------------------------------------------------------

RUNS = f"""{STATES},
sw AS (SELECT *, CASE WHEN idx = 0 OR state <> lag(state) OVER (PARTITION BY series_id ORDER BY idx) THEN 1 ELSE 0 END
  AS switch FROM st),
rr AS (SELECT *, sum(switch) OVER (PARTITION BY series_id ORDER BY idx) AS rid FROM sw),
runs0 AS (SELECT series_id, rid, min(state) AS state, min(idx) AS s, max(idx) AS e, count(*) AS len FROM rr GROUP BY 1, 2),
runs AS (SELECT *, row_number() OVER (PARTITION BY series_id, state ORDER BY s) - 1 AS nth,
  e = max(e) OVER (PARTITION BY series_id) AS is_open FROM runs0),
age AS (SELECT rr.*, s AS run_start, idx - s + 1 AS run_len FROM rr JOIN runs USING (series_id, rid)),
recent AS (SELECT a.series_id, a.idx, count(r.len) AS recent_n, avg(r.len) AS recent_mean FROM age a
  LEFT JOIN runs r ON r.series_id = a.series_id AND r.state = a.state AND r.e BETWEEN a.idx - {{window}} AND a.idx - 1
  GROUP BY 1, 2)"""
RUN_SQL = RUNS.format(window=200)
EWMA_RUNS = f"""{RUN_SQL},
ew(series_id, state, nth, y) AS (
  SELECT series_id, state, nth, len::DOUBLE FROM runs WHERE nth = 0
  UNION ALL
  SELECT r.series_id, r.state, r.nth, 0.85 * ew.y + 0.15 * r.len FROM ew JOIN runs r
    ON r.series_id = ew.series_id AND r.state = ew.state AND r.nth = ew.nth + 1),
after_run AS (SELECT runs.*, y FROM runs JOIN ew USING (series_id, state, nth)),
others AS (SELECT series_id, s, avg(y) AS y FROM (
   SELECT f.series_id, f.s, a.state, arg_max(a.y, a.e) AS y FROM runs f JOIN after_run a
     ON a.series_id = f.series_id AND a.e < f.s WHERE f.nth = 0 GROUP BY 1, 2, 3) GROUP BY 1, 2),
prior AS (SELECT r.series_id, r.rid, coalesce(a.y, o.y) AS prior FROM runs r
  LEFT JOIN after_run a ON a.series_id = r.series_id AND a.state = r.state AND a.nth = r.nth - 1
  LEFT JOIN others o ON o.series_id = r.series_id AND o.s = r.s),
life AS (SELECT a.*, recent_n, greatest(1.0, CASE WHEN recent_n >= 3 THEN recent_mean
   WHEN prior IS NULL THEN run_len WHEN recent_mean IS NULL THEN prior
   ELSE (recent_mean * recent_n + prior * greatest(1, 3 - recent_n)) / (recent_n + greatest(1, 3 - recent_n)) END) AS avg_run_local
  FROM age a JOIN recent USING (series_id, idx) JOIN prior USING (series_id, rid)),
metrics AS (SELECT *, CASE WHEN idx >= 9 THEN avg(switch) OVER (PARTITION BY series_id ORDER BY idx ROWS 49 PRECEDING) END
  AS switch_rate_local, run_len / avg_run_local AS exhaustion_ratio FROM life)"""


def daily_runs(spark, folder):
    df = daily_states(spark, folder).select("series_id", "ts", "idx", "state")
    return P.with_runs(df)


@query("run_length", f"WITH {RUN_SQL} SELECT {HEAD}, CAST(run_len AS BIGINT) AS run_len, CAST(run_start AS BIGINT) AS run_start FROM age")
def run_length(spark, folder):
    return daily_runs(spark, folder).select("series_id", time_text().alias("ts"), long("run_len").alias("run_len"),
                                            long("run_start").alias("run_start"))


@query("expected_life", f"""WITH {RUN_SQL} SELECT {HEAD}, {sql_rnd('coalesce(recent_mean, run_len)', 6, 'life')}
FROM age JOIN recent USING (series_id, idx)""")
def expected_life(spark, folder):
    df = P.expected_life(daily_runs(spark, folder), "state", 200, "life")
    return df.select("series_id", time_text().alias("ts"), *rounded(6, "life"))


@query("expected_life_ewma", f"WITH RECURSIVE {EWMA_RUNS} SELECT {HEAD}, {sql_rounded(6, 'avg_run_local')} FROM metrics")
def expected_life_ewma(spark, folder):
    df = P.expected_life_ewma(daily_runs(spark, folder), "state", CFG)
    return df.select("series_id", time_text().alias("ts"), *rounded(6, "avg_run_local"))


@query("switch_rate", f"WITH RECURSIVE {EWMA_RUNS} SELECT {HEAD}, {sql_rounded(6, 'switch_rate_local')} FROM metrics")
def switch_rate(spark, folder):
    df = P.switch_rate(daily_runs(spark, folder))
    return df.select("series_id", time_text().alias("ts"), *rounded(6, "switch_rate_local"))


@query("path_metrics", f"""WITH RECURSIVE {EWMA_RUNS} SELECT {HEAD}, CAST(run_len AS BIGINT) AS run_len_so_far,
 {sql_rounded(6, 'avg_run_local', 'exhaustion_ratio', 'switch_rate_local')} FROM metrics""")
def path_metrics(spark, folder):
    df = daily_states(spark, folder).select("series_id", "ts", "idx", "state")
    df = P.path_metrics(df, "state", CFG)
    return df.select("series_id", time_text().alias("ts"), long("run_len_so_far").alias("run_len_so_far"),
                     *rounded(6, "avg_run_local", "exhaustion_ratio", "switch_rate_local"))


@query("path_seed_states", f"""WITH RECURSIVE {EWMA_RUNS},
seen AS (SELECT *, max(e) OVER (PARTITION BY series_id, state) AS visit FROM after_run)
SELECT series_id, CAST(state AS BIGINT) AS state, count(*) FILTER (e >= visit - 200) AS kept,
 CAST(coalesce(sum(len) FILTER (e >= visit - 200), 0) AS BIGINT) AS sum_len,
 {sql_rnd('arg_max(y, e)', 6, 'ewma_mean')}, count(*) AS ewma_n FROM seen WHERE NOT is_open GROUP BY 1, 2""")
def path_seed_states(spark, folder):
    df = P.path_seed_by_state(daily_runs(spark, folder), "state", CFG)
    return df.select("series_id", long("state").alias("state"), long(F.size("runs")).alias("kept"),
                     long("sum_len").alias("sum_len"), *rounded(6, "ewma_mean"), "ewma_n")


@query("path_seed", f"""WITH {RUN_SQL},
z AS (SELECT *, max(idx) OVER (PARTITION BY series_id) AS m FROM age)
SELECT series_id, CAST(arg_max(state, idx) AS BIGINT) AS last_state, CAST(arg_max(run_len, idx) AS BIGINT) AS cur_run_len,
 CAST(sum(switch) FILTER (idx > m - 50) AS BIGINT) AS switches, CAST(max(idx) + 1 AS BIGINT) AS seed_n
FROM z GROUP BY 1""")
def path_seed(spark, folder):
    doc = P.path_seed(daily_runs(spark, folder), "state", CFG)
    parsed = F.from_json("seed", "last_state BIGINT, cur_run_len BIGINT, seed_n BIGINT, switch_buf ARRAY<BIGINT>")
    s = doc.select("series_id", parsed.alias("s"))
    total = F.aggregate("s.switch_buf", F.lit(0).cast("long"), lambda a, v: a + v)
    return s.select("series_id", "s.last_state", "s.cur_run_len", "s.seed_n", total.alias("switches"))
