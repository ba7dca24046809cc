"""Queries: run selection, curve combination, comparison, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import fold_name, fold_number, seed_triplet
from ..operators import blocks as K
from ..operators import calendar as C
from ..operators import compare as D
from ..operators import walkforward as W
from ..sources import readers as R
from ..sources import writers as S
from . import sql
from .q_bars import SQL_WINDOWS, daily_bars, events_bars, order_days
from .registry import long, query, rnd, rounded, sql_rnd, sql_rounded, sql_time, time_text

CFG = RunConfig()

# -- an evaluation table: months as cycles, supplier number modulo 30 as sweep ----


def evaluations(spark, folder):
    li = spark.read.parquet(f"{folder}/lineitem.parquet")
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    g = li.groupBy(month.cast("int").alias("cycle_no"), (F.col("l_suppkey") % 30).alias("sweep_i")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"), F.sum("l_linenumber").alias("l"),
        F.max("l_orderkey").alias("o"))
    return g.select(
        "cycle_no", "sweep_i", seed_triplet("sweep_i").alias("t"),
        F.when(F.col("o") % 17 == 0, float("-inf")).when(F.col("o") % 19 == 0, None)
        .otherwise((F.col("q") % 400) / 100 - 1).alias("eval_sharpe_daily"),
        F.when(F.col("o") % 11 == 0, None).otherwise(-(F.col("l") % 20) / 100).alias("eval_max_dd"),
        (F.col("o") % 25).alias("eval_trades"), (40 + F.col("q").cast("long") % 100).alias("eval_active_bars"),
        F.when(F.col("o") % 7 == 0, None).otherwise((F.col("l") % 100) / 100).alias("eval_gate_coverage"),
        (F.col("o") % 13 != 0).alias("engine_ok"),
    ).select("*", "t.*").drop("t")


EVALS = """ev0 AS (SELECT CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INT) AS cycle_no, l_suppkey % 30 AS sweep_i,
  count(*) AS n, sum(l_quantity) AS q, sum(l_linenumber) AS l, max(l_orderkey) AS o FROM lineitem GROUP BY 1, 2),
ev AS (SELECT cycle_no, sweep_i, sweep_i * 13 + 5 AS rs_5m, sweep_i * 17 + 7 AS rs_30m, sweep_i * 19 + 11 AS rs_1d,
  CASE WHEN o % 17 = 0 OR o % 19 = 0 THEN NULL ELSE (q % 400) / 100 - 1 END AS sharpe,
  CASE WHEN o % 11 = 0 THEN NULL ELSE -(l % 20) / 100 END AS dd, o % 25 AS trades, 40 + CAST(q AS BIGINT) % 100 AS active,
  CASE WHEN o % 7 = 0 THEN NULL ELSE (l % 100) / 100 END AS cov, o % 13 <> 0 AS ok FROM ev0),
ti AS (SELECT *, coalesce(abs(dd), 0.16) AS mdd,
  ok AND sharpe IS NOT NULL AND trades >= 8 AND active >= 60 AND (cov IS NULL OR cov BETWEEN 0.03 AND 0.9) AS relaxed,
  ok AND sharpe IS NOT NULL AND trades >= 8 AND active >= 60 AND (cov IS NULL OR cov BETWEEN 0.03 AND 0.9)
    AND coalesce(abs(dd), 0.16) <= 0.08 AS strict, ok AND trades > 0 AS last_resort FROM ev),
tn AS (SELECT *, CASE WHEN count(*) FILTER (strict) OVER c >= 5 THEN 'strict' WHEN count(*) FILTER (relaxed) OVER c > 0 THEN 'relaxed'
  WHEN count(*) FILTER (last_resort) OVER c > 0 THEN 'last_resort' ELSE 'strict' END AS tier FROM ti WINDOW c AS (PARTITION BY cycle_no)),
ca AS (SELECT *, coalesce(sharpe - 3.0 * mdd - 0.15 * greatest(0, 8 - trades), -1e9) AS robust_score,
  rs_5m || '_' || rs_30m || '_' || rs_1d AS seed_triplet FROM tn
  WHERE CASE tier WHEN 'strict' THEN strict WHEN 'relaxed' THEN relaxed ELSE last_resort END),
nu AS (SELECT *, row_number() OVER (PARTITION BY seed_triplet ORDER BY cycle_no) AS k FROM ca),
em(seed_triplet, k, ema_score) AS (
  SELECT seed_triplet, k, robust_score FROM nu WHERE k = 1
  UNION ALL SELECT n.seed_triplet, n.k, 0.6 * n.robust_score + 0.4 * e.ema_score FROM em e JOIN nu n
    ON n.seed_triplet = e.seed_triplet AND n.k = e.k + 1),
sc AS (SELECT nu.*, ema_score FROM nu JOIN em USING (seed_triplet, k))"""


@query("candidate_filter", f"WITH RECURSIVE {EVALS} SELECT cycle_no, sweep_i, tier FROM ca")
def candidate_filter(spark, folder):
    c = W.choose_candidates(W.candidate_tiers(K.stage(evaluations(spark, folder)), CFG), CFG)
    return c.select(long("cycle_no").alias("cycle_no"), long("sweep_i").alias("sweep_i"), "tier")


@query("robust_score", f"WITH RECURSIVE {EVALS} SELECT cycle_no, sweep_i, {sql_rnd('coalesce(sharpe - 3.0 * mdd - 0.15 * greatest(0, 8 - trades), -1e9)', 6, 'robust_score')} FROM tn")
def robust_score(spark, folder):
    return W.robust_score(evaluations(spark, folder), CFG).select(
        long("cycle_no").alias("cycle_no"), long("sweep_i").alias("sweep_i"), *rounded(6, "robust_score"))


@query("ema_top5", f"""WITH RECURSIVE {EVALS}
SELECT cycle_no, sweep_i, seed_triplet, {sql_rnd('ema_score', 5, 'ema_score')}, place FROM
 (SELECT *, row_number() OVER (PARTITION BY cycle_no ORDER BY round(ema_score, 9) DESC, robust_score DESC, sharpe DESC NULLS LAST, rs_5m) AS place
  FROM sc) WHERE place <= 5""")
def ema_top5(spark, folder):
    s = W.select_runs(evaluations(spark, folder), CFG)
    return s.select(long("cycle_no").alias("cycle_no"), long("sweep_i").alias("sweep_i"), "seed_triplet",
                    *rounded(5, "ema_score"), long("place").alias("place"))


# -- curves: weeks as cycles, event types as members -----------------------

def curves(spark, folder):
    bars = events_bars(spark, folder)
    week = F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 7).cast("int")
    return bars.select(week.alias("cycle_no"), F.col("series_id").alias("member"), "ts",
                       (1 + F.col("close") / 1000).alias("equity"))


CURVES = f"""{sql.bars('events', 30)},
cu AS (SELECT CAST(floor(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) / 7) AS INT) AS cycle_no,
  series_id AS member, ts, 1 + "close" / 1000 AS equity FROM bars),
rs AS (SELECT cycle_no, member, ts, equity / first_value(equity) OVER (PARTITION BY cycle_no, member ORDER BY ts) AS equity FROM cu),
gr AS (SELECT t.cycle_no, t.ts, m.member, r.equity FROM (SELECT DISTINCT cycle_no, ts FROM rs) t
  JOIN (SELECT DISTINCT cycle_no, member FROM rs) m USING (cycle_no) LEFT JOIN rs r USING (cycle_no, member, ts)),
fi AS (SELECT *, coalesce(last_value(equity IGNORE NULLS) OVER (PARTITION BY cycle_no, member ORDER BY ts), 1.0) AS e FROM gr),
co AS (SELECT cycle_no, ts, avg(e) AS eq_rel_combo FROM fi GROUP BY 1, 2),
fin AS (SELECT cycle_no, arg_max(eq_rel_combo, ts) AS f FROM co GROUP BY 1),
st AS (SELECT cycle_no, coalesce(exp(sum(ln(f)) OVER (ORDER BY cycle_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0) AS s FROM fin),
gl AS (SELECT cycle_no, ts, eq_rel_combo, eq_rel_combo * s AS eq_global FROM co JOIN st USING (cycle_no))"""


@query("rescale_to_1", f"WITH {CURVES} SELECT cycle_no, member, {sql_time()}, {sql_rounded(6, 'equity')} FROM rs")
def rescale_to_1(spark, folder):
    return W.rescale_to_1(curves(spark, folder)).select(
        long("cycle_no").alias("cycle_no"), "member", time_text().alias("ts"), *rounded(6, "equity"))


def combined(spark, folder, **kw):
    return W.combine_curves(W.rescale_to_1(K.stage(curves(spark, folder))), **kw)


@query("combine_curves", f"WITH {CURVES} SELECT cycle_no, {sql_time()}, {sql_rounded(6, 'eq_rel_combo')} FROM co")
def combine_curves(spark, folder):
    return combined(spark, folder).select(long("cycle_no").alias("cycle_no"), time_text().alias("ts"),
                                          *rounded(6, "eq_rel_combo"))


@query("combine_curves_padded", f"""WITH {CURVES} SELECT cycle_no, {sql_time()},
 {sql_rnd('(sum(e) + greatest(8 - count(*), 0)) / greatest(8, count(*))', 6, 'eq_rel_combo')} FROM fi GROUP BY cycle_no, fi.ts""")
def combine_curves_padded(spark, folder):
    return combined(spark, folder, pad_to=8).select(long("cycle_no").alias("cycle_no"), time_text().alias("ts"),
                                                    *rounded(6, "eq_rel_combo"))


@query("compound_stitch", f"""WITH {CURVES} SELECT {sql_time()}, cycle_no, {sql_rounded(6, 'eq_global')} FROM
 (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY cycle_no DESC) AS r FROM gl) WHERE r = 1""")
def compound_stitch(spark, folder):
    c = W.stitch(W.compound_cycles(K.stage(combined(spark, folder))))
    return c.select(time_text().alias("ts"), long("cycle_no").alias("cycle_no"), *rounded(6, "eq_global"))


@query("experiment_record", f"""WITH {CURVES},
d AS (SELECT CAST(ts AS DATE) AS day, arg_max(eq_global, ts) AS l, arg_min(eq_global, ts) AS f FROM gl GROUP BY 1),
r AS (SELECT *, coalesce(l / lag(l) OVER (ORDER BY day) - 1, 0) AS r FROM d)
SELECT 'check' AS tag, {sql_rnd('arg_max(l, day) / arg_min(f, day)', 4, 'final_net_value')},
 {sql_rnd('avg(r) / stddev_samp(r) * sqrt(252.0)', 4, 'sharpe_ratio')} FROM r""")
def experiment_record(spark, folder):
    c = W.stitch(W.compound_cycles(K.stage(combined(spark, folder))))
    return S.experiment_record(c, {"step_days": 22}, "check").select(
        "tag", (F.col("final_net_value") + 0.0).alias("final_net_value"), (F.col("sharpe_ratio") + 0.0).alias("sharpe_ratio"))


@query("flat_curve", f"""WITH {SQL_WINDOWS},
t AS (SELECT DISTINCT series_id, ts FROM ticks),
p AS (SELECT series_id, cycle_no, ts FROM cycles JOIN t USING (series_id) WHERE ts BETWEEN trade_start AND trade_end)
SELECT series_id, cycle_no, {sql_time()}, 1.0 AS eq_rel_combo FROM (SELECT * FROM p UNION ALL
 SELECT series_id, cycle_no, unnest([trade_start, trade_end]) FROM cycles ANTI JOIN p USING (series_id, cycle_no))""")
def flat_curve(spark, folder):
    windows = K.stage(C.walk_forward_windows(order_days(spark, folder), 22))
    f = W.flat_curve(R.ticks_orders(spark, folder), windows)
    return f.select("series_id", long("cycle_no").alias("cycle_no"), time_text().alias("ts"), "eq_rel_combo")


@query("selection_history", f"""WITH RECURSIVE {EVALS}, {SQL_WINDOWS},
pl AS (SELECT *, row_number() OVER (PARTITION BY cycle_no ORDER BY round(ema_score, 9) DESC, robust_score DESC, sharpe DESC NULLS LAST, rs_5m) AS place FROM sc)
SELECT cycle_no, cycle_id, {sql_time('trade_start', 'trade_start')}, seed_triplet, place
FROM pl JOIN (SELECT * FROM cycles WHERE series_id = '1-URGENT') USING (cycle_no) WHERE place <= 5""")
def selection_history(spark, folder):
    windows = C.walk_forward_windows(order_days(spark, folder), 22).filter("series_id = '1-URGENT'")
    h = W.selection_history(W.select_runs(evaluations(spark, folder), CFG), windows)
    return h.select(long("cycle_no").alias("cycle_no"), "cycle_id", time_text("trade_start").alias("trade_start"),
                    "seed_triplet", long("place").alias("place"))


@query("cycle_debug", f"""WITH RECURSIVE {EVALS},
pl AS (SELECT *, row_number() OVER (PARTITION BY cycle_no ORDER BY round(ema_score, 9) DESC, robust_score DESC, sharpe DESC NULLS LAST, rs_5m) AS place FROM sc),
me AS (SELECT DISTINCT CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INT) AS cycle_no, l_suppkey % 30 AS sweep_i
  FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)
SELECT cycle_no, count(me.sweep_i) AS valid, coalesce(string_agg(CASE WHEN me.sweep_i IS NULL THEN 'LIVE' || place || '_' || seed_triplet END, ','
  ORDER BY place), '') AS live_missing FROM pl LEFT JOIN me USING (cycle_no, sweep_i) WHERE place <= 5 GROUP BY cycle_no""")
def cycle_debug(spark, folder):
    sel = W.select_runs(evaluations(spark, folder), CFG).withColumn("member", F.col("sweep_i").cast("string"))
    li = spark.read.parquet(f"{folder}/lineitem.parquet").filter("l_returnflag = 'R' AND l_quantity > 40")
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    have = li.select(month.cast("int").alias("cycle_no"), (F.col("l_suppkey") % 30).cast("string").alias("member"))
    d = W.cycle_debug(sel, have)
    return d.select(long("cycle_no").alias("cycle_no"), long("valid").alias("valid"),
                    F.array_join("live_missing", ",").alias("live_missing"))


# -- comparison ------------------------------------------------------------

def two_curves(spark, folder):
    bars = K.stage(K.position_bars(daily_bars(spark, folder), 1))
    old = bars.filter("idx % 61 <> 0").select("series_id", "ts", F.col("close").alias("equity"))
    shift = F.when(F.col("idx") % 7 == 0, F.col("close") * 1.0012).otherwise(F.col("close"))
    return old, bars.filter("idx % 53 <> 0").select("series_id", "ts", shift.alias("equity"))


TWO = f"""{sql.bars('orders', None)},
old AS (SELECT series_id, ts, "close" AS equity FROM bars WHERE idx % 61 <> 0),
new AS (SELECT series_id, ts, CASE WHEN idx % 7 = 0 THEN "close" * 1.0012 ELSE "close" END AS equity FROM bars WHERE idx % 53 <> 0),
df AS (SELECT series_id, ts, o.equity AS equity_old, n.equity AS equity_new, abs(n.equity - o.equity) AS abs_diff,
  abs(n.equity - o.equity) / abs(o.equity) AS rel_diff FROM old o FULL JOIN new n USING (series_id, ts))"""


@query("curve_diff", f"""WITH {TWO} SELECT series_id, {sql_time()}, {sql_rounded(4, 'equity_old')}, {sql_rounded(4, 'equity_new')},
 {sql_rounded(4, 'abs_diff')}, {sql_rounded(6, 'rel_diff')} FROM df""")
def curve_diff(spark, folder):
    d = D.curve_diff(*two_curves(spark, folder))
    return d.select("series_id", time_text().alias("ts"), *rounded(4, "equity_old", "equity_new", "abs_diff"),
                    *rounded(6, "rel_diff"))


@query("diff_summary", f"""WITH {TWO} SELECT series_id, count(abs_diff) AS rows_compared, {sql_rnd('max(abs_diff)', 4, 'max_abs_diff')},
 {sql_rnd('max(rel_diff)', 6, 'max_rel_diff')}, count(*) FILTER (abs_diff > 1e-6 OR rel_diff > 1e-4) AS rows_over_threshold,
 count(*) FILTER (abs_diff > 1e-6 OR rel_diff > 1e-4) = 0 AS passed,
 CASE WHEN count(*) FILTER (abs_diff > 1e-6 OR rel_diff > 1e-4) > 0 THEN 'domain_mismatch' END AS likely_cause FROM df GROUP BY 1""")
def diff_summary(spark, folder):
    s = D.diff_summary(D.curve_diff(*two_curves(spark, folder)))
    return s.select("series_id", long("rows_compared").alias("rows_compared"), *rounded(4, "max_abs_diff"),
                    *rounded(6, "max_rel_diff"), long("rows_over_threshold").alias("rows_over_threshold"), "passed",
                    "likely_cause")


@query("top_diffs", f"""WITH {TWO} SELECT series_id, {sql_time()}, {sql_rounded(4, 'abs_diff')}, place FROM
 (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs_diff DESC, ts) AS place FROM df WHERE abs_diff > 1e-6 OR rel_diff > 1e-4)
 WHERE place <= 10""")
def top_diffs(spark, folder):
    t = D.top_diffs(D.curve_diff(*two_curves(spark, folder)), 10, tol_abs=1e-6, tol_rel=1e-4)
    return t.select("series_id", time_text().alias("ts"), *rounded(4, "abs_diff"), long("place").alias("place"))


def fold_curves(spark, folder):
    """Both curves with the fold read from a made-up file path per priority."""
    # 1-URGENT ... 5-LOW become fold_001, S001, LIVE3_.., FOLD_0004 and a fold only on one side.
    n = F.substring("series_id", 1, 1).cast("int")
    path = (F.when(n == 1, "runs/fold_1/curve.csv").when(n == 2, "runs/S001/curve.csv")
            .when(n == 3, "runs/LIVE3_5_7_11/curve.csv").when(n == 4, "runs/FOLD_0004/curve.csv")
            .otherwise("runs/other/curve.csv"))
    old, new = two_curves(spark, folder)
    add = lambda d: d.withColumn("fold", F.coalesce(fold_name(fold_number(path)), F.lit("fold_005")))
    old, new = add(old), add(new).filter("fold <> 'fold_005'")
    thin = (F.col("fold") == "fold_003") & (F.dayofmonth("ts") > 20)
    # The new side knows fold 4 but has no curve for it.
    return old, new.filter(~thin).withColumn("ts", F.when(F.col("fold") != "fold_004", F.col("ts")))


@query("fold_diff", f"""WITH {TWO},
o AS (SELECT *, 'fold_00' || left(series_id, 1) AS fold FROM old),
n0 AS (SELECT *, 'fold_00' || left(series_id, 1) AS fold FROM new WHERE left(series_id, 1) <> '5'),
n AS (SELECT * FROM n0 WHERE fold <> 'fold_004' AND NOT (fold = 'fold_003' AND day(ts) > 20)),
lo AS (SELECT fold, count(*) AS len_old FROM o GROUP BY 1),
ln AS (SELECT f.fold, count(n.ts) AS len_new FROM (SELECT DISTINCT fold FROM n0) f LEFT JOIN n USING (fold) GROUP BY 1),
j AS (SELECT o.fold, o.ts, abs(n.equity - o.equity) AS a, abs(n.equity - o.equity) / abs(o.equity) AS r FROM o JOIN n
  ON n.fold = o.fold AND n.ts = o.ts),
s AS (SELECT fold, count(*) AS rows_compared, max(a) AS ma, max(r) AS mr, count(*) FILTER (a > 1e-6 OR r > 1e-4) AS bad,
  min(ts) FILTER (a > 1e-6 OR r > 1e-4) AS fb, max(ts) FILTER (a > 1e-6 OR r > 1e-4) AS lb FROM j GROUP BY 1),
z AS (SELECT *, coalesce(rows_compared, 0) / greatest(least(len_old, len_new), 1) AS coverage
  FROM lo JOIN ln USING (fold) LEFT JOIN s USING (fold))
SELECT fold, coalesce(rows_compared, 0) AS rows_compared, {sql_rnd('coalesce(ma, 0)', 4, 'max_abs_diff')}, {sql_rnd('coalesce(mr, 0)', 6, 'max_rel_diff')},
 coalesce(bad, 0) AS rows_over_threshold, {sql_time('fb', 'first_bad_time')}, {sql_time('lb', 'last_bad_time')}, len_old, len_new,
 {sql_rnd('coverage', 6, 'coverage')}, CASE WHEN least(len_old, len_new) = 0 THEN 'EQUITY_EMPTY' WHEN coalesce(rows_compared, 0) = 0 THEN 'ZERO_ROWS_COMPARED'
  WHEN coverage < 0.95 THEN 'LOW_COVERAGE' END AS fail_reason, false AS pass_fold FROM z""")
def fold_diff(spark, folder):
    f = D.fold_diff(*fold_curves(spark, folder))
    counts = [long(c).alias(c) for c in ("rows_compared", "rows_over_threshold", "len_old", "len_new")]
    return f.select("fold", *counts, *rounded(4, "max_abs_diff"), *rounded(6, "max_rel_diff", "coverage"),
                    time_text("first_bad_time").alias("first_bad_time"),
                    time_text("last_bad_time").alias("last_bad_time"), "fail_reason", "pass_fold")


@query("stage_diff", f"""WITH {sql.bars('orders', None)},
a AS (SELECT series_id, ts, "close", volume FROM bars WHERE idx % 61 <> 0),
b AS (SELECT series_id, ts, "close" * 1.5 AS "close", volume + idx % 3 AS volume FROM bars WHERE idx % 53 <> 0)
SELECT (SELECT count(*) FROM a) AS rows_old, (SELECT count(*) FROM b) AS rows_new, count(*) AS merged_rows,
 {sql_rnd('max(abs(a."close" - b."close"))', 3, 'diff_close')}, {sql_rnd('max(abs(a.volume - b.volume))', 6, 'diff_volume')},
 (SELECT count(*) FROM a) = (SELECT count(*) FROM b) AS passed, true AS same_columns
FROM a JOIN b ON a.series_id = b.series_id AND a.ts = b.ts""")
def stage_diff(spark, folder):
    bars = K.stage(K.position_bars(daily_bars(spark, folder), 1))
    old = bars.filter("idx % 61 <> 0").select("series_id", "ts", "close", "volume")
    new = bars.filter("idx % 53 <> 0").select("series_id", "ts", (F.col("close") * 1.5).alias("close"),
                                              (F.col("volume") + F.col("idx") % 3).alias("volume"))
    s = D.stage_diff(old, new, ["close", "volume", "absent"])
    return s.select(*[long(c).alias(c) for c in ("rows_old", "rows_new", "merged_rows")], *rounded(3, "diff_close"),
                    *rounded(6, "diff_volume"), "passed", "same_columns")


@query("table_profile", """WITH p AS (SELECT event_type AS series_id, count(*) AS n_rows, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1),
k AS (SELECT event_type AS series_id, CAST(floor(value) AS INT) % 3 AS s, count(*) AS c FROM events GROUP BY 1, 2)
SELECT series_id, n_rows, strftime(a, '%Y-%m-%d %H:%M:%S') AS time_min, strftime(b, '%Y-%m-%d %H:%M:%S') AS time_max,
 string_agg(s || ':' || c, ',' ORDER BY s) AS distribution FROM p JOIN k USING (series_id) GROUP BY ALL""")
def table_profile(spark, folder):
    ticks = R.ticks_events(spark, folder).withColumn("state", F.floor("price").cast("int") % 3)
    p = D.table_profile(ticks, ["price", "seq"], keys=["series_id"], state="state")
    pairs = F.transform(F.map_entries("distribution"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return p.select("series_id", long("rows").alias("n_rows"), time_text("time_min").alias("time_min"),
                    time_text("time_max").alias("time_max"), F.array_join(pairs, ",").alias("distribution"))


# -- run documents ---------------------------------------------------------

def run_docs(spark, folder):
    """One run document per series and month of orders, some figures missing."""
    o = spark.read.parquet(f"{folder}/orders.parquet")
    g = o.groupBy(F.col("o_orderpriority").alias("p"), F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("a"))
    return g.select(
        F.concat_ws("/", "p", "m").alias("run_id"), F.col("m").alias("data_end_date"),
        F.when(F.col("n") % 5 == 0, float("nan")).otherwise(F.col("n") / 10).alias("sharpe_daily"),
        F.lit(1.0).alias("final_equity"), (-(F.col("n") % 9) / 100).alias("max_drawdown"),
        (F.col("n") % 4).cast("double").alias("n_trades"), (F.col("n") % 6).cast("double").alias("active_bars"),
        F.col("n").cast("double").alias("gated_n"),
        F.when(F.col("n") % 3 == 0, float("inf")).otherwise(F.col("n") / 100).alias("gate_coverage"))


@query("run_metrics", """WITH g AS (SELECT o_orderpriority || '/' || strftime(o_orderdate, '%Y-%m') AS run_id, count(*) AS n FROM orders GROUP BY 1)
SELECT run_id, CASE WHEN n % 5 = 0 THEN -9e9 ELSE round(n / 10, 6) + 0.0 END AS eval_sharpe_daily, round(-(n % 9) / 100, 6) + 0.0 AS eval_max_dd,
 CAST(coalesce(nullif(n % 4, 0), 0) AS BIGINT) AS eval_trades, CAST(coalesce(nullif(n % 6, 0), n) AS BIGINT) AS eval_active_bars,
 CASE WHEN n % 3 <> 0 THEN round(n / 100, 6) + 0.0 END AS eval_gate_coverage FROM g""")
def run_metrics(spark, folder):
    text = S.run_documents(run_docs(spark, folder)).select(F.to_json(F.struct("*")).alias("doc"))
    parsed = text.select(F.from_json("doc", R.RUN_SCHEMA).alias("d")).select("d.*")
    m = R.run_metrics(parsed)
    sharpe = F.when(F.col("eval_sharpe_daily") == float("-inf"), F.lit(-9e9)).otherwise(rnd("eval_sharpe_daily"))
    return m.select("run_id", sharpe.alias("eval_sharpe_daily"), *rounded(6, "eval_max_dd", "eval_gate_coverage"),
                    "eval_trades", "eval_active_bars")


@query("sanitized_json", """WITH g AS (SELECT o_orderpriority || '/' || strftime(o_orderdate, '%Y-%m') AS run_id, count(*) AS n FROM orders GROUP BY 1)
SELECT run_id, n % 5 = 0 AS no_sharpe, n % 3 = 0 AS no_coverage FROM g""")
def sanitized_json(spark, folder):
    text = S.sanitize(run_docs(spark, folder)).select("run_id", F.to_json(F.struct("*")).alias("doc"))
    return text.select("run_id", F.get_json_object("doc", "$.sharpe_daily").isNull().alias("no_sharpe"),
                       F.get_json_object("doc", "$.gate_coverage").isNull().alias("no_coverage"))
