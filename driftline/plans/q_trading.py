"""Queries: forecast preparation, gate, exits, profit and loss."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import day_of
from ..operators import blocks as K
from ..operators import forecast as M
from ..operators import indicators as I
from ..operators import labels as L
from ..operators import paths as P
from ..operators import trading as G
from . import sql
from .q_bars import daily_bars
from .q_labels import EWMA_RUNS, HEAD, daily_returns, daily_states
from .registry import long, query, rnd, rounded, sql_rnd, sql_rounded, sql_time, time_text

CFG = replace(RunConfig(), history_start="1996-01-01 00:00:00", trade_days=100, stop_mult=0.6, take_mult=1.2,
              exhaustion_min=0.05, exhaustion_max=6.0, clamp_switch_min=0.05, clamp_run_max=60.0)


def labelled(spark, folder):
    """Daily bars with labels, path metrics, a forward return and a momentum forecast."""
    df = daily_states(spark, folder)
    df = P.path_metrics(df, "state", CFG).withColumnRenamed("state", "super_state")
    df = K.open_blocks(K.stage(df, "labelled"), before=20, after=4)
    w = K.block_window()
    df = df.withColumns({
        "pred": I.pct_change("close", 10, w),
        "y_ret_4": F.log(F.lead("close", 4).over(w) / F.col("close")),
        "_pc": F.lag("close").over(w),
        "stability_score": F.lit(1.0),
    })
    return K.close_blocks(df)


LABELLED = f"""{EWMA_RUNS},
lab AS (SELECT *, state AS super_state, "close" / lag("close", 10) OVER w - 1 AS pred,
  ln(lead("close", 4) OVER w / "close") AS y_ret_4 FROM metrics WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
lab2 AS (SELECT * FROM lab WHERE pred IS NOT NULL AND y_ret_4 IS NOT NULL),
dd AS (SELECT series_id, min(day) AS d0 FROM (SELECT series_id, day, row_number() OVER (PARTITION BY series_id ORDER BY day DESC) AS r
  FROM (SELECT DISTINCT series_id, CAST(ts AS DATE) AS day FROM lab2)) WHERE r <= 100 GROUP BY 1),
ro AS (SELECT lab2.*, CASE WHEN ts >= d0 THEN 'trade' WHEN ts >= TIMESTAMP '1996-01-01' THEN 'history' END AS role
  FROM lab2 JOIN dd USING (series_id)),
sp AS (SELECT *, CASE WHEN role = 'trade' THEN 'trade'
   WHEN row_number() OVER (PARTITION BY series_id, role ORDER BY ts) <= floor(0.8 * count(*) OVER (PARTITION BY series_id, role))
   THEN 'train' ELSE 'validation' END AS split FROM ro WHERE role IS NOT NULL)"""


def split_rows(spark, folder):
    rows = K.stage(labelled(spark, folder).filter("pred IS NOT NULL AND y_ret_4 IS NOT NULL"), "split_in")
    window = M.last_days_window(rows, CFG.trade_days)
    return M.time_split(rows, window, CFG, rows_per_day=1)


@query("forward_label", f"""WITH {sql.bars('orders', None)}
SELECT {HEAD}, {sql_rnd('ln(lead("close", 4) OVER (PARTITION BY series_id ORDER BY idx) / "close")', 6, 'y_ret_4')} FROM bars""")
def forward_label(spark, folder):
    df = M.forward_label(K.position_bars(daily_bars(spark, folder), 1), 4)
    return df.select("series_id", time_text().alias("ts"), *rounded(6, "y_ret_4"))


@query("forecast_features", f"""WITH RECURSIVE {sql.bars('orders', None)}, {sql.features()}
SELECT {HEAD}, {sql_rounded(6, 'log_ret_1', 'momentum_60', 'rsi_14', 'vol_ratio')}, {sql_rnd('ma_fast / ma_slow - 1', 6, 'ma_gap')}
FROM feat WHERE {sql.COMPLETE}""")
def forecast_features(spark, folder):
    names = ("log_ret_1", "momentum_60", "rsi_14", "vol_ratio", "ma_gap")
    feats = I.make_features(daily_bars(spark, folder), CFG, "1d", rows_per_day=1)
    return M.forecast_features(feats, names).select("series_id", time_text().alias("ts"), *rounded(6, *names))


@query("time_split", f"WITH RECURSIVE {LABELLED} SELECT {HEAD}, split FROM sp")
def time_split(spark, folder):
    return split_rows(spark, folder).select("series_id", time_text().alias("ts"), "split")


METRICS = """vm AS (SELECT super_state, sqrt(avg((y_ret_4 - pred) ** 2)) AS rmse, avg(abs(y_ret_4 - pred)) AS mae,
  1 - sum((y_ret_4 - pred) ** 2) / nullif(var_pop(y_ret_4) * count(*), 0) AS r2, CASE WHEN count(*) > 2 THEN corr(y_ret_4, pred) END AS ic, count(*) AS test_n
  FROM sp WHERE split = 'validation' GROUP BY 1)"""


@query("regression_metrics", f"""WITH RECURSIVE {LABELLED}, {METRICS}
SELECT CAST(super_state AS BIGINT) AS super_state, {sql_rounded(6, 'rmse', 'mae', 'r2', 'ic')}, test_n FROM vm""")
def regression_metrics(spark, folder):
    m = M.regression_metrics(split_rows(spark, folder).filter("split = 'validation'"), "y_ret_4", "pred")
    return m.select(long("super_state").alias("super_state"), *rounded(6, "rmse", "mae", "r2", "ic"), "test_n")


# Labels are judged by a lenient rule here: the momentum forecast has no skill.
LENIENT = replace(CFG, min_ic=-0.5, min_r2=-1e9)


@query("select_states", f"""WITH RECURSIVE {LABELLED}, {METRICS}
SELECT CAST(super_state AS BIGINT) AS super_state FROM (SELECT super_state FROM vm
 WHERE test_n >= 80 AND ic > -0.5 AND r2 > -1e9 ORDER BY ic DESC, super_state LIMIT 3)""")
def select_states(spark, folder):
    m = M.regression_metrics(split_rows(spark, folder).filter("split = 'validation'"), "y_ret_4", "pred")
    return M.select_states(m, LENIENT, 3).select(long("super_state").alias("super_state"))


GATE = f"""{LABELLED},
good AS (SELECT DISTINCT series_id, super_state FROM sp WHERE super_state IN (1, 2, 3, 4)),
th AS (SELECT series_id, least(quantile_cont(avg_run_local, 0.65), 60.0) AS avg_run_min,
   greatest(quantile_cont(switch_rate_local, 0.35), 0.05) AS switch_rate_max
   FROM sp SEMI JOIN good USING (series_id, super_state) WHERE split = 'train' GROUP BY 1),
ga AS (SELECT sp.*, coalesce(super_state IN (1, 2, 3, 4) AND stability >= 0.95 AND avg_run_local >= avg_run_min
   AND switch_rate_local <= switch_rate_max AND exhaustion_ratio >= 0.05 AND exhaustion_ratio <= 6.0, false) AS gate_on
   FROM (SELECT *, 1.0 AS stability FROM sp) sp LEFT JOIN th USING (series_id))"""


def gated(spark, folder):
    rows = K.stage(split_rows(spark, folder), "gate_in")
    good = rows.select("series_id", "super_state").distinct().filter("super_state IN (1, 2, 3, 4)")
    th = G.gate_thresholds(rows.filter("split = 'train'"), good, CFG, ["series_id"])
    return G.gate_mask(rows, th, ["series_id"]), th


@query("gate_thresholds", f"""WITH RECURSIVE {GATE}
SELECT series_id, {sql_rounded(6, 'avg_run_min', 'switch_rate_max')} FROM th""")
def gate_thresholds(spark, folder):
    return gated(spark, folder)[1].select("series_id", *rounded(6, "avg_run_min", "switch_rate_max"))


@query("gate_mask", f"WITH RECURSIVE {GATE} SELECT {HEAD}, split, gate_on FROM ga")
def gate_mask(spark, folder):
    return gated(spark, folder)[0].select("series_id", time_text().alias("ts"), "split", "gate_on")


@query("trade_snapshot", f"""WITH RECURSIVE {GATE}
SELECT {HEAD}, CAST(super_state AS BIGINT) AS super_state, gate_on, {sql_rnd('CASE WHEN super_state IN (1, 2, 3, 4) THEN pred END', 6, 'pred')}
FROM ga WHERE split = 'trade'""")
def trade_snapshot(spark, folder):
    rows = K.stage(gated(spark, folder)[0].filter("split = 'trade'"), "trade")
    preds = rows.filter("super_state IN (1, 2, 3, 4)").select("series_id", "ts", "super_state", "pred")
    snap = M.trade_snapshot(rows.drop("pred"), preds)
    return snap.select("series_id", time_text().alias("ts"), long("super_state").alias("super_state"), "gate_on",
                       *rounded(6, "pred"))


# -- exits and P&L on the whole daily table --------------------------------

def signal_inputs(spark, folder):
    """Bars with an ATR, and momentum forecasts gated by the label."""
    df = daily_states(spark, folder)
    df = K.open_blocks(df, before=I.feature_halo(CFG), size=I.feature_block(CFG))
    w = K.block_window()
    df = I.add_atr(I.add_lags(df, w), w, 14).withColumn("pred", I.pct_change("close", 10, w))
    df = K.stage(K.close_blocks(df), "signal_bars")
    preds = df.filter("idx >= 15 AND idx % 3 <> 0").select(
        "series_id", "ts", F.col("state").isin(1, 2, 3, 4).alias("gate_on"), "pred")
    return df.drop("pred"), preds


def signals(spark, folder):
    bars, preds = signal_inputs(spark, folder)
    return K.stage(G.fill_bar_columns(G.entry_signal(bars, preds, rows_per_day=1)), "signals")


SIGNALS = f"""{sql.ewmas('b0', {'tr': 'atr_14'}, 1 / 14, 'ea')},
p0 AS (SELECT b0.*, atr_14, "close" / lag("close", 10) OVER (PARTITION BY series_id ORDER BY idx) - 1 AS pred
  FROM b0 JOIN ea USING (series_id, idx)),
pr AS (SELECT series_id, ts, state IN (1, 2, 3, 4) AS gate_on, pred FROM p0 WHERE idx >= 15 AND idx % 3 <> 0),
spn AS (SELECT series_id, min(ts) AS t0, max(ts) AS t1 FROM pr GROUP BY 1),
x AS (SELECT p0.series_id, p0.ts, high, low, "close", atr_14, coalesce(pr.gate_on, false) AS gate_on,
   CASE WHEN pr.gate_on AND pr.pred IS NOT NULL THEN sign(pr.pred) ELSE 0.0 END AS sig,
   row_number() OVER (PARTITION BY p0.series_id ORDER BY p0.ts) - 1 AS idx,
   count(*) OVER (PARTITION BY p0.series_id) AS n
   FROM p0 JOIN spn USING (series_id) LEFT JOIN pr ON pr.series_id = p0.series_id AND pr.ts = p0.ts
   WHERE p0.ts BETWEEN t0 AND t1)"""
SIG = f"""{{states}},
b0 AS (SELECT *, greatest(high - low, coalesce(abs(high - lag("close") OVER w), 0), coalesce(abs(low - lag("close") OVER w), 0)) AS tr
  FROM st WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
{SIGNALS}"""
from .q_labels import STATES  # noqa: E402

SIG = SIG.replace("{states}", STATES)

EXITS = f"""{SIG},
s AS (SELECT *, "close" - sig * 0.6 * atr_14 AS stop, "close" + sig * 1.2 * atr_14 AS take FROM x WHERE sig <> 0 AND idx < n - 1),
hit AS (SELECT s.series_id, s.idx, s.sig AS dir, s."close" AS entry_px, s.ts AS entry_time, b.idx AS exit_idx, b.ts AS exit_time,
  CASE WHEN b.idx = s.idx + 4 THEN 1
   WHEN (s.sig > 0 AND b.low <= stop) OR (s.sig < 0 AND b.high >= stop) THEN 2
   WHEN (s.sig > 0 AND b.high >= take) OR (s.sig < 0 AND b.low <= take) THEN 3
   WHEN b.sig <> 0 AND b.sig <> s.sig THEN 4 END AS rule, stop, take, b."close" AS bar_close
  FROM s JOIN x b ON b.series_id = s.series_id AND b.idx BETWEEN s.idx + 1 AND s.idx + 4 AND b.idx < b.n - 1),
fe AS (SELECT series_id, idx, min(exit_idx) AS exit_idx FROM hit WHERE rule IS NOT NULL GROUP BY 1, 2),
ex AS (SELECT s.series_id, s.idx, s.ts AS entry_time, s.sig AS dir, s."close" AS entry_px, h.exit_idx, h.exit_time,
  CASE rule WHEN 2 THEN h.stop WHEN 3 THEN h.take ELSE bar_close END AS exit_px,
  list_extract(['time_exit', 'stop_loss', 'take_profit', 'signal_flip'], rule) AS exit_reason
  FROM s LEFT JOIN fe USING (series_id, idx) LEFT JOIN hit h ON h.series_id = s.series_id AND h.idx = s.idx AND h.exit_idx = fe.exit_idx)"""

TRADES = f"""{EXITS},
ns AS (SELECT series_id, idx, min(CASE WHEN sig <> 0 AND idx < n - 1 THEN idx END) OVER (PARTITION BY series_id ORDER BY idx
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM x),
nx AS (SELECT a.series_id, a.idx, nxt FROM ex a JOIN ns ON ns.series_id = a.series_id AND ns.idx = a.exit_idx
  WHERE nxt IS NOT NULL),
chain(series_id, idx) AS (
  SELECT series_id, min(idx) FROM ex GROUP BY 1
  UNION ALL
  SELECT c.series_id, nxt FROM chain c JOIN nx USING (series_id, idx)),
tr AS (SELECT ex.* FROM ex SEMI JOIN chain USING (series_id, idx))"""

PNL = f"""{TRADES},
po AS (SELECT x.*, coalesce(t.dir, 0.0) AS "position" FROM x LEFT JOIN tr t ON t.series_id = x.series_id
   AND x.idx >= t.idx AND x.idx < coalesce(t.exit_idx, 1000000000)),
pl AS (SELECT *, coalesce(ln("close" / lag("close") OVER w), 0.0) AS ret_1,
  coalesce(abs("position" - lag("position") OVER w), 0.0) AS turnover,
  coalesce(lag("position") OVER w, 0.0) AS held FROM po WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
pq AS (SELECT *, turnover * 3.0 / 10000.0 AS cost, held * ret_1 - turnover * 3.0 / 10000.0 AS strategy_ret FROM pl),
eq AS (SELECT *, sum(strategy_ret) OVER (PARTITION BY series_id ORDER BY idx) AS log_equity,
  exp(sum(strategy_ret) OVER (PARTITION BY series_id ORDER BY idx)) AS equity FROM pq)"""


@query("entry_signal", f"""WITH RECURSIVE {SIG} SELECT {HEAD}, CAST(idx AS BIGINT) AS idx, gate_on, {sql_rnd('sig', 1, 'entry_signal')},
 {sql_rounded(2, 'atr_14')} FROM x""")
def entry_signal(spark, folder):
    df = signals(spark, folder)
    return df.select("series_id", time_text().alias("ts"), long("idx").alias("idx"), "gate_on",
                     *rounded(1, "entry_signal"), *rounded(2, "atr_14"))


@query("fill_bar_columns", f"""WITH {sql.bars('orders', None)}
SELECT {HEAD}, {sql_rnd('CASE WHEN idx >= 13 THEN avg(high - low) OVER (PARTITION BY series_id ORDER BY idx ROWS 13 PRECEDING) ELSE 0 END', 4, 'atr_14')}
FROM bars""")
def fill_bar_columns(spark, folder):
    df = G.fill_bar_columns(K.position_bars(daily_bars(spark, folder), 1))
    return df.select("series_id", time_text().alias("ts"), *rounded(4, "atr_14"))


EXIT_COLS = (f"series_id, {sql_time('entry_time', 'entry_time')}, {sql_time('exit_time', 'exit_time')}, "
             f"{sql_rnd('dir', 1, 'dir')}, {sql_rounded(2, 'entry_px')}, {sql_rnd('exit_px', 2, 'exit_px')}, exit_reason")


def exit_output(df):
    return df.select("series_id", time_text("entry_time").alias("entry_time"), time_text("exit_time").alias("exit_time"),
                     *rounded(1, "dir"), *rounded(2, "entry_px", "exit_px"), "exit_reason")


@query("first_touch_exit", f"WITH RECURSIVE {EXITS} SELECT {EXIT_COLS} FROM ex")
def first_touch_exit(spark, folder):
    return exit_output(G.first_touch_exit(signals(spark, folder), CFG))


def trade_rows(spark, folder):
    table = signals(spark, folder)
    return table, K.stage(G.non_overlapping_trades(G.first_touch_exit(table, CFG), CFG.horizon), "trades")


@query("trades", f"""WITH RECURSIVE {TRADES} SELECT {EXIT_COLS}, {sql_rnd('ln(exit_px / entry_px) * dir', 6, 'logret')}
FROM tr WHERE exit_idx IS NOT NULL""")
def trades(spark, folder):
    t = G.trades_table(trade_rows(spark, folder)[1])
    return t.select("series_id", time_text("entry_time").alias("entry_time"), time_text("exit_time").alias("exit_time"),
                    *rounded(1, "dir"), *rounded(2, "entry_px", "exit_px"), "exit_reason", *rounded(6, "logret"))


@query("positions", f"WITH RECURSIVE {PNL} SELECT {HEAD}, {sql_rnd('position', 1, 'position')} FROM po".replace(
    'CAST(position AS', 'CAST("position" AS'))
def positions(spark, folder):
    table, t = trade_rows(spark, folder)
    return G.positions_from_trades(table, t).select("series_id", time_text().alias("ts"), *rounded(1, "position"))


def equity_rows(spark, folder):
    bars, preds = signal_inputs(spark, folder)
    return G.backtest(bars, preds, CFG, rows_per_day=1)


@query("pnl", f"""WITH RECURSIVE {PNL} SELECT {HEAD}, {sql_rounded(6, 'ret_1', 'turnover', 'cost', 'strategy_ret', 'log_equity')} FROM eq""")
def pnl(spark, folder):
    df = equity_rows(spark, folder)[0].withColumn("log_equity", F.log("equity"))
    return df.select("series_id", time_text().alias("ts"),
                     *rounded(6, "ret_1", "turnover", "cost", "strategy_ret", "log_equity"))


SHARPE = """ds AS (SELECT series_id, avg(r) / stddev_samp(r) * sqrt(252.0) AS sharpe_daily FROM
 (SELECT series_id, CAST(ts AS DATE) AS day, sum(strategy_ret) AS r FROM eq GROUP BY 1, 2) GROUP BY 1),
md AS (SELECT series_id, min((equity - peak) / peak) AS max_drawdown FROM
 (SELECT *, max(equity) OVER (PARTITION BY series_id ORDER BY idx) AS peak FROM eq) GROUP BY 1)"""


@query("daily_sharpe", f"WITH RECURSIVE {PNL}, {SHARPE} SELECT series_id, {sql_rounded(6, 'sharpe_daily')} FROM ds")
def daily_sharpe(spark, folder):
    return G.daily_sharpe(equity_rows(spark, folder)[0]).select("series_id", *rounded(6, "sharpe_daily"))


@query("max_drawdown", f"WITH RECURSIVE {PNL}, {SHARPE} SELECT series_id, {sql_rounded(6, 'max_drawdown')} FROM md")
def max_drawdown(spark, folder):
    return G.max_drawdown(equity_rows(spark, folder)[0]).select("series_id", *rounded(6, "max_drawdown"))


@query("equity_sharpe", f"""WITH RECURSIVE {sql.bars('events', 30)},
d AS (SELECT series_id, CAST(ts AS DATE) AS day, arg_max("close", ts) AS l, arg_min("close", ts) AS f FROM bars GROUP BY 1, 2),
r AS (SELECT *, coalesce(l / lag(l) OVER (PARTITION BY series_id ORDER BY day) - 1, 0) AS r FROM d)
SELECT series_id, {sql_rnd('arg_max(l, day) / arg_min(f, day)', 6, 'net_value')},
 {sql_rnd('avg(r) / stddev_samp(r) * sqrt(252.0)', 6, 'sharpe')} FROM r GROUP BY 1""")
def equity_sharpe(spark, folder):
    from .q_bars import events_bars
    return G.equity_sharpe(events_bars(spark, folder), "close").select("series_id", *rounded(6, "net_value", "sharpe"))


@query("run_stats", f"""WITH RECURSIVE {PNL}, {SHARPE},
b AS (SELECT series_id, exp(arg_max(log_equity, idx)) AS final_equity, count(*) FILTER ("position" <> 0) AS active_bars,
  avg(CASE WHEN gate_on THEN 1.0 ELSE 0.0 END) AS gate_coverage, count(*) FILTER (gate_on) AS gated_n FROM eq GROUP BY 1),
c AS (SELECT series_id, count(*) AS n_trades FROM tr WHERE exit_idx IS NOT NULL GROUP BY 1)
SELECT series_id, {sql_rnd('ln(final_equity)', 6, 'log_final')}, active_bars, {sql_rounded(6, 'gate_coverage')}, gated_n,
 n_trades, {sql_rounded(6, 'sharpe_daily', 'max_drawdown')} FROM b JOIN c USING (series_id) JOIN ds USING (series_id)
 JOIN md USING (series_id)""")
def run_stats(spark, folder):
    df, t = equity_rows(spark, folder)
    s = G.run_stats(df, t).withColumn("log_final", F.log("final_equity"))
    return s.select("series_id", *rounded(6, "log_final", "gate_coverage", "sharpe_daily", "max_drawdown"),
                    *[long(c).alias(c) for c in ("active_bars", "gated_n", "n_trades")])
