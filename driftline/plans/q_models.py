"""Queries: hidden-Markov recursions, starting rows and forests, each beside SQL that works them out row by row."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import blocks as K
from ..operators import forecast as M
from ..operators import forest as T
from ..operators import hmm as H
from ..operators import labels as L
from . import sql
from .q_bars import events_bars
from .q_labels import STATES, daily_states
from .registry import long, query, rounded, sql_rnd, sql_time, time_text

HEAD = f"series_id, {sql_time()}"

# A model of three states for scaled returns, the same for every series.
START = (0.5, 0.3, 0.2)
TRANS = ((0.9, 0.06, 0.04), (0.05, 0.9, 0.05), (0.03, 0.07, 0.9))
MEANS = (-0.8, 0.1, 0.9)
VARS = (0.5, 0.2, 1.5)
R3 = range(3)


def scaled_returns(spark, folder):
    bars = K.open_blocks(K.position_bars(events_bars(spark, folder), 48), before=1)
    lr = F.coalesce(F.log("close") - F.log(F.lag("close").over(K.block_window())), F.lit(0.0))
    rows = K.close_blocks(bars.withColumn("z", lr)).select("series_id", "ts", "idx", "z")
    return L.standardize(rows, ["z"], F.lit(True)).drop("z").withColumnRenamed("z_z", "z")


def fixed_model(rows):
    array = lambda values: F.array(*[F.lit(float(v)) for v in values])
    return rows.select("series_id").distinct().select(
        F.col("series_id").alias("model_id"), H.sequence_key(["series_id"]).alias("seq"), F.lit(0).cast("long").alias("seed"),
        array(START).alias("start"), array(x for row in TRANS for x in row).alias("trans"), array(MEANS).alias("means"),
        array(VARS).alias("covars"), F.lit("full").alias("kind"), F.lit(float("-inf")).alias("loglik"), F.lit(False).alias("done"),
        F.lit(0).alias("iters"))


Z = f"""{sql.bars('events', 30)},
lr AS (SELECT *, coalesce(ln("close") - ln(lag("close") OVER (PARTITION BY series_id ORDER BY idx)), 0) AS lr FROM bars),
z AS (SELECT series_id, ts, idx, max(idx) OVER w AS last_idx, (lr - avg(lr) OVER w) / stddev_pop(lr) OVER w AS z
  FROM lr WINDOW w AS (PARTITION BY series_id)),
lb AS (SELECT *, {', '.join(f'-0.5 * (ln(2 * pi() * {v}) + (z - ({m})) * (z - ({m})) / {v}) AS l{j}' for j, (m, v) in enumerate(zip(MEANS, VARS)))} FROM z),
d AS (SELECT *, {', '.join(f'exp(l{j}) AS p{j}' for j in R3)} FROM lb)"""


def _best(j: int) -> tuple[str, str]:
    ways = [f"v.v{i} + ln({TRANS[i][j]})" for i in R3]
    return (f"greatest({', '.join(ways)})",
            f"CASE WHEN {ways[0]} >= {ways[1]} AND {ways[0]} >= {ways[2]} THEN 0 WHEN {ways[1]} >= {ways[2]} THEN 1 ELSE 2 END")


VITERBI = f"""WITH RECURSIVE {Z},
v(series_id, idx, v0, v1, v2, f0, f1, f2) AS (
  SELECT series_id, idx, {', '.join(f'ln({s}) + l{j}' for j, s in enumerate(START))}, 0, 0, 0 FROM lb WHERE idx = 0
  UNION ALL
  SELECT b.series_id, b.idx, {', '.join(f'{_best(j)[0]} + b.l{j}' for j in R3)}, {', '.join(_best(j)[1] for j in R3)}
  FROM v JOIN lb b ON b.series_id = v.series_id AND b.idx = v.idx + 1),
back(series_id, idx, state) AS (
  SELECT series_id, idx, CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END FROM v JOIN z USING (series_id, idx) WHERE idx = last_idx
  UNION ALL
  SELECT v.series_id, v.idx - 1, CASE back.state WHEN 0 THEN v.f0 WHEN 1 THEN v.f1 ELSE v.f2 END
  FROM back JOIN v ON v.series_id = back.series_id AND v.idx = back.idx AND v.idx > 0)
SELECT {HEAD}, CAST(state AS BIGINT) AS state FROM back JOIN z USING (series_id, idx)"""


@query("hmm_viterbi", VITERBI)
def hmm_viterbi(spark, folder):
    """Most likely states of a given model."""
    rows = K.stage(scaled_returns(spark, folder), "z")
    out = H.decode(H.segments(rows, None, 0), ["z"], fixed_model(rows), 3, rows_per_day=48, path_only=True)
    return out.select("series_id", time_text().alias("ts"), long("state").alias("state"))


def _forward(j: int) -> str:
    return f"({' + '.join(f'f.a{i} * {TRANS[i][j]}' for i in R3)}) * d.p{j}"


def _backward(i: int) -> str:
    return " + ".join(f"{TRANS[i][j]} * d.p{j} * g.b{j}" for j in R3)


SMOOTHED = f"""{Z},
f(series_id, idx, ll, a0, a1, a2) AS (
  SELECT series_id, idx, ln(t), {', '.join(f'u{j} / t' for j in R3)} FROM (SELECT *, u0 + u1 + u2 AS t FROM (
    SELECT series_id, idx, {', '.join(f'{s} * p{j} AS u{j}' for j, s in enumerate(START))} FROM d WHERE idx = 0))
  UNION ALL
  SELECT series_id, idx, ll + ln(t), {', '.join(f'u{j} / t' for j in R3)} FROM (SELECT *, u0 + u1 + u2 AS t FROM (
    SELECT d.series_id, d.idx, f.ll, {', '.join(f'{_forward(j)} AS u{j}' for j in R3)}
    FROM f JOIN d ON d.series_id = f.series_id AND d.idx = f.idx + 1))),
g(series_id, idx, b0, b1, b2) AS (
  SELECT series_id, idx, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE FROM z WHERE idx = last_idx
  UNION ALL
  SELECT series_id, idx, {', '.join(f'u{j} / t' for j in R3)} FROM (SELECT *, u0 + u1 + u2 AS t FROM (
    SELECT d.series_id, d.idx - 1 AS idx, {', '.join(f'{_backward(i)} AS u{i}' for i in R3)}
    FROM g JOIN d ON d.series_id = g.series_id AND d.idx = g.idx AND d.idx > 0))),
s AS (SELECT *, {', '.join(f'a{j} * b{j} / (a0 * b0 + a1 * b1 + a2 * b2) AS g{j}' for j in R3)} FROM f JOIN g USING (series_id, idx) JOIN d USING (series_id, idx)),
h AS (SELECT *, {' + '.join(f'-g{j} * ln(greatest(least(g{j}, 1), 1e-12))' for j in R3)} AS entropy FROM s)"""


@query("hmm_posterior", f"""WITH RECURSIVE {SMOOTHED}
SELECT {HEAD}, {sql_rnd('greatest(g0, g1, g2)', 6, 'posterior_maxp')}, {sql_rnd('entropy', 6, 'posterior_entropy')},
 {sql_rnd('1 - entropy / ln(3)', 6, 'stability_score')}, {sql_rnd('entropy / ln(3)', 6, 'mixed_signals')},
 {', '.join(sql_rnd(f'a{j}', 6, f'filtered_{j}') for j in R3)} FROM h""")
def hmm_posterior(spark, folder):
    """Smoothed and filtered probabilities of a given model, and what is read off them."""
    rows = K.stage(scaled_returns(spark, folder), "z")
    out = H.posterior_metrics(H.decode(H.segments(rows, None, 0), ["z"], fixed_model(rows), 3, rows_per_day=48), 3)
    filtered = {f"filtered_{j}": F.col("filtered")[j] for j in R3}
    return out.withColumns(filtered).select("series_id", time_text().alias("ts"), *rounded(
        6, "posterior_maxp", "posterior_entropy", "stability_score", "mixed_signals", *filtered))


def _pair(i: int, j: int) -> str:
    return f"lag(a{i}) OVER w * {TRANS[i][j]} * p{j} * b{j}"


@query("hmm_step", f"""WITH RECURSIVE {SMOOTHED},
x AS (SELECT *, {', '.join(f'{_pair(i, j)} AS x{i}{j}' for i in R3 for j in R3)} FROM s WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
y AS (SELECT *, {' + '.join(f'x{i}{j}' for i in R3 for j in R3)} AS t FROM x),
m AS (SELECT series_id, max(CASE WHEN idx = last_idx THEN ll END) AS loglik,
  {', '.join(f'max(CASE WHEN idx = 0 THEN g{j} END) AS start_{j}, sum(g{j} * z) / sum(g{j}) AS mean_{j}, sum(g{j} * z * z) / sum(g{j}) AS sq_{j}' for j in R3)},
  {', '.join(f'sum(x{i}{j} / t) AS t{i}{j}' for i in R3 for j in R3)} FROM y GROUP BY 1)
SELECT series_id, {sql_rnd('loglik', 4, 'loglik')}, {', '.join(sql_rnd(f'start_{j}', 6, f'start_{j}') for j in R3)},
 {', '.join(sql_rnd(f'mean_{j}', 6, f'mean_{j}') for j in R3)}, {', '.join(sql_rnd(f'sq_{j} - mean_{j} * mean_{j} + 0.001', 6, f'var_{j}') for j in R3)},
 {', '.join(sql_rnd(f't{i}{j} / (t{i}0 + t{i}1 + t{i}2)', 6, f'trans_{i}{j}') for i in R3 for j in R3)} FROM m""")
def hmm_step(spark, folder):
    """One step of fitting from given parameters, over whole series."""
    rows = K.stage(scaled_returns(spark, folder), "z")
    params = H.fit_gaussian_hmm(rows, ["z"], None, 3, RunConfig(), rows_per_day=48, max_iter=1, init=fixed_model(rows))
    names = {f"{out}_{j}": F.col(column)[j] for out, column in (("start", "start"), ("mean", "means"), ("var", "covars")) for j in R3}
    names |= {f"trans_{i}{j}": F.col("trans")[3 * i + j] for i in R3 for j in R3}
    return params.withColumns(names).select(F.col("model_id").alias("series_id"), *rounded(4, "loglik"), *rounded(6, *names))


def sql_mix(x: str) -> str:
    """`hmm.mix32` of a number."""
    once = lambda e: f"((xor({e}, {e} >> 16) * 73244475) & 4294967295)"
    twice = once(once(f"(({x}) & 4294967295)"))
    return f"xor({twice}, {twice} >> 16)"


SECOND = "CAST(epoch(ts) AS BIGINT)"


@query("hmm_starts", f"""WITH {Z}, seeds AS (SELECT unnest(range(30)) * 13 + 5 AS seed),
h0 AS (SELECT *, {sql_mix(SECOND)} AS hs FROM z),
h1 AS (SELECT seed, {sql_mix('seed')} AS hm FROM seeds),
h AS (SELECT series_id, seed, z, row_number() OVER (PARTITION BY series_id, seed ORDER BY {sql_mix('xor(hs, hm)')}, ts) AS place FROM h0, h1)
SELECT series_id, CAST(seed AS BIGINT) AS seed, CAST(place AS BIGINT) AS place, {sql_rnd('z', 6, 'z')} FROM h WHERE place <= 6""")
def hmm_starts(spark, folder):
    """The rows that models of 30 seeds start from."""
    rows = K.stage(scaled_returns(spark, folder), "z")
    models = rows.select("series_id").distinct().withColumn("seed", F.explode(F.expr("transform(sequence(0L, 29L), i -> i * 13 + 5)")))
    models = K.stage(models.select("series_id", H.sequence_key(["series_id"]).alias("seq"), "seed",
                                   F.concat_ws("|", "series_id", "seed").alias("model_id")), "models")
    drawn = H.sampled_rows(H.chunk_rows(rows, ["z"], rows_per_day=48), models, 6, 1)
    return drawn.join(models, "model_id").select("series_id", "seed", long("place").alias("place"), F.col("v")[0].alias("z")).select(
        "series_id", "seed", "place", *rounded(6, "z"))


# -- forests -----------------------------------------------------------------

FOREST_SQL = {
    "range_pct": '(high - low) / "close"', "body": '"close" / open - 1', "level": '"close" / ma - 1', "ret_1": "ret_1", "vol_short": "vol_short",
    "volume": "volume", "up_share": '("close" - low) / (high - low + 1)', "tall": "high / low - 1", "day": "CAST(extract(day FROM ts) AS DOUBLE)"}
FOREST_FEATURES = tuple(FOREST_SQL)
CFG = RunConfig()


def forest_rows(spark, folder):
    rows = daily_states(spark, folder)
    rows = M.forward_label(rows, CFG.horizon, "y").withColumns({
        "range_pct": (F.col("high") - F.col("low")) / F.col("close"), "body": F.col("close") / F.col("open") - 1,
        "level": F.col("close") / F.col("ma") - 1, "up_share": (F.col("close") - F.col("low")) / (F.col("high") - F.col("low") + 1),
        "tall": F.col("high") / F.col("low") - 1, "day": F.dayofmonth("ts").cast("double")})
    rows = rows.select("series_id", "ts", long("state").alias("state"), "y", *FOREST_FEATURES).dropna()
    return K.stage(rows.withColumn("train", F.col("ts") < F.lit("2000-01-01").cast("timestamp_ntz")), "rows")


def forest_predictions(spark, folder, depth: int):
    cfg, rows = replace(CFG, tree_depth=depth), forest_rows(spark, folder)
    models = M.fit_per_state(rows.filter("train"), "y", cfg, FOREST_FEATURES, "state")
    pred = M.predict_per_state(rows.filter("NOT train"), models, FOREST_FEATURES, "state", cfg=cfg)
    return pred.select("series_id", time_text().alias("ts"), "state", *rounded(6, "pred"))


TREES = f"""{STATES},
labelled AS (SELECT *, ln(lead("close", 4) OVER (PARTITION BY series_id ORDER BY idx) / "close") AS y FROM st),
fr AS (SELECT series_id, ts, state, y, {', '.join(f'{e} AS f{i}' for i, e in enumerate(FOREST_SQL.values()))}, ts < TIMESTAMP '2000-01-01' AS train
  FROM labelled WHERE y IS NOT NULL AND ma IS NOT NULL AND vol_short IS NOT NULL AND ret_1 IS NOT NULL),
facts AS (SELECT state, count(*) AS n, avg(y) AS mean, CASE WHEN stddev_pop(y) > 0 THEN stddev_pop(y) ELSE 1 END AS dev
  FROM fr WHERE train GROUP BY state HAVING count(*) >= {CFG.min_train_rows}),
trees AS (SELECT CAST(unnest(range({CFG.n_trees})) AS BIGINT) AS tree),
tw AS (SELECT tree, {sql_mix(f'tree * 65537 + {CFG.forest_seed}')} AS ht FROM trees),
rw AS (SELECT row_number() OVER () AS r, fr.*, (y - mean) / dev AS yz, {sql_mix(SECOND)} AS hr FROM fr JOIN facts USING (state) WHERE train),
u AS (SELECT r, tree, {sql_mix('xor(hr, ht)')} / 4294967296.0::DOUBLE AS u FROM rw, tw),
w AS (SELECT r, tree, {' + '.join(f'CAST(u >= {float(p)!r} AS INT)' for p in T.POISSON)} AS w FROM u WHERE u >= {float(T.POISSON[0])!r}),
roots AS (SELECT state, tree, sum(w) AS rw, sum(w * yz) AS rs FROM w JOIN rw USING (r) GROUP BY 1, 2)"""


@query("forest_mean", f"""WITH {TREES},
means AS (SELECT state, avg(CASE WHEN rw > 0 THEN rs / rw ELSE 0 END) AS v FROM roots GROUP BY state)
SELECT {HEAD}, CAST(state AS BIGINT) AS state, {sql_rnd('mean + dev * v', 6, 'pred')} FROM fr JOIN facts USING (state) JOIN means USING (state) WHERE NOT train""")
def forest_mean(spark, folder):
    """Forests without a split: the weighted means of 500 samples of a state's rows."""
    return forest_predictions(spark, folder, 0)


@query("forest_split", f"""WITH {TREES},
tall AS ({' UNION ALL '.join(f'SELECT r, state, {i} AS f, f{i} AS x FROM rw' for i in range(len(FOREST_SQL)))}),
ranks AS (SELECT state, f, x, row_number() OVER (PARTITION BY state, f ORDER BY x) AS k, count(*) OVER (PARTITION BY state, f) AS n FROM tall),
cuts AS (SELECT state, f, list(DISTINCT x ORDER BY x) AS cuts FROM ranks JOIN (SELECT unnest(range(1, {T.BINS})) AS i) ON k = ceil(i / {T.BINS}.0::DOUBLE * n) GROUP BY 1, 2),
binned AS (SELECT r, state, f, len(list_filter(cuts, lambda c: c < x)) AS b FROM tall JOIN cuts USING (state, f)),
fh AS (SELECT f, {sql_mix(f'f * 65537 + {CFG.forest_seed + 1}')} AS hf FROM (SELECT unnest(range({len(FOREST_SQL)})) AS f)),
th AS (SELECT tree, {sql_mix('tree * 4099')} AS hn FROM trees),
chosen AS (SELECT tree, f FROM (SELECT tree, f, row_number() OVER (PARTITION BY tree ORDER BY {sql_mix('xor(hn, hf)')}, f) AS k FROM th, fh) WHERE k <= 3),
hist AS (SELECT state, tree, f, b, sum(w) AS sw, sum(w * yz) AS ss FROM binned JOIN chosen USING (f) JOIN w USING (r, tree) JOIN rw USING (r, state) GROUP BY 1, 2, 3, 4),
cum AS (SELECT state, tree, f, b, sum(sw) OVER o AS wl, sum(ss) OVER o AS sl FROM hist WINDOW o AS (PARTITION BY state, tree, f ORDER BY b)),
gains AS (SELECT cum.*, rw - wl AS wr, rs - sl AS sr, round(sl * sl / wl + (rs - sl) * (rs - sl) / (rw - wl) - rs * rs / rw, 6) AS gain
  FROM cum JOIN roots USING (state, tree) WHERE wl >= {CFG.min_leaf} AND rw - wl >= {CFG.min_leaf}),
best AS (SELECT *, row_number() OVER (PARTITION BY state, tree ORDER BY gain DESC, f, b) AS k FROM gains WHERE gain > 0),
splits AS (SELECT state, tree, best.f, cuts[b + 1] AS c, sl / wl AS lv, sr / wr AS rv FROM best JOIN cuts USING (state, f) WHERE k = 1),
asked AS (SELECT row_number() OVER () AS q, * FROM fr WHERE NOT train),
ax AS ({' UNION ALL '.join(f'SELECT q, {i} AS f, f{i} AS x FROM asked' for i in range(len(FOREST_SQL)))}),
votes AS (SELECT q, asked.state, tree, rs / rw AS root FROM asked JOIN roots USING (state)),
answers AS (SELECT votes.q, votes.state, avg(CASE WHEN s.c IS NULL THEN root WHEN ax.x <= s.c THEN lv ELSE rv END) AS v
  FROM votes LEFT JOIN splits s ON s.state = votes.state AND s.tree = votes.tree LEFT JOIN ax ON ax.q = votes.q AND ax.f = s.f GROUP BY 1, 2)
SELECT {HEAD}, CAST(asked.state AS BIGINT) AS state, {sql_rnd('mean + dev * v', 6, 'pred')} FROM asked JOIN answers USING (q) JOIN facts ON facts.state = asked.state""")
def forest_split(spark, folder):
    """Forests of 500 trees with one split each: the best of a tree's features and cuts."""
    return forest_predictions(spark, folder, 1)
