"""Shared pieces of the checking SQL (common table expressions, without WITH)."""

from __future__ import annotations

TICKS = {
    "events": "SELECT event_type AS series_id, ts, value AS price, 1.0::DOUBLE AS qty, event_id AS seq FROM events",
    "orders": "SELECT o_orderpriority AS series_id, o_orderdate AS ts, o_totalprice AS price, "
              "1.0::DOUBLE AS qty, o_orderkey AS seq FROM orders",
    "lineitem": "SELECT l_returnflag || l_linestatus AS series_id, l_shipdate AS ts, "
                "l_extendedprice / l_quantity AS price, l_quantity AS qty, "
                "(l_orderkey * 8 + l_linenumber)::HUGEINT * 10000000000 + l_partkey AS seq FROM lineitem",
}


def bin_end(minutes: int, ts: str = "ts") -> str:
    return (f"time_bucket(INTERVAL {minutes} MINUTE, {ts} - INTERVAL 1 MICROSECOND) "
            f"+ INTERVAL {minutes} MINUTE")


def bars(table: str, minutes: int | None, name: str = "bars", min_count: int = 1) -> str:
    """ticks and bars of a table; minutes None means daily."""
    bucket = "date_trunc('day', ts)::TIMESTAMP" if minutes is None else bin_end(minutes)
    return f"""ticks AS ({TICKS[table]}),
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx FROM (
    SELECT series_id, {bucket} AS ts, arg_min(price, seq) AS open, max(price) AS high,
           min(price) AS low, arg_max(price, seq) AS "close", sum(qty) AS volume
    FROM ticks GROUP BY 1, 2 HAVING count(*) >= {min_count}))"""


def ewma(src: str, column: str, alpha: float, name: str, first: int = 0) -> str:
    """Exponential averages by recursion; needs idx and the listed column in src."""
    return ewmas(src, {column: name}, alpha, f"{name}_t", first)


def ewmas(src: str, columns: dict, alpha: float, table: str, first: int = 0) -> str:
    start = ", ".join(f"{c}::DOUBLE AS {n}" for c, n in columns.items())
    step = ", ".join(f"{1 - alpha!r} * r.{n} + {alpha!r} * b.{c}" for c, n in columns.items())
    return f"""{table}(series_id, idx, {', '.join(columns.values())}) AS (
  SELECT series_id, idx, {start} FROM {src} WHERE idx = {first}
  UNION ALL
  SELECT b.series_id, b.idx, {step}
  FROM {table} r JOIN {src} b ON b.series_id = r.series_id AND b.idx = r.idx + 1)"""


def features(src: str = "bars", opening: str = "") -> str:
    """Feature table `feat` over a bar table (defaults of the settings)."""
    w = "PARTITION BY series_id ORDER BY idx"

    def roll(fn, x, n, first=0):
        return (f"CASE WHEN idx >= {first + n - 1} THEN {fn}({x}) OVER "
                f"(PARTITION BY series_id ORDER BY idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END")

    def change(n):
        return f'"close" / lag("close", {n}) OVER ({w}) - 1'

    a = 1 / 14
    return f"""f1 AS (
  SELECT *, lag("close") OVER ({w}) AS pc, lag(high) OVER ({w}) AS ph, lag(low) OVER ({w}) AS pl,
    {change(1)} AS ret_1, {change(15)} AS price_change_15, {change(10)} AS momentum_10,
    {change(30)} AS momentum_30, {change(60)} AS momentum_60
  FROM {src}),
f2 AS (
  SELECT *, ln("close") - ln(pc) AS log_ret_1,
    {roll('avg', '"close"', 20)} AS ma_fast, {roll('avg', '"close"', 60)} AS ma_slow,
    {roll('stddev_samp', 'ret_1', 20, 1)} AS vol_short0, {roll('stddev_samp', 'ret_1', 60, 1)} AS vol_long,
    {roll('stddev_samp', 'ret_1', 15, 1)} AS volatility_150, {roll('avg', 'volume', 15)} AS volume_mean_15,
    greatest(abs(high - low), coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr,
    CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END AS pdm,
    CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END AS mdm,
    greatest("close" - pc, 0.0) AS up, greatest(pc - "close", 0.0) AS down
  FROM f1),
{ewmas('f2', {'tr': 'etr', 'pdm': 'epdm', 'mdm': 'emdm'}, a, 'e1')},
{ewmas('f2', {'up': 'eup', 'down': 'edown'}, a, 'e2', 1)},
f3 AS (
  SELECT series_id, idx, 100.0 * abs(100.0 * epdm / (etr + 1e-12) - 100.0 * emdm / (etr + 1e-12))
     / ((100.0 * epdm / (etr + 1e-12) + 100.0 * emdm / (etr + 1e-12)) + 1e-12) AS dx FROM e1),
{ewmas('f3', {'dx': 'adx_14'}, a, 'e3')},
feat0 AS (
  SELECT f2.*, ("close" - ma_slow) / (ma_slow + 1e-12) AS trend_strength,
    vol_short0 / (vol_long + 1e-12) AS vol_ratio,
    100.0 - 100.0 / (1.0 + eup / (edown + 1e-12)) AS rsi_14, etr AS atr_14,
    etr / ("close" + 1e-12) AS atr_pct_14, adx_14,
    volume / (volume_mean_15 + 1e-12) AS volume_ratio_150,
    (high - low) / ("close" + 1e-12) AS range_pct
  FROM f2 LEFT JOIN e1 USING (series_id, idx) LEFT JOIN e2 USING (series_id, idx)
  LEFT JOIN e3 USING (series_id, idx)),
feat AS (
  SELECT * EXCLUDE (vol_short0, volatility_150, volume_ratio_150, volume),
    vol_short0 * factor AS vol_short, volatility_150 * factor AS volatility_15,
    volume_ratio_150 * factor AS volume_ratio_15, volume * factor AS volume
  FROM (SELECT *, {opening or '1.0'} AS factor FROM feat0))"""


COMPLETE = ("log_ret_1 IS NOT NULL AND ma_slow IS NOT NULL AND vol_long IS NOT NULL AND rsi_14 IS NOT NULL "
            "AND volume_ratio_15 IS NOT NULL AND momentum_60 IS NOT NULL AND vol_short IS NOT NULL "
            "AND volatility_15 IS NOT NULL AND ret_1 IS NOT NULL")
