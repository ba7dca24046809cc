"""Tolerance-based comparison of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce_numeric, ratio
from .blocks import attach

# Fixed value: least share of common rows for a fold to pass.
COVERAGE = 0.95


def curve_diff(old: DataFrame, new: DataFrame, keys=("series_id",)) -> DataFrame:
    """Full outer join of two (keys, ts, equity) curves with absolute and relative difference."""
    on = [*keys, "ts"]
    a = old.select(*on, coerce_numeric("equity").alias("equity_old"))
    b = new.select(*on, coerce_numeric("equity").alias("equity_new"))
    d = a.join(b, on, "full").withColumn("abs_diff", F.abs(F.col("equity_new") - F.col("equity_old")))
    return d.withColumn("rel_diff", ratio("abs_diff", F.abs("equity_old")))


def over_tolerance(tol_abs: float, tol_rel: float):
    bad = (F.col("abs_diff") > tol_abs) | (F.col("rel_diff") > tol_rel)
    return F.col("abs_diff").isNotNull() & F.coalesce(bad, F.col("abs_diff") > tol_abs)


def diff_summary(diff: DataFrame, tol_abs: float = 1e-6, tol_rel: float = 1e-4, keys=("series_id",)) -> DataFrame:
    bad = over_tolerance(tol_abs, tol_rel)
    out = diff.groupBy(*keys).agg(
        F.count("abs_diff").alias("rows_compared"), F.max("abs_diff").alias("max_abs_diff"),
        F.max(F.when(F.col("abs_diff").isNotNull(), F.col("rel_diff"))).alias("max_rel_diff"),
        F.count_if(bad).alias("rows_over_threshold"))
    fails = F.col("rows_over_threshold") > 0
    nothing = (F.col("max_abs_diff") == 0) & (F.col("max_rel_diff") == 0)
    return out.withColumns({
        "passed": ~fails,
        "likely_cause": F.when(fails & nothing, "missing_equity").when(fails, "domain_mismatch"),
    })


def top_diffs(diff: DataFrame, n: int, keys=("series_id",), tol_abs: float | None = None,
              tol_rel: float | None = None) -> DataFrame:
    """The n largest differences per key; with tolerances only rows over one of them."""
    rows = diff.filter("abs_diff IS NOT NULL")
    if tol_abs is not None:
        rows = rows.filter(over_tolerance(tol_abs, tol_rel))
    w = Window.partitionBy(*keys).orderBy(F.desc("abs_diff"), "ts")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= max(1, n))


def fold_diff(old: DataFrame, new: DataFrame, tol_abs: float = 1e-6, tol_rel: float = 1e-4,
              fold: str = "fold") -> DataFrame:
    """One row per fold present on both sides, with the reason a fold fails.

    Rows carry fold, ts and equity; a fold known to exist but without a curve is a row
    whose ts is NULL.  `missing` (boolean, optional) marks a fold whose file is absent or
    empty, `outside` one whose file lies outside the compared folder.
    """
    def side(df, tag):
        flags = {c: F.col(c) if c in df.columns else F.lit(False) for c in ("missing", "outside")}
        return df.withColumns(flags).groupBy(fold).agg(
            F.count_if(F.col("ts").isNotNull() & F.col("equity").isNotNull()).alias(f"len_{tag}"),
            F.bool_or("missing").alias(f"_missing_{tag}"), F.bool_or("outside").alias(f"_outside_{tag}"))

    def usable(df):
        return df.filter("ts IS NOT NULL AND equity IS NOT NULL")

    common = side(old, "old").join(side(new, "new"), fold)
    diff = curve_diff(usable(old), usable(new), (fold,))
    bad = over_tolerance(tol_abs, tol_rel)
    stats = diff.groupBy(fold).agg(
        F.count("abs_diff").alias("_rows"), F.max("abs_diff").alias("_abs"),
        F.max(F.when(F.col("abs_diff").isNotNull(), F.col("rel_diff"))).alias("_rel"),
        F.count_if(bad).alias("_bad"), F.min(F.when(bad, F.col("ts"))).alias("first_bad_time"),
        F.max(F.when(bad, F.col("ts"))).alias("last_bad_time"))
    out = common.join(stats, fold, "left")
    out = out.withColumns({
        "rows_compared": F.coalesce("_rows", F.lit(0)), "max_abs_diff": F.coalesce("_abs", F.lit(0.0)),
        "max_rel_diff": F.coalesce("_rel", F.lit(0.0)), "rows_over_threshold": F.coalesce("_bad", F.lit(0)),
    })
    shorter = F.least("len_old", "len_new")
    out = out.withColumn("coverage", F.when(shorter > 0, F.col("rows_compared") / F.nullif(shorter, F.lit(0))).otherwise(0.0))
    reason = (
        F.when(F.col("_missing_new"), "EQUITY_MISSING_NEW").when(F.col("_missing_old"), "EQUITY_MISSING_OLD")
        .when(F.col("_outside_old") | F.col("_outside_new"), "PATH_OUT_OF_ROOT")
        .when(shorter == 0, "EQUITY_EMPTY").when(F.col("rows_compared") == 0, "ZERO_ROWS_COMPARED")
        .when(F.col("coverage") < COVERAGE, "LOW_COVERAGE"))
    out = out.withColumn("fail_reason", reason)
    passed = F.col("fail_reason").isNull() & (F.col("rows_over_threshold") == 0) & (F.col("rows_compared") > 0)
    return out.withColumn("pass_fold", passed).select(
        fold, "rows_compared", "max_abs_diff", "max_rel_diff", "rows_over_threshold", "first_bad_time",
        "last_bad_time", "len_old", "len_new", "coverage", "fail_reason", "pass_fold")


def fold_overall(folds: DataFrame) -> DataFrame:
    return folds.agg(F.bool_and("pass_fold").alias("overall_pass"), F.max("max_abs_diff").alias("max_abs_diff"),
                     F.max("rows_over_threshold").alias("max_rows_over_threshold"), F.count(F.lit(1)).alias("folds"))


def stage_diff(old: DataFrame, new: DataFrame, columns, keys=("series_id",)) -> DataFrame:
    """One row: row counts, time ranges, schema agreement, and the largest difference of
    each column over the common times (NULL when the column is absent on one side)."""
    on = [*keys, "ts"]
    shared = [c for c in columns if c in old.columns and c in new.columns]
    a = old.select(*on, *[coerce_numeric(c).alias(f"_a_{c}") for c in shared])
    b = new.select(*on, *[coerce_numeric(c).alias(f"_b_{c}") for c in shared])
    diffs = a.join(b, on).agg(
        F.count(F.lit(1)).alias("merged_rows"),
        *[F.max(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}"))).alias(f"diff_{c}") for c in shared])

    def facts(df, tag):
        return df.agg(F.count(F.lit(1)).alias(f"rows_{tag}"), F.min("ts").alias(f"start_{tag}"),
                      F.max("ts").alias(f"end_{tag}"))

    one = F.lit(1).alias("_one")
    out = facts(old, "old").select("*", one).join(facts(new, "new").select("*", one), "_one").join(
        diffs.select("*", one), "_one").drop("_one")
    out = out.withColumns({f"diff_{c}": F.lit(None).cast("double") for c in columns if c not in shared})
    return out.withColumns({
        "same_columns": F.lit(set(old.columns) == set(new.columns)),
        "same_order": F.lit(list(old.columns) == list(new.columns)),
        "passed": F.col("rows_old") == F.col("rows_new"),
    })


def table_profile(df: DataFrame, columns, n: int = 64, keys=(), state: str | None = None) -> DataFrame:
    """Rows, time range, a content hash of all columns, and a hash of the first and last n rows.

    The edge hash covers `columns`, all of them if none is there. A hash is a sum of row hashes, so it does not
    depend on the order of the rows; columns count in the order of their names.
    """
    keys = list(keys)
    present = [c for c in columns if c in df.columns] or df.columns
    whole = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    h = F.xxhash64(*present).cast("decimal(38,0)")
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("time_min"), F.max("ts").alias("time_max"),
        F.sum(whole).alias("content_hash"))
    tie = [F.col(c) for c in present]
    edges = None
    for order in ([F.col("ts"), *tie], [F.col("ts").desc(), *[c.desc() for c in tie]]):
        # The limit is applied per task before the shuffle.
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
        part = df.select(*dict.fromkeys([*keys, "ts", *present])).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
        edges = part if edges is None else edges.unionByName(part)
    edge = edges.groupBy(*keys).agg(F.sum(h).alias("edge_hash"))
    out = _beside(base, edge, keys)
    if state is None:
        return out
    counts = df.filter(F.col(state).isNotNull()).groupBy(*keys, state).agg(F.count(F.lit(1)).alias("_n"))
    dist = counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.col(state).cast("int").alias("key"), F.col("_n").alias("value"))))).alias("distribution"))
    return _beside(out, dist, keys)


def _beside(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    return attach(a, b, keys, "left", salt=1)
