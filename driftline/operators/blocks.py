"""Ordered computations on series of any length.

A window partitioned by `series_id` alone would put a whole series into one task.
Everything ordered in this package therefore works on blocks of consecutive rows:

* `with_position`   numbers the rows of each series from two levels of counts,
* `open_blocks`     cuts the numbered rows into blocks and copies the few rows a
                    bounded frame needs ("halo") into the neighbouring block,
* `carry`           turns running sums, maxima and last values into a scan inside
                    each block plus a scan over one summary row per block,
* `ranked`          ranks the rows of a group by value without sorting it in one task.

The summary tables hold one row per block, so their windows are smaller than the
data by the block size.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import day_number

BLOCK = 4096
SALT = 16


# -- cutting lineage -------------------------------------------------------

def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`.

    A local session without that setting gets a temporary folder; on a cluster
    the setting is required, because every executor must see the folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors can reach")
    own = tempfile.mkdtemp(prefix="driftline-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Used before a table feeds several branches of a plan: the branches then read
    only their own columns of a stored table instead of recomputing it, and a lost
    executor costs no upstream work.
    """
    if getattr(df, "_staged", False):
        return df
    spark = df.sparkSession
    path = os.path.join(
        shared_folder(spark), spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex}"
    )
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = True
    return out


def stored(df: DataFrame) -> DataFrame:
    """Mark a filter or projection of a stored table, which is cheap to read again."""
    df._staged = True
    return df


# -- joining per-key values ------------------------------------------------

def attach(df: DataFrame, small: DataFrame, keys, how: str = "inner", salt: int = SALT,
           salt_on=None) -> DataFrame:
    """Join one small row per key onto many rows.

    No broadcast is forced: adaptive execution broadcasts `small` when its measured
    size allows.  Otherwise both sides shuffle, and because `small` is repeated `salt`
    times the rows of a hot key spread over `salt` partitions.
    """
    keys = list(keys)
    if not keys:
        keys = ["_all"]
        df, small = df.withColumn("_all", F.lit(0)), small.withColumn("_all", F.lit(0))
    spread = list(salt_on) if salt_on else _salting_columns(df)
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salt)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return left.join(right, keys + ["_salt"], how).drop("_salt", "_all")


def _salting_columns(df: DataFrame):
    preferred = [c for c in ("idx", "ts") if c in df.columns]
    return preferred or list(df.columns)


# -- positions -------------------------------------------------------------

def day_bucket(rows_per_day: int, ts: str = "ts") -> Column:
    """Calendar bucket holding at most about BLOCK rows of one series."""
    return F.floor(day_number(ts) / F.lit(max(1, BLOCK // max(1, rows_per_day))))


def with_position(df: DataFrame, keys, order, bucket: Column, name: str = "idx", counted: DataFrame | None = None) -> DataFrame:
    """Number rows 0, 1, 2, ... inside each key, in `order`.

    `bucket` must be monotone in `order` and hold a bounded number of rows.  Rows are
    numbered inside their bucket and shifted by the sizes of the earlier buckets.
    `counted` may give a table with the same rows that is cheaper to count.
    """
    keys = list(keys)
    before = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        (df if counted is None else counted).groupBy(*keys, bucket.alias("_bkt"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_bkt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    inside = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    return (
        df.withColumn("_bkt", bucket)
        .join(offsets, keys + ["_bkt"])
        .withColumn(name, (F.col("_off") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_bkt", "_off")
    )


def position_bars(bars: DataFrame, rows_per_day: int = 288, keys=("series_id",)) -> DataFrame:
    """`idx` for a bar table: one row per key and timestamp, at most `rows_per_day` a day."""
    if "idx" in bars.columns:
        return bars
    # Numbering reads the table twice; bars are far fewer than the ticks behind them.
    bars = stage(bars, "bars")
    return with_position(bars, keys, ["ts"], day_bucket(rows_per_day))


# -- bounded frames --------------------------------------------------------

def open_blocks(df: DataFrame, before: int = 0, after: int = 0, size: int | None = None) -> DataFrame:
    """Add `_blk`, copying `before`/`after` neighbouring rows into each block.

    Copies have `_own` = false; `close_blocks` removes them again.
    """
    size = size or BLOCK
    if before > size or after > size:
        raise ValueError("a frame may not be longer than a block")
    own = F.expr(f"idx div {size}")
    inside = F.pmod(F.col("idx"), F.lit(size))
    targets = [own]
    if before:
        targets.append(F.when(inside >= size - before, own + 1))
    if after:
        targets.append(F.when((inside < after) & (own > 0), own - 1))
    if len(targets) == 1:
        return df.withColumns({"_blk": own, "_own": F.lit(True)})
    return (
        df.withColumn("_blk", F.explode(F.array_compact(F.array(*targets))))
        .withColumn("_own", F.col("_blk") == own)
    )


def own_rows(df: DataFrame) -> DataFrame:
    """Remove the copies but stay in blocks, so that `carry` needs no new shuffle."""
    return df.filter("_own").drop("_own")


def close_blocks(df: DataFrame) -> DataFrame:
    helpers = [c for c in df.columns if c.startswith("_")]
    return df.filter("_own").drop(*helpers)


def block_window(keys=("series_id",), *more):
    return Window.partitionBy(*keys, "_blk", *more).orderBy("idx")


def last_rows(w, n: int):
    return w.rowsBetween(-(n - 1), 0)


# -- running values --------------------------------------------------------

_TOTALS = {"sum": F.sum, "max": F.max, "min": F.min}


def carry(df: DataFrame, keys, running: dict, size: int | None = None) -> DataFrame:
    """Running values along `idx`, for series of any length.

    `running` maps an output name to (kind, column); kind is "sum", "max", "min" or
    "last" (last non-NULL value so far).  A kind ending in "_before" leaves the current
    row out.  The input feeds two branches: store it first when it is costly.
    """
    keys = list(keys)
    if "_blk" not in df.columns:
        df = df.withColumn("_blk", F.expr(f"idx div {size or BLOCK}"))
    df = df.withColumns({f"_in_{n}": c for n, (_, c) in running.items()})
    totals, shifted, local, final = [], {}, {}, {}
    blocks = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    row = block_window(keys)
    for name, (kind, _) in running.items():
        base = kind.removesuffix("_before")
        src, loc, tot, car = (F.col(f"_{p}_{name}") for p in ("in", "loc", "tot", "car"))
        frame = row.rowsBetween(Window.unboundedPreceding, -1 if kind != base else 0)
        if base == "last":
            total = F.max_by(src, F.when(src.isNotNull(), F.col("idx")))
            over = F.last(tot, ignorenulls=True).over(blocks)
            local[f"_loc_{name}"] = F.last(src, ignorenulls=True).over(frame)
            final[name] = F.coalesce(loc, car)
        else:
            fn = _TOTALS[base]
            total, over = fn(src), fn(tot).over(blocks)
            local[f"_loc_{name}"] = fn(src).over(frame)
            if base == "sum":
                final[name] = F.when(loc.isNull(), car).otherwise(loc + F.coalesce(car, F.lit(0)))
            else:
                pick = F.greatest if base == "max" else F.least
                final[name] = pick(loc, car)
        totals.append(total.alias(f"_tot_{name}"))
        shifted[f"_car_{name}"] = over
    summary = (
        df.groupBy(*keys, "_blk").agg(*totals)
        .select(*keys, "_blk", *[c.alias(n) for n, c in shifted.items()])
    )
    out = df.withColumns(local).join(summary, keys + ["_blk"]).withColumns(final)
    return out.drop("_blk", *[c for c in out.columns if c.startswith(("_in_", "_loc_", "_car_"))])


# -- ranks and quantiles ---------------------------------------------------

def _in_ranges(df: DataFrame, order, parts: int | None, name: str) -> DataFrame:
    """`df` sorted into ranges of `order`, stored, with the number of its range (`_part`).

    The ranges come from a sample and follow the size of the data, so a hot key is as many ranges as it needs.
    """
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    placed = ranged.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return stage(placed, name).withColumn("_part", F.shiftright("_id", 33))


def ranked(df: DataFrame, keys, value: str, tie: str, rank: str = "rank", total: str = "n", parts: int | None = None) -> DataFrame:
    """Exact rank (1-based, ties in `tie` order) of every row within its key.

    The rows are sorted in ranges of (key, value, tie); a row's rank is the rows of its key in earlier ranges and its
    place in its own.  Neither a long series nor a frequent value ends up in one task, and no row is compared with a
    list of splits.  `parts` fixes the number of ranges, which else follows the data.
    """
    keys = list(keys)
    rows = _in_ranges(df, [*keys, value, tie], parts, "ranked")
    everything = Window.partitionBy(*keys)
    earlier = everything.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
        .select(*keys, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
                F.sum("_n").over(everything).alias(total))
    )
    return rows.join(offsets, keys + ["_part"]).withColumn(rank, F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")


def exact_quantiles(df: DataFrame, keys, value: str, probs: dict, parts: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles of `value` per key; `probs` maps name to probability.

    Equal values are counted before anything is shuffled.  The counted values are sorted in ranges; the counts of the
    ranges say which of them hold a wanted rank, and only those are looked at row by row.
    """
    keys = list(keys)
    grain = keys or ["_all"]
    counted = df if keys else df.withColumn("_all", F.lit(0))
    counted = counted.filter(F.col(value).isNotNull()).groupBy(*grain, value).agg(F.count(F.lit(1)).alias("_cnt"))
    counted = _in_ranges(counted, [*grain, value], parts, "counted")
    everything = Window.partitionBy(*grain)
    earlier = everything.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        counted.groupBy(*grain, "_part").agg(F.sum("_cnt").alias("_n"))
        .select(*grain, "_part", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
                F.sum("_n").over(everything).alias("_total"))
    )

    def places(p):
        pos = (F.col("_total") - 1) * F.lit(float(p))
        return F.floor(pos) + 1, F.ceil(pos) + 1, pos - F.floor(pos)

    def holds(low, high, at):
        return (low <= at) & (high >= at)

    hit = F.lit(False)
    for p in probs.values():
        for at in places(p)[:2]:
            hit = hit | holds(F.col("_off") + 1, F.col("_off") + F.col("_n"), at)
    run = Window.partitionBy(*grain, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranks = (
        counted.join(ranges.filter(hit).drop("_n"), grain + ["_part"])
        .withColumn("_hi", F.col("_off") + F.sum("_cnt").over(run))
        .withColumn("_lo", F.col("_hi") - F.col("_cnt") + 1)
    )
    aggs, wanted = [], F.lit(False)
    for name, p in probs.items():
        low, high, frac = places(p)
        on_low, on_high = (holds(F.col("_lo"), F.col("_hi"), at) for at in (low, high))
        wanted = wanted | on_low | on_high
        a = F.max(F.when(on_low, F.col(value)))
        b = F.max(F.when(on_high, F.col(value)))
        aggs.append((a + (b - a) * F.max(frac)).alias(name))
    return ranks.filter(wanted).groupBy(*grain).agg(*aggs).drop("_all")
