"""Regression forests for many groups of rows at once, grown level by level from histograms.

Every group of rows (a series, cycle, run and state, say) gets a forest.  Values are put
into bins at quantiles of their group; a level of all trees is grown from sums of weights
and labels by (tree, node, feature, bin), which add up over any division of the rows:

* groups of at most WHOLE rows are grown in tasks of their own, one for a group and a
  number of trees, so that thousands of small forests are one job;
* a larger group is read in chunks, one job for each level for all such groups: a chunk
  comes with the trees grown so far, finds the node of each row, and sends its sums.

Both ways use the same functions and give the same trees.  Nothing is drawn at random:
a row's weight in a tree (Poisson, mean 1) and a node's features are hashes of the row's
second, the tree, the node and the feature, in numbers that SQL can repeat.

Labels are scaled by their group's mean and deviation while trees grow, and gains rounded,
so that equally good splits are settled by feature and bin, not by the order of a sum.
A forest is rows of nodes: `node` is tree * nodes of a tree + place in the tree (children
of place i are 2i + 1 and 2i + 2), `feature` is -1 in a leaf, `value` the mean label.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import attach, stage, stored
from .hmm import mix32

#: Bins of a feature.
BINS = 32
#: Rows of a chunk, of a group that one task may hold, and of a chunk to predict.
CHUNK, WHOLE, ASKED = 4096, 1 << 16, 8192
#: Rows times trees of a task.
WORK = 1 << 21
#: Trees whose sums are one row, and parts in which they are added up.
TREES, PARTS = 16, 32
#: Chances of a Poisson number of mean 1 to be at most 0, 1, 2, ...
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(8)])

GROWING = ("trees", "feature", "bin", "value")
FOREST = "tree_group int, node array<int>, feature array<int>, threshold array<double>, value array<double>"


# -- numerics ---------------------------------------------------------------

def nodes_of(depth: int) -> int:
    return 2 ** (depth + 1) - 1


def row_weights(second, trees, seed: int):
    """(trees, rows): how often a row stands in a tree's sample."""
    h = mix32(mix32(second)[None, :] ^ mix32(np.asarray(trees) * 65537 + seed)[:, None])
    return np.searchsorted(POISSON, h / 2.0 ** 32, "right").astype(np.int64)


def node_features(trees, places, n_features: int, seed: int):
    """(trees, places, m): the features a node may split on, in order; m is the root of their number, rounded down."""
    m = max(1, math.isqrt(n_features))
    where = mix32(np.asarray(trees)[:, None] * 4099 + np.asarray(places)[None, :])
    h = mix32(where[..., None] ^ mix32(np.arange(n_features) * 65537 + seed + 1))
    return np.sort(np.argsort(h, axis=-1, kind="stable")[..., :m], -1)


def binned(x, cuts):
    """Bins of the columns of x; bin b holds values above cut b - 1 and up to cut b."""
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(np.asarray(c), x[:, j], "left")
    return out


class Trees:
    """Some trees of a group while they grow."""

    def __init__(self, numbers, depth: int, n_features: int, seed: int):
        self.numbers, self.depth, self.n_features, self.seed = np.asarray(numbers), depth, n_features, seed
        shape = (len(self.numbers), nodes_of(depth))
        self.feature, self.bin = np.full(shape, -1, np.int32), np.zeros(shape, np.int32)
        self.value = np.full(shape, np.nan)

    def places(self, bins, level: int):
        """(trees, rows): the node of each row on `level`, or where it ended above."""
        at = np.zeros((len(self.numbers), len(bins)), np.int32)
        for _ in range(level):
            at = self.below(at, bins)
        return at

    def below(self, at, bins):
        t = np.arange(len(self.numbers))[:, None]
        f = self.feature[t, at]
        right = bins[np.arange(len(bins))[None, :], np.maximum(f, 0)] > self.bin[t, at]
        return np.where(f < 0, at, 2 * at + 1 + right)

    def chosen(self, level: int):
        width = 2 ** level
        return node_features(self.numbers, np.arange(width - 1, 2 * width - 1), self.n_features, self.seed)

    def sums(self, level: int, at, bins, y, weights):
        """(2, trees, nodes of the level, features, bins): weights, and weights times labels."""
        width = 2 ** level
        features = self.chosen(level)
        m = features.shape[-1]
        tree, row = np.nonzero((weights > 0) & (at >= width - 1))
        node = at[tree, row] - (width - 1)
        w = weights[tree, row].astype(float)
        wy = w * y[row]
        out = np.empty((2, len(self.numbers), width, m, BINS))
        cell = (tree * width + node) * BINS
        for slot in range(m):
            cells = cell + bins[row, features[tree, node, slot]]
            for i, v in enumerate((w, wy)):
                out[i, :, :, slot] = np.bincount(cells, v, len(self.numbers) * width * BINS).reshape(-1, width, BINS)
        return out

    def grow(self, level: int, sums, min_leaf: float) -> bool:
        """Split the nodes of the level where that helps; whether any was split."""
        width = 2 ** level
        features = self.chosen(level)
        weight, label = sums
        if level == 0:
            total = weight[:, 0, 0].sum(-1)
            self.value[:, 0] = np.where(total > 0, label[:, 0, 0].sum(-1) / np.maximum(total, 1e-300), 0.0)
        if level == self.depth:
            return False
        w_left, s_left = weight.cumsum(-1), label.cumsum(-1)
        w_all, s_all = w_left[..., -1:], s_left[..., -1:]
        w_right, s_right = w_all - w_left, s_all - s_left
        fits = (w_left >= max(min_leaf, 1)) & (w_right >= max(min_leaf, 1))
        gain = s_left ** 2 / np.maximum(w_left, 1) + s_right ** 2 / np.maximum(w_right, 1) - s_all ** 2 / np.maximum(w_all, 1)
        gain = np.where(fits, np.round(gain, 6), 0.0).reshape(len(self.numbers), width, -1)
        best = gain.argmax(-1)
        tree, node = np.nonzero(gain.max(-1) > 0)
        slot, cut = np.divmod(best[tree, node], BINS)
        place = node + width - 1
        self.feature[tree, place] = features[tree, node, slot]
        self.bin[tree, place] = cut
        at = (tree, node, slot, cut)
        self.value[tree, 2 * place + 1] = s_left[at] / w_left[at]
        self.value[tree, 2 * place + 2] = s_right[at] / w_right[at]
        return len(tree) > 0

    def table(self, group, cuts, mean: float, deviation: float) -> dict:
        """The nodes as lists, in the units of the label."""
        tree, place = np.nonzero(~np.isnan(self.value))
        f = self.feature[tree, place]
        threshold = np.array([cuts[j][b] if j >= 0 else 0.0 for j, b in zip(f, self.bin[tree, place])])
        return {"tree_group": group, "node": (self.numbers[tree] * nodes_of(self.depth) + place).astype(np.int32), "feature": f,
                "threshold": threshold, "value": mean + deviation * self.value[tree, place]}

    @classmethod
    def from_rows(cls, row, depth: int, n_features: int, seed: int):
        """Trees in the middle of growth from a row of the table between two levels."""
        out = cls(np.asarray(row["trees"]), depth, n_features, seed)
        shape = out.feature.shape
        out.feature, out.bin = (np.asarray(row[c], np.int32).reshape(shape).copy() for c in ("feature", "bin"))
        out.value = np.asarray(row["value"], float).reshape(shape).copy()
        return out

    def to_rows(self) -> dict:
        return {"trees": self.numbers.astype(np.int32), "feature": self.feature.ravel(), "bin": self.bin.ravel(), "value": self.value.ravel()}


# -- Spark side -------------------------------------------------------------

def _packed(rows: DataFrame, group: str, label: str, features) -> DataFrame:
    """Chunks of the rows of a group: seconds, labels and values."""
    values = F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"), F.col(label).cast("double").alias("y"),
                      F.array(*[F.col(c).cast("double") for c in features]).alias("v"))
    packed = rows.groupBy(group, "_chunk").agg(F.collect_list(values).alias("r"))
    return packed.select(group, "_chunk", F.col("r.second").alias("second"), F.col("r.y").alias("y"), F.flatten("r.v").alias("x"))


def group_facts(rows: DataFrame, group: str, label: str, features) -> DataFrame:
    """Of each group: rows, mean and deviation of the label, and for each feature the cuts between its bins."""
    probs = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    cuts = [F.array_sort(F.array_distinct(F.percentile_approx(F.col(c).cast("double"), probs, F.lit(10000)))).alias(f"_c{i}")
            for i, c in enumerate(features)]
    facts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("mean"), F.stddev_pop(label).alias("deviation"), *cuts)
    return facts.select(group, "n", "mean", F.when(F.col("deviation") > 0, F.col("deviation")).otherwise(1.0).alias("deviation"),
                        F.array(*[f"_c{i}" for i in range(len(features))]).alias("cuts"))


def fit_forests(rows: DataFrame, group: str, label: str, features, trees: int, depth: int, min_leaf: float, seed: int,
                min_rows: int = 1) -> DataFrame:
    """The forest of every group with at least `min_rows` rows: the group and FOREST columns, some trees a row.

    `rows` has the group, `ts`, the label and the features, without NULLs; it is read several times, so store it first.
    Rows of one second have equal weights in a tree, also those of several series in one group.
    """
    features, seed = list(features), int(seed)
    enough = stage(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows).select(group), "enough")
    rows = stored(rows.join(enough, group, "left_semi"))
    facts = stage(group_facts(rows, group, label, features), "facts")
    near = stored(facts.select(group, "n"))
    chunked = attach(rows.select(group, "ts", label, *features), near, [group], salt_on=["ts"])
    chunked = chunked.withColumn("_chunk", F.pmod(F.xxhash64("ts", label), F.ceil(F.col("n") / CHUNK)).cast("int")).drop("n")
    chunks = stage(_packed(chunked, group, label, features), "chunks")
    kind = dict(facts.dtypes)[group]
    schema = f"{group} {kind}, {FOREST}"

    def whole(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        fact, part = right.iloc[0], int(key[1])
        second, y, x = (np.concatenate(left[c].to_list()) for c in ("second", "y", "x"))
        bins = binned(x.reshape(len(y), -1), fact["cuts"])
        each = int(fact["each"])
        grown = Trees(np.arange(part * each, min(trees, (part + 1) * each)), depth, len(features), seed)
        weights, at = row_weights(second, grown.numbers, seed), grown.places(bins, 0)
        y = (y - fact["mean"]) / fact["deviation"]
        for level in range(depth + 1):
            if not grown.grow(level, grown.sums(level, at, bins, y, weights), min_leaf):
                break
            at = grown.below(at, bins)
        return pd.DataFrame([{group: key[0], **grown.table(part, fact["cuts"], fact["mean"], fact["deviation"])}])

    brief = facts.filter(F.col("n") <= WHOLE).withColumn("each", F.greatest(F.lit(1), F.least(F.lit(trees), F.floor(F.lit(WORK) / F.col("n")))))
    brief = brief.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.lit(trees) / F.col("each")) - 1)))
    by = [group, "_part"]
    beside = chunks.join(brief.select(*by), group).select(*[F.col(c).alias(c) for c in (*by, "second", "y", "x")])
    done = stage(beside.groupBy(*by).cogroup(brief.groupBy(*by)).applyInPandas(whole, schema), "forests")
    large = stored(facts.filter(F.col("n") > WHOLE))
    if large.isEmpty():
        return done
    return stored(done.unionByName(_fit_large(chunks, large, group, kind, len(features), trees, depth, min_leaf, seed)))


def _fit_large(chunks: DataFrame, facts: DataFrame, group: str, kind: str, n_features: int, trees: int, depth: int, min_leaf: float,
               seed: int) -> DataFrame:
    """Groups of any size, one job for each level."""
    growing = f"{group} {kind}, tree_group int, trees array<int>, feature array<int>, bin array<int>, value array<double>"

    def first(batches):
        for pdf in batches:
            yield pd.DataFrame([{group: g, "tree_group": i, **Trees(np.arange(i * TREES, min(trees, (i + 1) * TREES)), depth, n_features, seed).to_rows()}
                                for g in pdf[group] for i in range(-(-trees // TREES))])

    state = stage(facts.select(group).mapInPandas(first, growing), "trees")
    own = attach(chunks, facts.select(group, "mean", "deviation", "cuts"), [group], salt_on=["_chunk"])
    by = [group, "tree_group"]
    for level in range(depth + 1):
        def send(batches, level=level):
            held: dict = {}
            for pdf in batches:
                for r in pdf.to_dict("records"):
                    y = (np.asarray(r["y"]) - r["mean"]) / r["deviation"]
                    bins = binned(np.asarray(r["x"]).reshape(len(y), -1), r["cuts"])
                    for some in zip(r["tree_group"], *(r[c] for c in GROWING)):
                        grown = Trees.from_rows(dict(zip(GROWING, some[1:])), depth, n_features, seed)
                        sums = grown.sums(level, grown.places(bins, level), bins, y, row_weights(np.asarray(r["second"]), grown.numbers, seed))
                        key = r[group], some[0]
                        held[key] = held[key] + sums if key in held else sums
                    if len(held) >= PARTS:                 # bounded, however many groups a task meets
                        yield pd.DataFrame([{group: g, "tree_group": i, "sums": v.ravel()} for (g, i), v in held.items()])
                        held = {}
            yield pd.DataFrame([{group: g, "tree_group": i, "sums": v.ravel()} for (g, i), v in held.items()], columns=[group, "tree_group", "sums"])

        def add(key: tuple, table: pa.Table) -> pa.Table:
            total = sum(np.asarray(v.values) for v in table["sums"])
            return pa.table({group: table[group][:1], "tree_group": table["tree_group"][:1], "sums": pa.array([total], pa.list_(pa.float64()))})

        def grow(batches, level=level):
            for pdf in batches:
                out = []
                for r in pdf.to_dict("records"):
                    grown = Trees.from_rows(r, depth, n_features, seed)
                    grown.grow(level, np.asarray(r["sums"]).reshape(2, len(grown.numbers), 2 ** level, -1, BINS), min_leaf)
                    out.append({group: r[group], "tree_group": r["tree_group"], **grown.to_rows()})
                yield pd.DataFrame(out)

        summed = f"{group} {kind}, tree_group int, sums array<double>"
        # A chunk comes once, with all trees of its group.
        packed = state.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("tree_group", *GROWING))).alias("_s"))
        packed = packed.select(group, *[F.col(f"_s.{c}").alias(c) for c in ("tree_group", *GROWING)])
        sums = attach(own, packed, [group], salt_on=["_chunk"]).mapInPandas(send, summed).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
        sums = sums.groupBy(*by, "_part").applyInArrow(add, summed).groupBy(*by).applyInArrow(add, summed)
        state = stage(state.join(sums, by).mapInPandas(grow, growing), "trees")

    def finish(batches):
        for pdf in batches:
            yield pd.DataFrame([{group: r[group], **Trees.from_rows(r, depth, n_features, seed).table(r["tree_group"], r["cuts"], r["mean"], r["deviation"])}
                                for r in pdf.to_dict("records")])

    return stage(state.join(facts.select(group, "mean", "deviation", "cuts"), group).mapInPandas(finish, f"{group} {kind}, {FOREST}"), "forests")


def predict_forests(rows: DataFrame, forests: DataFrame, group: str, features, depth: int, out: str = "pred") -> DataFrame:
    """Rows of the groups that have a forest, with the mean of its trees.

    A group's rows are dealt to tasks of about ASKED rows, each with the group's forest.
    """
    features, nodes = list(features), nodes_of(depth)
    sizes = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("_parts"))
    sizes = stage(sizes.join(forests.select(group).distinct(), group), "asked")
    spread = "ts" if "ts" in rows.columns else features[0]
    dealt = attach(rows, sizes, [group], salt_on=[spread]).withColumn("_part", F.pmod(F.xxhash64(spread, features[0]), F.col("_parts"))).drop("_parts")
    beside = forests.join(sizes, group).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place = np.concatenate([np.asarray(v.values) for v in right["node"]])
        tree, place = np.divmod(place, nodes)
        shape = (int(tree.max()) + 1, nodes)
        feature, threshold, value = np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape)
        for table, name in ((feature, "feature"), (threshold, "threshold"), (value, "value")):
            table[tree, place] = np.concatenate([np.asarray(v.values) for v in right[name]])
        x = np.column_stack([left[c].to_numpy() for c in features]).astype(float)
        total, t = np.zeros(len(x)), np.arange(shape[0])[:, None]
        for start in range(0, len(x), 1024):
            part = x[start:start + 1024]
            at, n = np.zeros((shape[0], len(part)), np.int32), np.arange(len(part))[None, :]
            for _ in range(depth):
                f = feature[t, at]
                at = np.where(f < 0, at, 2 * at + 1 + (part[n, np.maximum(f, 0)] > threshold[t, at]))
            total[start:start + 1024] = value[t, at].mean(0)
        return left.drop_columns(["_part"]).append_column(out, pa.array(total))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    by = [group, "_part"]
    return dealt.select(*rows.columns, "_part").groupBy(*by).cogroup(beside.groupBy(*by)).applyInArrow(run, f"{schema}, `{out}` double")
