"""Helpers that the operators share: words, content keys, stored tables, small joins, components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]+"
#: A table measured to be at most this many rows may be broadcast.
SMALL_ROWS = 100_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Words of a text, unchanged; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Store:
    """Tables written to the shared folder, so that lineage is short and no executor holds the only copy.

    The folder is spark.checkpoint.dir of the session. Only a local session without it gets a temporary folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = os.path.join(tempfile.gettempdir(), "driftline-checkpoints")
        self.base = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Write `df` and read it back."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that this store wrote and nothing will read again."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def join_small(df: DataFrame, small: DataFrame, on, how: str = "left", most: int = SMALL_ROWS) -> DataFrame:
    """Join with a table that is broadcast only if it is measured to have at most `most` rows.

    `small` should be a stored table: its rows are counted first. Beyond the bound both sides are shuffled, and
    adaptive execution splits hot keys of `df`.
    """
    return df.join(F.broadcast(small) if small.limit(most + 1).count() <= most else small, on, how)


def components(store: Store, edges: DataFrame) -> DataFrame:
    """(node, component) of every node in `edges` (a, b): one node of each component stands for it.

    Union-find on tables: every node hooks to its least neighbour, edges are contracted, until none is left. Labels
    are random (hashes), so the number of rounds grows with the logarithm of the nodes. Loops and repeated edges
    do no harm; a hub is a key of a partial aggregate and of joins that can be split.
    """
    live = store.put(edges.select("a", "b").where("a <> b").distinct())
    nodes = live.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = store.put(nodes.select("node", F.col("node").alias("component")))
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = store.put(both.groupBy("a").agg(F.min("b").alias("to")).where("to < a"))
        first, second = hooks.select("a", F.col("to").alias("a_to")), hooks.select(F.col("a").alias("b"), F.col("to").alias("b_to"))
        moved = (live.join(first, "a", "left").join(second, "b", "left")
                 .select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b")))
        after = store.put(moved.where("a <> b").distinct())
        step = hooks.select(F.col("a").alias("component"), "to")
        new = store.put(labels.join(step, "component", "left")
                        .select("node", F.coalesce("to", "component").alias("component")))
        store.drop(live, hooks, labels)
        live, labels = after, new
    store.drop(live)
    return labels
