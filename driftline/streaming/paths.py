"""Path statistics continued row by row on a stream of labels.

State per series: the same figures as the seed document of `operators.paths.path_seed`.
Only runs that ended within the window and the last switch flags are kept, so the state
of a series has a fixed upper size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import RunConfig

OUTPUT = ("series_id string, ts timestamp_ntz, state int, run_len_so_far bigint, avg_run_local double, "
          "exhaustion_ratio double, switch_rate_local double")
STATE = "doc string"


def new_state() -> dict:
    return {"n": 0, "last": None, "age": 0, "runs": {}, "ewma": {}, "switches": []}


def from_seed(seed: str) -> dict:
    """State from a seed document."""
    s = json.loads(seed)
    return {
        "n": s["seed_n"], "last": s["last_state"], "age": s["cur_run_len"], "switches": list(s["switch_buf"]),
        "runs": {k: [[r["end"], r["len"]] for r in v] for k, v in (s.get("per_state_runs") or {}).items()},
        "ewma": {k: v["mean"] for k, v in (s.get("ewma") or {}).items()},
    }


def advance(st: dict, label: int, cfg: RunConfig) -> tuple[int, float, float, float | None]:
    """Take one label in; returns age, expected life, exhaustion, switch rate."""
    window, least, t, key = max(20, cfg.run_window), max(1, cfg.min_hist_runs), st["n"], str(label)
    switched = st["last"] is None or st["last"] != label
    if switched and st["last"] is not None:
        old, length = str(st["last"]), st["age"]
        st["runs"].setdefault(old, []).append([t - 1, length])
        before = st["ewma"].get(old)
        st["ewma"][old] = float(length) if before is None else (
            cfg.run_alpha * length + (1 - cfg.run_alpha) * before)
    st["age"] = 1 if switched else st["age"] + 1
    st["last"], st["n"] = label, t + 1
    st["switches"] = (st["switches"] + [int(switched)])[-cfg.switch_window:]
    recent = [r for r in st["runs"].get(key, []) if r[0] >= t - window]
    if key in st["runs"]:
        st["runs"][key] = recent
    n = len(recent)
    mean = sum(r[1] for r in recent) / n if n else None
    prior = None
    if cfg.use_prior and cfg.run_alpha > 0 and st["ewma"]:
        prior = st["ewma"].get(key, sum(st["ewma"].values()) / len(st["ewma"]))
    if n >= least:
        life = mean
    elif prior is None or prior <= 0:
        life = float(st["age"])
    elif mean is None:
        life = prior
    else:
        w = max(1, least - n)
        life = (mean * n + prior * w) / (n + w)
    life = max(1.0, life)
    flags = st["switches"]
    enough = st["n"] >= cfg.switch_min_periods
    return st["age"], life, st["age"] / max(life, 1e-6), sum(flags) / len(flags) if enough else None


def online_path_metrics(labels: DataFrame, cfg: RunConfig = RunConfig()) -> DataFrame:
    """Path statistics of a stream of (series_id, ts, state, seed).

    `seed` is NULL on ordinary rows.  A row with a seed document (and any ts before the
    first label) sets the state of its series; see `with_seed`.  Rows of one micro-batch
    are put in time order, so a series must not send older rows in a later batch.
    A NULL label counts as -1, as in the batch form.
    """
    def step(key, frames: Iterator[pd.DataFrame], group: GroupState):
        st = json.loads(group.get[0]) if group.exists else new_state()
        # A micro-batch of one series; its size is set by the trigger and the source.
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for ts, label, seed in zip(rows["ts"], rows["state"], rows["seed"]):
            if isinstance(seed, str):
                st = from_seed(seed)
            else:
                out.append((key[0], ts, int(label), *advance(st, int(label), cfg)))
        group.update((json.dumps(st),))
        yield pd.DataFrame(out, columns=["series_id", "ts", "state", "run_len_so_far", "avg_run_local",
                                         "exhaustion_ratio", "switch_rate_local"])

    return labels.select("series_id", "ts", F.coalesce(F.col("state").try_cast("int"), F.when(F.col("seed").isNull(), -1)).alias("state"), "seed").groupBy(
        "series_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def with_seed(labels: DataFrame) -> DataFrame:
    """Label rows in the shape `online_path_metrics` takes."""
    return labels.select("series_id", "ts", F.col("state").try_cast("int").alias("state"),
                         F.lit(None).cast("string").alias("seed"))


def seed_rows(seeds: DataFrame) -> DataFrame:
    """Seed documents (series_id, seed) as the first rows of the stream."""
    return seeds.select("series_id", F.get_json_object("seed", "$.seed_until_time").cast("timestamp_ntz").alias("ts"),
                        F.lit(None).cast("int").alias("state"), "seed")


def write_path_metrics(metrics: DataFrame, path: str, checkpoint: str):
    """Append the stream to a table until what is there now is used up; the checkpoint keeps the state for the next call."""
    return metrics.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
