"""Thompson sampling with a seeded generator, and encoder profiling."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIOR, DECAY = (3.0, 1.0), 0.995


def choose(outcomes: DataFrame, draws: int = 100, seed: int = 12345) -> DataFrame:
    """Outcomes (task, arm, success, age_days) -> (task, arm, wins, losses, chosen): each draw takes
    the arm of the largest Beta(prior + decayed counts) sample. Deterministic by seed and task."""
    decayed = F.pow(F.lit(DECAY), F.floor("age_days").cast("double"))
    counts = outcomes.groupBy("task", "arm").agg(F.sum(F.when(F.col("success"), decayed).otherwise(0.0)).alias("wins"), F.sum(F.when(~F.col("success"), decayed).otherwise(0.0)).alias("losses"))

    def play(table: pa.Table) -> pa.Table:
        table = table.sort_by("arm")
        task = table.column("task")[0].as_py()
        r = np.random.default_rng([seed, *task.encode()])
        wins, losses = np.asarray(table.column("wins")), np.asarray(table.column("losses"))
        samples = r.beta(PRIOR[0] + wins, PRIOR[1] + losses, (draws, len(wins)))
        return table.append_column("chosen", pa.array(np.bincount(samples.argmax(axis=1), minlength=len(wins)), pa.int64()))

    return counts.groupBy("task").applyInArrow(play, "task string, arm string, wins double, losses double, chosen bigint")


def profile(rows: pa.Table, deep: bool = False) -> list[dict]:
    """Trial encodings of a sample: ratio and seconds by preset and block size, the best first; within
    a hundredth of the best ratio the faster one wins."""
    from tideline.sources import archive

    levels, blocks = ((1, 3, 5, 9, 15), (256, 512, 1000, 2000, 4000, 8000)) if deep else ((1, 3, 9), (1000, 4000))
    raw = 32 * rows.num_rows
    trials = []
    for level in levels:
        for size in blocks:
            archive.PRESETS["trial"] = (level, size)
            began = time.perf_counter()
            data, _ = archive.encode(rows, "trial")
            trials.append({"level": level, "block": size, "ratio": raw / len(data), "seconds": time.perf_counter() - began})
    archive.PRESETS.pop("trial", None)
    best = trials[0]
    for t in trials[1:]:
        if t["ratio"] > best["ratio"] + 0.01 or abs(t["ratio"] - best["ratio"]) <= 0.01 and t["seconds"] < best["seconds"]:
            best = t
    return [best, *[t for t in trials if t is not best]]
