"""Streaming drivers: the batch folds as stateful processors, and micro-batch state upkeep.

``behavior`` keeps each key's whole fold in the state store (intervals, field statistics, streak and
signs; nothing is lost on a restart) and gives out its row after every micro-batch, in arrival
order; on input sorted by time it ends where the batch fold ends. It can start from the rows of a
batch fold. ``upkeep`` applies a mutation stream to a written last-writer-wins table: a micro-batch
rewrites the buckets of keys that it touches, and replays of a batch change nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.operators import folds as fo
from tideline.operators import state as st
from tideline.sources import files

STATE = ("ts bigint, n bigint, velocity double, dt_mean double, dt_m2 double, value double, k double, ema double, mean double, m2 double, low double, high double, "
         "streak bigint, record bigint, signs string, label string")
BEHAVIOR = ("key string, last_write bigint, write_count bigint, velocity double, volatility double, ema double, mean double, deviation double, z double, low double, high double, "
            "streak bigint, streak_record bigint, signs bigint, entropy double, label string")
NAMES = [c.split()[0] for c in BEHAVIOR.split(", ")]


def advanced(state: tuple | None, at: int, x: float, k: float) -> tuple:
    """A key's state after a write."""
    if state is None:
        return (at, 1, 1.0, 0.0, 0.0, x, k, x, x, 0.0, x, x, 0, 0, "", "emerging")
    ts, n, velocity, dt_mean, dt_m2, value, last_k, ema, mean, m2, low, high, streak, record, signs, label = state
    gap = at - ts
    dt = float(max(1, gap))
    velocity = fo.ALPHA * (fo.HOUR_MS / dt) + (1 - fo.ALPHA) * velocity
    before, dt_mean = dt_mean, dt_mean + (dt - dt_mean) / n
    dt_m2 += (dt - before) * (dt - dt_mean)
    n += 1
    ema = fo.TREND * x + (1 - fo.TREND) * ema
    before, mean = mean, mean + (x - mean) / n
    m2 += (x - before) * (x - mean)
    change = (x - value) + (k - last_k)
    sign = (change > 0) - (change < 0)
    if sign:
        streak = streak + sign if streak * sign > 0 else sign
        signs = (signs + ("+" if sign > 0 else "-"))[-fo.SIGNS:]
    if gap > fo.DEAD_MS or label == "dead":
        label = "resurrected"
    elif velocity > fo.HIGH:
        label = "emerging" if n < 10 else "active"
    else:
        label = "declining" if velocity < fo.LOW else "stable"
    return (at, n, velocity, dt_mean, dt_m2, x, k, ema, mean, m2, min(low, x), max(high, x), streak, max(record, abs(streak)), signs, label)


def row(key: str, state: tuple) -> tuple:
    ts, n, velocity, _, dt_m2, value, _, ema, mean, m2, low, high, streak, record, signs, label = state
    deviation = math.sqrt(m2 / (n - 1)) if n > 1 else 0.0
    p = signs.count("+") / max(1, len(signs))
    entropy = 0.0 if len(signs) < 2 or p in (0, 1) else -(p * math.log2(p) + (1 - p) * math.log2(1 - p))
    return (key, ts, n, velocity, math.sqrt(dt_m2 / (n - 2)) if n > 2 else 0.0, ema, mean, deviation, (value - mean) / deviation if deviation > 0 else 0.0, low, high, streak, record, len(signs), entropy, label)


class Behavior(StatefulProcessor):
    """The behaviour fold of a key's writes (ts ms, seq, value, k)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("fold", STATE)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        names = [c.split()[0] for c in STATE.split(", ")]
        self.held.update(tuple(v.item() if hasattr(v, "item") else v for v in initialState.iloc[0][names]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = tuple(self.held.get()) if self.held.exists() else None
        batch = []
        for part in rows:  # lists, as a frame of a few rows costs more than its rows
            batch += zip(part["ts"].tolist(), part["seq"].tolist(), part["value"].tolist(), part["k"].tolist())
        batch.sort(key=lambda b: b[:2])
        for at, _, x, k in batch:
            state = advanced(state, at, float(x), float(k))
        self.held.update(state)
        yield pd.DataFrame([row(key[0], state)], columns=NAMES)

    def close(self) -> None:
        pass


def restorable(behaviors: DataFrame) -> DataFrame:
    """Rows of ``folds.behavior`` as state to start a stream from (key and STATE): nothing of a fold is left out."""
    v, n = F.col("value"), F.col("write_count")
    return behaviors.select(
        "key", F.col("last_write").alias("ts"), n.alias("n"), "velocity", F.col("interval").alias("dt_mean"), (F.col("volatility") * F.col("volatility") * F.greatest(n - 2, F.lit(0))).alias("dt_m2"),
        v["last"].alias("value"), F.col("k.last").alias("k"), v["ema"].alias("ema"), v["mean"].alias("mean"), (v["deviation"] * v["deviation"] * (n - 1)).alias("m2"), v["min"].alias("low"), v["max"].alias("high"),
        "streak", F.col("streak_record").alias("record"), F.array_join(F.transform("signs", lambda s: F.when(s > 0, "+").otherwise("-")), "").alias("signs"),
        fo.lifecycle(F.col("velocity"), n, F.lit(0)).alias("label"))


def behavior(stream: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """stream: (key, ts, seq, value, k). Needs the RocksDB state store (see ``store``). initial: rows of ``restorable``."""
    start = initial.groupBy("key") if initial is not None else None
    return stream.groupBy("key").transformWithStateInPandas(Behavior(), BEHAVIOR, "update", "none", start)


def store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


BUCKETS = 64


def versions(path: str, number: int | None = None) -> dict[str, int]:
    """The batch that last wrote each bucket, by a batch's manifest (the newest if not given)."""
    found = [n for n in files.names(f"{path}/versions") if n.endswith(".json") and not n.startswith(".")]
    name = max(found, default=None) if number is None else f"{number:020d}.json" if f"{number:020d}.json" in found else None
    return json.loads(files.read(f"{path}/versions/{name}")) if name else {}


def held(spark: SparkSession, path: str) -> DataFrame | None:
    """The surviving rows of all buckets; none before the first batch."""
    parts = [f"{path}/data/{batch}/bucket={bucket}" for bucket, batch in versions(path).items()]
    return spark.read.parquet(*parts) if parts else None


def upkeep(log: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """A writer of the surviving row of each key: a micro-batch is merged with the buckets of keys that it
    touches, which are written under the batch's name; a manifest a batch says where each bucket is. A
    retried batch overwrites its own files and starts from the manifest before it. What no manifest of
    the last two batches names is removed."""
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # A file's split may hold far more rows than a task should sort, so rows go by their keys before they are folded.
        own = st.latest(batch.repartition("key")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).persist()
        before = versions(path, number - 1)
        touched = sorted(str(r["bucket"]) for r in own.select("bucket").distinct().collect())  # at most ``buckets`` rows
        rows = own.drop("bucket")
        old = [f"{path}/data/{before[b]}/bucket={b}" for b in touched if b in before]
        if old:
            rows = st.latest(spark.read.parquet(*old).unionByName(rows))
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{number}")
        own.unpersist()
        files.make(f"{path}/versions")
        files.replace(f"{path}/versions/{number:020d}.json", json.dumps(before | {b: number for b in touched}).encode())
        live = {str(n) for n in (*before.values(), number)} | {str(n) for n in versions(path, number).values()}
        for name in files.names(f"{path}/data"):
            if name.isdigit() and name not in live:
                files.remove(f"{path}/data/{name}")
        for name in files.names(f"{path}/versions"):
            if name.removesuffix(".json").isdigit() and int(name.removesuffix(".json")) < number - 1:
                files.remove(f"{path}/versions/{name}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def windowed(stream: DataFrame, size: str, late: str) -> DataFrame:
    """Counts by event-time window and kind with a watermark; stream: (ts timestamp, kind, value)."""
    return (stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "kind").agg(F.count("*").alias("n"))
            .select(F.unix_seconds("w.start").alias("start"), "kind", "n"))


class Hooks:
    """Functions run on every micro-batch in the order of registration: before_write may change the
    batch or raise to refuse it; on_write sees what was written."""

    def __init__(self):
        self.before, self.after = [], []

    def before_write(self, function):
        self.before.append(function)
        return function

    def on_write(self, function):
        self.after.append(function)
        return function

    def run(self, batch: DataFrame, write) -> None:
        for function in self.before:
            batch = function(batch)
        write(batch)
        for function in self.after:
            function(batch)


TOPICS = ("lifecycle_change", "anomaly_detected", "recommendation_new", "correlation_discovered", "cluster_formed", "cluster_dissolved", "insight_disabled")


class Topics:
    """Subscriptions to what micro-batches bring about: a topic has a function that makes its event rows of a
    batch, and subscribers that get them, if there are any. A topic nobody subscribed to isn't computed."""

    def __init__(self):
        self.makers, self.subscribers = {}, {}

    def topic(self, name: str, make) -> None:
        if name not in TOPICS:
            raise ValueError(f"unknown topic {name!r}")
        self.makers[name] = make

    def subscribe(self, names, function) -> None:
        for name in names:
            if name not in TOPICS:
                raise ValueError(f"unknown topic {name!r}")
            self.subscribers.setdefault(name, []).append(function)

    def unsubscribe(self, function) -> None:
        self.subscribers = {n: [f for f in all_ if f is not function] for n, all_ in self.subscribers.items()}

    def publish(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``; subscribers get (topic, events) and may see a batch again after a failure."""
        for name, make in self.makers.items():
            if self.subscribers.get(name):
                events = make(batch)
                if not events.isEmpty():
                    for function in self.subscribers[name]:
                        function(name, events)
