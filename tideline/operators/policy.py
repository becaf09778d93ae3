"""Replayable runtime policies: file rotation, circuit breaking, supervision.

Each is a small state machine over one log in order; logs run in parallel, a group each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROTATION = "log string, seq bigint, reason string"
BREAKER = "log string, seq bigint, ts bigint, state string, admitted boolean"
SUPERVISOR = "log string, seq bigint, state string, backoff_ms bigint"


def rotations(flushes: DataFrame, max_bytes: int, max_snapshots: int, max_segments: int | None = None, max_ms: int | None = None, alpha: float = 0.2, latency_factor: float = 2.0, ratio_drop: float = 0.7, breaches: int = 3, cooldown: int = 5) -> DataFrame:
    """Where a session of flushes (log, seq, bytes, snapshots, latency_us, ratio, and ts in ms if max_ms is
    given) starts a new file: at a hard limit (bytes, snapshots, segments, that is flushes, or age), or after consecutive breaches of the latency or ratio averages, not within a cooldown."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        size = count = run_ = segments = 0
        opened = None
        times = table.column("ts").to_pylist() if max_ms is not None else [0] * len(table)
        since, latency, ratio, best, first, out = cooldown, None, None, 0.0, None, []
        for at, log, seq, b, n, l, r in zip(times, *(table.column(c).to_pylist() for c in ("log", "seq", "bytes", "snapshots", "latency_us", "ratio"))):
            size, count, since, segments = size + b, count + n, since + 1, segments + 1
            opened = at if opened is None else opened
            latency = l if latency is None else alpha * l + (1 - alpha) * latency
            ratio = r if ratio is None else alpha * r + (1 - alpha) * ratio
            first, best = latency if first is None else min(first, latency), max(best, ratio)
            breach = "latency" if latency > latency_factor * first else "ratio" if ratio < ratio_drop * best else None
            run_ = run_ + 1 if breach else 0
            reason = "bytes" if size >= max_bytes else "snapshots" if count >= max_snapshots else "segments" if max_segments and segments >= max_segments else "duration" if max_ms is not None and at - opened >= max_ms else breach if run_ >= breaches and since > cooldown else None
            if reason:
                out.append((log, seq, reason))
                size = count = run_ = since = segments = 0
                opened = None
        return pa.table({n.split()[0]: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate(zip(ROTATION.split(", "), (pa.string(), pa.int64(), pa.string())))})

    return flushes.groupBy("log").applyInArrow(run, ROTATION)


def breaker(ops: DataFrame, failures: int = 5, window_ms: int = 60_000, open_ms: int = 30_000, probes: int = 3) -> DataFrame:
    """The circuit's state at each operation (log, seq, ts, ok): it opens on so many failures within the
    window, lets probes through after a rest, and closes after so many good ones."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("ts", "ascending"), ("seq", "ascending")])
        state, recent, opened, good, states, admitted = "closed", [], 0, 0, [], []
        for ts, ok in zip(table.column("ts").to_pylist(), table.column("ok").to_pylist()):
            if state == "open" and ts - opened >= open_ms:
                state, good = "half_open", 0
            admitted.append(state != "open")
            if state == "closed":
                recent = [t for t in recent if ts - t < window_ms] + ([] if ok else [ts])
                if len(recent) >= failures:
                    state, opened, recent = "open", ts, []
            elif state == "half_open":
                good = good + 1 if ok else 0
                if not ok:
                    state, opened = "open", ts
                elif good >= probes:
                    state = "closed"
            states.append(state)
        return pa.table({"log": table.column("log"), "seq": table.column("seq"), "ts": table.column("ts"), "state": pa.array(states, pa.string()), "admitted": pa.array(admitted, pa.bool_())})

    return ops.groupBy("log").applyInArrow(run, BREAKER)


def supervise(events: DataFrame, restarts: int = 5, window_ms: int = 300_000) -> DataFrame:
    """Health events (log, seq, ts, healthy): restarts back off from 1 to 16 s; too many within the window
    degrade; a healthy event brings back running."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        tries, wait, states, waits = [], 1000, [], []
        for ts, healthy in zip(table.column("ts").to_pylist(), table.column("healthy").to_pylist()):
            if healthy:
                state, wait, pause, tries = "running", 1000, 0, []
            else:
                tries = [t for t in tries if ts - t < window_ms] + [ts]
                state, pause = ("degraded", 0) if len(tries) > restarts else ("restarting", wait)
                wait = min(16_000, wait * 2)
            states.append(state)
            waits.append(pause)
        return pa.table({"log": table.column("log"), "seq": table.column("seq"), "state": pa.array(states, pa.string()), "backoff_ms": pa.array(waits, pa.int64())})

    return events.groupBy("log").applyInArrow(run, SUPERVISOR)


PRESSURE = "log string, seq bigint, pending bigint, admitted boolean, active boolean"


def backpressure(ops: DataFrame, high: int = 1000, low: int = 200) -> DataFrame:
    """Operations (log, seq, begins) as they begin and end: one that begins when ``high`` are pending is refused,
    and so are all until no more than ``low`` are. The end of a refused one should not be in the input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pending, active, begun = None, 0, False, False
        for batch in batches:
            out = []
            for log, begins in zip(batch.column("log").to_pylist(), batch.column("begins").to_pylist()):
                if not begun or log != of:
                    of, pending, active, begun = log, 0, False, True
                admitted = None
                if begins:
                    active = active and pending > low
                    active = active or pending >= high
                    admitted = not active
                    pending += admitted
                else:
                    pending = max(0, pending - 1)
                    active = active and pending > low
                out.append((pending, admitted, active))
            pending_, admitted_, active_ = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("log"), batch.column("seq"), pa.array(pending_, pa.int64()), pa.array(admitted_, pa.bool_()), pa.array(active_, pa.bool_())],
                                             ["log", "seq", "pending", "admitted", "active"])

    # Spark sorts, on disk if it must; a log's rows pass through a task batch by batch.
    return ops.select("log", F.col("seq").cast("bigint").alias("seq"), "begins").repartition("log").sortWithinPartitions("log", "seq").mapInArrow(run, PRESSURE)


def retries(attempts: DataFrame, most: int = 3, base_ms: int = 100, cap_ms: int = 5000) -> DataFrame:
    """Attempts (op, attempt from 1, error: null, ``timeout`` or another) with what follows: only a timeout is
    tried again, at most ``most`` times in all, after base * 2 ** (attempt - 1) ms up to the cap (no jitter)."""
    again = (F.col("error") == "timeout") & (F.col("attempt") < most)
    delay = F.least(F.lit(cap_ms), F.lit(base_ms) * F.pow(F.lit(2), F.col("attempt") - 1)).cast("bigint")
    return attempts.select("*", F.when(F.col("error").isNull(), "done").when(again, "retry").otherwise("failed").alias("next"), F.when(again, delay).otherwise(0).alias("delay_ms"))
