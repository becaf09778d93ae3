"""Hash-chained audit logs, Merkle checkpoints, tiered retention, telemetry and sessions."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.scalars import sha256

DAY_MS = 86_400_000
ZERO_HASH = "0" * 64
PAYLOAD_CHARS = 1024


def entry_text(payload: F.Column) -> F.Column:
    """A long payload is replaced by its hash."""
    return F.when(F.length(payload) > PAYLOAD_CHARS, F.concat(F.lit("sha256:"), F.sha2(payload, 256))).otherwise(payload)


CHAIN = "seq bigint, ts bigint, actor string, action string, target string, payload string, prev_hash string, hash string"


def chain(entries: DataFrame, by: str = "log") -> DataFrame:
    """Entries (log, seq, ts, actor, action, target, payload) with the hash of each and of the
    one before. A chain is serial: a log is sorted into one task and hashed as it streams by, a batch in
    memory at a time; logs run in parallel. Nulls are left out of the hashed line."""
    rows = entries.select(F.col(by).cast("string").alias("log"), F.col("seq").cast("bigint").alias("seq"), F.col("ts").cast("bigint").alias("ts"), "actor", "action", "target",
                          entry_text(F.col("payload")).alias("payload"))
    line = F.concat_ws("|", F.col("seq").cast("string"), F.col("ts").cast("string"), "actor", "action", "target", "payload")
    rows = rows.withColumn("line", line).repartition("log").sortWithinPartitions("log", "seq")

    def run(batches):
        log, before = object(), ZERO_HASH
        for batch in batches:
            prev, hashes = [], []
            for own, text in zip(batch.column("log").to_pylist(), batch.column("line").to_pylist()):
                if own != log:
                    log, before = own, ZERO_HASH
                prev.append(before)
                before = hashlib.sha256(f"{text}|{before}".encode()).hexdigest()
                hashes.append(before)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(7)), pa.array(prev, pa.string()), pa.array(hashes, pa.string())],
                                             [by, *(c.split()[0] for c in CHAIN.split(", "))])

    return rows.mapInArrow(run, f"{by} string, {CHAIN}")


def verify(entries: DataFrame, by: str = "log") -> DataFrame:
    """Per log: entries, corrupted sequences (whose hash isn't that of their content) and whether
    the links are whole. Content hashes are recomputed in parallel; links are one lag."""
    line = F.concat_ws("|", F.col("seq").cast("string"), F.col("ts").cast("string"), "actor", "action", "target", "payload", "prev_hash")
    w = W.partitionBy(by).orderBy("seq")
    checked = entries.select(by, "seq", (F.sha2(line, 256) != F.col("hash")).alias("bad"), (F.col("prev_hash") != F.lag("hash", 1, ZERO_HASH).over(w)).alias("broken"))
    return checked.groupBy(by).agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(F.col("bad"), F.col("seq")))).alias("corrupted"),
                                   F.bool_or("broken").alias("chain_broken")).withColumn("valid", (F.size("corrupted") == 0) & ~F.col("chain_broken"))


def merkle(hashes: DataFrame, size: int = 1000, by: str = "log") -> DataFrame:
    """Roots over each full run of ``size`` hashes (log, i, hash), i from 0; an odd node is paired
    with itself. Every level is one aggregation by half the place, so a run is never one row."""
    level = hashes.withColumn("run", F.floor(F.col("i") / size).cast("bigint"))
    full = level.groupBy(by, "run").agg(F.count("*").alias("c")).filter(F.col("c") == size).select(by, "run")
    level = level.join(full, [by, "run"]).select(by, "run", (F.col("i") % size).cast("bigint").alias("i"), "hash")
    n = size
    while n > 1:
        w = F.array_sort(F.collect_list(F.struct("i", "hash")))
        level = level.groupBy(by, "run", F.floor(F.col("i") / 2).cast("bigint").alias("i2")).agg(w.alias("p")).select(
            by, "run", F.col("i2").alias("i"), F.sha2(F.concat(F.element_at("p", 1)["hash"], F.element_at("p", -1)["hash"]), 256).alias("hash"))
        n = (n + 1) // 2
    return level.select(by, "run", F.col("hash").alias("root"))


def tier(age_ms: F.Column, compress_ms: int = 7 * DAY_MS, distil_ms: int = 30 * DAY_MS) -> F.Column:
    return F.when(age_ms >= distil_ms, "distilled").when(age_ms >= compress_ms, "compressed").otherwise("raw")


def retain(records: DataFrame, now: int | F.Column) -> DataFrame:
    """Records (key, ts, content, ...) with their tier at ``now``; a distilled one keeps the hash
    of its content, not the content."""
    now = F.lit(now) if isinstance(now, int) else now
    made = records.withColumn("tier", tier(now - F.col("ts"))).withColumn("content_hash", F.sha2("content", 256))
    return made.withColumn("content", F.when(F.col("tier") != "distilled", F.col("content")))


def tier_stats(retained: DataFrame) -> DataFrame:
    return retained.groupBy("tier").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("content"), F.lit(64))).cast("bigint").alias("bytes"),
                                        F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def weekly(distilled: DataFrame) -> DataFrame:
    """Weeks with more than one distilled record, as one collapsed row each."""
    return (distilled.groupBy(F.floor(F.col("ts") / (7 * DAY_MS)).cast("bigint").alias("week"), "task")
            .agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"), F.min("ts").alias("first"), F.max("ts").alias("last")).filter("n > 1"))


def purge(records: DataFrame, now: F.Column, budget: int) -> DataFrame:
    """What an emergency purge drops: raw records over 3 days old, then compressed ones over 15,
    oldest first within a step, until what is left is below 90 % of the budget. Sums by step and day come
    first (a row a day); only days are ordered by themselves, and a day's records among each other."""
    size = F.octet_length("content").cast("bigint")
    age = now - F.col("ts")
    rows = records.withColumn("tier", tier(age)).withColumn("bytes", size)
    step = F.when((F.col("tier") == "raw") & (age > 3 * DAY_MS), 1).when((F.col("tier") == "compressed") & (age > 15 * DAY_MS), 2)
    rows = rows.withColumn("_step", step).withColumn("_day", F.floor(F.col("ts") / DAY_MS).cast("bigint"))
    days = rows.groupBy("_step", "_day").agg(F.sum("bytes").alias("b"))
    total = days.agg(F.sum("b").alias("_total"))
    earlier = F.coalesce(F.sum("b").over(W.orderBy("_step", "_day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    days = days.filter("_step IS NOT NULL").withColumn("_earlier", earlier).crossJoin(F.broadcast(total))
    days = days.filter(F.col("_total") - F.col("_earlier") >= 0.9 * budget).drop("b")  # what days before leave in place
    order = W.partitionBy("_step", "_day").orderBy("ts", "key").rowsBetween(W.unboundedPreceding, -1)
    picked = rows.join(days, ["_step", "_day"])
    freed = F.col("_earlier") + F.coalesce(F.sum("bytes").over(order), F.lit(0))
    return picked.withColumn("_left", F.col("_total") - freed).filter(F.col("_left") >= 0.9 * budget).select("key", "ts", "tier", "bytes", F.col("_step").cast("bigint").alias("step"))


def retrieve(retained: DataFrame, key: str) -> DataFrame:
    """The record of exactly this key from its freshest tier."""
    order = F.when(F.col("tier") == "raw", 0).when(F.col("tier") == "compressed", 1).otherwise(2)
    return retained.filter(F.col("key") == key).groupBy("key").agg(F.min_by(F.struct("ts", "tier", "content_hash"), F.struct(order, -F.col("ts"))).alias("r")).select("key", "r.*")


def counters(points: DataFrame) -> DataFrame:
    return points.groupBy("name", "label").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def gauges(points: DataFrame) -> DataFrame:
    return points.groupBy("name", "label").agg(F.max_by("value", F.struct("ts", "seq")).alias("last"))


def histograms(points: DataFrame, bounds: tuple[float, ...]) -> DataFrame:
    """count, sum, min, max and cumulative buckets (value <= le), one conditional count each."""
    made = points.groupBy("name", "label").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"),
                                               *[F.count_if(F.col("value") <= b).alias(f"_{i}") for i, b in enumerate(bounds)])
    buckets = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)])
    return made.select("name", "label", "n", "total", "low", "high", buckets.alias("buckets"))


def ring(events: DataFrame, size: int, kind: str | None = None, most: int | None = None) -> DataFrame:
    """The last events of a ring of ``size``; the filter is on what the ring holds."""
    held = events.orderBy(F.desc("seq")).limit(size)
    held = held.filter(F.col("kind") == kind) if kind else held
    return held.orderBy(F.desc("seq")).limit(most) if most else held


def slug(text: F.Column) -> F.Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def session_check(parts: DataFrame) -> DataFrame:
    """Manifest rows (session, seq, start_hash, end_hash): whether each continues the one before,
    and orphaned for all from the first that doesn't."""
    w = W.partitionBy("session").orderBy("seq")
    linked = F.col("start_hash") == F.lag("end_hash", 1, ZERO_HASH).over(w)
    return parts.withColumn("linked", linked).withColumn("orphaned", ~F.bool_and("linked").over(w.rowsBetween(W.unboundedPreceding, 0)))


def part_hash(*parts: F.Column) -> F.Column:
    return sha256(*parts)
