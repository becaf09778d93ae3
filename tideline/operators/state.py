"""Last-writer-wins state over an append-only mutation log.

A log row is (lsn, ts, op, key, num, str, tier). The newest ``ts`` wins and
among equal times the later arrival (higher ``lsn``) wins, so one ``max_by``
with partial aggregation gives the state: no window, no sort, one shuffle on key.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.scalars import uri_component

SYSTEM_PREFIXES = ("_sys|", "_insight|", "_insight/", "_infer|", "_infer/")
TOMBSTONE = "_sys|tombstone|"
TIERS = ("hot", "warm", "cold")


def is_system(key: F.Column) -> F.Column:
    test = F.lit(False)
    for prefix in SYSTEM_PREFIXES:
        test = test | key.startswith(prefix)
    return test


def latest(log: DataFrame) -> DataFrame:
    """One row per key, deletes included: the surviving log row."""
    row = F.struct("ts", "lsn", "op", "num", "str", "tier")
    return log.groupBy("key").agg(F.max_by(row, F.struct("ts", "lsn")).alias("r")).select("key", "r.*")


def current(log: DataFrame, include_system: bool = False) -> DataFrame:
    """The visible state: live keys, without the hidden namespaces."""
    live = latest(log).filter(F.col("op") == "PUT")
    return live if include_system else live.filter(~is_system(F.col("key")))


def get(log: DataFrame, key: str, include_system: bool = False) -> DataFrame:
    """The visible row of one key: the filter reaches the log before the aggregation."""
    return current(log.filter(F.col("key") == key), include_system)


def scan(state: DataFrame, prefix: str = "", tiers: tuple[str, ...] | None = None, cursor: str | None = None, limit: int = 0) -> DataFrame:
    """A page of keys in Unicode order strictly after the cursor. limit 0 is no limit; a
    cursor past the last key gives an empty page. The sort is a top-k if limited."""
    page = state.filter(F.col("key").startswith(prefix))
    if tiers is not None:
        page = page.filter(F.col("tier").isin(*tiers))
    order = F.collate(F.col("key"), "UNICODE")
    if cursor is not None:
        page = page.filter(order > F.collate(F.lit(cursor), "UNICODE"))
    page = page.orderBy(order)
    return page.limit(limit) if limit else page


def count_prefix(state: DataFrame, prefix: str) -> DataFrame:
    return state.filter(F.col("key").startswith(prefix)).agg(F.count("*").alias("n"))


def latest_by_prefix(state: DataFrame, prefix: str) -> DataFrame:
    """The newest row under a prefix; of equal times the larger key in Unicode order."""
    row = F.struct("key", "ts", "tier")
    order = F.struct(F.col("ts"), F.collate(F.col("key"), "UNICODE"))
    return state.filter(F.col("key").startswith(prefix)).agg(F.max_by(row, order).alias("r")).filter("r IS NOT NULL").select("r.*")


def scan_summary(state: DataFrame, *by: str | F.Column) -> DataFrame:
    """Count, oldest and newest write, newest key and tier counts (NULLs when empty)."""
    key = F.struct(F.col("ts"), F.collate(F.col("key"), "UNICODE"))
    return state.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.min("ts").alias("oldest"),
        F.max("ts").alias("newest"),
        F.max_by("key", key).alias("latest_key"),
        *[F.count_if(F.col("tier") == t).alias(t) for t in TIERS],
    )


def tombstones(log: DataFrame) -> DataFrame:
    """The hidden marker row that a delete leaves for each deleted key."""
    gone = latest(log).filter(F.col("op") == "DELETE")
    return gone.select(F.concat(F.lit(TOMBSTONE), uri_component(F.col("key"))).alias("key"), "ts", "lsn")


def batches(log: DataFrame, size: int = 10) -> DataFrame:
    """Writes gathered to batches of ``size`` log numbers, with the hash of their canonical content."""
    line = F.concat_ws("|", F.col("lsn").cast("string"), "op", "key")
    ordered = F.array_sort(F.collect_list(F.struct("lsn", line.alias("line"))))
    return (log.groupBy(F.floor(F.col("lsn") / size).cast("bigint").alias("batch")).agg(ordered.alias("rows"), F.count("*").alias("n"))
            .select("batch", "n", F.sha2(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), 256).alias("request_hash")))


def admit(requests: DataFrame) -> DataFrame:
    """Requests (idempotency_key, seq, request_hash) with what becomes of each: the first of
    a key is applied; a later one of equal hash is deduplicated, of another a conflict."""
    first = F.min_by("request_hash", "seq").over(W.partitionBy("idempotency_key"))
    at = F.min("seq").over(W.partitionBy("idempotency_key"))
    return requests.select("*", F.when(F.col("seq") == at, "applied").when(F.col("request_hash") == first, "deduplicated").otherwise("conflict").alias("outcome"))


def replay(log: DataFrame, checkpoint_lsn: int) -> DataFrame:
    """State from the checkpoint at an lsn and the tail after it; equals the state of the whole log."""
    base = latest(log.filter(F.col("lsn") <= checkpoint_lsn))
    tail = log.filter(F.col("lsn") > checkpoint_lsn)
    return current(base.unionByName(tail.select(base.columns)))


def compact(segments: DataFrame) -> DataFrame:
    """Segments (segment, log columns) merged to one: the surviving row of each key, whether it
    is live, and how many rows it replaces."""
    row = F.struct("ts", "lsn", "op", "num", "str", "tier")
    return segments.groupBy("key").agg(F.max_by(row, F.struct("ts", "lsn")).alias("r"), F.count("*").alias("versions"), F.countDistinct("segment").alias("segments")).select("key", "r.*", "versions", "segments")


def rotate(segments: DataFrame, now: int | F.Column, cold_after_ms: int, expire_after_ms: int) -> DataFrame:
    """Segments (segment, newest) with the tier that their age gives and what to do."""
    age = F.lit(now) - F.col("newest") if isinstance(now, int) else now - F.col("newest")
    action = F.when(age > expire_after_ms, "expire").when(age > cold_after_ms, "to_cold").otherwise("keep")
    return segments.withColumn("action", action)


MEMTABLE_BYTES, MEMTABLE_DIRTY = 4 << 20, 1000


def json_number(x: F.Column) -> F.Column:
    """A double as JSON writes it: whole numbers without a fraction."""
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def record_bytes(key: F.Column, fields: F.Column) -> F.Column:
    """Size of a record in a write buffer: its key, its fields' JSON (text) and 32 for the rest."""
    return (F.octet_length(key) + F.octet_length(fields) + F.lit(32)).cast("bigint")


def fields_json(num: F.Column, text: F.Column) -> F.Column:
    """Fields as one flat JSON object: numbers, then strings."""
    numbers = F.transform(F.map_entries(num), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), json_number(e["value"])))
    strings = F.transform(F.map_entries(text), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":"'), e["value"], F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(F.concat(numbers, strings), ","), F.lit("}"))


FLUSH = "log string, flush bigint, lsn bigint, reason string, bytes bigint, records bigint"


def flush_points(log: DataFrame, max_bytes: int = MEMTABLE_BYTES, max_dirty: int = MEMTABLE_DIRTY, by: str = "log") -> DataFrame:
    """Where a write buffer is flushed when replayed in log order, a row a flush. A rewritten key counts
    once, with its new size; a delete takes its record out. After each put the buffer is flushed if its
    bytes exceed max_bytes (reason size), else if its records exceed max_dirty (dirty), and is empty then.
    A fold per log (column ``by``); logs run in parallel."""
    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("lsn")
        held, total, out = {}, 0, []
        for lsn, op, key, size in zip(*(table.column(c).to_pylist() for c in ("lsn", "op", "key", "size"))):
            total -= held.pop(key, 0)
            if op != "PUT":
                continue
            held[key] = size
            total += size
            if total > max_bytes or len(held) > max_dirty:
                out.append((lsn, "size" if total > max_bytes else "dirty", total, len(held)))
                held, total = {}, 0
        columns = list(zip(*out)) or [()] * 4
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.table([table.column("log")[:1].combine_chunks().take(pa.array([0] * len(out), pa.int64())), pa.array(range(1, len(out) + 1), pa.int64()), *map(pa.array, columns, kinds)],
                        names=["log", "flush", "lsn", "reason", "bytes", "records"])

    rows = log.select(F.col(by).cast("string").alias("log"), "lsn", "op", "key", record_bytes(F.col("key"), fields_json(F.col("num"), F.col("str"))).alias("size"))
    return rows.groupBy("log").applyInArrow(fold, FLUSH)


def resolve_buffer(buffer: DataFrame, log: DataFrame) -> DataFrame:
    """Writes buffered while degraded: a key that the log has meanwhile is discarded, others apply."""
    known = log.select(F.col("key").alias("_known")).distinct()
    return (buffer.join(known, F.col("key") == F.col("_known"), "left")
            .select("key", "lsn", "ts", F.when(F.col("_known").isNull(), "applied").otherwise("discarded").alias("outcome")))


def remap(state: DataFrame, mapping: DataFrame) -> DataFrame:
    """Tiers renamed by a (tier, new_tier) table; others stay. Broadcast only if Spark finds it small."""
    return state.join(mapping, "tier", "left").withColumn("tier", F.coalesce("new_tier", "tier")).drop("new_tier")


def segment_entries(state: DataFrame, segment: str) -> DataFrame:
    """The keys whose current row is in a segment (column ``segment``)."""
    return state.filter(F.col("segment") == segment)


def without_segment(state: DataFrame, segment: str) -> DataFrame:
    """The state less the keys whose current row is in a segment."""
    return state.filter(F.coalesce(F.col("segment") != segment, F.lit(True)))


def infer_schema(state: DataFrame) -> DataFrame:
    """(field, kind, keys): numeric or categorical fields seen in live rows, as a segment's schema would list them."""
    num = state.select("key", F.explode(F.map_keys("num")).alias("field"), F.lit("numeric").alias("kind"))
    text = state.select("key", F.explode(F.map_keys("str")).alias("field"), F.lit("categorical").alias("kind"))
    return num.union(text).groupBy("field", "kind").agg(F.count("*").alias("keys"))


def checkpoint(log: DataFrame) -> DataFrame:
    """(bucket, keys, max_lsn, hash): a checkpoint's hash of the surviving rows, by the first three digits of
    their keys' MD5, so that no task holds the state; equal states have equal hashes in every order of writing."""
    row = F.concat_ws("|", "key", F.col("ts").cast("string"), "op", fields_json(F.col("num"), F.col("str")))
    rows = latest(log).select(F.substring(F.md5("key"), 1, 3).alias("bucket"), "key", "lsn", row.alias("row"))
    made = rows.groupBy("bucket").agg(F.count("*").alias("keys"), F.max("lsn").alias("max_lsn"), F.array_sort(F.collect_list(F.struct("key", "row"))).alias("rows"))
    return made.select("bucket", "keys", "max_lsn", F.sha2(F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), 256).alias("hash"))


def checkpoint_due(log: DataFrame, ops: int = 500, every_ms: int = 30_000) -> DataFrame:
    """(lsn, ts, reason): where a log checkpoints: the first entry after so many others or so long a time
    since the last checkpoint. A fold in order of lsn; column ``log`` tells logs apart."""
    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("lsn")
        count, since, out = 0, None, []
        for lsn, ts in zip(table.column("lsn").to_pylist(), table.column("ts").to_pylist()):
            since, count = ts if since is None else since, count + 1
            if count >= ops or ts - since >= every_ms:
                out.append((lsn, ts, "ops" if count >= ops else "time"))
                count, since = 0, ts
        name = table.column("log")[:1].combine_chunks().take(pa.array([0] * len(out), pa.int64()))
        return pa.table([name, *map(pa.array, list(zip(*out)) or [()] * 3, (pa.int64(), pa.int64(), pa.string()))], names=["log", "lsn", "ts", "reason"])

    return log.select(F.col("log").cast("string").alias("log"), "lsn", "ts").groupBy("log").applyInArrow(fold, "log string, lsn bigint, ts bigint, reason string")


def flushed(log: DataFrame, flushes: DataFrame) -> DataFrame:
    """The warm segments that flushes (log, flush, lsn) leave: of each flush its records, split into user and
    system ones (log, flush, system, key, ts, lsn). A record is the key's last put since the flush before,
    unless a delete came after it."""
    bounds = flushes.withColumn("after", F.coalesce(F.lag("lsn").over(W.partitionBy("log").orderBy("flush")), F.lit(-1)))
    bounds = bounds.groupBy("log").agg(F.array_sort(F.collect_list(F.struct(F.col("lsn").alias("to"), "flush"))).alias("b"))
    own = F.element_at(F.filter("b", lambda x: x["to"] >= F.col("lsn")), 1)["flush"]
    rows = log.join(bounds, "log").withColumn("flush", F.when(F.exists("b", lambda x: x["to"] >= F.col("lsn")), own)).filter("flush IS NOT NULL")
    last = rows.groupBy("log", "flush", "key").agg(F.max_by(F.struct("ts", "lsn", "op"), "lsn").alias("r"))
    return last.filter("r.op = 'PUT'").select("log", "flush", is_system(F.col("key")).alias("system"), "key", "r.ts", "r.lsn")


def service_health(log: DataFrame, checkpoint_lsn: int = 0) -> DataFrame:
    """One row of what a health check says: live keys by tier, deleted keys, entries, the newest write, and the
    entries since a checkpoint with their share of all."""
    rows = latest(log)
    live = F.col("op") == "PUT"
    state = rows.agg(F.count_if(live).alias("keys"), *[F.count_if(live & (F.col("tier") == t)).alias(t) for t in TIERS], F.count_if(~live).alias("tombstones"))
    log_ = log.agg(F.count("*").alias("entries"), F.max("lsn").alias("max_lsn"), F.max("ts").alias("last_write"), F.count_if(F.col("lsn") > checkpoint_lsn).alias("since_checkpoint"))
    return state.crossJoin(log_).withColumn("status", F.when(F.col("since_checkpoint") > 10_000, "degraded").otherwise("ok"))
