"""A key/value store over a folder of mutation parts: the operators behind one object.

Writes append a part, named by the log numbers that it holds, so the next number is known from
names alone; reads are last-writer-wins over the parts. ``compact`` folds them to one part and keeps
what a retried batch needs: its idempotency key and hash, as a hidden row. The folder may be on any
file system that Spark and ``tideline.sources.files`` know.
For large stores write parts by a stream (``tideline.streaming.live.upkeep``) instead.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import correlate, folds, ledger
from tideline.operators import state as st
from tideline.sources import files

LOG = "lsn bigint, ts bigint, op string, key string, num map<string,double>, str map<string,string>, tier string, idempotency_key string, request_hash string"


IDEMPOTENCY = "_sys|idempotency|"


class Conflict(ValueError):
    """An idempotency key that was used for another request."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._empty = spark.createDataFrame([], LOG)

    def parts(self) -> list[str]:
        return [n for n in files.names(self.path) if n.startswith("part-")]

    def log(self) -> DataFrame:
        parts = [f"{self.path}/{p}" for p in self.parts()]
        return self.spark.read.schema(LOG).parquet(*parts) if parts else self._empty

    def _append(self, rows: list[tuple], key: str | None = None, digest: str | None = None) -> None:
        base = max((int(p.split("-")[2]) for p in self.parts()), default=0)
        made = [(base + i + 1, ts, op, k, {f: float(v) for f, v in fields.items() if not isinstance(v, str)}, {f: v for f, v in fields.items() if isinstance(v, str)}, "hot", key, digest)
                for i, (ts, op, k, fields) in enumerate(rows)]
        self.spark.createDataFrame(made, LOG).coalesce(1).write.parquet(f"{self.path}/part-{base + 1:020d}-{base + len(made):020d}-{uuid.uuid4()}")

    def put(self, key: str, fields: dict, ts: int) -> None:
        self._append([(ts, "PUT", key, fields)])

    def put_many(self, records: list[tuple[str, dict]], ts: int, idempotency_key: str | None = None) -> str:
        """applied, or deduplicated if the key's request was the same; Conflict if it was another."""
        digest = hashlib.sha256(json.dumps(records, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        if idempotency_key is not None:
            seen = self.log().filter(F.col("idempotency_key") == idempotency_key).select("request_hash").first()
            if seen:
                if seen["request_hash"] != digest:
                    raise Conflict(idempotency_key)
                return "deduplicated"
        self._append([(ts, "PUT", k, f) for k, f in records], idempotency_key, digest)
        return "applied"

    def delete(self, key: str, ts: int) -> None:
        self._append([(ts, "DELETE", key, {})])

    def state(self, include_system: bool = False) -> DataFrame:
        return st.current(self.log(), include_system)

    def get(self, key: str) -> dict | None:
        row = st.get(self.log(), key).first()
        return {**row["num"], **row["str"]} if row else None

    def scan(self, prefix: str = "", cursor: str | None = None, limit: int = 0) -> DataFrame:
        return st.scan(self.state(), prefix, cursor=cursor, limit=limit)

    def count_prefix(self, prefix: str) -> int:
        return st.count_prefix(self.state(), prefix).first()["n"]

    def latest_by_prefix(self, prefix: str) -> DataFrame:
        return st.latest_by_prefix(self.state(), prefix)

    def scan_summary(self, prefix: str = "") -> DataFrame:
        return st.scan_summary(self.state().filter(F.col("key").startswith(prefix)))

    def compact(self) -> int:
        """Rewrites the log as one part of the surviving rows, deletes included, and a hidden row for each
        idempotency key; how many rows went. Readers see the old parts or the new one: it is written under
        a hidden name, moved into place, and then the old parts go (till then both say the same)."""
        log, names = self.log(), [f.split()[0] for f in LOG.split(", ")]
        before, old = log.count(), self.parts()
        if not old:
            return 0
        once = (log.filter("idempotency_key IS NOT NULL").groupBy("idempotency_key")
                .agg(F.min_by("request_hash", "lsn").alias("request_hash"), F.max("lsn").alias("lsn"), F.max("ts").alias("ts"))
                .select("lsn", "ts", F.lit("PUT").alias("op"), F.concat(F.lit(IDEMPOTENCY), "idempotency_key").alias("key"), F.expr("CAST(map() AS map<string,double>)").alias("num"),
                        F.create_map(F.lit("request_hash"), F.col("request_hash")).alias("str"), F.lit("hot").alias("tier"), "idempotency_key", "request_hash"))
        none = F.lit(None).cast("string")
        kept = st.latest(log.filter(~F.col("key").startswith(IDEMPOTENCY))).withColumns({"idempotency_key": none, "request_hash": none}).select(*names)
        last = max(int(p.split("-")[2]) for p in old)
        hidden = f"{self.path}/.new-{uuid.uuid4()}"
        kept.union(once.select(*names)).write.parquet(hidden)
        after = self.spark.read.schema(LOG).parquet(hidden).count()
        files.move(hidden, f"{self.path}/part-{1:020d}-{last:020d}-{uuid.uuid4()}")
        for p in old:
            files.remove(f"{self.path}/{p}")
        return before - after

    def observations(self, field: str) -> DataFrame:
        """The log's values of a field as observations; a delete counts as a write of 1."""
        value = F.when(F.col("op") == "DELETE", F.lit(1.0)).otherwise(F.col("num")[field])
        return self.log().select("key", "ts", F.col("lsn").alias("seq"), value.alias("value"), F.lit(0).cast("bigint").alias("k")).filter("value IS NOT NULL")

    def insights(self, field: str, now: int | None = None) -> DataFrame:
        return folds.labelled(folds.behavior(self.observations(field)), now)

    def anomalies(self, field: str) -> DataFrame:
        return folds.anomalies(folds.trace(self.observations(field)))

    def correlations(self, field: str, threshold: float = correlate.THRESHOLD) -> DataFrame:
        return correlate.correlations(self.observations(field).select("key", "ts", "seq", F.col("value").alias("signal")), threshold)

    def audit(self) -> DataFrame:
        """The log as a verified hash chain."""
        entries = self.log().select(F.lit("store").alias("log"), F.col("lsn").alias("seq"), "ts", F.lit("store").alias("actor"), F.col("op").alias("action"), F.col("key").alias("target"), F.to_json("num").alias("payload"))
        return ledger.chain(entries)
