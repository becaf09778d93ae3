"""Readers and a writer of write-ahead logs, binary and JSON lines.

Binary: a 5-byte head, then entries of lsn, time, op, key and JSON payload with a CRC-32 each.
JSON lines: a head line, then an object a line whose crc32 covers the object's other fields.
Entries whose checksum is wrong are skipped, a torn last one too. Batches are expanded.
A file is a task: logs are written by one process each and read in parallel.
"""

from __future__ import annotations

import json
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, VERSION = bytes((0x47, 0x57, 0x56, 0x32)), 2
OPS = {1: "PUT", 2: "DELETE", 3: "BATCH"}
SCHEMA = "file string, lsn bigint, ts bigint, op string, key string, num map<string,double>, str map<string,string>, position int"


def entry(lsn: int, ts: int, op: int, key: str, payload) -> bytes:
    """A binary entry."""
    name, value = key.encode(), json.dumps(payload, separators=(",", ":"), ensure_ascii=False).encode()
    body = struct.pack("<QQBH", lsn, ts, op, len(name)) + name + struct.pack("<I", len(value)) + value
    return body + struct.pack("<I", zlib.crc32(body))


def binary(data: bytes) -> list[tuple[int, int, int, str, object]]:
    """(lsn, ts, op, key, payload) of the whole, undamaged entries."""
    if data[:5] != MAGIC + bytes([VERSION]):
        raise ValueError("not a binary log")
    found, at = [], 5
    while at + 23 <= len(data):
        lsn, ts, op, name = struct.unpack("<QQBH", data[at:at + 19])
        if at + 23 + name > len(data):
            break
        size = struct.unpack("<I", data[at + 19 + name:at + 23 + name])[0]
        stop = at + 23 + name + size
        if stop + 4 > len(data):
            break
        if zlib.crc32(data[at:stop]) == struct.unpack("<I", data[stop:stop + 4])[0] and op in OPS:
            try:
                found.append((lsn, ts, op, data[at + 19:at + 19 + name].decode(), json.loads(data[at + 23 + name:stop])))
            except ValueError:
                pass
        at = stop + 4
    return found


def _dumps(x) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def lines(data: bytes) -> list[tuple[int, int, int, str, object]]:
    """The same of JSON lines; version 1, without a head, is numbered by its good lines."""
    found, first = [], True
    for raw in data.decode(errors="replace").split("\n"):
        try:
            e = json.loads(raw)
        except ValueError:
            continue
        if first and "__wal" in e:
            first = False
            continue
        first = False
        body = {k: v for k, v in e.items() if k != "crc32"}
        if zlib.crc32(_dumps(body).encode()) != e.get("crc32"):
            continue
        lsn = int(e["lsn"]) if "lsn" in e else len(found) + 1
        found.append((lsn, int(e.get("timestamp", 0)), int(e["op"]), e["key"], e["payload"]))
    return found


def line(lsn: int, ts: int, op: int, key: str, payload) -> str:
    body = {"version": 2, "lsn": str(lsn), "timestamp": ts, "op": op, "key": key, "payload": payload}
    return _dumps({**body, "crc32": zlib.crc32(_dumps(body).encode())})


def expanded(entries):
    """Single puts and deletes with their place in a batch."""
    for lsn, ts, op, key, payload in entries:
        if OPS[op] != "BATCH":
            yield lsn, ts, OPS[op], key, payload or {}, 0
            continue
        parts = payload.get("entries", []) if isinstance(payload, dict) else payload
        for i, p in enumerate(parts):
            yield lsn, ts, OPS[int(p["op"])], p["key"], p.get("payload") or {}, i


def read(spark: SparkSession, path: str, kind: str = "binary") -> DataFrame:
    """The log's rows, with numbers and strings in a map each."""
    parse = binary if kind == "binary" else lines

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = [(name, lsn, ts, op, key, {k: float(v) for k, v in p.items() if isinstance(v, (int, float)) and not isinstance(v, bool)},
                         {k: v for k, v in p.items() if isinstance(v, str)}, i) for lsn, ts, op, key, p, i in expanded(parse(content.as_py()))]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.float64()), pa.map_(pa.string(), pa.string()), pa.int32())
                columns = [pa.array([list(r[i].items()) if i in (5, 6) else r[i] for r in rows], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def as_log(rows: DataFrame) -> DataFrame:
    """rows in the shape of the state operators; within a batch the later entry is the later arrival."""
    return rows.select((F.col("lsn") * 1_000_000 + F.col("position")).alias("lsn"), "ts", "op", "key", "num", "str", F.lit("hot").alias("tier"))
