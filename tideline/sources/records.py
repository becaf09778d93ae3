"""Record archives: snapshots of keyed records of any schema, as a table of encoded segments.

A record is (ts, key, fields); a field is numeric or categorical, keys are strings or whole
numbers. ``write`` ranges the rows by ts into parts; a task encodes its part into segments, each a
row of a Parquet table: its times, a Bloom filter of its keys as 64-bit words, and a payload of
columns by their own codecs, with sorted string dictionaries. A snapshot (the rows of one ts) is in
one segment. So reading is a scan of binary cells, a query by key tests the filter in the JVM and
decodes what is left, and the driver sees a line a part.

Hashes chain a part's segments; the manifest has each part's segments and last hash, so a segment
that is changed, cut out or moved is noticed. With a password payloads are sealed by AES-256-GCM
(the key by PBKDF2-SHA-256, the nonce by a keyed hash of the segment's place, the place as
additional data) and a keyed hash in the manifest tells a wrong password before anything is read.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.sources import archive as ar
from tideline.sources import files
from tideline.sources.codecs import ArchiveError

MANIFEST, WORDS, SEGMENT_ROWS, PART_ROWS, ITERATIONS = "records.json", 64, 65_536, 2_000_000, 100_000
KINDS = {"numeric": "double", "categorical": "string"}
SEGMENT = ("part int, ordinal int, first_ts bigint, last_ts bigint, snapshots bigint, records bigint, bloom array<bigint>, "
           "payload binary, prev_hash string, hash string")


def places(key) -> list[int]:
    """Three bit places of a key in the filter."""
    digest = hashlib.sha256(str(key).encode()).digest()
    return [x % (64 * WORDS) for x in struct.unpack("<3Q", digest[:24])]


def bloom(keys: list) -> list[int]:
    words = np.zeros(WORDS, np.uint64)
    for key in keys:
        for p in places(key):
            words[p >> 6] |= np.uint64(1) << np.uint64(p & 63)
    return words.view(np.int64).tolist()


def may_have(key) -> F.Column:
    """The same test as a JVM expression on the column ``bloom``."""
    test = F.lit(True)
    for p in places(key):
        test = test & (F.shiftrightunsigned(F.get("bloom", F.lit(p >> 6)), p & 63).bitwiseAND(1) == 1)
    return test


def _codes(values: list) -> tuple[list, np.ndarray]:
    """The sorted distinct values (null last) and each one's place."""
    known = sorted({v for v in values if v is not None}) + ([None] if None in values else [])
    at = {v: i for i, v in enumerate(known)}
    return known, np.array([at[v] for v in values], np.int64)


def encode(table: pa.Table, fields: dict[str, str], preset: str) -> tuple[bytes, list]:
    """(payload, keys) of a segment's rows (ts, key, fields), sorted by (ts, key)."""
    level, size = ar.PRESETS[preset]
    ts = np.asarray(table.column("ts"))
    lead = np.flatnonzero(np.append(True, ts[1:] != ts[:-1]))
    keys, key = _codes(table.column("key").to_pylist())
    streams, dictionaries = [(ar.TIME, ts[lead]), (ar.LENGTH, np.diff(np.append(lead, len(ts)))), (ar.ITEM, key)], [keys]
    for name, kind in fields.items():
        column = table.column(name)
        if kind == "categorical":
            known, codes = _codes(column.to_pylist())
            dictionaries.append(known)
            streams.append((ar.ITEM, codes))
        else:
            there = np.asarray(column.is_valid()).astype(np.int64)
            streams += [(ar.ITEM, there), (ar.VALUE, np.asarray(column.fill_null(0.0).cast(pa.float64())))]
    head, body, pack = [], [], zstandard.ZstdCompressor(level=level)
    for stream, values in streams:
        blocks = ar._blocks(stream, values, size)
        raw = b"".join(b[3] for b in blocks)
        body.append(pack.compress(raw))
        head.append([stream, len(raw), len(body[-1]), [(c, n, len(d), f) for c, n, f, d in blocks]])
    front = pack.compress(json.dumps([head, dictionaries], separators=(",", ":")).encode())
    front = struct.pack("<I", len(front)) + front + b"".join(body)
    return front + struct.pack("<I", zlib.crc32(front)), keys


def decode(payload: bytes, fields: dict[str, str], keyed: str) -> pa.Table:
    """The rows again; any flaw raises ``ArchiveError``."""
    if len(payload) < 8 or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ArchiveError("a segment's checksum is wrong")
    n = struct.unpack("<I", payload[:4])[0]
    head, dictionaries = json.loads(zstandard.ZstdDecompressor().decompress(payload[4:4 + n]))
    at, columns = 4 + n, []
    for stream, raw, size, manifest in head:
        columns.append(ar._column(ar.Section(stream, 1, raw, b"", [tuple(m) for m in manifest], payload[at:at + size])))
        at += size
    if at + 4 != len(payload) or len(columns) != 3 + sum(2 if k == "numeric" else 1 for k in fields.values()) or len(columns[0]) != len(columns[1]):
        raise ArchiveError("a segment's sections aren't those of its schema")
    rows = int(columns[1].sum())
    if any(len(c) != rows for c in columns[2:]):
        raise ArchiveError("a segment's columns don't fit together")

    def looked_up(known, codes, kind):
        return pa.array(known, kind).take(pa.array(codes.astype(np.int64)))

    made = {"ts": pa.array(np.repeat(columns[0].astype(np.int64), columns[1].astype(np.int64))),
            "key": looked_up(dictionaries[0], columns[2], pa.int64() if keyed == "bigint" else pa.string())}
    rest, words = iter(columns[3:]), iter(dictionaries[1:])
    for name, kind in fields.items():
        if kind == "categorical":
            made[name] = looked_up(next(words), next(rest), pa.string())
        else:
            there = next(rest).astype(bool)
            made[name] = pa.array(next(rest).astype(np.float64), mask=~there)
    return pa.table(made)


def _key(password: str, salt: bytes) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, ITERATIONS)


def _sealed(key: bytes, nonce: str) -> tuple[F.Column, F.Column, F.Column]:
    """(key, nonce, additional data) of a segment's cipher."""
    place = F.concat_ws("|", F.col("part").cast("string"), F.col("ordinal").cast("string"))
    inner = F.unhex(F.sha2(F.concat(F.lit(key), F.concat_ws("|", F.lit(nonce), place).cast("binary")), 256))
    return F.lit(key), F.substring(F.unhex(F.sha2(F.concat(F.lit(key), inner), 256)), 1, 12), place


def write(rows: DataFrame, path: str, fields: dict[str, str], key: str = "item_key", preset: str = "balanced", segment_rows: int = SEGMENT_ROWS,
          parts: int | None = None, password: str | None = None) -> None:
    """Writes rows (ts bigint, key, fields) as an archive of their own. Rows of one (ts, key) are kept all;
    rows without ts are refused by the cast; null keys and fields are kept; an empty table has no segment."""
    if not all(k in KINDS for k in fields.values()):
        raise ValueError("fields are numeric or categorical")
    keyed = "bigint" if rows.schema[key].dataType.simpleString() in ("bigint", "int", "smallint") else "string"
    made = rows.select(F.col("ts").cast("bigint").alias("ts"), F.col(key).cast(keyed).alias("key"), *[F.col(n).cast(KINDS[k]).alias(n) for n, k in fields.items()])
    parts = parts or -(-made.count() // PART_ROWS) or 1
    ranged = made.repartitionByRange(parts, "ts").sortWithinPartitions("ts", "key")

    def run(batches):
        from pyspark import TaskContext

        part, ordinal, before, held = TaskContext.get().partitionId(), 0, "0" * 64, None

        def out(table):
            nonlocal ordinal, before
            payload, keys = encode(table, fields, preset)
            own = hashlib.sha256(before.encode() + payload).hexdigest()
            ts = np.asarray(table.column("ts"))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([ordinal], pa.int32()), pa.array([ts[0]]), pa.array([ts[-1]]), pa.array([len(np.unique(ts))], pa.int64()), pa.array([len(ts)], pa.int64()),
                 pa.array([bloom(keys)], pa.list_(pa.int64())), pa.array([payload], pa.binary()), pa.array([before]), pa.array([own])], [c.split()[0] for c in SEGMENT.split(", ")])
            ordinal, before = ordinal + 1, own
            return row

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows > segment_rows:
                ts = np.asarray(held.column("ts"))
                stop = int(np.searchsorted(ts, ts[segment_rows], side="left")) or int(np.searchsorted(ts, ts[0], side="right"))
                if stop == held.num_rows:
                    break  # the snapshot may go on
                yield out(held.slice(0, stop).combine_chunks())
                held = held.slice(stop)
        if held is not None and held.num_rows:
            yield out(held.combine_chunks())

    segments = ranged.mapInArrow(run, SEGMENT)
    about = {"version": 1, "fields": fields, "key": key, "keyed": keyed, "preset": preset}
    if password is not None:
        salt, nonce = os.urandom(16), os.urandom(12).hex()
        secret = _key(password, salt)
        k, iv, place = _sealed(secret, nonce)
        segments = segments.withColumn("payload", F.aes_encrypt("payload", k, F.lit("GCM"), F.lit("DEFAULT"), iv, place))
        about |= {"salt": salt.hex(), "nonce": nonce, "check": hmac.new(secret, b"password", "sha256").hexdigest()}
    segments.write.mode("overwrite").parquet(f"{path}/segments")
    ends = rows.sparkSession.read.schema(SEGMENT).parquet(f"{path}/segments").groupBy("part").agg(F.count("*").alias("n"), F.max_by("hash", "ordinal").alias("hash"), F.sum("records").alias("records"))
    about["parts"] = [[r["part"], r["n"], r["records"], r["hash"]] for r in ends.orderBy("part").collect()]  # a line a part
    files.replace(f"{path}/{MANIFEST}", json.dumps(about).encode())


def schema(path: str) -> dict:
    """The manifest: fields, key and its kind, preset, parts."""
    return json.loads(files.read(f"{path}/{MANIFEST}"))


def _segments(spark: SparkSession, path: str, password: str | None) -> tuple[DataFrame, dict]:
    about = schema(path)
    rows = spark.read.schema(SEGMENT).parquet(f"{path}/segments")
    if "check" in about:
        if password is None:
            raise ArchiveError("the archive needs a password")
        secret = _key(password, bytes.fromhex(about["salt"]))
        if not hmac.compare_digest(hmac.new(secret, b"password", "sha256").hexdigest(), about["check"]):
            raise ArchiveError("the password is wrong")
        k, _, place = _sealed(secret, about["nonce"])
        rows = rows.withColumn("payload", F.aes_decrypt("payload", k, F.lit("GCM"), F.lit("DEFAULT"), place))
    return rows, about


def _rows(segments: DataFrame, about: dict, key=None) -> DataFrame:
    fields, keyed, name = about["fields"], about["keyed"], about["key"]

    def run(batches):
        for batch in batches:
            for payload in batch.column("payload"):
                table = decode(payload.as_py(), fields, keyed)
                if key is not None:  # the snapshots that hold the key
                    ts = np.asarray(table.column("ts"))
                    table = table.filter(pa.array(np.isin(ts, ts[np.array(table.column("key").to_pylist(), object) == key])))
                yield from table.rename_columns(["ts", name, *fields]).to_batches()

    return segments.select("payload").mapInArrow(run, f"ts bigint, {name} {keyed}, " + ", ".join(f"{n} {KINDS[k]}" for n, k in fields.items()))


def read(spark: SparkSession, path: str, password: str | None = None) -> DataFrame:
    return _rows(*_segments(spark, path, password))


def query(spark: SparkSession, path: str, key, password: str | None = None) -> DataFrame:
    """All records of the snapshots that hold a key; segments whose filter lacks it aren't decoded."""
    segments, about = _segments(spark, path, password)
    return _rows(segments.filter(may_have(key)), about, key)


def verify(spark: SparkSession, path: str, password: str | None = None) -> DataFrame:
    """(part, segments, valid): payloads decode, hashes are theirs and link up, and the manifest has the same
    segments. A part that is missing is invalid."""
    segments, about = _segments(spark, path, password)
    fields, keyed = about["fields"], about["keyed"]

    def run(batches):
        for batch in batches:
            good = []
            for payload, before, own, records in zip(*(batch.column(c).to_pylist() for c in ("payload", "prev_hash", "hash", "records"))):
                try:
                    good.append(payload is not None and hashlib.sha256(before.encode() + payload).hexdigest() == own and decode(payload, fields, keyed).num_rows == records)
                except (ArchiveError, ValueError, KeyError, IndexError, zstandard.ZstdError):
                    good.append(False)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "ordinal", "prev_hash", "hash")), pa.array(good, pa.bool_())], ["part", "ordinal", "prev_hash", "hash", "good"])

    if "check" in about:  # a payload that can't be opened is a flaw, not a failure of the job
        raw, k = spark.read.schema(SEGMENT).parquet(f"{path}/segments"), _sealed(_key(password, bytes.fromhex(about["salt"])), about["nonce"])
        segments = raw.withColumn("payload", F.try_aes_decrypt("payload", k[0], F.lit("GCM"), F.lit("DEFAULT"), k[2]))
    checked = segments.select("part", "ordinal", "prev_hash", "hash", "payload", "records").mapInArrow(run, "part int, ordinal int, prev_hash string, hash string, good boolean")
    over = W.partitionBy("part").orderBy("ordinal")
    checked = checked.withColumn("linked", (F.col("prev_hash") == F.lag("hash", 1, "0" * 64).over(over)) & (F.row_number().over(over) - 1 == F.col("ordinal")))
    found = checked.groupBy("part").agg(F.count("*").alias("n"), F.max_by("hash", "ordinal").alias("last"), F.bool_and(F.col("good") & F.col("linked")).alias("ok"))
    want = spark.createDataFrame([(p, n, h) for p, n, _, h in about["parts"]], "part int, segments bigint, end string")
    return want.join(found, "part", "full").select("part", F.coalesce("segments", F.lit(0)).alias("segments"),
                                                   F.coalesce(F.col("ok") & (F.col("n") == F.col("segments")) & (F.col("last") == F.col("end")), F.lit(False)).alias("valid"))


def dictionary(rows: DataFrame, column: str) -> DataFrame:
    """(id, value): the distinct values numbered from 0 in order of their MD5, counted by its first two digits,
    so that no task numbers them all."""
    values = rows.select(F.col(column).cast("string").alias("value")).filter("value IS NOT NULL").distinct()
    values = values.withColumn("_m", F.md5("value")).withColumn("_b", F.substring("_m", 1, 2))
    before = F.coalesce(F.sum("n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = values.groupBy("_b").agg(F.count("*").alias("n")).select("_b", before.alias("before"))
    place = F.row_number().over(W.partitionBy("_b").orderBy("_m")) - 1
    return values.join(base, "_b").select((F.col("before") + place).cast("bigint").alias("id"), "value")


def coded(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """rows with the id of the column's value in place of it (null stays null)."""
    table = known.select(F.col("id").alias("_id"), F.col("value").alias("_value"))
    return rows.join(table, F.col(column) == F.col("_value"), "left").withColumn(column, F.col("_id")).drop("_id", "_value")


def decoded(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """The values of ids again; an id that isn't known is null."""
    table = known.select(F.col("id").alias("_id"), F.col("value").alias("_value"))
    return rows.join(table, F.col(column) == F.col("_id"), "left").withColumn(column, F.col("_value")).drop("_id", "_value")
