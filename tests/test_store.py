"""The store, write-ahead logs and replayable policies."""

import pytest

from tideline.operators import ledger, policy
from tideline.operators import state as st
from tideline.sources import wal
from tideline.store import Conflict, Store


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.get("a") is None and s.count_prefix("") == 0
    s.put("a", {"x": 1, "name": "n"}, 10)
    assert s.put_many([("b", {"x": 2}), ("c", {"x": 3})], 11, "k") == "applied"
    assert s.put_many([("b", {"x": 2}), ("c", {"x": 3})], 12, "k") == "deduplicated"
    with pytest.raises(Conflict):
        s.put_many([("b", {"x": 9})], 12, "k")
    s.put("a", {"x": 5}, 9)
    s.delete("b", 12)
    assert s.get("a") == {"x": 1.0, "name": "n"} and s.get("b") is None
    assert [r["key"] for r in s.scan().collect()] == ["a", "c"] and s.latest_by_prefix("").first()["key"] == "c"
    assert s.compact() == 1 and s.get("a") == {"x": 1.0, "name": "n"} and s.get("b") is None and s.scan_summary().first()["n"] == 2
    assert s.put_many([("b", {"x": 2}), ("c", {"x": 3})], 20, "k") == "deduplicated" and s.get("b") is None
    with pytest.raises(Conflict):
        s.put_many([("b", {"x": 9})], 21, "k")
    assert s.compact() == 0 and s.put_many([("b", {"x": 2}), ("c", {"x": 3})], 22, "k") == "deduplicated" and len(s.parts()) == 1
    assert s.insights("x").count() == 3 and s.anomalies("x").count() == 0
    assert ledger.verify(s.audit()).first()["valid"]
    s.put("d", {"x": 1}, 30)
    assert s.log().agg({"lsn": "max"}).first()[0] == 6 and s.get("d") == {"x": 1.0}


ENTRIES = [(1, 10, 1, "a", {"x": 1.5, "s": "ü"}), (2, 11, 2, "b", None), (3, 12, 3, "", {"entries": [{"op": 1, "key": "b", "payload": {"x": 2}}, {"op": 2, "key": "a"}]}), (4, 13, 1, "c", {"x": 3})]


@pytest.mark.parametrize("kind", ["binary", "lines"])
def test_logs_replay_and_skip_damage(spark, tmp_path, kind):
    parts = [wal.entry(*e) for e in ENTRIES] if kind == "binary" else [(wal.line(*e) + "\n").encode() for e in ENTRIES]
    head = wal.MAGIC + bytes([wal.VERSION]) if kind == "binary" else b'{"__wal":"x","version":2}\n'
    hurt = bytearray(parts[3])
    hurt[len(hurt) // 2] ^= 1
    for name, body, keys in (("whole", head + b"".join(parts), {"b", "c"}), ("hurt", head + b"".join(parts[:3]) + bytes(hurt), {"b"}), ("torn", head + b"".join(parts)[:-3], {"b"})):
        path = tmp_path / name
        path.write_bytes(body)
        rows = wal.read(spark, str(path), kind)
        assert {r["key"] for r in st.current(wal.as_log(rows)).collect()} == keys
    first = wal.read(spark, str(tmp_path / "whole"), kind).filter("lsn = 1").first()
    assert (first["num"], first["str"], first["ts"]) == ({"x": 1.5}, {"s": "ü"}, 10)


def test_policies(spark):
    flushes = spark.createDataFrame([("s", i, 10, 1, 100.0 if i < 20 else 900.0, 5.0) for i in range(30)], "log string, seq long, bytes long, snapshots long, latency_us double, ratio double")
    got = [(r["seq"], r["reason"]) for r in policy.rotations(flushes, 100, 1000).orderBy("seq").collect()]
    assert got[:2] == [(9, "bytes"), (19, "bytes")] and ("latency" in {r for _, r in got})
    ops = spark.createDataFrame([("s", i, i * 1000, i < 2 or i > 20) for i in range(60)], "log string, seq long, ts long, ok boolean")
    states = [r["state"] for r in policy.breaker(ops).orderBy("seq").collect()]
    assert states[5] == "closed" and states[6] == "open" and states[-1] == "closed" and "half_open" in states
    health = spark.createDataFrame([("s", i, i * 1000, i == 9) for i in range(12)], "log string, seq long, ts long, healthy boolean")
    got = [(r["state"], r["backoff_ms"]) for r in policy.supervise(health).orderBy("seq").collect()]
    assert got[:6] == [("restarting", 1000), ("restarting", 2000), ("restarting", 4000), ("restarting", 8000), ("restarting", 16000), ("degraded", 0)]
    assert got[9] == ("running", 0) and got[10] == ("restarting", 1000)


def test_session_limits_of_segments_and_age(spark):
    rows = [("s", i, 1, 1, 1.0, 1.0, i * 10) for i in range(12)]
    flushes = spark.createDataFrame(rows, "log string, seq long, bytes long, snapshots long, latency_us double, ratio double, ts long")
    assert [(r["seq"], r["reason"]) for r in policy.rotations(flushes, 10**9, 10**9, max_segments=5).orderBy("seq").collect()] == [(4, "segments"), (9, "segments")]
    assert [(r["seq"], r["reason"]) for r in policy.rotations(flushes, 10**9, 10**9, max_ms=40).orderBy("seq").collect()] == [(4, "duration"), (9, "duration")]


def test_backpressure_has_two_marks(spark):
    begins = [True] * 6 + [False] * 2 + [True] + [False] * 2 + [True]
    rows = spark.createDataFrame([("s", i, b) for i, b in enumerate(begins)], "log string, seq long, begins boolean")
    got = [(r["pending"], r["admitted"]) for r in policy.backpressure(rows, 4, 1).orderBy("seq").collect()]
    assert got == [(1, True), (2, True), (3, True), (4, True), (4, False), (4, False), (3, None), (2, None), (2, False), (1, None), (0, None), (1, True)]


def test_flushes_of_a_buffer_one_by_one(spark):
    """Rewrites count once with their new size, deletes take records out, a flush empties the buffer."""
    import random

    r, rows, held, want = random.Random(2), [], {}, []
    for lsn in range(1, 400):
        key, op, value = f"k{r.randrange(30)}", "DELETE" if r.random() < 0.2 else "PUT", float(r.choice([1, 2.5, 1000, 0.125]))
        rows.append(("all", lsn, lsn, op, key, {"v": value}, {"s": "ü" * r.randrange(4)}, "hot"))
        held.pop(key, None)
        if op == "PUT":
            text = '{"v":' + (str(int(value)) if value == int(value) else str(value)) + ',"s":"' + rows[-1][6]["s"] + '"}'
            held[key] = len(key) + len(text.encode()) + 32
            if sum(held.values()) > 700 or len(held) > 12:
                want.append((lsn, "size" if sum(held.values()) > 700 else "dirty", sum(held.values()), len(held)))
                held = {}
    log = spark.createDataFrame(rows, "log string, lsn long, ts long, op string, key string, num map<string,double>, str map<string,string>, tier string")
    assert [(x["lsn"], x["reason"], x["bytes"], x["records"]) for x in st.flush_points(log, 700, 12).orderBy("flush").collect()] == want and {w[1] for w in want} == {"size", "dirty"}
    assert st.flush_points(log.filter("false")).count() == 0


def test_backpressure_takes_a_log_in_batches(spark):
    """One log's rows come to Python a batch at a time, several logs apart from one another."""
    n = 300
    rows = spark.range(2 * n).selectExpr("IF(id % 2 = 0, 'a', NULL) AS log", "id DIV 2 AS seq", "(id DIV 2) % 3 <> 2 AS begins")
    plan = policy.backpressure(rows, 20, 5)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    want, pending, active = [], 0, False
    for i in range(n):
        admitted = None
        if i % 3 != 2:
            active = (active and pending > 5) or pending >= 20
            admitted = not active
            pending += admitted
        else:
            pending = max(0, pending - 1)
            active = active and pending > 5
        want.append((i, pending, admitted, active))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    got = policy.backpressure(rows, 20, 5).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for log in ("a", None):
        assert sorted((r["seq"], r["pending"], r["admitted"], r["active"]) for r in got if r["log"] == log) == want
