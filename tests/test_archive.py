"""The archive: codecs round trip, files verify, and damage fails closed."""

import json
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.sources import archive, codecs, records
from tideline.sources.views import snapshots

INTS = st.lists(st.integers(-(1 << 50), 1 << 50), max_size=60)
FLOATS = st.lists(st.floats(allow_nan=True, allow_infinity=True), max_size=40)


@given(INTS)
@settings(max_examples=150, deadline=None)
def test_integer_codecs_round_trip(values):
    v = np.array(values, np.int64)
    for codec, make in ((codecs.VARINT, codecs.varint), (codecs.BITPACK, codecs.bitpack), (codecs.RLE, codecs.rle), (codecs.FRAME, codecs.frame)):
        assert codecs.decode(codec, make(v), len(v)).tolist() == values


@given(FLOATS)
@settings(max_examples=150, deadline=None)
def test_float_codecs_keep_bits(values):
    x = np.array(values, np.float64)
    for codec, make in ((codecs.FIXED64, codecs.fixed), (codecs.XOR, codecs.xor)):
        assert codecs.decode(codec, make(x), len(x)).view(np.uint64).tolist() == x.view(np.uint64).tolist()


def _table(prices, items=3, quantities=None):
    n = len(prices)
    seq = np.arange(n) // items
    return pa.table({"snapshot_seq": seq, "ts": 1000 + seq * 60, "item_id": np.arange(n) % items, "price": np.array(prices, float), "quantity": np.array(quantities or [1.0] * n, float)})


def _rows(data, seed=bytes(32)):
    assert archive.verify(data, seed)
    out = [archive.segment(data, at).rows() for at, _ in archive.offsets(data)]
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 5


SPECIAL = [0.0, -0.0, float("nan"), float("inf"), -float("inf"), 5e-324, 1.7976931348623157e308, 1.5, 3.0]


@pytest.mark.parametrize("prices", [[10000 + 3 * i for i in range(90)], SPECIAL * 4, [1.0, 2.0, 2.5] * 20, [-0.0] * 9, [float(1 << 60)] * 6, []])
@pytest.mark.parametrize("preset", sorted(archive.PRESETS))
def test_files_round_trip(prices, preset):
    table = _table(prices, quantities=list(reversed(prices)))
    data, facts = archive.encode(table, preset, segment_bytes=300)
    _, ts, item, price, quantity = _rows(data)
    assert facts["items"] == len(prices) and archive.encode(table, preset, segment_bytes=300)[0] == data
    for got, name in ((ts, "ts"), (item, "item_id")):
        assert got.tolist() == table.column(name).to_pylist()
    for got, name in ((price, "price"), (quantity, "quantity")):
        assert np.asarray(got, np.float64).view(np.uint64).tolist() == np.asarray(table.column(name)).view(np.uint64).tolist()


def test_every_truncation_and_flip_is_refused():
    data, _ = archive.encode(_table([100 + i % 7 for i in range(60)]), segment_bytes=400)
    assert archive.verify(data)
    assert not any(archive.verify(data[:n]) for n in range(len(data)))
    assert not archive.verify(data + b"\0")
    for at in range(len(data)):
        hurt = bytearray(data)
        hurt[at] ^= 1 << at % 8
        assert not archive.verify(bytes(hurt)) or at in range(5, 10), at  # the header's flags and count aren't covered by a hash


def test_index_tells_which_segments_hold_an_item():
    rows = pa.table({"snapshot_seq": np.arange(100), "ts": np.arange(100), "item_id": np.arange(100) * 7, "price": np.ones(100), "quantity": np.ones(100)})
    data, _ = archive.encode(rows, segment_bytes=240)
    parts = [archive.segment(data, at) for at, _ in archive.offsets(data)]
    assert len(parts) == 10
    for item in range(700):
        assert [p.may_have(item) for p in parts] == [item in p.ids() for p in parts]


def test_source_and_sink(spark, sf, tmp_path):
    rows, path = snapshots(spark, sf), str(tmp_path / "a")
    archive.write(rows, path, segment_bytes=1 << 14, parts=3)
    back = archive.read(spark, path)
    assert back.select("ts", "item_id", "price", "quantity").exceptAll(rows).isEmpty() and back.count() == rows.count()
    seq = [r[0] for r in back.select("snapshot_seq").distinct().orderBy("snapshot_seq").collect()]
    assert seq == list(range(len(seq)))
    assert all(r["valid"] for r in archive.verify_all(spark, path).collect())
    item = rows.first()["item_id"]
    times = rows.filter(rows.item_id == item).select("ts")
    assert archive.query(spark, path, item).count() == rows.join(times, "ts", "left_semi").count()
    archive.write(rows.selectExpr("ts + 1000000000 AS ts", "item_id", "price", "quantity"), path, mode="append", parts=2)
    assert archive.read(spark, path).count() == 2 * rows.count()
    part = archive.parts_of(path)[0]["path"]
    with open(part, "r+b") as file:
        file.seek(100)
        byte = file.read(1)
        file.seek(100)
        file.write(bytes([byte[0] ^ 1]))
    assert [r["valid"] for r in archive.verify_all(spark, path).collect()].count(False) == 1
    with pytest.raises(Exception):
        archive.read(spark, path).count()


def test_a_part_that_is_cut_out_or_missing_is_noticed(spark, tmp_path):
    rows = spark.createDataFrame([(t, i, float(t * i), 1.0) for t in range(90) for i in range(5)], "ts long, item_id long, price double, quantity double")
    path = str(tmp_path / "a")
    archive.write(rows, path, parts=3)
    whole = archive.files.read(f"{path}/{archive.MANIFEST}")
    parts = json.loads(whole)["parts"]
    archive.files.replace(f"{path}/{archive.MANIFEST}", json.dumps({"version": 1, "parts": [parts[0], parts[2]]}).encode())
    assert not any(r["valid"] for r in archive.verify_all(spark, path).collect())
    archive.files.replace(f"{path}/{archive.MANIFEST}", whole)
    assert all(r["valid"] for r in archive.verify_all(spark, path).collect())
    archive.files.remove(f"{path}/{parts[1]['name']}")
    assert [r["valid"] for r in archive.verify_all(spark, path).collect()].count(False) == 1
    single = archive.read(spark, f"{path}/{parts[0]['name']}")
    assert single.count() == parts[0]["items"] and single.agg({"snapshot_seq": "max"}).first()[0] == parts[0]["snapshots"] - 1


@given(st.lists(st.integers(-400, 400), max_size=900))
@settings(max_examples=40, deadline=None)
def test_ring_codec(values):
    a, b, cut = codecs.Ring(), codecs.Ring(), len(values) // 2
    for part in (values[:cut], values[cut:]):  # the ring goes on over blocks
        assert codecs.unring(codecs.ring(np.array(part, np.int64), a), b).tolist() == part
    assert len(a.held) <= codecs.RING


def test_records_of_any_schema(spark, tmp_path):
    """Composite keys, absent fields, specials, nulls; whole-number keys; an empty table."""
    nan, inf = float("nan"), float("inf")
    rows = [(t, k, None if (t + i) % 4 == 0 else float(t * i), [0.1, -0.0, inf, nan, 5e-324, 1e308][(t + i) % 6], None if i == 2 else f"o/{i} |") for t in range(40) for i, k in enumerate(["a|b/c", "ü x", "", "z"])] + [(7, None, 1.0, 2.0, "n")]
    table = spark.createDataFrame(rows, "ts long, item_key string, x double, y double, kind string")
    path, fields = str(tmp_path / "r"), {"x": "numeric", "y": "numeric", "kind": "categorical"}
    for password in (None, "secret"):
        records.write(table, path, fields, segment_rows=30, parts=2, password=password)
        assert Counter(map(str, records.read(spark, path, password).collect())) == Counter(str(r) for r in table.collect())
        assert all(r["valid"] for r in records.verify(spark, path, password).collect())
        assert records.query(spark, path, "ü x", password).count() == len(rows) and records.query(spark, path, "none", password).count() == 0
        assert spark.read.parquet(path + "/segments").filter(records.may_have("ü x")).count() > spark.read.parquet(path + "/segments").filter(records.may_have("none")).count()
    with pytest.raises(codecs.ArchiveError):
        records.read(spark, path)
    with pytest.raises(codecs.ArchiveError):
        records.read(spark, path, "wrong")
    numbered = table.selectExpr("ts", "length(kind) AS item_id", "x")
    records.write(numbered, path, {"x": "numeric"}, key="item_id")
    assert Counter(map(str, records.read(spark, path).collect())) == Counter(str(r) for r in numbered.selectExpr("ts", "CAST(item_id AS bigint) AS item_id", "x").collect())
    assert records.query(spark, path, 5).count() > 0 and records.schema(path)["keyed"] == "bigint"
    records.write(table.filter("false"), path, fields)
    assert records.read(spark, path).count() == 0 and records.verify(spark, path).count() == 0


@pytest.mark.parametrize("password", [None, "secret"])
def test_changed_cut_and_moved_segments_are_noticed(spark, tmp_path, password):
    table = spark.createDataFrame([(t, f"k{i}", float(t)) for t in range(60) for i in range(3)], "ts long, item_key string, x double")
    path, other = str(tmp_path / "r"), str(tmp_path / "other")
    records.write(table, path, {"x": "numeric"}, segment_rows=20, parts=1, password=password)
    whole = spark.read.schema(records.SEGMENT).parquet(path + "/segments")
    bent = F.concat(F.expr("substring(payload, 1, 40)"), F.unhex(F.lit("00ff")), F.expr("substring(payload, 43, length(payload))"))
    swap = F.when(F.col("ordinal") == 1, 2).when(F.col("ordinal") == 2, 1).otherwise(F.col("ordinal")).cast("int")
    for hurt in (whole.withColumn("payload", F.when(F.col("ordinal") == 2, bent).otherwise(F.col("payload"))), whole.filter("ordinal <> 3"), whole.filter("ordinal <> 0"), whole.filter("ordinal < 5"),
                 whole.withColumn("ordinal", swap), whole.filter("false")):
        hurt.write.mode("overwrite").parquet(other + "/segments")
        archive.files.write(f"{other}/{records.MANIFEST}", archive.files.read(f"{path}/{records.MANIFEST}"))
        assert not any(r["valid"] for r in records.verify(spark, other, password).collect())


def test_command_line(spark, tmp_path, capsys):
    from tideline import cli

    source = tmp_path / "in.json"
    source.write_text('{"snapshots": [{"timestamp": 1, "items": {"7": {"price": 1.5, "quantity": 2}}}, {"timestamp": 2, "items": {"8": {"price": 3, "quantity": 4}}}]}')
    out = str(tmp_path / "out")
    assert cli.main(["encode", str(source), out]) == 0 and cli.main(["verify", out]) == 0
    capsys.readouterr()
    assert cli.main(["query", out, "7"]) == 0
    assert '"price":1.5' in capsys.readouterr().out


def test_encoder_holds_a_segment_of_a_sorted_stream():
    """The same file from batches as from a table, with what waits bounded by a segment, not by the file."""
    table = _table([1.5 * i for i in range(5000)], items=7)
    made, most, out = archive.Encoder(segment_bytes=1200), 0, []
    out.append(made.head())
    for at in range(0, 5000, 50):
        out += made.add(table.slice(at, 50))
        most = max(most, made.rows)
    rest, facts = made.finish()
    data, whole = archive.encode(table, segment_bytes=1200)
    assert b"".join(out + rest) == data and facts == whole and most < 400


def test_rows_said_to_be_sorted_are_checked(spark, tmp_path):
    archive.register(spark)
    rows = spark.createDataFrame([(s, 10 * s, 1, 1.0, 1.0) for s in (3, 1, 2)], archive.SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="sorted"):
        rows.write.format("snapshot_archive").mode("append").option("sorted", "true").save(str(tmp_path / "a"))
    assert not [p for p in (tmp_path / "a").iterdir() if p.name.endswith(".arc")]
    rows.write.format("snapshot_archive").mode("append").save(str(tmp_path / "b"))
    assert [r["ts"] for r in archive.read(spark, str(tmp_path / "b")).orderBy("snapshot_seq").collect()] == [10, 20, 30]
