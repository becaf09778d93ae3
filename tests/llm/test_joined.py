"""Joins of sets with many narrow rows: nothing is broadcast but a bit table."""

import contextlib
import io

import pytest

from tideline.llm import op03_fingerprints, postings


@pytest.mark.parametrize("how", ["inner", "left"])
def test_many_rows_are_not_broadcast(spark, how):
    sets = spark.range(5000).selectExpr("id * 7919 - 9000 AS fp", "int(id) AS k")
    narrow = spark.range(3000).selectExpr("id * 7919 * 3 - 9000 AS fp", "id AS mark")
    made = postings.joined(sets, narrow.checkpoint(), how, 100)
    with contextlib.redirect_stdout(io.StringIO()) as said:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        made.explain()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in said.getvalue()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, made.collect())) == sorted(map(key, sets.join(narrow, "fp", how).collect())) and made.count() == (5000 if how == "left" else 1667)


def test_fingerprints_alike_without_broadcasts(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = sorted(map(tuple, op03_fingerprints.search(docs).collect()))
    monkeypatch.setattr(postings, "FEW", 0)
    monkeypatch.setattr(postings, "FAMILY", 8)
    assert sorted(map(tuple, op03_fingerprints.search(docs).collect())) == want and want
