"""``python -m tideline.cli``: encode, decode, verify, info, profile and query.

    encode IN.json OUT      snapshots [{timestamp, items: {id: {price, quantity}}}] to an archive folder
    decode ARCHIVE          the archive's rows as JSON lines
    verify ARCHIVE          whether every part is whole; the exit code says so too
    info ARCHIVE            parts, snapshots, items, bytes
    profile ARCHIVE         trial encodings of its first rows
    query ARCHIVE ITEM      the snapshots that hold an item
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F

from tideline.session import session
from tideline.sources import archive


def from_json(spark, path: str):
    """Rows of a JSON file of snapshots: one object with ``snapshots``, or an array of them."""
    item = "struct<price: double, quantity: double>"
    raw = spark.read.text(path, wholetext=True)
    kind = f"array<struct<timestamp: bigint, items: map<string, {item}>>>"
    body = F.coalesce(F.from_json("value", f"struct<snapshots: {kind}>")["snapshots"], F.from_json("value", kind))
    return (raw.select(F.explode(body).alias("s")).select(F.col("s.timestamp").alias("ts"), F.explode("s.items").alias("id", "x"))
            .select("ts", F.col("id").cast("bigint").alias("item_id"), "x.price", "x.quantity"))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tideline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, places in (("encode", ("input", "output")), ("decode", ("archive",)), ("verify", ("archive",)), ("info", ("archive",)), ("profile", ("archive",)), ("query", ("archive", "item"))):
        command = commands.add_parser(name)
        for place in places:
            command.add_argument(place)
        if name == "encode":
            command.add_argument("--preset", choices=sorted(archive.PRESETS), default="balanced")
    chosen = parser.parse_args(args)
    spark = session("tideline", os.environ.get("SPARK_MASTER", "local[*]"))
    if chosen.command == "encode":
        archive.write(from_json(spark, chosen.input), chosen.output, chosen.preset)
    elif chosen.command in ("decode", "query"):
        rows = archive.read(spark, chosen.archive) if chosen.command == "decode" else archive.query(spark, chosen.archive, int(chosen.item))
        for line in rows.orderBy("snapshot_seq", "item_id").toJSON().toLocalIterator():
            print(line)
    elif chosen.command == "verify":
        found = archive.verify_all(spark, chosen.archive).collect()
        print(json.dumps({r["path"]: r["valid"] for r in found}))
        return int(not all(r["valid"] for r in found))
    elif chosen.command == "info":
        print(json.dumps([{k: v for k, v in p.items() if k != "path"} for p in archive.parts_of(chosen.archive)]))
    else:
        from tideline.operators.bandit import profile

        sample = archive.read(spark, chosen.archive).orderBy("snapshot_seq", "item_id").limit(20_000).toArrow()
        print(json.dumps(profile(sample)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
