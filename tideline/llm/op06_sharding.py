"""Sharding by longest-processing-time scheduling.

Groups must stay in one shard: rows of one value of a column, or copies of a text. They are taken from the
largest to the smallest, each to the shard with the least load, found by a heap. Groups
of one size are interchangeable, so the driver needs only the histogram of group sizes
(its rows are the distinct sizes, not the groups) and, where a size is frequent, gives
all its groups out at once: the shards' counts are the same as those of one-by-one
scheduling. Ranges of ranks within a size then tell the executors each group's shard; a
size's groups are ranked in parts of bounded size, so that no size is one task.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import ready, small

SHARDS = 64
#: Groups of one size that one task ranks, about.
PART = 1_000_000


def spread(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` items of one size each shard gets, when each item goes to
    the least loaded shard (the lowest number among equals). Doesn't step item by item."""
    shards = len(loads)
    if size == 0:
        given = [0] * shards
        given[min(range(shards), key=lambda i: (loads[i], i))] = count
        return given
    low, high = min(loads), max(loads) + size * (count // shards + 1)

    def upto(level: int) -> int:  # items placed onto a load <= level
        return sum((level - x) // size + 1 for x in loads if x <= level)

    while low < high:  # the least level at which all items are placed
        level = (low + high) // 2
        if upto(level) >= count:
            high = level
        else:
            low = level + 1
    given = [max(0, (low - 1 - x) // size + 1) if x <= low - 1 else 0 for x in loads]
    left = count - sum(given)
    for i, x in enumerate(loads):
        if left and x <= low and (low - x) % size == 0:
            given[i], left = given[i] + 1, left - 1
    return given


def schedule(histogram: list[tuple[int, int]], shards: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """[(size, first rank, last rank, shard)] with ranks from 1, and the shards' loads."""
    heap, ranges = [(0, i) for i in range(shards)], []
    for size, count in sorted(histogram, reverse=True):
        if count <= shards:
            for rank in range(1, count + 1):
                load, shard = heapq.heappop(heap)
                ranges.append((size, rank, rank, shard))
                heapq.heappush(heap, (load + size, shard))
            continue
        loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
        rank = 1
        for shard, n in enumerate(spread(loads, size, count)):
            if n:
                ranges.append((size, rank, rank + n - 1, shard))
                loads[shard], rank = loads[shard] + n * size, rank + n
        heap = [(load, i) for i, load in enumerate(loads)]
        heapq.heapify(heap)
    return ranges, [load for load, _ in sorted(heap, key=lambda x: x[1])]


def plan(counts: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """[(size, part, first rank, last rank, shard)], ranks from 1 within a part, from the sorted
    (size, part, groups)."""
    histogram: dict[int, int] = {}
    parts: dict[int, list[tuple[int, int]]] = {}
    for size, part, n in counts:
        histogram[size] = histogram.get(size, 0) + n
        parts.setdefault(size, []).append((part, n))
    found = []
    for size, low, high, where in schedule(list(histogram.items()), shards)[0]:
        before = 0
        for part, n in parts[size]:
            a, b = max(low, before + 1), min(high, before + n)
            if a <= b:
                found.append((size, part, a - before, b - before, where))
            before += n
    return found


def shard(docs: DataFrame, shards: int = SHARDS, group: str | None = None) -> DataFrame:
    """(doc_id, shard, group_size), a row per row of docs.

    A group is the rows of one value of the column ``group``, or of equal text if none is given; its size
    is its characters in all, at least 1 a
    row. Nulls form one group, and so do empty texts; a null doc_id is kept; equal
    rows stay together; an empty table gives an empty table; texts of any length count whole; other columns are
    ignored; ties in size are ordered by the group's MD5."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = ready(docs.sparkSession)
    of = F.col(f"`{group or 'text'}`").cast("string")
    keyed = docs.select("doc_id", F.coalesce(F.unhex(F.md5(of)), F.lit(b"")).alias("key"),
                        F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("bigint").alias("size"))
    groups = keyed.groupBy("key").agg(F.sum("size").alias("size")).checkpoint()  # a few bytes a group; the texts are read twice, not thrice
    counted = groups.groupBy("size").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / PART).cast("int")
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    # The sizes that many groups have are ranked part by part.
    often = small(counted.filter(F.col("n") > PART).select("size", parts.alias("parts")).checkpoint())
    dealt = groups.join(often, "size", "left").select("key", "size", F.coalesce(part, F.lit(0)).alias("part")).checkpoint()
    counts = sorted((r["size"], r["part"], r["n"]) for r in dealt.groupBy("size", "part").agg(F.count("*").alias("n")).collect())
    table = spark.createDataFrame(plan(counts, shards), "size bigint, part int, lo bigint, hi bigint, shard int")
    ranges_of = table.groupBy("size", "part").agg(F.array_sort(F.collect_list(F.struct("hi", "shard"))).alias("to"))
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("size", "part").orderBy("key")))
    # The first range that ends at or after the rank.
    where = F.element_at(F.filter("to", lambda x: x["hi"] >= F.col("rank")), 1)["shard"]
    placed = ranked.join(small(ranges_of), ["size", "part"]).select("key", where.alias("shard"), F.col("size").alias("group_size"))
    return keyed.select("doc_id", "key").join(placed, "key").select("doc_id", "shard", "group_size")


def query(spark, sf_dir):
    from tideline.llm.common import read

    return shard(read(spark, sf_dir, "documents"))
