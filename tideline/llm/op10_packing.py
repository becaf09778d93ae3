"""Best-fit packing with exact-complement hashing.

Texts are cut into pieces of at most ``capacity`` whitespace-separated words. Piece
lengths are at most the capacity, so their histogram has a bounded number of rows
whatever the corpus; all combinatorics run on the histogram on the driver:

* for each length from the longest, the gap that it leaves is looked up in the index of
  available single lengths, then of pair sums, then of triple sums; a combination that
  fills the gap exactly is used as often as its counts allow;
* what is left is packed best-fit: the longest piece that still fits comes next.

The result is a list of runs (pattern of lengths, number of sequences). Executors rank
the pieces of each length in parts of bounded size (so that no length is one task: long
texts give mostly pieces of the full length) and read the sequence number off the runs
that their part meets. No text is shuffled.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import ready, small

CAPACITY = 2048
#: Pieces of one length that one task ranks, about.
PART = 1_000_000


class Stock:
    """Available pieces by length, with lookups of exact sums."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            if not 0 < length <= capacity:
                raise ValueError(f"length {length} is not within 1 to {capacity}")
            self.count[length] += n

    def pair(self, total: int) -> tuple[int, int] | None:
        """Available lengths a >= b of this sum, a as long as can be."""
        if total < 2:
            return None
        small_ = self.count[1:total // 2 + 1]
        both = (small_ > 0) & (self.count[total - 1:total - 1 - len(small_):-1] > 0)
        if total % 2 == 0 and both[-1] and self.count[total // 2] < 2:
            both[-1] = False
        found = int(both.argmax()) if both.any() else -1
        return (total - found - 1, found + 1) if found >= 0 else None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        for first in (np.flatnonzero(self.count[1:max(1, total - 1)]) + 1)[::-1]:
            first = int(first)
            self.count[first] -= 1
            rest = self.pair(total - first)
            self.count[first] += 1
            if rest:
                return (first, *rest)
        return None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        if self.count[gap] > 0:
            return (gap,)
        return self.pair(gap) or self.triple(gap)

    def take(self, pattern: tuple[int, ...]) -> int:
        """Uses a pattern as often as the counts allow; how often."""
        lengths, need = np.unique(pattern, return_counts=True)
        times = int((self.count[lengths] // need).min())
        self.count[lengths] -= times * need
        return times


def runs(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, number of such sequences)]; every piece is used once."""
    stock, found = Stock(histogram, capacity), []
    if stock.count[capacity]:
        found.append(((capacity,), stock.take((capacity,))))
    for length in range(capacity - 1, 0, -1):
        while stock.count[length] > 0:
            stock.count[length] -= 1
            rest = stock.fill(capacity - length)
            stock.count[length] += 1
            if rest is None:
                break
            found.append(((length, *rest), stock.take((length, *rest))))
    for length in range(capacity - 1, 0, -1):
        while stock.count[length] > 0:
            pattern, gap = [length], capacity - length
            stock.count[length] -= 1
            while gap and (fits := np.flatnonzero(stock.count[1:gap + 1])).size:
                pattern.append(best := int(fits[-1]) + 1)
                stock.count[best] -= 1
                gap -= best
            for used in pattern:
                stock.count[used] += 1
            found.append((tuple(pattern), stock.take(tuple(pattern))))
    return found


def slots(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """[(length, first rank, last rank, sequence of the first rank, slot)], ranks from 0."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in found:
        for slot, length in enumerate(pattern):
            at = used.get(length, 0)
            rows.append((length, at, at + times - 1, base, slot))
            used[length] = at + times
        base += times
    return rows


def split(by_part: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """[(length, part, first rank, last rank, sequence of the first rank, slot)], ranks from 0 within a
    part, from the sorted (length, part, pieces)."""
    histogram: dict[int, int] = {}
    parts: dict[int, list[tuple[int, int, int]]] = {}
    for length, part, n in by_part:
        before = histogram.get(length, 0)
        parts.setdefault(length, []).append((part, before, n))
        histogram[length] = before + n
    found = []
    for length, low, high, base, slot in slots(runs(histogram, capacity)):
        own = parts[length]
        at = bisect.bisect_right(own, low, key=lambda p: p[1]) - 1
        while at < len(own) and own[at][1] <= high:
            part, before, n = own[at]
            a, b = max(low, before), min(high, before + n - 1)
            found.append((length, part, a - before, b - before, base + a - low, slot))
            at += 1
    return found


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, start, n_tokens): the pieces of each text, start counted in words."""
    words = F.size(F.filter(F.split("text", r"[ \t\n\r\f]+", -1), lambda x: x != "")).cast("bigint")
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(words)
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(capacity).cast("bigint"))
    return (docs.select("doc_id", n.cast("bigint").alias("n")).filter("n > 0")
            .select("doc_id", "n", F.explode(starts).alias("start"))
            .select("doc_id", "start", F.least(F.col("n") - F.col("start"), F.lit(capacity)).cast("int").alias("n_tokens")))


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence, slot, doc_id, start, n_tokens): what each sequence holds.

    A sequence holds at most ``capacity`` words. Every word of every text is in exactly
    one row's range [start, start + n_tokens). Null, empty and blank texts have no words
    and no row; a null doc_id is kept; equal rows are packed as often as they occur;
    equal lengths are taken in hash order; other columns are ignored; an empty table
    gives an empty result."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = ready(docs.sparkSession)
    cut = pieces(docs, capacity).checkpoint()  # a few numbers a row: the texts are read once
    counts = cut.groupBy("n_tokens").agg(F.count("*").alias("n"))
    often = small(counts.filter(F.col("n") > PART).select("n_tokens", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("doc_id", "start"), F.col("parts")).cast("int")
    dealt = cut.join(often, "n_tokens", "left").withColumn("part", F.coalesce(part, F.lit(0))).drop("parts")
    # A row a part: the pieces over PART and the lengths in all at most.
    by_part = sorted((r["n_tokens"], r["part"], r["n"]) for r in dealt.groupBy("n_tokens", "part").agg(F.count("*").alias("n")).collect())
    plan = spark.createDataFrame(split(by_part, capacity), "n_tokens int, part int, lo bigint, hi bigint, base bigint, slot int")
    plan = plan.groupBy("n_tokens", "part").agg(F.array_sort(F.collect_list(F.struct("hi", "lo", "base", "slot"))).alias("to"))
    order = W.partitionBy("n_tokens", "part").orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(small(plan), ["n_tokens", "part"])
    # The first run that ends at or after the rank.
    run = F.element_at(F.filter("to", lambda x: x["hi"] >= F.col("rank")), 1)
    return (ranked.withColumn("_r", run)
            .select((F.col("_r.base") + F.col("rank") - F.col("_r.lo")).alias("sequence"), F.col("_r.slot").alias("slot"), "doc_id", "start", "n_tokens"))


def query(spark, sf_dir):
    from tideline.llm.common import read

    return pack(read(spark, sf_dir, "documents"))
