"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes of UTF-8 marks chunk boundaries wherever its low ``k``
bits are ones, so the block size is 2 ** k and boundaries depend on local content only.
k is the least with at most 64 chunks expected, lowered while fewer than 32 are found.
A signature is the sequence of chunk hashes; a fingerprint has the one at block size
2 ** k (up to 64 chunks) and that at twice the size (up to 32). Fingerprints are compared
at equal block sizes, so those whose k differ by one are compatible. The score is 100 less
the share of insertions and deletions (a change is both) that turn one signature into the
other; chunks are compared by 30 bits of hash, so chance matches of letters don't count.

Search is exact: a score needs a number of common chunks, so by the prefix principle two
signatures share one of their rarest chunks, with enough chunks left after it in both;
rarity comes from counts of all chunks in a table of fixed size, so passages that many
documents share aren't paired. Large groups of near copies (families, see ``postings``)
don't meet by chunks: they are compared all with all. Candidates meet in packed buckets cut by rows (see
``postings``), one way for every size. Equal fingerprints are one candidate. Links are
counted in the tasks that compare, which give out a row a member, not a row a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import postings as po
from tideline.llm import textkernel as tk
from tideline.llm.common import ready

SCORE = 60
LONG, SHORT, ENOUGH, LEAST_K, MOST_K, WINDOW = 64, 32, 32, 2, 30, 7
#: Signatures of fewer chunks are compared with equal ones only.
FEWEST = 7
#: Chunks of the fingerprints that one comparing task holds.
HELD = 1_000_000
#: The same of a task that compares all with all of a family.
HELD_ALL = 250_000


def rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the seven bytes that end at each place."""
    k = np.uint32(0x01000193 | 1)
    with np.errstate(over="ignore"):
        k2 = np.uint32(k * k)
        k4 = np.uint32(k2 * k2)
        one = data.astype(np.uint32) + np.uint32(1)
        two = one.copy()
        two[1:] += k * one[:-1]
        four = two.copy()
        four[2:] += k2 * two[:-2]
        three = two
        three[2:] += k2 * one[:-2]
        four[4:] += k4 * three[:-4]
        four ^= four >> np.uint32(15)
        four *= np.uint32(0x2C1B3C6D)
        four ^= four >> np.uint32(12)
    return four


def chunk_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """k of each text, and for block sizes 2 ** k and 2 ** (k + 1) (30-bit chunk hash, row), in order."""
    rows, size = len(offsets) - 1, np.diff(offsets)
    roll = rolling(data) if len(data) else np.zeros(0, np.uint32)
    place = np.flatnonzero((roll & np.uint32(3)) == 3)
    row = np.searchsorted(offsets, place, side="right") - 1
    inside = place - offsets[row] >= WINDOW - 1
    place, row = place[inside], row[inside]
    r = roll[place].astype(np.uint64)
    level = np.minimum(MOST_K, np.log2(((r + np.uint64(1)) & ~r).astype(np.float64)).astype(np.int64))
    count = np.bincount(row * (MOST_K + 1) + level, minlength=rows * (MOST_K + 1)).reshape(rows, MOST_K + 1)
    count = count[:, ::-1].cumsum(1)[:, ::-1]  # boundaries at level k or above
    k = np.clip(np.ceil(np.log2(np.maximum(size, 1) / LONG)).astype(np.int64), LEAST_K, MOST_K - 1)
    while True:
        lower = (k > LEAST_K) & (count[np.arange(rows), k] < ENOUGH)
        if not lower.any():
            break
        k = k - lower
    found = []
    for at, most in ((k, LONG), (k + 1, SHORT)):
        mine = level >= at[row]
        p, r = place[mine], row[mine]
        before = np.searchsorted(r, r, side="left")
        cut = (np.arange(len(r)) - before < most - 1) & (p + 1 < offsets[r + 1])  # the last chunk takes the rest
        p, r = p[cut], r[cut]
        starts = np.concatenate([offsets[:-1][size > 0], p + 1])
        owner = np.concatenate([np.flatnonzero(size > 0), r])
        order = np.argsort(starts, kind="stable")
        starts, owner = starts[order], owner[order]
        stops = np.append(starts[1:], len(data))
        stops = np.minimum(stops, offsets[owner + 1])
        found.append(((tk.range_hashes(data, starts, stops) >> np.uint64(34)).astype(np.int32), owner))
    return k, found


def _lists(values: np.ndarray, owner: np.ndarray, rows: int) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, k, first, second): chunk hashes at block sizes 2 ** k and 2 ** (k + 1).

    Null and empty texts have no row."""
    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                data, offsets = tk.buffer(part.column("text"))
                k, ((a, ra), (b, rb)) = chunk_hashes(data, offsets)
                rows = len(offsets) - 1
                made = pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(k, pa.int32()), _lists(a, ra, rows), _lists(b, rb, rows)],
                    ["doc_id", "k", "first", "second"])
                yield made.filter(pa.array(np.diff(offsets) > 0))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, k int, first array<int>, second array<int>")


def common(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Longest common subsequences of rows of codes (at most 64, padded), bit-parallel."""
    bits = np.full(len(a), ~np.uint64(0))
    wide = np.full((len(a), 64), -1, np.int32)
    wide[:, :a.shape[1]] = np.where(np.arange(a.shape[1])[None, :] < la[:, None], a, -1)
    with np.errstate(over="ignore"):
        for j in range(int(lb.max()) if len(lb) else 0):
            code = np.where(j < lb, b[:, j], -2)
            met = bits & np.packbits(wide == code[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
            bits = (bits + met) | (bits - met)
    mask = np.where(la >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(la, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~bits & mask).astype(np.int64)


def score(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """100 - floor(100 * insertions and deletions / chunks of both)."""
    return 100 - (100 * (la + lb - 2 * common(a, b, la, lb))) // np.maximum(la + lb, 1)


def part_of_sum(least: int) -> float:
    """A score of at least ``least`` has more common chunks than this times the chunks of both."""
    return (least - 1) / 200


def prefix(size: np.ndarray, least: int) -> np.ndarray:
    """Of a signature's chunks, rarest first, so many can be the first in common with a partner of any size."""
    table = np.arange(LONG + 1)
    need = np.floor(part_of_sum(least) * (table[:, None] + table[None, :]) + 1e-9).astype(np.int64) + 1
    fits = need <= table[None, :]  # a partner can't have more in common than it has
    fewest = np.where(fits, need, LONG + 1).min(axis=1)
    return np.clip(table - fewest + 1, 0, None)[size]


def _padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.asarray(column.value_lengths()).astype(np.int64)
    out = np.full((len(n), width), -1, np.int32)
    out[np.arange(width)[None, :] < n[:, None]] = np.asarray(column.flatten())
    return out, n


def _tokens(batch: pa.RecordBatch):
    """For first and second: (tokens, row, row's count), a token for each chunk that says its block
    size, its hash and which of equal ones in the signature it is."""
    k = np.asarray(batch.column("k")).astype(np.uint64)
    for name, shift in (("first", 0), ("second", 1)):
        column = batch.column(name)
        n = np.asarray(column.value_lengths()).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        key = np.sort((row.astype(np.uint64) << np.uint64(32)) | np.asarray(column.flatten()).astype(np.uint64))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        again = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        row = (key >> np.uint64(32)).astype(np.int64)
        kept = n[row] >= FEWEST
        row, key, again = row[kept], key[kept] & np.uint64(0xFFFFFFFF), again[kept].astype(np.uint64)
        yield tk.mix64(key | ((k[row] + np.uint64(shift)) << np.uint64(32)) | (again << np.uint64(40))), row, np.bincount(row, minlength=len(n))


def sketched(sets: DataFrame) -> DataFrame:
    """(fp, doc_id, copies, size, sketch) of sets, size being the chunks and sketch those of both signatures, see ``postings``."""
    names = ["fp", "doc_id", "copies", "size"]

    def run(batches):
        low = np.uint64((1 << 48) - 1)
        for batch in batches:
            made = []
            for tokens, row, _ in _tokens(batch):
                key = np.sort((row.astype(np.uint64) << np.uint64(48)) | (tokens >> np.uint64(16)))
                made.append(np.asarray(po.sketches(key & low, (key >> np.uint64(48)).astype(np.int64), batch.num_rows).flatten()).reshape(batch.num_rows, -1))
            both = np.concatenate(made, axis=1)
            ends = pa.array(np.arange(len(both) + 1, dtype=np.int32) * both.shape[1])
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.ListArray.from_arrays(ends, pa.array(both.reshape(-1)))], [*names, "sketch"])

    return (sets.withColumn("size", (F.size("first") + F.size("second")).cast("bigint"))
            .mapInArrow(run, "fp bigint, doc_id bigint, copies bigint, size bigint, sketch array<bigint>"))


def _matcher(least: int):
    """For ``postings.within``: scores of a row's fingerprint with those of a range of rows. Which places of
    its signature have a chunk is noted once, by chunk, so that a pair takes a look-up a chunk."""
    share = part_of_sum(least)

    def matcher(table: pa.Table):
        k = np.asarray(table.column("k"))
        codes = {c: _padded(table.column(c), most) for c, most in (("first", LONG), ("second", SHORT))}
        known = np.unique(np.concatenate([x.reshape(-1) for x, _ in codes.values()]))
        # Hashes have 30 bits, so the padding, -1, comes first.
        wide = {c: (np.ascontiguousarray(np.searchsorted(known, x).T), n) for c, (x, n) in codes.items()}
        places = np.zeros(len(known) + 1, np.uint64)
        padding = int(known[0]) == -1

        def match(a: int, low: int, high: int) -> np.ndarray:
            best = np.full(high - low, -1.0)
            for x, y, gap in (("first", "first", 0), ("second", "second", 0), ("first", "second", 1), ("second", "first", -1)):
                (own, la), (others, lb) = wide[x], wide[y]
                n, size = la[a], lb[low:high]
                shorter = np.minimum(n, size)
                at = np.flatnonzero((k[a] - k[low:high] == gap) & (shorter >= FEWEST) & (shorter > share * (n + size) - 1e-9))
                if not len(at):
                    continue
                mine = own[:n, a]
                np.bitwise_or.at(places, mine, np.uint64(1) << np.arange(n, dtype=np.uint64))
                if padding:
                    places[0] = 0
                bits = np.full(len(at), ~np.uint64(0))
                with np.errstate(over="ignore"):
                    for step in places[others[:size[at].max(), low:high][:, at]]:
                        met = bits & step
                        bits = (bits + met) | (bits - met)
                places[mine] = 0
                full = ~np.uint64(0) if n >= 64 else (np.uint64(1) << np.uint64(n)) - np.uint64(1)
                both = n + size[at]
                value = 100 - (100 * (both - 2 * np.bitwise_count(~bits & full).astype(np.int64))) // np.maximum(both, 1)
                best[at] = np.maximum(best[at], value)
            return np.where(best >= least, best, -1.0)

        return match

    return matcher


def search(docs: DataFrame, least: int = SCORE) -> DataFrame:
    """(doc_id, class_id, links, score), a row for each document that is similar to another.

    links counts the other documents of a score of at least ``least``, all of them, and score is
    the highest; equal fingerprints have 100. class_id is the least doc_id of those that links
    join the document to, over any number of steps. Documents without a link have no row.
    Null and empty texts and rows without doc_id are left out; signatures of fewer than
    FEWEST chunks match equal fingerprints only; repeated rows of a doc_id count once; unlike texts
    of a doc_id are of one class, and their links add up; very long
    texts are read whole; other columns are ignored; an empty table gives an empty result.
    doc_id must be an integer."""
    if not 1 < least <= 100:
        raise ValueError("least must be within (1, 100]")
    spark = ready(docs.sparkSession)
    share = part_of_sum(least)
    made = (fingerprints(docs.filter("doc_id IS NOT NULL")).withColumn("fp", F.xxhash64("k", "first", "second"))
            .withColumn("fp2", F.xxhash64(F.lit(2), "second", "first", "k")).checkpoint())
    made = po.settled(made, po.clashes(made))
    sets = made.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count_distinct("doc_id").alias("copies"),
                                  F.first(F.struct("k", "first", "second")).alias("s")).select("fp", "doc_id", "copies", "s.*").checkpoint()

    def count(batches):
        counter = po.Counter()
        for batch in batches:
            for tokens, _, _ in _tokens(batch):
                counter.add(tokens)
        block, cells = counter.blocks()
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(cells, pa.binary())], ["block", "cells"])

    rank = spark.sparkContext.broadcast(po.ranks(sets.select("k", "first", "second").mapInArrow(count, "block int, cells binary")))
    chunks = sets.agg(F.sum(F.size("first") + F.size("second"))).first()[0] or 0
    cut = np.uint64(po.bucket_count(int(0.6 * chunks)))

    def emit(batches):
        packer, table = po.Packer(marked=True), rank.value
        grids = po.grids(table)
        for batch in batches:
            ids, marks = np.asarray(batch.column("fp")), np.asarray(batch.column("mark").fill_null(po.NONE))
            for tokens, row, size in _tokens(batch):
                cost = table[(tokens & np.uint64(len(table) - 1)).astype(np.int64)]
                # The cost must order tokens alike everywhere, so equal costs go by token.
                order = np.lexsort((tokens, cost, row))
                tokens, row, cost = tokens[order], row[order], cost[order]
                place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
                kept = place < prefix(size, least)[row]
                at, place = row[kept], place[kept]
                went, keys = po.dealt(tokens[kept], ids[at], grids[cost[kept]])
                at, place = at[went], place[went]
                bucket = (tk.mix64(keys) % cut).astype(np.int64)
                yield from packer.add(keys, bucket, at, (place // 2).astype(np.uint8), ids, size, np.zeros(len(ids), np.uint8), marks)
        yield from packer.flush()

    def compare(pairs: pa.Table, held: pa.Table) -> pa.Table:
        held = held.combine_chunks()
        ids = np.asarray(held.column("fp"))
        order = np.argsort(ids)
        ia, ib = (order[np.searchsorted(ids[order], np.asarray(pairs.column(c)))] for c in ("a", "b"))
        k = np.asarray(held.column("k"))
        codes = {c: _padded(held.column(c), LONG) for c in ("first", "second")}
        best = np.zeros(len(ia), np.int64)
        for low in range(0, len(ia), 20_000):
            xa, xb = ia[low:low + 20_000], ib[low:low + 20_000]
            for x, y, gap in (("first", "first", 0), ("second", "second", 0), ("first", "second", 1), ("second", "first", -1)):
                (a, la), (b, lb) = codes[x], codes[y]
                shorter, both = np.minimum(la[xa], lb[xb]), la[xa] + lb[xb]
                at = np.flatnonzero((k[xa] - k[xb] == gap) & (shorter >= FEWEST) & (shorter > share * both - 1e-9))
                if len(at):
                    pa_, pb = xa[at], xb[at]
                    best[low + at] = np.maximum(best[low + at], score(a[pa_], b[pb], la[pa_], lb[pb]))
        good = best >= least
        return po.tally(ia[good], ib[good], best[good].astype(float), np.asarray(held.column("doc_id")), np.asarray(held.column("copies")))

    def compared(found):
        placed, label = po.place(found, known.select("fp", "size"), HELD)
        return po.gather(placed, po.joined(sets, label.select("fp", "cells")), compare, po.LINKED).checkpoint()

    own = made.select("doc_id", "fp")
    known = sketched(sets).checkpoint()
    family, first = None, po.stars(known)
    if not first.isEmpty():
        family = po.families(own, known, compared(first))
    marks = spark.createDataFrame([], "fp bigint, mark bigint") if family is None else family.select("fp", "mark")
    packed = po.joined(sets.select("fp", "k", "first", "second"), marks, "left").mapInArrow(emit, po.MARKED)
    found = po.meetings(packed, lambda group: po.meet_first(group, share), "a bigint, b bigint").distinct().checkpoint()
    linked = compared(found)
    if family is not None:
        parts = po.parted(family, HELD_ALL).select("fp", "doc_id", "copies", "mark", "g", "p").checkpoint()
        whole = po.joined(sets.select("fp", "k", "first", "second"), parts)
        linked = linked.union(po.within(whole, _matcher(least)).checkpoint())
    made_of = po.classes(own, sets.select("fp", "doc_id", "copies"), linked, 100.0)
    return made_of.select("doc_id", "class_id", "links", F.col("best").cast("int").alias("score"))


def query(spark, sf_dir):
    from tideline.llm.common import read

    return search(read(spark, sf_dir, "documents"))
