"""N-gram Jaccard join by universe partition and the pigeonhole principle, exact.

A text is the set of its word n-grams (of its words, if it has fewer than n). Sets are
banded by size; each band has a number of segments, and every token hashes to one. Two
sets of Jaccard similarity at least t differ in at most
H = (1 - t) / (1 + t) * (sum of their sizes) tokens, so if the larger looks up units worth
u > H, where a segment looked up exactly is worth one and a segment looked up with its
one-deletion neighbourhood two, at least u - H units must find the smaller.

The larger set chooses its units by cost: the frequency of a segment's rarest token, from
counts of all tokens in a table of fixed size. So segments of common tokens and passages
are not looked up, and their long lists are never paired. A few units beyond H + 1
(``SPARE``) make the join ask for several meetings. What met often enough is verified on
the sets themselves.

Where segments of several tokens can't give more than H units (small sets, lower
thresholds) the universe is cut to a segment a token. Then only what the larger set has and
the smaller lacks can spoil a unit, so fewer are looked up, and as both choose in one order
of cost, the smaller needs to be indexed by its cheapest segments alone. With each goes its
place in that order, so that two sets meet only where both have enough tokens left from there on.
This is the way at the thresholds in use; segments of several tokens come in from about 0.75.

Passes over the texts: one that counts tokens and gives each set a fingerprint, one that
emits signatures (packed, see ``postings``), and one over the candidates' texts alone.
Sets that are equal are one candidate. Links are counted in the tasks that verify them,
which give out a row a member. Large groups of near copies (families, found by sketches of the
first pass) don't meet by signatures: their sets are compared all with all in tasks of
bounded size, and only their pairs with other sets are searched for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import postings as po
from tideline.llm import textkernel as tk
from tideline.llm.common import NARROW_ROWS, ready, release, small

N, THRESHOLD, SPARE = 2, 0.7, po.SPARE
#: From here on documents are near copies: on sf0.1 pairs are rarest at 0.55 to 0.6, and below
#: 0.5 most are unrelated. A short text loses much of its similarity with one word.
NEAR = 0.5
#: Sets up to this size have a segment for each token; larger ones share segments, unless
#: ROOM times the units that they need are more than the segments that they fill. On 0.51 GB at 0.7
#: single tokens, with their places, cost a third of the signatures and give fewer chance pairs.
SINGLE, LOAD, ROOM = 64, 0.75, 2
#: Every so many-th segment has a one-deletion neighbourhood.
EVERY = 8
#: Tokens of the sets that one verifying task holds.
HELD = 1_000_000


def token_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(token, row, rows): the distinct n-grams of each text, ordered by (row, token)."""
    data, offsets = tk.buffer(texts)
    starts, stops, row = tk.spans(data, offsets)
    hashes = tk.range_hashes(data, starts, stops)
    words = np.bincount(row, minlength=len(offsets) - 1)
    gram, size = hashes.copy(), np.minimum(np.maximum(words[row], 1), n) if len(row) else row
    first = np.concatenate([[0], np.cumsum(words)])[row] if len(row) else row
    place = np.arange(len(row)) - first
    with np.errstate(over="ignore"):
        for k in range(1, n):
            more = np.flatnonzero(size > k)
            more = more[more + k < len(hashes)]
            gram[more] = tk.mix64(gram[more] * np.uint64(3) + hashes[more + k])
    keep = place + size <= words[row] if len(row) else np.zeros(0, bool)
    gram, row = gram[keep], row[keep]
    key = tk.distinct((row.astype(np.uint64) << np.uint64(48)) | (gram >> np.uint64(16)))
    return key & np.uint64((1 << 48) - 1), (key >> np.uint64(48)).astype(np.int64), len(offsets) - 1


def fingerprints(tokens: np.ndarray, row: np.ndarray, rows: int, clash=()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, size, second fingerprint) of each row's set; the second stands for the first
    where that is one of ``clash``, which unlike sets share."""
    size = np.bincount(row, minlength=rows)
    ends = np.cumsum(size)
    made = []
    with np.errstate(over="ignore"):
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            total = np.concatenate([[np.uint64(0)], np.cumsum(tk.mix64(tokens ^ np.uint64(salt >> 17)), dtype=np.uint64)])
            made.append(tk.mix64(total[ends] - total[ends - size] + size.astype(np.uint64) * np.uint64(salt)).view(np.int64))
    return np.where(np.isin(made[0], clash), made[1], made[0]) if len(clash) else made[0], size, made[1]


def several(threshold: float) -> bool:
    """Whether segments of several tokens can give the units needed, of two sets of one size."""
    return ROOM * 2 * (1 - threshold) / (1 + threshold) <= LOAD * (1 - np.exp(-1 / LOAD))


def bands(threshold: float) -> np.ndarray:
    """The largest size of each band; a set can only be similar to its own and the next lower band.
    One band is enough where every token has a segment."""
    if not several(threshold):
        return np.array([1 << 40])
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, int(np.floor((tops[-1] + 1) / threshold + 1e-9))))
    return np.array(tops)


def differ(larger: np.ndarray, smaller: np.ndarray, threshold: float) -> np.ndarray:
    return np.floor((1 - threshold) / (1 + threshold) * (larger + smaller) + 1e-9).astype(np.int64)


def signatures(tokens, row, size, rank: np.ndarray, threshold: float, fine: bool = False):
    """For the bands that sets belong to, then for those that they look into: (keys, rows,
    roles, bands, counts) of signatures, need per row, and the residual rows, which couldn't
    fill their units and must be compared otherwise (``fine``: a segment a token in every
    band, so there are none). counts: codes of the table ``rank``."""
    tops = np.array([1 << 40]) if fine else bands(threshold)
    own = np.searchsorted(tops, np.maximum(size, 1))
    code = rank[(tokens & np.uint64(len(rank) - 1)).astype(np.int64)]
    alone = (tops <= SINGLE) | (len(tops) == 1)
    for lower in (False, True):
        band = own - 1 if lower else own
        here = size > 0
        if lower:
            here &= (band >= 0) & (tops[np.maximum(band, 0)] >= threshold * size - 1e-9)
        at = np.flatnonzero(here[row])
        lone = alone[np.maximum(band, 0)][row[at]]
        for make, mine in ((_fine, at[lone]), (_coarse, at[~lone])):
            if len(mine):
                yield make(tokens[mine], row[mine], code[mine], size, np.maximum(band, 0), tops, threshold, lower)


def _fine(t, r, c, size, band, tops, threshold, lower):
    """A segment a token, with its place. t is in order within a row, so that equal costs go by token everywhere."""
    order = np.argsort((r.astype(np.uint64) << np.uint64(8)) | c.astype(np.uint64), kind="stable")
    r, t, c = r[order], t[order], c[order]
    new = np.ones(len(r), bool)
    new[1:] = r[1:] != r[:-1]
    place = np.arange(len(r)) - np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
    bottom = np.concatenate([[0], tops[:-1]])[band] + 1
    most = size - po.shared(size, np.maximum(bottom, np.ceil(threshold * size - 1e-9).astype(np.int64)), threshold)
    units = np.minimum(size, most + 1 + SPARE)
    # What the smaller of two sets needs is less.
    some = place < (units if lower else np.maximum(units, size - po.shared(size, size, threshold) + 1 + SPARE))[r]
    r, t, place = r[some], t[some], place[some]
    with np.errstate(over="ignore"):
        keys = tk.mix64(t ^ tk.mix64(band[r].astype(np.uint64) + np.uint64(0xA24BAED4963EE407)))
    return (keys, r, po.placed(place, size[r], threshold), band[r], c[some]), units - most, np.zeros(len(size), bool)


def _coarse(t, r, c, size, band, tops, threshold, lower):
    """Segments of several tokens, some with a one-deletion neighbourhood."""
    here = np.zeros(len(size), bool)
    here[r] = True
    top = tops[band]
    c = c.astype(np.int64) + 1
    parts = np.maximum(1, (LOAD * top).astype(np.int64))[r]
    with np.errstate(over="ignore"):
        salt = tk.mix64(band[r].astype(np.uint64) + np.uint64(0xA24BAED4963EE407))
        segment = (tk.mix64(t ^ salt) % parts.astype(np.uint64)).astype(np.int64)
    order = np.argsort((r.astype(np.uint64) << np.uint64(40)) | segment.astype(np.uint64))
    r, t, c, segment, salt = r[order], t[order], c[order], segment[order], salt[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (segment[1:] != segment[:-1])
    lead = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    count = np.diff(np.append(lead, len(r)))
    with np.errstate(over="ignore"):
        mixed = tk.mix64(t)
        total = np.add.reduceat(mixed, lead)
        place = tk.mix64(segment[lead].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt[lead])
        exact = tk.mix64(total ^ place)
    grow, low = r[lead], np.minimum.reduceat(c, lead)
    # A deletable segment: its neighbours less one token, and what looking them up costs.
    two = (segment[lead] % EVERY == 0) & (count > 1)
    less = np.flatnonzero(two[group])
    with np.errstate(over="ignore"):
        gone = tk.mix64((total[group[less]] - mixed[less]) ^ place[group[less]])
    ranked = np.where(c == low[group], 1 << 20, c)
    second = np.minimum.reduceat(ranked, lead)
    second = np.where(second == 1 << 20, low, second)
    double = np.where(two, low * (count - 1) + second, 0)
    # The cheapest units of each row: first looks at a segment, then second ones.
    unit_group = np.concatenate([np.arange(len(lead)), np.flatnonzero(two)])
    unit_cost = np.concatenate([low, np.maximum(double, low)[two]])
    is_second = np.arange(len(unit_group)) >= len(lead)
    urow = grow[unit_group]
    order = np.argsort((urow.astype(np.uint64) << np.uint64(40)) | (np.minimum(unit_cost, (1 << 38) - 1).astype(np.uint64) << np.uint64(1)) | is_second.astype(np.uint64))
    urow = urow[order]
    lead_unit = np.ones(len(urow), bool)
    lead_unit[1:] = urow[1:] != urow[:-1]
    rank_in = np.arange(len(urow)) - np.maximum.accumulate(np.where(lead_unit, np.arange(len(urow)), 0))
    most = differ(size, np.minimum(size, top), threshold)
    wanted = most + 1 + SPARE
    taken = order[rank_in < wanted[urow]]
    have = np.bincount(grow[unit_group[taken]], minlength=len(size))
    first_look, second_look = np.zeros(len(lead), bool), np.zeros(len(lead), bool)
    first_look[unit_group[taken[~is_second[taken]]]] = True
    second_look[unit_group[taken[is_second[taken]]]] = True
    role = np.where(second_look, po.PROBE2, np.where(first_look, po.PROBE, 0)) | (0 if lower else po.INDEX)
    gone_role = np.where(second_look[group[less]], po.PROBE_DEL, 0) | (0 if lower else po.INDEX_DEL)
    keys = np.concatenate([exact, gone])
    rows = np.concatenate([grow, r[less]])
    roles = np.concatenate([role, gone_role]).astype(np.uint8)
    some = roles > 0
    # What is left of a segment less its one cheapest token is as frequent as the second cheapest.
    cheap = c == low[group]
    fewer = np.where(cheap[less] & (np.add.reduceat(cheap.astype(np.int64), lead)[group[less]] == 1), second[group[less]], low[group[less]])
    codes = np.concatenate([low, fewer])[some] - 1
    return (keys[some], rows[some], roles[some], band[rows[some]], codes), have - most, here & (have <= most)


def layout(sizes: dict[int, int], threshold: float, fine: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(first bucket, buckets) of each band, from how many sets have which size."""
    tops = np.array([1 << 40]) if fine else bands(threshold)
    rows = np.zeros(len(tops) + 1)
    for size, count in sizes.items():
        own = int(np.searchsorted(tops, size))
        lone = len(tops) == 1 or tops[own] <= SINGLE
        rows[own] += ((1 - threshold) * size + 1 + SPARE if lone else 0.65 * size) * count
        rows[max(own - 1, 0)] += 0.4 * size * count if len(tops) > 1 else 0
    parts = np.array([po.bucket_count(int(r)) for r in rows])
    return np.cumsum(parts) - parts, parts


def scan(docs: DataFrame, n: int) -> DataFrame:
    """One pass: (doc_id, fp, fp2, size, sketch) of every text with a token, and (block, cells) of token counts."""
    def run(batches):
        counter = po.Counter()
        names = ["doc_id", "fp", "fp2", "size", "sketch", "block", "cells"]
        for batch in batches:
            for part in tk.slices(batch, "text"):
                tokens, row, rows = token_sets(part.column("text"), n)
                counter.add(tokens)
                fp, size, second = fingerprints(tokens, row, rows)
                some = size > 0
                ids = part.column("doc_id").cast(pa.int64()).filter(pa.array(some))
                k = len(ids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(fp[some]), pa.array(second[some]), pa.array(size[some], pa.int64()),
                                                  po.sketches(tokens, row, rows).filter(pa.array(some)),
                                                  pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        block, cells = counter.blocks()
        k = len(block)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(k, pa.int64())] * 4, pa.nulls(k, pa.list_(pa.int64())), pa.array(block, pa.int32()), pa.array(cells, pa.binary())], names)

    return docs.mapInArrow(run, "doc_id bigint, fp bigint, fp2 bigint, size bigint, sketch array<bigint>, block int, cells binary")


def emit(docs: DataFrame, n: int, threshold: float, rank, buckets: tuple[np.ndarray, np.ndarray], clash: list[int], fine: bool = False) -> DataFrame:
    """Packed signatures of every text's set, with the marks of documents if docs has a column ``mark``; rows of
    bucket -1 name residual sets."""
    marked = "mark" in docs.columns

    def run(batches):
        packer, table, (first, parts) = po.Packer(marked=marked), rank.value, buckets
        grids = po.grids(table)
        for batch in batches:
            for part in tk.slices(batch, "text"):
                tokens, row, rows = token_sets(part.column("text"), n)
                fp, size, _ = fingerprints(tokens, row, rows, clash)
                marks = np.asarray(part.column("mark").fill_null(po.NONE)) if marked else None
                for (keys, at, roles, band, codes), need, left in signatures(tokens, row, size, table, threshold, fine=fine):
                    went, keys = po.dealt(keys, fp[at], grids[codes])
                    at, roles, band = at[went], roles[went], band[went]
                    bucket = first[band] + (tk.mix64(keys) % parts[band].astype(np.uint64)).astype(np.int64)
                    yield from packer.add(keys, bucket, at, roles, fp, size, need, marks)
                    if left.any():
                        names = [x.split()[0] for x in (po.MARKED if marked else po.PACKED).split(", ")]
                        blobs = {"ids": fp[left].tobytes(), "sizes": size[left].astype(np.int32).tobytes()}
                        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *[pa.array([blobs.get(x, b"")], pa.binary()) for x in names[1:]]], names)
        yield from packer.flush()

    return docs.mapInArrow(run, po.MARKED if marked else po.PACKED)


def _packed(tokens: np.ndarray) -> bytes:
    """Tokens in six bytes each."""
    return tokens.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(blobs: list) -> np.ndarray:
    made = np.zeros((sum(len(x) for x in blobs) // 6, 8), np.uint8)
    made[:, :6] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    return made.view(np.uint64).reshape(-1)


def _jaccard(pairs: pa.Table, sets: pa.Table, threshold: float) -> pa.Table:
    """The tally of a task's pairs that reach the threshold. The commoner set of a pair is marked
    once and the others are looked up in it, all at once."""
    sets = sets.combine_chunks()
    fp, lead = np.unique(np.asarray(sets.column("fp")), return_index=True)
    column = sets.column("tokens").combine_chunks()
    size = np.asarray(pc.binary_length(column)).astype(np.int64)[lead] // 6
    flat = _unpacked([column[int(i)].as_buffer() for i in lead])
    _, token = np.unique(flat, return_inverse=True)
    start = np.cumsum(size) - size
    a, b = (np.searchsorted(fp, np.asarray(pairs.column(c))) for c in "ab")
    often = np.bincount(a, minlength=len(fp)) + np.bincount(b, minlength=len(fp))
    swap = (often[b] > often[a]) | ((often[b] == often[a]) & (b > a))
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    both, mark = np.zeros(len(a), np.int64), np.zeros(len(flat), np.int8)
    edge = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    for low, high in zip(edge, np.append(edge[1:], len(a))):
        own = token[start[a[low]]:start[a[low]] + size[a[low]]]
        mark[own] = 1
        at = low
        while at < high:
            n = size[b[at:high]]
            stop = at + max(1, int(np.searchsorted(np.cumsum(n), 4_000_000, side="right")))
            n = n[:stop - at]
            ends = np.cumsum(n)
            place = np.arange(ends[-1]) + np.repeat(start[b[at:stop]] - (ends - n), n)
            both[at:stop] = np.add.reduceat(mark[token[place]], ends - n, dtype=np.int64)
            at = stop
        mark[own] = 0
    value = both / np.maximum(size[a] + size[b] - both, 1)
    good = value >= threshold - 1e-12
    return po.tally(a[good], b[good], value[good], np.asarray(sets.column("doc_id"))[lead], np.asarray(sets.column("copies"))[lead])


def verify(docs: DataFrame, known: DataFrame, found: DataFrame, n: int, threshold: float, clash: list[int]) -> DataFrame:
    """The tallies of the candidate pairs at the threshold. known: (fp, doc_id, size, copies), a row a set."""
    placed, label = po.place(found, known, HELD)
    return po.gather(placed, payload(docs, label.select("fp", "doc_id", "copies", "cells"), n, clash), lambda x, y: _jaccard(x, y, threshold), po.LINKED)


def payload(docs: DataFrame, wanted: DataFrame, n: int, clash: list[int]) -> DataFrame:
    """wanted, a row (fp, doc_id, ...) a set, with its tokens; the texts aren't shuffled unless these are too many."""
    names = wanted.columns

    def tokens(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                t, row, rows = token_sets(part.column("text"), n)
                fp, size, _ = fingerprints(t, row, rows, clash)
                ends = np.cumsum(size)
                # A doc_id may have several texts, or a text twice; one of them has the set.
                mine = np.flatnonzero(fp == np.asarray(part.column("fp")))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(mine)) for c in names),
                     pa.array([_packed(t[ends[i] - size[i]:ends[i]]) for i in mine], pa.binary())], [*names, "tokens"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema.fields)
    return (docs.join(small(wanted.withColumnRenamed("doc_id", "_id"), NARROW_ROWS), F.col("doc_id") == F.col("_id")).select(*names, "text")
            .mapInArrow(tokens, kinds + ", tokens binary"))


def _matcher(threshold: float):
    """For ``postings.within``: Jaccard similarities of a row's set with those of a range of rows."""
    def matcher(table: pa.Table):
        column = table.column("tokens").combine_chunks()
        size = np.asarray(pc.binary_length(column)).astype(np.int64) // 6
        flat = _unpacked([x.as_buffer() for x in column])
        token = np.searchsorted(tk.distinct(flat), flat)
        # What one set alone has is in no other.
        shared = np.bincount(token)[token] > 1
        ends = np.concatenate([[0], np.cumsum(shared)])[np.concatenate([[0], np.cumsum(size)])]
        token = token[shared]
        mark = np.zeros(len(flat), np.int8)

        def match(a: int, low: int, high: int) -> np.ndarray:
            own = token[ends[a]:ends[a + 1]]
            mark[own] = 1
            total = np.cumsum(np.append(np.int8(0), mark[token[ends[low]:ends[high]]]), dtype=np.int32)
            mark[own] = 0
            at = ends[low:high + 1] - ends[low]
            both = total[at[1:]] - total[at[:-1]]
            value = both / np.maximum(size[a] + size[low:high] - both, 1)
            return np.where(value >= threshold - 1e-12, value, -1.0)

        return match

    return matcher


class _Sets:
    """What a join knows of the texts before it looks for pairs."""

    def __init__(self, docs: DataFrame, n: int, threshold: float):
        if not 0 < threshold <= 1 or n < 1:
            raise ValueError("threshold must be within (0, 1] and n at least 1")
        spark = ready(docs.sparkSession)
        self.n, self.threshold = n, threshold
        self.texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("text"))
        seen = scan(self.texts, n).checkpoint()
        self.rank = spark.sparkContext.broadcast(po.ranks(seen.filter("block IS NOT NULL").select("block", "cells")))
        own = seen.filter("fp IS NOT NULL").select("doc_id", "fp", "fp2", "size", "sketch")
        self.clash = po.clashes(own)
        self.own = po.settled(own, self.clash).select("doc_id", "fp", "size", "sketch")
        self.known = self.own.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.count_distinct("doc_id").alias("copies"),
                                                F.first("sketch").alias("sketch")).checkpoint()
        self.sizes = {r["size"]: r["count"] for r in self.own.groupBy("size").count().collect()}

    def families(self) -> tuple[DataFrame | None, DataFrame | None]:
        """(what ``postings.families`` gives, tallies that join each of them); None if there are none."""
        found = po.stars(self.known)
        if found.isEmpty():
            return None, None
        first = self.verified(found)
        family = po.families(self.own, self.known, first)
        return (None, None) if family.isEmpty() else (family, first)

    def verified(self, found: DataFrame) -> DataFrame:
        return verify(self.texts, self.known, found, self.n, self.threshold, self.clash).checkpoint()

    def within(self, family: DataFrame) -> DataFrame:
        """The tallies of all pairs of the same family."""
        sets = payload(self.texts, po.parted(family, HELD).select("fp", "doc_id", "copies", "mark", "g", "p").checkpoint(), self.n, self.clash)
        return po.within(sets, _matcher(self.threshold)).checkpoint()

    def linked(self, family: DataFrame | None) -> DataFrame:
        """The tallies of all pairs that reach the threshold, but those within a family."""
        threshold, texts = self.threshold, self.texts
        if family is not None:
            mark = self.own.select("doc_id", "fp").distinct().join(small(family.select("fp", "mark"), NARROW_ROWS), "fp").select(F.col("doc_id").alias("_id"), "mark")
            texts = texts.join(small(mark.checkpoint(), NARROW_ROWS), F.col("doc_id") == F.col("_id"), "left").drop("_id")

        def met(fine):
            packed = emit(texts, self.n, self.threshold, self.rank, layout(self.sizes, self.threshold, fine), self.clash, fine)
            return po.meetings(packed, lambda group: po.meet(group, threshold))

        if several(self.threshold):
            found = met(False).checkpoint()
            # Sets that couldn't fill their units; practically none. Then all sets meet by single tokens.
            if not found.filter("b IS NULL").isEmpty():
                found = met(True)
        else:
            found = met(True)
        found = po.enough(found).checkpoint()
        release(self.texts.sparkSession)
        return self.verified(found)


def similar(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links, jaccard), a row for each document that is similar to another:
    texts are lower-cased and cut at white space.

    links counts the other documents with a Jaccard similarity of at least the threshold, all of
    them, exactly, and jaccard is the highest. class_id is the least doc_id of those that links
    join the document to, over any number of steps. Documents without a link have no row. Null, empty
    and blank texts have no tokens and no row; rows without doc_id are left out; repeated
    rows of a doc_id count once; unlike texts of a doc_id are of one class, and their links add up; very
    long texts are read whole; other columns are ignored; an empty table gives an empty result.
    doc_id must be an integer."""
    sets = _Sets(docs, n, threshold)
    family, _ = sets.families()
    linked = sets.linked(family)
    if family is not None:
        linked = linked.union(sets.within(family))
    return po.classes(sets.own.select("doc_id", "fp"), sets.known, linked, 1.0).withColumnRenamed("best", "jaccard")


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id): the rows of ``similar`` without their links, for less.

    Who is in a class needs no count of its pairs, so those within a family, which is joined already,
    aren't compared; all others are, so that no two similar documents are in unlike classes."""
    sets = _Sets(docs, n, threshold)
    family, first = sets.families()
    linked = sets.linked(family)
    if family is not None:
        linked = linked.union(first)
    return po.classes(sets.own.select("doc_id", "fp"), sets.known, linked, 1.0).select("doc_id", "class_id")


#: See ``postings``.
groups = po.groups


def dropped(found: DataFrame) -> DataFrame:
    """(_drop): every document of a class but the least, marked for broadcast if few."""
    return small(found.filter("doc_id <> class_id").select(F.col("doc_id").alias("_drop")).checkpoint(), NARROW_ROWS)


def query(spark, sf_dir):
    from tideline.llm.common import read

    return similar(read(spark, sf_dir, "documents"))


def near_query(spark, sf_dir):
    """What the pipeline takes for near copies."""
    from tideline.llm.common import read

    return similar(read(spark, sf_dir, "documents"), N, NEAR)


def _oracle(threshold: float) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f]+') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' ')) END)) AS g FROM w WHERE len(w) > 0),
l AS MATERIALIZED (SELECT min(doc_id) AS doc_id, count(DISTINCT doc_id) AS copies, g FROM g GROUP BY g),
t AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM l),
p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
      FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id AND least(a.n, b.n) >= {threshold} * greatest(a.n, b.n) - 1e-9 GROUP BY ALL),
j AS MATERIALIZED (SELECT doc_a, doc_b, c / (na + nb - c) AS jaccard FROM p WHERE c / (na + nb - c) >= {threshold} - 1e-12),
e AS MATERIALIZED (SELECT doc_a AS x, doc_b AS y, jaccard FROM j UNION ALL SELECT doc_b, doc_a, jaccard FROM j),
r(x, y) AS (SELECT doc_id, doc_id FROM l UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
k AS (SELECT x, min(y) AS class_id FROM r GROUP BY x),
s AS (SELECT e.x, sum(l.copies) AS links, max(e.jaccard) AS jaccard FROM e JOIN l ON e.y = l.doc_id GROUP BY e.x)
SELECT g.doc_id, k.class_id, (coalesce(s.links, 0) + l.copies - 1)::BIGINT AS links,
  CASE WHEN l.copies > 1 THEN 1.0::DOUBLE ELSE s.jaccard END AS jaccard
FROM g JOIN l ON g.g = l.g JOIN k ON k.x = l.doc_id LEFT JOIN s ON s.x = l.doc_id WHERE coalesce(s.links, 0) + l.copies > 1
"""


ORACLE = _oracle(THRESHOLD)
NEAR_ORACLE = _oracle(NEAR)
