"""A packed self-join on signatures, counts of tokens in a table of fixed size, and classes.

``Packer`` turns (signature, document) rows into a few binary blobs per bucket of
signatures, eight bytes a row; ``meet`` sorts a bucket's rows and yields the documents
that met. Rows of a database table would take three times the space and a JVM object
each. Buckets are cut by rows, so a bucket's size is the same whatever the corpus; a
signature that the counts show to be hot is dealt to a grid of cells (see ``dealt``), so
no signature is one task.

Roles of a row (bits): INDEX a signature others may find; INDEX_DEL the same for a part
less one token; PROBE a look-up worth 1; PROBE2 one worth 2; PROBE_DEL a look-up of a
part less one token. A row with FLAG set has a place in place of roles (see ``placed``).
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import textkernel as tk
from tideline.llm.common import small

INDEX, INDEX_DEL, PROBE, PROBE2, PROBE_DEL = 1, 2, 4, 8, 16
KEY_BITS, DOC_BITS, ROLE_BITS = 41, 17, 6
#: Marks a row that is a single token; steps of its place.
FLAG, STEPS = 32, 32
#: Meetings asked for beyond the one that similar sets are sure to have.
SPARE = 2
PACKED = "bucket int, rows binary, ids binary, sizes binary, needs binary"
MARKED = PACKED + ", marks binary"
#: The mark of a document without a class.
NONE = np.iinfo(np.int64).min
#: Rows of one signature that a cell of the grid for hot ones holds, about.
HOT = 20_000
PAIRS = "a bigint, b bigint, w int, need int"


def bucket_count(rows: int, each: int = 3_000_000) -> int:
    """Buckets so that each has about that many rows."""
    return max(1, -(-rows // each))


def shared(larger: np.ndarray, smaller: np.ndarray, threshold: float) -> np.ndarray:
    """The tokens that two sets of these sizes have in common at least, to be similar."""
    return np.ceil(threshold / (1 + threshold) * (larger + smaller) - 1e-9).astype(np.int64)


def width(size: np.ndarray, threshold: float) -> np.ndarray:
    """The tokens of sets, in an order that all sets follow, among which are the first 1 + SPARE that they
    have in common with any similar set that isn't larger."""
    return np.maximum(1, size - shared(size, np.ceil(threshold * size - 1e-9), threshold) + 1 + SPARE)


def placed(place: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    """The role of a single token: its place in its set, rounded down to a STEPS-th of the set's width."""
    return (FLAG | np.minimum(place * STEPS // width(size, threshold), STEPS - 1)).astype(np.uint8)


class Packer:
    """Gathers signature rows and gives them out packed by bucket."""

    def __init__(self, rows: int = 500_000, marked: bool = False):
        self.limit, self.marked = rows, marked
        self._clear()

    def _clear(self):
        self.keys, self.buckets, self.docs, self.roles, self.ids, self.sizes, self.needs, self.marks = [], [], [], [], [], [], [], []
        self.rows = self.count = 0

    def add(self, keys, buckets, docs, roles, ids, sizes, needs, marks=None) -> Iterator[pa.RecordBatch]:
        """keys, buckets, docs, roles of rows, docs counting in ids, sizes, needs (needs: matches wanted)."""
        if self.count + len(ids) >= 1 << DOC_BITS or self.rows >= self.limit:
            yield from self.flush()
        if len(ids) >= 1 << DOC_BITS:
            raise ValueError("too many documents at once")
        self.keys.append(keys)
        self.buckets.append(buckets)
        self.docs.append(docs.astype(np.int64) + self.count)
        self.roles.append(roles)
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.needs.append(needs)
        self.marks.append(marks)
        self.rows += len(keys)
        self.count += len(ids)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            keys, bucket, docs, roles = (np.concatenate(x) for x in (self.keys, self.buckets, self.docs, self.roles))
            ids, sizes, needs = (np.concatenate(x) for x in (self.ids, self.sizes, self.needs))
            order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")
            short = keys >> np.uint64(64 - KEY_BITS)
            present, starts = np.unique(bucket[order], return_index=True)
            ends = np.append(starts, len(order))
            marks = np.concatenate(self.marks) if self.marked else None
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for n, b in enumerate(present.tolist()):
                at = order[ends[n]:ends[n + 1]]
                here = np.zeros(len(ids), bool)
                here[docs[at]] = True
                local = np.cumsum(here) - 1
                packed = (short[at] << np.uint64(DOC_BITS + ROLE_BITS)) | (local[docs[at]].astype(np.uint64) << np.uint64(ROLE_BITS)) | roles[at].astype(np.uint64)
                for x, y in zip(out, (b, packed.tobytes(), ids[here].astype(np.int64).tobytes(), sizes[here].astype(np.int32).tobytes(), np.clip(needs[here], 0, 255).astype(np.uint8).tobytes())):
                    x.append(y)
                if marks is not None:
                    out[5].append(marks[here].astype(np.int64).tobytes())
            some = 6 if self.marked else 5
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(x, pa.binary()) for x in out[1:some]]],
                                             ["bucket", "rows", "ids", "sizes", "needs", "marks"][:some])
        self._clear()


def meet(group: list[pa.RecordBatch], ratio: float, at_once: int = 400_000, most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """The pairs of a bucket: a the larger by (size, id), b the smaller with at least
    ratio times a's size; w the look-ups of a that found b, need what a wants. A quarter
    of the signatures at a time; sums are given out whenever ``most`` have gathered, so a
    pair may come more than once. Of marked documents only pairs of unlike marks. Single tokens
    count only where both sets have enough left from there on: of two similar sets' tokens in
    common, the first 1 + SPARE are no further than so many from the place where what is left
    is just what the two must share."""
    named = [b.column("ids")[i].as_buffer() for b in group for i in range(b.num_rows) if b.column("bucket")[i].as_py() < 0]
    if named:  # sets that need another way, passed on as (a, null, null, size)
        a = np.concatenate([np.frombuffer(x, np.int64) for x in named])
        size = np.concatenate([np.frombuffer(b.column("sizes")[i].as_buffer(), np.int32) for b in group for i in range(b.num_rows)])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32()), pa.array(size, pa.int32())], ["a", "b", "w", "need"])
        return
    blobs, base, ids, sizes, needs = _unpacked(group)
    marks = _marks(group)
    found, waiting, limit = [], 0, 2 * at_once

    def settled():
        return [_summed(*(np.concatenate(y) for y in zip(*found)))]

    for part in range(4):
        for x in _part(blobs, base, part, ids, sizes, needs, ratio, at_once, marks):
            found.append(x)
            waiting += len(x[0])
            if waiting > limit:  # the same pairs meet again and again
                found = settled()
                waiting = len(found[0][0])
                limit = 2 * (waiting + at_once)
                if waiting > most:
                    yield _given(*found[0])
                    found, waiting, limit = [], 0, 2 * at_once
    if found:
        yield _given(*settled()[0])


def _unpacked(group: list[pa.RecordBatch]):
    blobs, base, ids, sizes, needs = [], [0], [], [], []
    for batch in group:
        for row in zip(*(batch.column(c) for c in ("rows", "ids", "sizes", "needs"))):
            r, i, s, n = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, (np.uint64, np.int64, np.int32, np.uint8)))
            blobs.append(r)
            ids.append(i)
            sizes.append(s)
            needs.append(n)
            base.append(base[-1] + len(ids[-1]))
    return blobs, base, *(np.concatenate(x) for x in (ids, sizes, needs))


def _marks(group: list[pa.RecordBatch]) -> np.ndarray | None:
    if "marks" in group[0].schema.names:
        return np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for batch in group for x in batch.column("marks")])
    return None


def _before(start: np.ndarray, first: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """With each row, its pairs with the rows of its signature before it; of rows in order of their
    marks ``own``, with those up to where its mark begins."""
    here = np.arange(len(start))
    if own is not None:
        turn = start | (own == NONE)
        turn[1:] |= own[1:] != own[:-1]
        here = np.maximum.accumulate(np.where(turn, here, 0))
    return here - first


def _given(a, b, w, need) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.int32()), pa.array(need, pa.int32())], ["a", "b", "w", "need"])


def meet_first(group: list[pa.RecordBatch], share: float, at_once: int = 1_000_000, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """(a, b) ids of a bucket, a < b, that may have more than ``share`` of the sum of their sizes in
    common. Rows are tokens of a set in an order that all sets follow, and a row's role bits hold
    half its place in it. Two sets meet first at their first common token, from where on they can
    have no more in common than either has left; so where that is too little they aren't a pair,
    or met before. A pair may come more than once. Of marked documents only pairs of unlike marks."""
    blobs, base, ids, sizes, _ = _unpacked(group)
    marks = _marks(group)
    rows = np.concatenate(blobs)
    docs = np.concatenate([((x >> np.uint64(ROLE_BITS)) & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64) + b for x, b in zip(blobs, base)])
    del blobs
    keys, left = rows >> np.uint64(DOC_BITS + ROLE_BITS), sizes[docs] - 2 * (rows & np.uint64((1 << ROLE_BITS) - 1)).astype(np.int64)
    order = np.argsort(keys) if marks is None else np.lexsort((marks[docs], keys))
    keys, docs, left = keys[order], docs[order], left[order]
    start = np.ones(len(keys), bool)
    start[1:] = keys[1:] != keys[:-1]
    first = np.maximum.accumulate(np.where(start, np.arange(len(keys)), 0))
    place = _before(start, first, None if marks is None else marks[docs])
    total, low, found, waiting = np.concatenate([[0], np.cumsum(place)]), 0, [], 0
    while low < len(keys):
        high = max(low + 1, int(np.searchsorted(total, total[low] + at_once, side="right")) - 1)
        n = place[low:high]
        x = np.repeat(np.arange(low, high), n)
        y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + first[x]
        low = high
        dx, dy = docs[x], docs[y]
        good = (np.minimum(left[x], left[y]) > share * (sizes[dx] + sizes[dy]) - 1e-9) & (ids[dx] != ids[dy])
        if good.any():
            p, q = ids[dx[good]], ids[dy[good]]
            found.append(_once(np.minimum(p, q), np.maximum(p, q)))
            waiting += len(found[-1][0])
            if waiting > most:
                yield _pairs(*_once(*(np.concatenate(z) for z in zip(*found))))
                found, waiting = [], 0
    if found:
        yield _pairs(*_once(*(np.concatenate(z) for z in zip(*found))))


def _once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _part(blobs, base, part, ids, sizes, needs, ratio, at_once, marks):
    """The summed pairs of the signatures whose upper two bits are part, chunk by chunk."""
    mine = [x[x >> np.uint64(62) == part] for x in blobs]
    keys = np.concatenate([x >> np.uint64(DOC_BITS + ROLE_BITS) for x in mine])
    lone = np.sort(keys)
    twice = lone[1:][lone[1:] == lone[:-1]]
    if not len(twice):
        return
    del lone, keys
    # Few signatures are there twice; a bit table of them lets most rows go before sorting rows.
    bits = np.zeros(1 << 22, bool)
    bits[(twice & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
    kept = [x[bits[((x >> np.uint64(DOC_BITS + ROLE_BITS)) & np.uint64((1 << 22) - 1)).astype(np.int64)]] for x in mine]
    docs = np.concatenate([((x >> np.uint64(ROLE_BITS)) & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64) + b for x, b in zip(kept, base)])
    rows = np.concatenate(kept)
    del mine, kept
    keys, roles = rows >> np.uint64(DOC_BITS + ROLE_BITS), (rows & np.uint64((1 << ROLE_BITS) - 1)).astype(np.uint8)
    order = np.argsort(keys)
    keys, docs, roles = keys[order], docs[order], roles[order]
    met = np.zeros(len(keys), bool)
    met[1:] = keys[1:] == keys[:-1]
    met[:-1] |= met[1:]
    keys, docs, roles = keys[met], docs[met], roles[met]
    # Copies (one id) that share a signature count once: the id's first row of a role.
    again = np.lexsort((roles, ids[docs], keys) if marks is None else (roles, ids[docs], marks[docs], keys))
    keys, docs, roles = keys[again], docs[again], roles[again]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (ids[docs[1:]] != ids[docs[:-1]]) | (roles[1:] != roles[:-1])
    keys, docs, roles = keys[fresh], docs[fresh], roles[fresh]
    start = np.ones(len(keys), bool)
    start[1:] = keys[1:] != keys[:-1]
    first = np.maximum.accumulate(np.where(start, np.arange(len(keys)), 0))
    place = _before(start, first, None if marks is None else marks[docs])
    total, low = np.concatenate([[0], np.cumsum(place)]), 0
    while low < len(keys):
        high = max(low + 1, int(np.searchsorted(total, total[low] + at_once, side="right")) - 1)
        n = place[low:high]
        x = np.repeat(np.arange(low, high), n)
        y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + first[x]
        low = high
        dx, dy = docs[x], docs[y]
        swap = (sizes[dx] < sizes[dy]) | ((sizes[dx] == sizes[dy]) & (ids[dx] < ids[dy]))
        big, less = np.where(swap, y, x), np.where(swap, x, y)
        da, db, ra, rb = docs[big], docs[less], roles[big], roles[less]
        w = np.where(rb & INDEX, (ra & PROBE) // PROBE + (ra & PROBE2) // PROBE2 * 2 + (ra & PROBE_DEL) // PROBE_DEL, 0)
        w = w + np.where((rb & INDEX_DEL) > 0, (ra & PROBE2) // PROBE2, 0)
        lone = np.flatnonzero(ra & rb & FLAG)
        if len(lone):
            w[lone] = _early(ra[lone], rb[lone], sizes[da[lone]], sizes[db[lone]], ratio)
        good = (w > 0) & (ids[da] != ids[db]) & (sizes[db] >= ratio * sizes[da] - 1e-9)
        if good.any():
            da, db = da[good], db[good]
            yield _summed(ids[da], ids[db], w[good].astype(np.int64), needs[da].astype(np.int32))


def _early(ra, rb, larger, smaller, threshold) -> np.ndarray:
    """Whether the places of a token in two sets let it be one of their first 1 + SPARE in common."""
    least = shared(larger, smaller, threshold)
    good = np.ones(len(ra), bool)
    for role, size in ((ra, larger), (rb, smaller)):
        size = size.astype(np.int64)
        good &= (role & np.uint8(STEPS - 1)).astype(np.int64) * width(size, threshold) <= STEPS * (size - least + SPARE)
    return good


def _summed(a, b, w, need):
    key = tk.mix64(a.astype(np.uint64)) + b.astype(np.uint64)
    order = np.argsort(key)
    key, a, b, w, need = key[order], a[order], b[order], w[order], need[order]
    new = np.ones(len(a), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return a[at], b[at], np.add.reduceat(w, at), np.minimum.reduceat(need, at)


def meetings(packed: DataFrame, run, schema: str = PAIRS) -> DataFrame:
    """What ``run`` (see ``meet``, ``meet_first``) makes of each bucket."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(list(batches))

    return packed.groupBy("bucket").applyInArrow(each, schema)


def dealt(keys: np.ndarray, ids: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): where the rows of signatures go. A hot signature's rows are split into g parts
    by their id, and each goes to the g cells that pair its part with one of all, so that every
    two rows meet in some cell and a cell holds about 2 * HOT rows (see ``grids``)."""
    hot = np.flatnonzero(g > 1)
    if not len(hot):
        return np.arange(len(keys)), keys
    n = g[hot]
    row = np.repeat(hot, n)
    other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        mine = (tk.mix64(ids[row].astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) % g[row].astype(np.uint64)).astype(np.int64)
        cell = np.minimum(mine, other) * g[row] + np.maximum(mine, other)
        made = tk.mix64(keys[row] + tk.mix64(cell.astype(np.uint64) + np.uint64(1)))
    cold = np.flatnonzero(g <= 1)
    return np.concatenate([cold, row]), np.concatenate([keys[cold], made])


def grids(rank: np.ndarray) -> np.ndarray:
    """Parts of a signature by the code of its count in the table of ``ranks``; what a cell holds
    at the median is of other signatures and not counted."""
    count = np.exp2(np.arange(256) / SCALE)
    return np.maximum(1, np.ceil((count - 2 * count[int(np.median(rank))]) / HOT)).astype(np.int64)


def enough(met: DataFrame) -> DataFrame:
    """(a, b): the pairs whose look-ups over all buckets reach what a wants."""
    met = met.filter("b IS NOT NULL")
    return met.groupBy("a", "b").agg(F.sum("w").alias("w"), F.min("need").alias("need")).filter("w >= need").select("a", "b")


def place(found: DataFrame, known: DataFrame, held: int) -> tuple[DataFrame, DataFrame]:
    """Tasks for candidate pairs. found: (a, b); known: (fp, size, ...), a row each.

    Pairs are gathered by the least candidate of their sets, so that what a cluster needs
    is sent once; a cluster whose sizes add up to more than ``held`` is cut into a grid of
    tasks. Returns (a, b, cell), and known for those in a pair with a label and the cells
    that need them."""
    both = found.select(F.col("a").alias("fp"), F.col("b").alias("o")).union(found.select("b", "a"))
    label = both.groupBy("fp").agg(F.least(F.col("fp"), F.min("o")).alias("label")).join(known, "fp").checkpoint()
    la, lb = (label.select(F.col("fp").alias(c), F.col("label").alias("l" + c)) for c in "ab")
    keyed = found.join(la, "a").join(lb, "b").select("a", "b", F.least("la", "lb").alias("key"))
    # Most sets of a cluster have its key as their label, so labels tell its size without another pass over pairs.
    grid = label.groupBy(F.col("label").alias("key")).agg(F.ceil(F.sum("size") / F.lit(held / 2)).cast("int").alias("g"))
    part = lambda c: F.pmod(F.hash(F.col(c), F.lit(7)), F.col("g"))
    # Two cells of one hash are one task, which is as well.
    cell = F.xxhash64("key", F.least(part("a"), part("b")), F.greatest(part("a"), part("b")))
    placed = keyed.join(grid, "key").select("a", "b", cell.alias("cell")).checkpoint()
    needed = placed.select("cell", F.col("a").alias("fp")).union(placed.select("cell", "b"))
    return placed, label.join(needed.groupBy("fp").agg(F.collect_set("cell").alias("cells")), "fp").checkpoint()


def gather(placed: DataFrame, payload: DataFrame, compare, schema: str) -> DataFrame:
    """compare(pairs, payload rows of their sets) of each task. payload: (fp, cells, ...), a row each, shuffled once."""
    sent = payload.withColumn("_cell", F.explode("cells")).drop("cells")
    return placed.groupBy("cell").cogroup(sent.groupBy("_cell")).applyInArrow(compare, schema)


#: Groups of at least so many alike sets are found by sketches and kept out of the search.
FAMILY = 64
#: A sketch has two hashes for each band, of the least and of the greatest tokens in its bins.
BANDS, BINS = 4, 3


def sketches(tokens: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """A list of 2 * BANDS hashes a row; tokens (48 bits) in order within a row. Two sets have a bin's least
    token in common as often as they are similar, and so its greatest, so nearly all of a group of near
    copies have some band in common with most of it. 0 stands for a band with an empty bin."""
    place = ((tokens * np.uint64(BANDS * BINS)) >> np.uint64(48)).astype(np.int64)
    lead = np.ones(len(row), bool)
    lead[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
    made = np.zeros((rows, 2, BANDS), np.uint64)
    for side, at in enumerate((lead, np.roll(lead, -1))):
        held = np.zeros((rows, BANDS, BINS), np.uint64)
        held.reshape(rows, -1)[row[at], place[at]] = tokens[at] + np.uint64(1)
        with np.errstate(over="ignore"):
            for k in range(BINS):
                made[:, side] = tk.mix64(made[:, side] * np.uint64(3) + held[:, :, k])
        made[:, side][(held == 0).any(axis=2)] = 0
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * (2 * BANDS)), pa.array(made.view(np.int64).reshape(-1)))


def stars(known: DataFrame) -> DataFrame:
    """(a, b): of each hash that at least FAMILY sets' sketches have, the least set with each other.
    known: (fp, sketch), a row a set."""
    each = known.select("fp", F.posexplode("sketch").alias("band", "value")).filter("value <> 0")
    heavy = each.groupBy("band", "value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter(F.col("n") >= FAMILY).drop("n")
    return each.join(small(heavy.checkpoint()), ["band", "value"]).select("a", F.col("fp").alias("b")).filter("a <> b").distinct().checkpoint()


def families(own: DataFrame, known: DataFrame, first: DataFrame) -> DataFrame:
    """(fp, doc_id, size, copies, mark): the sets of groups of at least FAMILY that the tallies ``first``
    join, mark being the least doc_id of the group. A doc_id's several texts are left out."""
    label = groups(first.filter("doc_id <> root").select(F.col("root").alias("doc_a"), F.col("doc_id").alias("doc_b")).distinct())
    large = label.groupBy("least").agg(F.count("*").alias("n")).filter(F.col("n") >= FAMILY).select("least")
    several = own.groupBy("doc_id").agg(F.min("fp").alias("m"), F.max("fp").alias("x")).filter("m <> x").select("doc_id")
    mixed = own.join(several, "doc_id").select("fp").distinct()
    return (known.join(small(label.join(large, "least").checkpoint()), "doc_id").join(small(mixed.checkpoint()), "fp", "left_anti")
            .select("fp", "doc_id", "size", "copies", F.col("least").alias("mark")).checkpoint())


def parted(family: DataFrame, held: int) -> DataFrame:
    """family with g, the parts that its group is cut into, so that two hold about ``held``, and p, the set's part."""
    count = family.groupBy("mark").agg(F.ceil(F.sum("size") / F.lit(held / 2)).cast("int").alias("g"))
    return family.join(small(count.checkpoint()), "mark").withColumn("p", F.pmod(F.hash("fp", F.lit(7)), "g"))


def within(payload: DataFrame, matcher) -> DataFrame:
    """The tallies of all pairs of each group. payload: (fp, doc_id, copies, mark, g, p, ...), a row a set.

    A task has two parts of a group. matcher(rows) gives a function of (a, low, high): the value of row a with each
    of the rows from low to high, below 0 if they aren't linked."""
    def compare(table: pa.Table) -> pa.Table:
        # A text that is there twice has its set twice.
        _, lead = np.unique(np.asarray(table.column("fp")), return_index=True)
        table = table.take(pa.array(lead)).sort_by("p").combine_chunks()
        p, copies, ids = (np.asarray(table.column(c)) for c in ("p", "copies", "doc_id"))
        n, cut = len(p), int(np.searchsorted(p, p[-1]))
        match, alone = matcher(table), table.column("i")[0].as_py() == table.column("j")[0].as_py()
        links, best = np.zeros(n, np.int64), np.zeros(n)
        for a in range(n if alone else cut):
            low = a + 1 if alone else cut
            value = match(a, low, n)
            good = value >= 0
            links[a] += copies[low:][good].sum()
            links[low:] += good * copies[a]
            best[a] = max(best[a], value.max(initial=0))
            np.maximum(best[low:], value, out=best[low:])
        some = links > 0
        return pa.table({"doc_id": pa.array(ids[some], pa.int64()), "root": pa.array(np.asarray(table.column("mark"))[some], pa.int64()),
                         "links": pa.array(links[some]), "best": pa.array(best[some])})

    cells = payload.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).withColumn("i", F.least("p", "q")).withColumn("j", F.greatest("p", "q"))
    return cells.groupBy("mark", "i", "j").applyInArrow(compare, LINKED)


CELL_BITS, BLOCK_BITS = 22, 16
#: Steps of a code to a doubling: of a task's count, and of the sum's.
FINE, SCALE = 16, 8


class Counter:
    """Counts tokens by their low bits; given out as blocks of one byte a cell, a logarithm."""

    def __init__(self, bits: int = CELL_BITS):
        self.bits, self.cells, self.waiting, self.count = bits, np.zeros(1 << bits, np.uint32), [], 0

    def add(self, tokens: np.ndarray) -> None:
        self.waiting.append((tokens & np.uint64((1 << self.bits) - 1)).astype(np.uint32))
        self.count += len(tokens)
        if self.count > len(self.cells):
            self._settle()

    def _settle(self) -> None:
        if self.count:
            self.cells += np.bincount(np.concatenate(self.waiting), minlength=len(self.cells)).astype(np.uint32)
        self.waiting, self.count = [], 0

    def blocks(self) -> tuple[list[int], list[bytes]]:
        self._settle()
        size = min(1 << BLOCK_BITS, len(self.cells))
        small = np.minimum(255, np.rint(FINE * np.log2(1.0 + self.cells))).astype(np.uint8).reshape(-1, size)
        return list(range(len(small))), [x.tobytes() for x in small]


def ranks(blocks: DataFrame, bits: int = CELL_BITS) -> np.ndarray:
    """From (block, cells) rows of many Counters, one byte a cell: the sum's logarithm.

    The table has 2 ** bits bytes whatever the corpus."""
    def add(table: pa.Table) -> pa.Table:
        count = np.rint(np.exp2(np.arange(256) / FINE) - 1)
        total = sum(count[np.frombuffer(x, np.uint8)] for x in table.column("cells").to_pylist())
        scaled = np.minimum(255, np.round(SCALE * np.log2(1.0 + total))).astype(np.uint8)
        return pa.table({"block": table.column("block")[:1].cast(pa.int32()), "cells": pa.array([scaled.tobytes()], pa.binary())})

    made = np.zeros(1 << bits, np.uint8)
    size = min(1 << BLOCK_BITS, 1 << bits)
    for row in blocks.groupBy("block").applyInArrow(add, "block int, cells binary").collect():
        made[row["block"] * size:(row["block"] + 1) * size] = np.frombuffer(row["cells"], np.uint8)
    return made


#: Bits of a place in the table of ``noted``, and of a place in one of its blocks.
NOTE_BITS, NOTE_BLOCK = 25, 16
#: Rows that ``joined`` broadcasts.
FEW = 10_000


def _noted_at(ids: np.ndarray) -> np.ndarray:
    return (tk.mix64(ids.astype(np.uint64)) >> np.uint64(64 - NOTE_BITS)).astype(np.int64)


def noted(rows: DataFrame) -> np.ndarray:
    """A bit for each hash that an fp of rows has: 4 MB whatever the rows."""
    def places(batches):
        for batch in batches:
            at = _noted_at(np.asarray(batch.column("fp")))
            yield pa.RecordBatch.from_arrays([pa.array((at >> NOTE_BLOCK).astype(np.int32)), pa.array((at & ((1 << NOTE_BLOCK) - 1)).astype(np.int32))], ["block", "place"])

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << NOTE_BLOCK, bool)
        bits[np.asarray(table.column("place"))] = True
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    made = np.zeros(1 << (NOTE_BITS - 3), np.uint8)
    size = 1 << (NOTE_BLOCK - 3)
    for row in rows.select("fp").mapInArrow(places, "block int, place int").groupBy("block").applyInArrow(pack, "block int, bits binary").collect():
        made[row["block"] * size:(row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return made


def joined(sets: DataFrame, narrow: DataFrame, how: str = "inner", rows: int | None = None) -> DataFrame:
    """sets joined to narrow, which is cheap to count, by fp. Where narrow has too many rows for a broadcast (the driver
    makes it) only the sets that it may have are shuffled, by a bit table."""
    rows = FEW if rows is None else rows
    if narrow.limit(rows + 1).count() <= rows:
        return sets.join(F.broadcast(narrow), "fp", how)
    bits = sets.sparkSession.sparkContext.broadcast(noted(narrow))

    def part(there: bool):
        def run(batches):
            table = bits.value
            for batch in batches:
                at = _noted_at(np.asarray(batch.column("fp")))
                yield batch.filter(pa.array(((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool) == there))
        return sets.mapInArrow(run, sets.schema)

    made = part(True).join(narrow, "fp", how)
    return made.unionByName(part(False), allowMissingColumns=True) if how == "left" else made


def groups(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(doc_id, least): each document of (doc_a, doc_b) edges with the least doc_id that
    edges join it to. Each round takes the least label among neighbours and then that
    label's own label, so long chains halve; ends when nothing changes."""
    both = edges.select(F.col("doc_a").alias("doc_id"), F.col("doc_b").alias("other")).union(edges.select("doc_b", "doc_a")).distinct().checkpoint()
    label = both.groupBy("doc_id").agg(F.least(F.col("doc_id"), F.min("other")).alias("least")).checkpoint()
    for _ in range(rounds):
        near = both.join(label.select(F.col("doc_id").alias("other"), F.col("least").alias("l")), "other").groupBy("doc_id").agg(F.min("l").alias("l"))
        step = label.join(near, "doc_id").select("doc_id", F.least("least", "l").alias("least"), F.col("least").alias("old"))
        jump = step.join(label.select(F.col("doc_id").alias("least"), F.col("least").alias("next")), "least", "left")
        made = jump.select("doc_id", F.least("least", F.coalesce("next", "least")).alias("least"), "old").checkpoint()
        label = made.select("doc_id", "least")
        if made.filter("least <> old").isEmpty():
            return label
    raise RuntimeError("groups didn't settle")


def clashes(own: DataFrame) -> list[int]:
    """The values of fp that rows of unlike fp2 share: of 2 ** 32 sets about one pair."""
    made = own.groupBy("fp").agg(F.min("fp2").alias("m"), F.max("fp2").alias("x")).filter("m <> x")
    return sorted(r["fp"] for r in made.select("fp").collect())


def settled(own: DataFrame, clash: list[int]) -> DataFrame:
    """own with fp2 in place of fp where fp is one of clash."""
    return own.withColumn("fp", F.when(F.col("fp").isin(clash), F.col("fp2")).otherwise(F.col("fp"))) if clash else own


LINKED = "doc_id bigint, root bigint, links bigint, best double"


def tally(a: np.ndarray, b: np.ndarray, value: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> pa.Table:
    """A task's linked pairs as a row for each of its members: (doc_id, root, links, best). a, b
    count in ids; root is the least id that pairs of the task join a member to."""
    n = len(ids)
    links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
    best = np.zeros(n)
    np.maximum.at(best, a, value)
    np.maximum.at(best, b, value)
    order = np.argsort(ids, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    p, q, label = place[a], place[b], np.arange(n)
    while len(p):
        before = label.copy()
        low = np.minimum(label[p], label[q])
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        label = label[label]
        if (label == before).all():
            break
    some = np.flatnonzero(links > 0)
    root = ids[order][label[place[some]]]
    return pa.table({"doc_id": pa.array(ids[some], pa.int64()), "root": pa.array(root, pa.int64()),
                     "links": pa.array(links[some].astype(np.int64)), "best": pa.array(best[some], pa.float64())})


def classes(own: DataFrame, known: DataFrame, linked: DataFrame, most: float) -> DataFrame:
    """(doc_id, class_id, links, best) of the documents with a link.

    own: (doc_id, fp), rows of documents; known: (fp, doc_id, copies), a row a set with its least
    doc_id; linked: rows of ``tally`` for these. Copies are links of value ``most``. Sets of
    one doc_id are of one class, and its links add up."""
    edges = linked.filter("doc_id <> root").select(F.col("root").alias("doc_a"), F.col("doc_id").alias("doc_b"))
    # A doc_id with several texts ties their sets.
    several = own.groupBy("doc_id").agg(F.min("fp").alias("m"), F.max("fp").alias("x")).filter("m <> x").select("doc_id", "m").checkpoint()
    if not several.isEmpty():
        ids = known.select("fp", F.col("doc_id").alias("r"))
        tied = own.join(several, "doc_id").select("fp", "m").distinct().filter("fp <> m")
        edges = edges.union(tied.join(ids, "fp").withColumnRenamed("r", "doc_a").join(ids.withColumnRenamed("fp", "m").withColumnRenamed("r", "doc_b"), "m")
                            .filter("doc_a <> doc_b").select("doc_a", "doc_b"))
    label = groups(edges.distinct())
    each = linked.groupBy("doc_id").agg(F.sum("links").alias("l"), F.max("best").alias("b"))
    sets = (known.join(each, "doc_id", "left").join(label, "doc_id", "left")
            .select("fp", F.coalesce("least", "doc_id").alias("class_id"), (F.coalesce("l", F.lit(0)) + F.col("copies") - 1).alias("links"),
                    F.when(F.col("copies") > 1, F.lit(float(most))).otherwise(F.col("b")).alias("best")).filter("links > 0"))
    return (own.distinct().join(sets, "fp").groupBy("doc_id")
            .agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"), F.max("best").alias("best")))
