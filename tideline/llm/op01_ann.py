"""Approximate nearest neighbours by cross-polytope hashing.

A table turns unit vectors by a pseudo-random rotation (three rounds of random signs and
a fast Hadamard transform) and gives each the nearest signed axis, ``depth`` times over
with rotations of its own: 2 * dimension cells to the power of depth. A query looks into
the cells that its own turned coordinates make likeliest (multiprobe), in every table.
What it finds there is ranked by the exact cosine.

Every vector is indexed; queries are a stated set. A table's cells are cut into shards of
about SHARD vectors; a vector goes to one shard a table, a query, with the list of its
cells there, to each shard that it probes. Counts of both tell where a shard is heavier
than that (a cell that many near copies share); its vectors and queries are dealt to a grid
of tasks, all of which meet. Of equal vectors only those of the lowest ids can be among a
query's best, so no more go on. Tables, probes and depth are the same at every size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import ready, small

K, SEED = 10, 5
#: Similarities that single precision can't tell apart.
CLOSE = np.float32(1e-5)
#: Set for a recall of 0.9 and more on small tables of vectors without structure, the hardest case.
TABLES, PROBES, DEPTH = 12, 512, 2
#: Vectors and queries of a task.
SHARD, QUERIES = 65_536, 16_384
#: Queries of the registered search: ids divisible by this.
EVERY = 50


def hadamard(x: np.ndarray) -> np.ndarray:
    """Each row times the normalised Hadamard matrix; the width is a power of two."""
    rows, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(rows, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, d)
        h *= 2
    return x / np.float32(np.sqrt(d))


def rotate(x: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    r = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * r.choice(np.array([-1, 1], np.float32), x.shape[1]))
    return x


def axes(turned: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The signed axes nearest to each row, best first, and their coordinates."""
    both = np.concatenate([turned, -turned], axis=1)
    order = np.argsort(-both, axis=1, kind="stable")[:, :most]
    return order, np.take_along_axis(both, order, axis=1)


def cells(x: np.ndarray, table: int, depth: int, probes: int, seed: int = SEED) -> np.ndarray:
    """(rows, probes): the cells that each row probes in a table; its own is the first."""
    width = 2 * x.shape[1]
    each = min(width, probes)
    found, value = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.float32)
    for level in range(depth):
        axis, at = axes(rotate(x, (seed, table, level)), each)
        found = (found[:, :, None] * width + axis[:, None, :]).reshape(len(x), -1)
        value = (value[:, :, None] + at[:, None, :]).reshape(len(x), -1)
        if probes < value.shape[1]:
            some = np.argpartition(-value, probes - 1, axis=1)[:, :probes]
            found, value = np.take_along_axis(found, some, axis=1), np.take_along_axis(value, some, axis=1)
        best = np.argsort(-value, axis=1, kind="stable")
        found, value = np.take_along_axis(found, best, axis=1), np.take_along_axis(value, best, axis=1)
    return found


def unit(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept, vectors): unit vectors, padded with zeros to a power of two, of the rows that
    have the dimension, only finite numbers and a length above 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    kept = np.asarray(column.value_lengths().fill_null(-1)) == dimension
    flat = column.filter(pa.array(kept)).flatten().cast(pa.float64())
    x = np.asarray(flat.fill_null(np.nan) if flat.null_count else flat, np.float64).reshape(-1, dimension)
    norm = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    kept[np.flatnonzero(kept)[~good]] = False
    width = 1 << max(0, int(np.ceil(np.log2(dimension))))
    out = np.zeros((int(good.sum()), width), np.float32)
    out[:, :dimension] = x[good] / norm[good][:, None]
    return kept, out


def nearest(own: int, cells_: np.ndarray, q: np.ndarray, home: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, repeated: bool) -> np.ndarray:
    """Rows of x (ordered by their cell, home) in a query's cells that may be of its k best other ids: a
    place for each id, and all that single precision can't tell from the k-th."""
    low, high = np.searchsorted(home, cells_), np.searchsorted(home, cells_, side="right")
    n = high - low
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - n), n)
    at = at[ids[at] != own]
    if not len(at):
        return at
    s = x[at] @ q
    each = s
    if repeated:  # the best of an id's rows counts
        order = np.argsort(ids[at], kind="stable")
        at, s = at[order], s[order]
        each = np.maximum.reduceat(s, np.flatnonzero(np.append(True, ids[at][1:] != ids[at][:-1])))
    if len(each) > k:
        at = at[s >= np.partition(each, len(each) - k)[len(each) - k] - CLOSE]
    return at


def neighbours(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, tables: int = TABLES, probes: int = PROBES, depth: int = DEPTH) -> DataFrame:
    """(vec_id, rank, neighbour_id, similarity): up to k others among vectors by cosine, rank from 1,
    for each vec_id of queries (all of vectors if not given).

    Equal similarities are ordered by neighbour_id. Left out, as queries and as
    neighbours: null ids, null vectors, vectors with a null, NaN or infinite number, of
    length 0, or not of the most frequent dimension of vectors (the larger of equals). Rows of one vec_id aren't each
    other's neighbours and share one result. A query may have fewer than k neighbours
    if its cells hold fewer. Other columns are ignored; empty tables give an empty result. vec_id must be an
    integer."""
    if k < 1:
        raise ValueError("k must be at least 1")

    ready(vectors.sparkSession)

    def usable(rows):
        return rows.filter("vec_id IS NOT NULL AND size(embedding) > 0").select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")

    own = usable(vectors)
    sizes = own.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dimension, count = (sizes[0]["d"], sizes[0]["count"]) if sizes else (1, 0)
    asked = (own if queries is None else usable(queries)).filter(F.size("embedding") == dimension).distinct()
    # Of equal vectors the k lowest ids, and one more for a query that is one of them: Spark limits groups before the shuffle.
    place = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    own = own.filter(F.size("embedding") == dimension).distinct().withColumn("_n", place).filter(F.col("_n") <= k + 1).drop("_n")
    width = 1 << max(0, int(np.ceil(np.log2(dimension))))
    space = (2 * width) ** depth
    probes = min(probes, space)
    shards = max(1, min(space, -(-count // SHARD)))

    def members(bare):
        def run(batches):
            for batch in batches:
                kept, x = unit(batch.column("embedding"), dimension)
                ids, raw = np.asarray(batch.column("vec_id"))[kept], pa.array([row.tobytes() for row in x], pa.binary())
                for table in range(tables if len(x) else 0):
                    home = cells(x, table, depth, 1)[:, 0]
                    key = [pa.array(np.full(len(x), table), pa.int32()), pa.array(home * shards // space, pa.int64())]
                    yield pa.RecordBatch.from_arrays(key if bare else [*key, pa.array(ids), pa.array(home, pa.int64()), raw],
                                                     ["t", "shard"] if bare else ["t", "shard", "vec_id", "home", "v"])
        return own.mapInArrow(run, "t int, shard bigint" + ("" if bare else ", vec_id bigint, home bigint, v binary"))

    def askers(bare):
        def run(batches):
            for batch in batches:
                kept, x = unit(batch.column("embedding"), dimension)
                ids, raw = np.asarray(batch.column("vec_id"))[kept], [row.tobytes() for row in x]
                for table in range(tables if len(x) else 0):
                    probed = np.sort(cells(x, table, depth, probes), axis=1)
                    shard = probed * shards // space
                    new = np.ones(shard.shape, bool)
                    new[:, 1:] = shard[:, 1:] != shard[:, :-1]
                    flat, starts = probed.reshape(-1), np.flatnonzero(new.reshape(-1))
                    row = starts // probed.shape[1]
                    key = [pa.array(np.full(len(row), table), pa.int32()), pa.array(shard.reshape(-1)[starts], pa.int64())]
                    yield pa.RecordBatch.from_arrays(
                        key if bare else [*key, pa.array(ids[row]), pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)), pa.int32()), pa.array(flat, pa.int64())),
                                          pa.array([raw[i] for i in row], pa.binary())],
                        ["t", "shard"] if bare else ["t", "shard", "vec_id", "probed", "v"])
        return asked.mapInArrow(run, "t int, shard bigint" + ("" if bare else ", vec_id bigint, probed array<bigint>, v binary"))

    # The few shards with more than a task's vectors or queries.
    load = members(True).groupBy("t", "shard").agg(F.count("*").alias("m")).join(askers(True).groupBy("t", "shard").agg(F.count("*").alias("q")), ["t", "shard"])
    grid = small(load.filter((F.col("m") > 2 * SHARD) | (F.col("q") > 2 * QUERIES))
                 .select("t", "shard", F.ceil(F.col("m") / SHARD).cast("int").alias("gm"), F.ceil(F.col("q") / QUERIES).cast("int").alias("gq")).checkpoint())

    def spread(rows, mine, other):
        part = lambda g, name: F.when(F.col(name).isNull(), F.lit(0)).otherwise(g)
        at = part(F.pmod(F.xxhash64("vec_id"), F.col(mine)).cast("int"), mine)
        return (rows.join(grid, ["t", "shard"], "left").withColumn("_a", at)
                .withColumn("_b", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))).drop("gm", "gq"))

    held = spread(members(False), "gm", "gq").withColumnsRenamed({"_a": "i", "_b": "j"})
    probing = spread(askers(False), "gq", "gm").withColumnsRenamed({"_a": "j", "_b": "i"})

    def look(probing: pa.Table, held: pa.Table) -> pa.Table:
        out = pa.schema([("vec_id", pa.int64()), ("neighbour_id", pa.int64()), ("similarity", pa.float64())])
        if not len(probing) or not len(held):
            return out.empty_table()
        order = np.argsort(np.asarray(held.column("home")), kind="stable")
        home, ids = np.asarray(held.column("home"))[order], np.asarray(held.column("vec_id"))[order]
        x = np.frombuffer(b"".join(held.column("v").to_pylist()), np.float32).reshape(len(ids), width)[order]
        asks = np.asarray(probing.column("vec_id"))
        y = np.frombuffer(b"".join(probing.column("v").to_pylist()), np.float32).reshape(len(asks), width)
        probed = probing.column("probed").combine_chunks()
        ends = np.append(0, np.cumsum(np.asarray(probed.value_lengths())))
        flat, repeated = np.asarray(probed.flatten()), len(np.unique(ids)) < len(ids)
        found = [nearest(asks[i], flat[ends[i]:ends[i + 1]], y[i], home, x, ids, k, repeated) for i in range(len(asks))]
        q, m = np.repeat(np.arange(len(asks)), [len(f) for f in found]), np.concatenate(found)
        s = np.concatenate([np.einsum("ij,ij->i", y[q[i:i + 65536]].astype(np.float64), x[m[i:i + 65536]].astype(np.float64))
                            for i in range(0, len(q), 65536)] or [np.zeros(0)]).round(9)
        # An id's best row with each other id, then its k best here.
        order = np.lexsort((-s, ids[m], asks[q]))
        q, m, s = asks[q[order]], ids[m[order]], s[order]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (m[1:] != m[:-1])
        q, m, s = q[fresh], m[fresh], s[fresh]
        order = np.lexsort((m, -s, q))
        q, m, s = q[order], m[order], s[order]
        top = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
        return pa.table([pa.array(q[top]), pa.array(m[top]), pa.array(s[top])], schema=out)

    key = ("t", "shard", "i", "j")
    met = probing.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(look, "vec_id bigint, neighbour_id bigint, similarity double")
    met = met.groupBy("vec_id", "neighbour_id").agg(F.max("similarity").alias("similarity"))
    better = met.groupBy("vec_id").agg(F.sort_array(F.collect_set(F.struct((-F.col("similarity")).alias("s"), F.col("neighbour_id").alias("n")))).alias("all"))
    return (better.select("vec_id", F.posexplode(F.slice("all", 1, k)).alias("rank", "b"))
            .select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("b.n").alias("neighbour_id"), (-F.col("b.s")).alias("similarity")))


def query(spark, sf_dir):
    """The neighbours, among all vectors, of those whose id is divisible by EVERY."""
    from tideline.llm.common import read

    vectors = read(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
