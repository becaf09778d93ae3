"""Each operator against brute force, an exact round trip or held-out accuracy."""

import heapq
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import (op01_ann, op02_secrets, op03_fingerprints, op04_html, op05_mixing, op06_sharding, op07_quality,
                          op08_pii, op09_jaccard, op10_packing, postings, textkernel)
from tideline.llm.common import read

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, DIR, "documents").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# --- the text kernel

@given(st.lists(st.text(alphabet="aé b\n\tß", max_size=12), max_size=8))
@settings(max_examples=80, deadline=None)
def test_words_are_those_of_split(texts):
    data, offsets = textkernel.buffer(pa.array(texts, pa.string()))
    starts, stops, row = textkernel.spans(data, offsets)
    found = [(int(r), bytes(data[a:b]).decode()) for a, b, r in zip(starts, stops, row)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in t.split()]
    hashes = textkernel.range_hashes(data, starts, stops)
    assert len({(w, int(h)) for (_, w), h in zip(found, hashes)}) == len({w for _, w in found}) == len(set(hashes.tolist()))


def test_slices_cover_a_batch_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (0, 5, 100, 3, 0, 7)] + [None])], ["text"])
    parts = list(textkernel.slices(batch, "text", 10))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()
    assert list(textkernel.slices(batch.slice(0, 0), "text")) == []


# --- 1

@pytest.mark.parametrize("sf,every", [("0.001", 1), ("0.01", 5), ("0.1", op01_ann.EVERY)])
def test_neighbours_recall_and_order(spark, sf, every):
    """With the settings that every search has."""
    table = read(spark, f"/root/testdata/sf{sf}", "embeddings")
    rows = table.collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.flatnonzero(ids % every == 0)
    sims = x[asked] @ x.T
    sims[np.arange(len(asked)), asked] = -2
    want = {int(ids[i]): set(ids[np.argsort(-s)[:10]].tolist()) for i, s in zip(asked, sims)}
    value = {int(ids[i]): dict(zip(ids.tolist(), s.tolist())) for i, s in zip(asked, sims)}
    got = defaultdict(list)
    found = op01_ann.neighbours(table, table.filter(table["vec_id"] % every == 0)) if every != op01_ann.EVERY else op01_ann.query(spark, f"/root/testdata/sf{sf}")
    for r in found.collect():
        got[r["vec_id"]].append((r["rank"], r["neighbour_id"], r["similarity"]))
        assert abs(r["similarity"] - value[r["vec_id"]][r["neighbour_id"]]) < 1e-5
    for own in got.values():
        own.sort()
        assert [f[0] for f in own] == list(range(1, len(own) + 1))
        assert all(a[2] >= b[2] for a, b in itertools.pairwise(own))
    assert got.keys() == want.keys()
    recall = np.mean([len({f[1] for f in got[i]} & w) / 10 for i, w in want.items()])
    assert recall >= 0.9, (sf, recall)


def test_heavy_shards_meet_whole(spark, monkeypatch):
    """Near copies in a few cells, dealt to a grid of tasks: the same result as in one."""
    r = np.random.default_rng(2)
    x = np.concatenate([np.ones((150, 8)) + r.normal(0, 0.01, (150, 8)), r.normal(size=(60, 8))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, op01_ann.neighbours(table).collect()))
    monkeypatch.setattr(op01_ann, "SHARD", 20)
    monkeypatch.setattr(op01_ann, "QUERIES", 15)
    assert sorted(map(tuple, op01_ann.neighbours(table).collect())) == whole and len(whole) == 2100


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16)).astype(np.float32)
    assert np.allclose(np.linalg.norm(op01_ann.rotate(x, (1, 2)), axis=1), np.linalg.norm(x, axis=1), atol=1e-4)
    assert np.allclose(op01_ann.hadamard(op01_ann.hadamard(x)), x, atol=1e-5)
    cells = op01_ann.cells(x, 0, 2, 20)
    assert cells.shape == (5, 20) and all(len(set(c)) == 20 for c in cells.tolist()) and cells.max() < 32 ** 2


# --- 3

def _plain_score(a, b):
    before = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        before = row
    return 100 - (100 * (len(a) + len(b) - 2 * before[-1])) // max(1, len(a) + len(b))


@given(st.lists(st.tuples(st.lists(st.integers(0, 5), max_size=64), st.lists(st.integers(0, 5), max_size=64)), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_edit_scores(pairs):
    a, la = op03_fingerprints._padded(pa.array([p[0] for p in pairs], pa.list_(pa.int32())), 64)
    b, lb = op03_fingerprints._padded(pa.array([p[1] for p in pairs], pa.list_(pa.int32())), 64)
    assert op03_fingerprints.score(a, b, la, lb).tolist() == [_plain_score(*p) for p in pairs]


def _classes(links, copies):
    """{doc: (class, links, best)} from {(rep, rep): value} and {rep: docs}; a copy has value ``links['copy']``."""
    same = links.pop("copy")
    parent = {r: r for r in copies}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    count, best = {r: len(c) - 1 for r, c in copies.items()}, {r: same if len(c) > 1 else 0 for r, c in copies.items()}
    for (a, b), v in links.items():
        x, y = sorted((root(a), root(b)))
        parent[y] = x
        for p, q in ((a, b), (b, a)):
            count[p] += len(copies[q])
            best[p] = max(best[p], v)
    return {i: (root(r), count[r], best[r]) for r, c in copies.items() for i in c if count[r]}


def _fingerprint_classes(rows, least):
    """Every two fingerprints of compatible block sizes, by plain edit distance alone."""
    copies = defaultdict(list)
    for r in rows:
        copies[(r["k"], tuple(r["first"]), tuple(r["second"]))].append(r["doc_id"])
    links = {"copy": 100}
    for (ka, ia), (kb, ib) in itertools.combinations([(k, min(c)) for k, c in copies.items()], 2):
        best = 0
        for x, lx in ((ka[1], ka[0]), (ka[2], ka[0] + 1)):
            for y, ly in ((kb[1], kb[0]), (kb[2], kb[0] + 1)):
                if lx == ly and min(len(x), len(y)) >= op03_fingerprints.FEWEST and 2 * min(len(x), len(y)) >= (least - 1) / 100 * (len(x) + len(y)) and set(x) & set(y):
                    best = max(best, _plain_score(x, y))
        if best >= least:
            links[(ia, ib)] = best
    return _classes(links, {min(c): c for c in copies.values()})


@pytest.mark.parametrize("least,rows,hot", [(60, 3_000_000, 20_000), (60, 2_000, 3), (35, 3_000_000, 20_000)])
def test_fingerprint_search_is_exact(docs, monkeypatch, least, rows, hot):
    """With one bucket, and cut to many, with the commonest chunks dealt to grids."""
    monkeypatch.setattr(postings, "HOT", hot)
    monkeypatch.setattr(postings, "bucket_count", lambda n, each=rows: max(1, -(-n // each)))
    want = _fingerprint_classes(op03_fingerprints.fingerprints(docs).collect(), least)
    assert {r["doc_id"]: (r["class_id"], r["links"], r["score"]) for r in op03_fingerprints.search(docs, least).collect()} == want and want


def test_chunks_follow_content(spark):
    r = np.random.default_rng(3)
    text = " ".join("".join(r.choice(list("abcdefgh"), 6)) for _ in range(600))
    rows = spark.createDataFrame([(1, text), (2, "Some words come first. " + text), (3, text[::-1])], "doc_id long, text string")
    found = {r["doc_id"]: (r["class_id"], r["links"], r["score"] > 90) for r in op03_fingerprints.search(rows).collect()}
    assert found == {1: (1, 1, True), 2: (1, 1, True)}


@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 64)), min_size=1, max_size=30), st.integers(2, 100))
@settings(max_examples=100, deadline=None)
def test_prefixes_hold_the_first_common_chunk(sizes, least):
    for a, b in sizes:
        need = int(np.floor(op03_fingerprints.part_of_sum(least) * (a + b) + 1e-9)) + 1
        if need <= min(a, b):
            assert a - need < op03_fingerprints.prefix(np.array([a]), least)[0] and b - need < op03_fingerprints.prefix(np.array([b]), least)[0]


def test_clashing_fingerprints_stay_apart(spark):
    own = spark.createDataFrame([(1, 5, 50), (2, 5, 51), (3, 6, 60), (4, 6, 60)], "doc_id long, fp long, fp2 long")
    assert postings.clashes(own) == [5]
    assert sorted(r["fp"] for r in postings.settled(own, [5]).collect()) == [6, 6, 50, 51]


# --- 4

def test_html_content_against_the_article(spark):
    pages = read(spark, DIR, "pages")
    right = wrong = missed = 0
    got = {r["page_id"]: r for r in op04_html.extract(pages).collect()}
    for p in pages.collect():
        article = re.search("<article>(.*)</article>", p["html"], re.DOTALL).group(1)
        want = Counter(b[0] for b in op04_html.blocks(article))
        kept = Counter(got[p["page_id"]]["text"].split("\n")) if got[p["page_id"]]["text"] else Counter()
        right += sum((want & kept).values())
        wrong += sum((kept - want).values())
        missed += sum((want - kept).values())
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_html_blocks_of_odd_markup():
    b = op04_html.blocks
    assert b("<p>a <b>b</b> c<p>d <a href='x>y'>e f</a>") == [("a b c", 3, 0), ("d e f", 3, 2)]
    assert b("1 < 2 <p>x &amp; y<br>z</p><!-- <p>no</p> --><script>if (a<b) {}</script>t") == [("1 < 2", 3, 0), ("x & y z", 4, 0), ("t", 1, 0)]
    assert b("a<script>never closed <p>b") == [("a", 1, 0)] and b("a<!-- open <p>b") == [("a", 1, 0)]
    assert b("") == [] and b("<<<") != [] and b("<div></div>") == [] and b("<p title=\"x") == []


def test_tree_learns_its_table():
    x, y = op04_html.LABELLED[:, :-1], op04_html.LABELLED[:, -1]
    assert ((op04_html.tree().predict(x) >= 0.5) == y).mean() > 0.95


# --- 5

def test_counts_have_the_rate(spark):
    rows = spark.range(20000).selectExpr("id AS doc_id", "'abcd' AS text", "IF(id % 2 = 0, 'a', 'b') AS source")
    counts = Counter(r["source"] for r in op05_mixing.mix(rows, weights={"a": 3, "b": 1}).collect())
    assert abs(counts["a"] - 15000) < 500 and abs(counts["b"] - 5000) < 300
    each = Counter(Counter(r["doc_id"] for r in op05_mixing.mix(rows, weights={"a": 3, "b": 1}).filter("source = 'a'").collect()).values())
    for k in range(1, 5):  # Poisson of 1.5
        p = np.exp(-1.5) * 1.5 ** k / np.prod(np.arange(1, k + 1))
        assert abs(each[k] / 10000 - p) < 0.02


def test_large_rates_add_up(spark):
    rows = spark.createDataFrame([(i, "x" * (1 if i < 5 else 2000), "rare" if i < 5 else "rest") for i in range(50)], "doc_id long, text string, source string")
    made = Counter(r["source"] for r in op05_mixing.mix(rows, weights={"rare": 1, "rest": 99}).collect())
    rate = {r["source"]: r["rate"] for r in op05_mixing.rates(rows, {"rare": 1, "rest": 99}).collect()}
    assert rate["rare"] > op05_mixing.RATE_A_DRAW and abs(made["rare"] / 5 - rate["rare"]) < 5 * np.sqrt(rate["rare"] / 5) + 1


# --- 6

def _one_by_one(sizes, shards):
    heap = [(0, i) for i in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, i = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, i))
    return sorted(load for load, _ in heap)


@given(st.lists(st.integers(1, 12), max_size=120), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_bulk_schedule_has_the_heaps_loads(sizes, shards):
    ranges, loads = op06_sharding.schedule(list(Counter(sizes).items()), shards)
    assert sorted(loads) == _one_by_one(sizes, shards)
    got = Counter((s, k) for s, lo, hi, _ in ranges for k in range(lo, hi + 1))
    assert got == Counter((s, k) for s, n in Counter(sizes).items() for k in range(1, n + 1))


def test_shards_keep_copies_together(docs, texts):
    rows = op06_sharding.shard(docs, 7).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    shard_of, load, size = {}, Counter(), {}
    for r in rows:
        assert shard_of.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
        size[texts[r["doc_id"]]] = r["group_size"]
        load[r["shard"]] += max(1, len(texts[r["doc_id"]]))
    assert sorted(load[i] for i in range(7)) == _one_by_one(size.values(), 7)


# --- 7

def test_quality_on_labels_held_out(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    x, y = op07_quality.sample(docs, labels)
    half = np.arange(len(y)) % 2 == 0
    model = op07_quality.fit(x[half], y[half])
    kept = model.score(x[~half]) >= model.threshold
    assert kept[y[~half] == 1].mean() > 0.98 and kept[y[~half] == 0].mean() < 0.1
    assert len(op07_quality.sample(docs, labels, 50)[1]) == 50


def test_pairs_carry_what_single_features_cannot():
    r = np.random.default_rng(0)
    x = r.random((4000, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = op07_quality.fit(x[:3000], y[:3000])
    assert (1, 2) in model.pairs
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95
    single = op07_quality.fit(x[:3000], y[:3000], pairs=0)
    assert ((single.score(x[3000:]) >= 0.5) == y[3000:]).mean() < 0.7


def test_margin_is_the_sum_of_bins():
    r = np.random.default_rng(1)
    x, y = r.random((300, 3)), r.integers(0, 2, 300)
    m = op07_quality.fit(x, y, 5, 5, 2)
    for row in x[:20]:
        total = m.intercept + sum(t[np.searchsorted(e, v, side="right")] for t, e, v in zip(m.tables, m.edges, row))
        for (a, b), t in zip(m.pairs, m.pair_tables):
            total += t[np.searchsorted(m.pair_edges[a], row[a], side="right"), np.searchsorted(m.pair_edges[b], row[b], side="right")]
        assert abs(total - m.margin(row[None])[0]) < 1e-9


# --- 8

PRIVATE = re.compile(r"[A-Za-z0-9.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<!\d)\d{16}(?!\d)|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])", re.IGNORECASE)


def test_private_data_of_documents(spark):
    rows = {r["doc_id"]: r["text"] for r in read(spark, "/root/testdata/sf0.01", "documents").collect()}
    got = {r["doc_id"]: r for r in op08_pii.redact(read(spark, "/root/testdata/sf0.01", "documents")).collect()}
    wanted = found = given_ = 0
    for i, text in rows.items():
        want = {m.span() for m in PRIVATE.finditer(text)}
        spans = {(s["start"], s["stop"]) for s in got[i]["redactions"]} if i in got else set()
        wanted, found, given_ = wanted + len(want), found + len(want & spans), given_ + len(spans)
        if i in got:
            assert all(m.group() not in got[i]["text"] for m in PRIVATE.finditer(text))
    assert found / wanted > 0.98 and found / given_ > 0.95


def test_pii_scores_are_calibrated_and_disjoint():
    model = op08_pii.train()
    x, y = op08_pii.training(seed=99, each=20)
    s = model.score(x)
    chosen = s >= model.thresholds[x[:, :len(op08_pii.KINDS)].argmax(axis=1)]
    assert y[chosen].mean() > 0.9 and chosen[y == 1].mean() > 0.95
    for low, high in ((0.0, 0.1), (0.9, 1.01)):
        near = (s >= low) & (s < high)
        assert abs(y[near].mean() - s[near].mean()) < 0.05
    text = "write to ann.b@uni.example.org or +1 (555) 555-1234, card 4556 7375 8689 9855; version 1.2.3.4 of order 12345678"
    spans = op08_pii.choose(text, model)
    assert [text[a:b] for a, b, _, _ in spans] == ["ann.b@uni.example.org", "+1 (555) 555-1234", "4556 7375 8689 9855"]
    assert [k for _, _, k, _ in spans] == ["email", "phone", "card"]


# --- 9

def _sets(texts, n):
    made = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        if w:
            made[i] = frozenset([" ".join(w)] if len(w) < n else [" ".join(w[k:k + n]) for k in range(len(w) - n + 1)])
    return made


def _similar(texts, n, t):
    copies = defaultdict(list)
    for i, s in _sets(texts, n).items():
        copies[s].append(i)
    links = {"copy": 1.0}
    for (a, x), (b, y) in itertools.combinations(copies.items(), 2):
        j = len(a & b) / len(a | b)
        if j >= t:
            links[(min(x), min(y))] = j
    return _classes(links, {min(c): c for c in copies.values()})


@pytest.mark.parametrize("n,t,rows,hot", [(2, 0.7, 3_000_000, 20_000), (2, 0.7, 3_000, 3), (1, 0.5, 3_000_000, 20_000), (2, 0.5, 3_000, 3), (3, 0.9, 3_000_000, 20_000), (2, 0.3, 3_000_000, 20_000)])
def test_jaccard_join_is_exact(docs, texts, monkeypatch, n, t, rows, hot):
    monkeypatch.setattr(postings, "HOT", hot)
    monkeypatch.setattr(postings, "bucket_count", lambda m, each=rows: max(1, -(-m // each)))
    found = op09_jaccard.similar(docs, n, t).collect()
    got = {r["doc_id"]: (r["class_id"], r["links"], r["jaccard"]) for r in found}
    want = _similar(texts, n, t)
    assert len(found) == len(got)
    assert got.keys() == want.keys() and all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-12 for k in want) and want


@pytest.mark.parametrize("n,t,rows,hot", [(2, 0.5, 3_000_000, 20_000), (2, 0.5, 3_000, 3), (2, 0.7, 3_000_000, 20_000), (1, 0.4, 3_000_000, 20_000)])
def test_classes_are_those_of_all_links(docs, texts, monkeypatch, n, t, rows, hot):
    monkeypatch.setattr(postings, "HOT", hot)
    monkeypatch.setattr(postings, "bucket_count", lambda m, each=rows: max(1, -(-m // each)))
    assert {r["doc_id"]: r["class_id"] for r in op09_jaccard.classes(docs, n, t).collect()} == {k: v[0] for k, v in _similar(texts, n, t).items()}


def test_classes_of_chains_and_groups(spark):
    """Each copy is like its neighbours alone; a group has one centre; some ids have unlike texts."""
    r = np.random.default_rng(9)
    words = [f"w{i}" for i in range(400)]
    rows = [(1000 + k, " ".join(words[6 * k:6 * k + 30])) for k in range(50)]
    base = [f"g{i}" for i in range(80)]
    rows += [(2000 + k, " ".join(w if r.random() > 0.06 else f"x{k}{i}" for i, w in enumerate(base))) for k in range(60)] + [(1001, " ".join(base)), (3000, "apart from all others"), (2001, rows[7][1])]
    found = {x["doc_id"]: x["class_id"] for x in op09_jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), 1, 0.5).collect()}
    copies = defaultdict(list)
    for i, s in ((i, frozenset(t.split())) for i, t in rows):
        copies[s].append(i)
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations([(i, set(t.split())) for i, t in rows], 2):
        if len(a[1] & b[1]) >= 0.5 * len(a[1] | b[1]):
            x, y = sorted((root(a[0]), root(b[0])))
            parent[y] = x
    assert found == {i: root(i) for i in parent if i != 3000}


def test_sets_without_enough_segments_meet_by_single_tokens(docs, texts, monkeypatch):
    """LOAD so low that sets can't fill their units."""
    monkeypatch.setattr(op09_jaccard, "LOAD", 0.3)
    monkeypatch.setattr(op09_jaccard, "several", lambda t: True)
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in op09_jaccard.similar(docs, 2, 0.7).collect()}
    assert got == {k: v[:2] for k, v in _similar(texts, 2, 0.7).items()}


def test_signatures_find_every_similar_pair():
    """Random sets over a small universe, where common tokens abound."""
    r = np.random.default_rng(7)
    for trial in range(12):
        t = [0.5, 0.7, 0.85][trial % 3]
        sets = []
        for _ in range(40):
            base = set(r.integers(0, 60 if trial % 2 else 4000, r.integers(1, 220)).tolist())
            sets.append(base)
            sets.append({x for x in base if r.random() > 0.12} | set(r.integers(0, 4000, 3).tolist()))
        sets = [s for s in sets if s]
        tokens = np.concatenate([np.sort(textkernel.mix64(np.array(sorted(s), np.uint64)) >> np.uint64(16)) for s in sets])
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        fp, size, _ = op09_jaccard.fingerprints(tokens, row, len(sets))
        counter = postings.Counter(10)
        counter.add(tokens)
        counter._settle()
        rank = np.minimum(255, np.log2(1.0 + counter.cells) * postings.SCALE).astype(np.uint8)
        packer, batches, left = postings.Packer(), [], set()
        for (keys, at, roles, _, codes), need, residual in op09_jaccard.signatures(tokens, row, size, rank, t):
            went, keys = postings.dealt(keys, fp[at], postings.grids(rank)[codes] if trial < 6 else codes % 3 + 1)
            batches += packer.add(keys, (keys % np.uint64(4)).astype(np.int64), at[went], roles[went], fp, size, need)
            left |= set(fp[residual].tolist())
        batches += packer.flush()
        table = pa.Table.from_batches(batches)
        met, need = Counter(), {}
        for b in range(4):
            own = table.filter(pa.compute.equal(table.column("bucket"), b))
            if own.num_rows:
                for made in postings.meet(own.to_batches(), t):
                    for a, c, w, n in zip(*(x.to_pylist() for x in made.columns)):
                        met[(a, c)] += w
                        need[(a, c)] = n
        found = {k for k, w in met.items() if w >= need[k]}
        for i, j in itertools.combinations(range(len(sets)), 2):
            if fp[i] != fp[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= t:
                a, c = max((size[i], fp[i]), (size[j], fp[j])), min((size[i], fp[i]), (size[j], fp[j]))
                assert (int(a[1]), int(c[1])) in found or int(a[1]) in left


def test_groups_are_connected_components(spark):
    r = np.random.default_rng(5)
    edges = [(int(min(a, b)), int(max(a, b))) for a, b in r.integers(0, 60, (40, 2)) if a != b] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["doc_id"]: r["least"] for r in op09_jaccard.groups(spark.createDataFrame(edges, "doc_a long, doc_b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e}


# --- 10

@given(st.lists(st.integers(1, 30), max_size=80))
@settings(max_examples=150, deadline=None)
def test_runs_use_every_piece_once(lengths):
    found = op10_packing.runs(dict(Counter(lengths)), 30)
    used = Counter()
    for pattern, times in found:
        assert times > 0 and sum(pattern) <= 30
        for length in pattern:
            used[length] += times
    assert used == Counter(lengths)
    bins = sum(t for _, t in found)
    open_ = []  # plain best-fit decreasing, one by one
    for length in sorted(lengths, reverse=True):
        fits = [i for i, gap in enumerate(open_) if gap >= length]
        if fits:
            best = min(fits, key=lambda i: open_[i])
            open_[best] -= length
        else:
            open_.append(30 - length)
    assert bins <= len(open_) * 1.25 + 1


def test_exact_complements_come_first():
    assert sum(t for _, t in op10_packing.runs({7: 4, 3: 4}, 10)) == 4
    assert sum(t for _, t in op10_packing.runs({6: 1, 3: 1, 1: 1}, 10)) == 1
    assert op10_packing.runs({4: 1, 3: 1, 2: 1, 1: 1}, 10) == [((4, 3, 2, 1), 1)]
    stock = op10_packing.Stock({5: 1, 2: 1}, 10)
    assert stock.pair(10) is None and stock.pair(7) == (5, 2) and stock.triple(9) is None


def test_packing_is_a_round_trip(docs, texts):
    rows = op10_packing.pack(docs, 128).collect()
    fill, seen, slots = Counter(), defaultdict(list), set()
    for r in rows:
        fill[r["sequence"]] += r["n_tokens"]
        seen[r["doc_id"]].append((r["start"], r["n_tokens"]))
        assert (r["sequence"], r["slot"]) not in slots
        slots.add((r["sequence"], r["slot"]))
    assert max(fill.values()) <= 128 and sorted(fill) == list(range(len(fill)))
    for i, text in texts.items():
        at = 0
        for start, n in sorted(seen.get(i, [])):
            assert start == at
            at += n
        assert at == len(text.split())
