"""Large groups of near copies: out of the search, compared all with all, none of their links lost."""

import random
from collections import Counter

import numpy as np
import pytest

from tideline.llm import op03_fingerprints, op09_jaccard, postings


@pytest.fixture(scope="module")
def copies():
    """Two groups of near copies, with exact copies and a row that is there twice, a few that link to a group's
    edge only, and others."""
    rng, texts = random.Random(5), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    for size in (60, 40):
        base = [word() for _ in range(80)]
        for _ in range(size):
            made = list(base)
            for _ in range(rng.choice([1, 2, 2, 3, 9, 12])):
                made[rng.randrange(80)] = word()
            texts.append(" ".join(made))
    texts += [" ".join(word() for _ in range(50)) for _ in range(30)]
    return [*enumerate(texts), (900, texts[3]), (901, texts[3]), (902, texts[70]), (5, texts[5]), (950, texts[8]), (950, texts[120])]


def _brute(rows, n, t):
    """{doc_id: (links, best)}, rows of a doc_id with unlike texts adding up."""
    def grams(text):
        w = text.split()
        return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))

    docs = {(i, grams(text)) for i, text in rows}
    ids = {}
    for i, s in docs:
        ids.setdefault(s, set()).add(i)
    out = {}
    for s, mine in ids.items():
        value = {x: len(s & x) / len(s | x) for x in ids if x != s}
        good = [x for x, v in value.items() if v >= t - 1e-12]
        links = sum(len(ids[x]) for x in good) + len(mine) - 1
        best = 1.0 if len(mine) > 1 else max((value[x] for x in good), default=0)
        for i in mine:
            if links:
                a, b = out.get(i, (0, 0))
                out[i] = (a + links, max(b, best))
    return out


@pytest.mark.parametrize("t, held", [(0.5, 1_000_000), (0.7, 2000)])
def test_pairs_of_a_family_stay_out_of_the_search(spark, copies, monkeypatch, t, held):
    met, enough = [], postings.enough

    def counted(found):
        made = enough(found).checkpoint()
        met.append(made.count())
        return made

    monkeypatch.setattr(postings, "enough", counted)
    monkeypatch.setattr(postings, "FAMILY", 12)
    monkeypatch.setattr(op09_jaccard, "HELD", held)
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    found = {r["doc_id"]: (r["class_id"], r["links"], r["jaccard"]) for r in op09_jaccard.similar(docs, 2, t).collect()}
    assert {k: (v[1], pytest.approx(v[2])) for k, v in found.items()} == _brute(copies, 2, t)
    assert {r["doc_id"]: r["class_id"] for r in op09_jaccard.classes(docs, 2, t).collect()} == {k: v[0] for k, v in found.items()}
    # All pairs of the two groups are some 2,500; the sets far from all others still meet.
    assert len(met) == 2 and max(met) < 1300


def test_texts_are_not_shuffled_for_a_table_of_ids(spark):
    docs = spark.range(300_000).selectExpr("id AS doc_id", "'a b' AS text")
    wanted = spark.range(200_000).selectExpr("id AS fp", "id AS doc_id", "1L AS copies").checkpoint()
    plan = op09_jaccard.payload(docs, wanted, 2, [])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    drop = op09_jaccard.dropped(spark.range(600_000).selectExpr("id + 1 AS doc_id", "0L AS class_id"))
    plan = docs.join(drop, docs["doc_id"] == drop["_drop"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_tokens_are_shuffled_once_in_six_bytes(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('a b c ', id) AS text").checkpoint()
    sets = op09_jaccard._Sets(docs, 2, 0.5)
    found = sets.known.selectExpr("min(fp) AS a", "max(fp) AS b")
    plan = op09_jaccard.verify(sets.texts, sets.known, found, 2, 0.5, [])._jdf.queryExecution().executedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert above.count("Exchange hashpartitioning") == 2 and "Join" not in above  # those of the pairs and of the tokens
    wanted = sets.known.select("fp", "doc_id", "copies")
    assert {len(r["tokens"]) for r in op09_jaccard.payload(sets.texts, wanted, 2, []).collect()} == {18}


def test_sketches_join_nearly_all_of_a_group():
    rng, rows = np.random.default_rng(7), 200
    base = rng.integers(0, 1 << 48, 400, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(400) < 0.12, rng.integers(0, 1 << 48, 400, dtype=np.uint64), base)) for _ in range(rows)]
    made = postings.sketches(np.concatenate(sets), np.repeat(np.arange(rows), [len(x) for x in sets]), rows).to_pylist()
    common = [Counter(x).most_common(1)[0] for x in zip(*made)]
    assert sum(any(v == c for v, (c, n) in zip(x, common)) for x in made) >= 0.98 * rows


def test_fingerprints_of_a_family_stay_out_of_the_search(spark, monkeypatch):
    rng, texts = random.Random(6), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    for size, words in ((50, 80), (30, 230)):
        base = [word() for _ in range(words)]
        for _ in range(size):
            made = list(base)
            for _ in range(rng.choice([1, 2, 3, 12])):
                made[rng.randrange(words)] = word()
            texts.append(" ".join(made + [word() for _ in range(rng.choice([0, 0, 20]))]))
    rows = [*enumerate(texts), (900, texts[3]), (901, texts[3]), (5, texts[5]), (902, texts[8]), (902, texts[60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").checkpoint()
    pairs, gather = [], postings.gather

    def counted(placed, *rest):
        pairs.append(placed.count())
        return gather(placed, *rest)

    monkeypatch.setattr(postings, "gather", counted)
    want = sorted(map(tuple, op03_fingerprints.search(docs).collect()))
    monkeypatch.setattr(postings, "FAMILY", 10)
    monkeypatch.setattr(op03_fingerprints, "HELD_ALL", 3000)
    assert sorted(map(tuple, op03_fingerprints.search(docs).collect())) == want and len(want) > 70
    before, _, after = pairs
    assert before > 800 and after < before / 2
