"""The pipeline's stages, each on all that its predecessor kept, against brute force."""

import os
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from tideline.llm import op07_quality, op09_jaccard, op10_packing
from tideline.llm.common import read

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """[(docs, result)] of the stages, written and reread."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), read(spark, DIR, "documents"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, DIR).write.parquet(str(folder / str(k)))
        made = spark.read.parquet(str(folder / str(k)))
        out.append((docs, made))
        docs = made
    return out


def _by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_the_columns_of_documents(spark, steps):
    want = read(spark, DIR, "documents").schema.simpleString()
    assert [name for name, _ in cp.STAGES] == ["quality classifier", "near duplicates", "secret scan", "source mixing", "best-fit packing"]
    for _, made in steps[:-1]:
        assert made.schema.simpleString() == want


def test_quality_keeps_clean_documents(spark, steps):
    docs, made = steps[0]
    labels = {r["doc_id"]: r["quality"] for r in read(spark, DIR, "labels").collect()}
    kept = {r["doc_id"] for r in made.collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.98 * len(good) and sum(i in kept for i, q in labels.items() if q == 0) <= 0.1 * len(labels)
    model = op07_quality.train(docs, read(spark, DIR, "labels"))
    assert kept == {r["doc_id"] for r in op07_quality.score(docs, model).filter("keep").collect()}


def test_one_of_each_group_stays(steps):
    docs, made = map(_by_id, steps[1])
    sets = {}
    for i, r in docs.items():
        w = r["text"].lower().split()
        if w:
            sets[i] = frozenset([" ".join(w)] if len(w) < 2 else [" ".join(w[k:k + 2]) for k in range(len(w) - 1)])
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if len(sets[i] & sets[j]) >= op09_jaccard.NEAR * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert set(made) == {i for i in docs if root(i) == i} and len(made) < len(docs)
    assert all(made[i] == docs[i] for i in made)


def test_secrets_go_and_documents_stay(steps):
    docs, made = map(_by_id, steps[2])
    token = re.compile(r'token = "([0-9a-f]{40})"', re.IGNORECASE)
    assert set(docs) == set(made)
    for i, r in docs.items():
        found = token.findall(r["text"])
        assert not any(t in made[i]["text"] for t in found) and made[i]["n_chars"] == len(made[i]["text"])
        assert found or made[i]["text"] == r["text"]


def test_mixture_is_of_its_documents(steps):
    docs, made = _by_id(steps[3][0]), steps[3][1].collect()
    assert all(docs[r["doc_id"]] == r for r in made) and abs(len(made) - len(docs)) < 0.3 * len(docs) + 10


def test_packing_covers_the_mixture(steps):
    docs, made = steps[4][0].collect(), steps[4][1].collect()
    fill, pieces = Counter(), defaultdict(Counter)
    for r in made:
        fill[r["sequence"]] += r["n_tokens"]
        pieces[r["doc_id"]][(r["start"], r["n_tokens"])] += 1
    want = defaultdict(Counter)
    for r in docs:
        n = len(r["text"].split())
        for start in range(0, n, op10_packing.CAPACITY):
            want[r["doc_id"]][(start, min(op10_packing.CAPACITY, n - start))] += 1
    assert pieces == want and max(fill.values()) <= op10_packing.CAPACITY


def test_run_does_all_stages(spark, steps):
    assert sorted(map(str, cp.run(spark, DIR).collect())) == sorted(map(str, steps[-1][1].collect()))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, replica string, _drop string, _r string, scope string, sequence string, fp string, score string"
TOKEN = "ghp_" + "aB3" * 12
GOOD = ["the river rose in the night and the old mill stood empty by morning", "a market opens at dawn when farmers bring their baskets of fruit"]


def _folder(spark, tmp_path, rows, labels):
    spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *["x"] * 7) for r in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_on_messy_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, repeated ids with unlike texts, clashing columns."""
    long = " ".join(f"word{i} and{i % 7}" for i in range(30_000))
    rows = [(1, GOOD[0], "en", "a"), (1, GOOD[0], "en", "a"), (2, GOOD[0] + " again", "en", None), (3, None, None, None), (4, "", "en", "b"), (5, "  \n", "en", "b"),
            (None, f"one {TOKEN} text of its own here", None, "a"), (None, GOOD[1], "en", "a"), (None, None, None, None), (6, long, "en", "b"),
            (7, f"two {TOKEN} and more", "en", "a"), (7, "unlike the other text with this number, and clean", "en", "a")]
    folder = _folder(spark, tmp_path, rows, [(1, 1, 0), (None, 1, None), (2, None, 0)])
    docs = read(spark, folder, "documents")
    kept = cp.quality(spark, docs, folder)
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if (r["text"] or "").strip())
    lone = cp.near_duplicates(spark, kept, folder)
    assert lone.columns == docs.columns and Counter(r["doc_id"] for r in lone.collect()) == {1: 2, None: 2, 6: 1, 7: 2}
    masked = cp.secrets(spark, lone, folder)
    want = Counter((r["doc_id"], r["text"].replace(TOKEN, "[SECRET]")) for r in lone.collect())
    assert masked.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in masked.collect()) == want
    assert all(r["n_chars"] == len(r["text"]) for r in masked.collect())
    mixed = cp.mixing(spark, masked, folder)
    assert mixed.columns == docs.columns and {str(r) for r in mixed.collect()} <= {str(r) for r in masked.collect()}
    packed = cp.packing(spark, mixed, folder)
    assert sum(r["n_tokens"] for r in packed.collect()) == sum(len(r["text"].split()) for r in mixed.collect())
    assert sorted(map(str, cp.run(spark, folder).collect())) == sorted(map(str, packed.collect()))


@pytest.mark.parametrize("rows,labels", [([], []), ([], [(1, 1, 0)]), ([(1, GOOD[0], "en", "a"), (2, GOOD[1], "en", "b")], [])])
def test_empty_tables(spark, tmp_path, rows, labels):
    folder = _folder(spark, tmp_path, rows, labels)
    assert {r["doc_id"] for r in cp.run(spark, folder).collect()} <= {r[0] for r in rows}
    docs = read(spark, folder, "documents")
    for _, stage in cp.STAGES[:-1]:
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns and made.count() <= 2 * len(rows)


def test_only_the_last_stage_stays_on_disk(spark):
    made = cp.run(spark, DIR)
    stage = os.path.dirname(made.inputFiles()[0].removeprefix("file://"))
    assert os.listdir(os.path.dirname(stage)) == [str(len(cp.STAGES) - 1)] and made.count() > 0
