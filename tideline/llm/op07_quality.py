"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text (shares of character classes, word shapes, repetitions) are cut into
quantile bins. Shallow trees, boosted in turn over the features with a small step, add up
to one lookup table per feature; then the pairs of features whose residuals show most
structure get a two-way table each, boosted in the same cyclic way. A score is the sum
of a row's bins, found by vectorised lookups.

Training takes at most ``max_labels`` labelled rows (the lowest hashes of doc_id), so it
costs the same whatever the corpus; scoring is one pass of Arrow batches over all texts,
without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import textkernel as tk

MAX_LABELS, BINS, PAIR_BINS, PAIRS = 20_000, 48, 12, 6
ROUNDS, PAIR_ROUNDS, STEP = 150, 60, 0.15
#: Of the good labelled texts held out at least this share must be kept.
KEEP = 0.995

FEATURES = ("log_words", "upper", "digit", "space", "newline", "stop", "mark", "symbol", "pipe", "bang", "high",
            "word_length", "repeat1", "repeat2", "distinct", "odd_end", "capital_words", "line_words")


def _classes() -> dict[str, np.ndarray]:
    def table(chars: bytes) -> np.ndarray:
        made = np.zeros(256, np.uint8)
        made[list(chars)] = 1
        return made

    return {"upper": table(bytes(range(65, 91))), "digit": table(b"0123456789"), "space": table(b" \t\r\f\n"),
            "newline": table(b"\n"), "stop": table(b"."), "mark": table(b",;:'\"?()-"), "symbol": table(b"#$%&*<>{}[]=+~^_@/\\`"),
            "pipe": table(b"|"), "bang": table(b"!"), "high": table(bytes(range(128, 256)))}


CLASSES = _classes()
ODD = CLASSES["symbol"] | CLASSES["bang"] | CLASSES["pipe"]


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; null and empty texts give zeros."""
    data, offsets = tk.buffer(texts)
    rows = len(offsets) - 1
    out = np.zeros((rows, len(FEATURES)))
    if not len(data):
        return out
    size = np.maximum(np.diff(offsets), 1)
    column = {name: k for k, name in enumerate(FEATURES)}
    for name, lut in CLASSES.items():
        out[:, column[name]] = tk.per_row(lut[data], offsets) / size
    starts, stops, row = tk.spans(data, offsets)
    words = np.bincount(row, minlength=rows)
    many = np.maximum(words, 1)
    out[:, column["log_words"]] = np.log1p(words)
    out[:, column["word_length"]] = np.bincount(row, stops - starts, rows) / many
    hashes = tk.range_hashes(data, starts, stops)
    for lag in (1, 2):
        same = (hashes[lag:] == hashes[:-lag]) & (row[lag:] == row[:-lag])
        out[:, column[f"repeat{lag}"]] = np.bincount(row[lag:][same], minlength=rows) / many
    once = tk.distinct((row.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    out[:, column["distinct"]] = np.bincount((once >> np.uint64(44)).astype(np.int64), minlength=rows) / many ** 0.9
    out[:, column["odd_end"]] = np.bincount(row, ODD[data[stops - 1]], rows) / many
    out[:, column["capital_words"]] = np.bincount(row, CLASSES["upper"][data[starts]], rows) / many
    out[:, column["line_words"]] = np.log1p(many / (1 + out[:, column["newline"]] * size))
    return out


@dataclass
class Additive:
    """intercept + tables[f][bin] + pair tables [(f, g)][bin, bin], in log odds of "good"."""

    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    threshold: float = 0.0

    @staticmethod
    def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if self.tables:
            bins = self.binned(x, self.edges)
            for k, t in enumerate(self.tables):
                total += t[bins[:, k]]
        if self.pairs:
            bins = self.binned(x, self.pair_edges)
            for (a, b), t in zip(self.pairs, self.pair_tables):
                total += t[bins[:, a], bins[:, b]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def quantile_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    at = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, k], at)) for k in range(x.shape[1])]


def _cut(g: np.ndarray, h: np.ndarray, least: float = 1.0) -> tuple[float, int]:
    """The best gain and place of one split of a histogram."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gt, ht = g.sum(), h.sum()
    gain = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)
    gain = np.where((hl >= least) & (ht - hl >= least), gain, -1.0)
    best = int(gain.argmax()) if len(gain) else -1
    return (float(gain[best]), best + 1) if best >= 0 and gain[best] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values by bin of a shallow regression tree on a histogram of gradients."""
    gain, at = _cut(g, h) if depth else (0.0, 0)
    if not gain:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best two-way split (one cut an axis) of a two-way histogram: gain and leaf values."""
    def prefix(x):
        return np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    cg, ch = prefix(g), prefix(h)
    tg, th = cg[-1, -1], ch[-1, -1]
    a, b = cg[1:-1, 1:-1], ch[1:-1, 1:-1]
    right_g, right_h = cg[-1:, 1:-1], ch[-1:, 1:-1]
    low_g, low_h = cg[1:-1, -1:], ch[1:-1, -1:]
    four = [(a, b), (low_g - a, low_h - b), (right_g - a, right_h - b), (tg - low_g - right_g + a, th - low_h - right_h + b)]
    gain = sum(x ** 2 / (y + 1) for x, y in four)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = np.zeros_like(g)
    for (x, y), where in zip(four, (np.s_[:i + 1, :j + 1], np.s_[:i + 1, j + 1:], np.s_[i + 1:, :j + 1], np.s_[i + 1:, j + 1:])):
        x, y = np.broadcast_to(x, gain.shape), np.broadcast_to(y, gain.shape)
        values[where] = x[i, j] / (y[i, j] + 1)
    return float(gain[i, j] - tg ** 2 / (th + 1)), values


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Additive:
    """The model of labels y (1 good, 0 not) on features x. With no or one class only it
    is constant: everything is kept."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return Additive([], [], intercept=4.0, threshold=0.0)
    model = Additive(quantile_edges(x, BINS), quantile_edges(x, PAIR_BINS))
    held = np.arange(len(y)) % 5 == 4
    if len(y) < 50 or y[held].min() == y[held].max():
        held[:] = False
    train = ~held
    xt, yt = x[train], y[train]
    model.intercept = float(np.log(max(yt.mean(), 1e-3) / max(1 - yt.mean(), 1e-3)))
    bins = model.binned(xt, model.edges)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    margin = np.full(len(yt), model.intercept)

    def gradient():
        p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        return yt - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            g, h = gradient()
            n = len(table)
            values = STEP * np.clip(_tree(np.bincount(bins[:, k], g, n), np.bincount(bins[:, k], h, n)), -4, 4)
            table += values
            margin += values[bins[:, k]]
    coarse = model.binned(xt, model.pair_edges)
    width = [len(e) + 1 for e in model.pair_edges]

    def grids(a, b):
        g, h = gradient()
        flat = coarse[:, a] * width[b] + coarse[:, b]
        return (np.bincount(flat, g, width[a] * width[b]).reshape(width[a], width[b]),
                np.bincount(flat, h, width[a] * width[b]).reshape(width[a], width[b]))

    ranked = sorted(((-_quadrants(*grids(a, b))[0], (a, b)) for a, b in combinations(range(x.shape[1]), 2)
                     if width[a] > 1 and width[b] > 1))
    model.pairs = [p for _, p in ranked[:pairs]]
    model.pair_tables = [np.zeros((width[a], width[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            _, values = _quadrants(*grids(a, b))
            values = STEP * np.clip(values, -4, 4)
            table += values
            margin += values[coarse[:, a], coarse[:, b]]
    good = model.score(x[held if held.any() else train][y[held if held.any() else train] == 1])
    model.threshold = min(0.5, float(np.quantile(good, 1 - KEEP)))
    return model


def sample(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most max_labels labelled texts, the lowest hashes of doc_id.

    Labels of one doc_id are averaged; null labels and ids are left out."""
    chosen = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
              .agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")

    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                found = features(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("y").cast(pa.int32()),
                     pa.array(list(found), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = rows.mapInArrow(run, "doc_id bigint, y int, x array<double>").toPandas().sort_values("doc_id")
    if not len(got):
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    return np.stack(got["x"].to_numpy()), got["y"].to_numpy()


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Additive:
    return fit(*sample(docs, labels, max_labels))


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """(doc_id, score, keep) of every row; null and blank texts score 0 and aren't kept."""
    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                p, keep = judge(part.column("text"), model)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array(keep)], ["doc_id", "score", "keep"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, keep boolean")


def judge(texts: pa.Array, model: Additive) -> tuple[np.ndarray, np.ndarray]:
    x = features(texts)
    p = np.where(x[:, 0] > 0, model.score(x), 0.0)
    return p, (x[:, 0] > 0) & (p >= model.threshold)


def keep(docs: DataFrame, model: Additive) -> DataFrame:
    """The rows of docs that the model keeps, all their columns as they are.

    Null, empty and blank texts go; very long texts are read whole; equal texts get equal
    decisions; an empty table stays empty; other columns are carried along."""
    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                yield part.filter(pa.array(judge(part.column("text"), model)[1]))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    """(doc_id, score) of the documents that the classifier keeps."""
    from tideline.llm.common import read

    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).filter("keep").select("doc_id", "score")
