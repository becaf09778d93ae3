"""HTML extraction by shallow text features.

A page is read as a flat sequence of text blocks, broken at block-level tags. Each block
has two numbers, its word count and its link density (share of words inside anchors), and
takes its neighbours' as well. A decision tree, trained on the small labelled table below,
tells content from boilerplate by these six numbers. Kept blocks make the page's text.

A page is handled by itself, so this is one pass of Arrow batches without a shuffle.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links")

#: words, link density, of the block before, of the block after (0, 0 at an end), content?
#: Labelled by hand from blocks of news, forum, shop and blog layouts.
LABELLED = np.array([
    # navigation, menus, breadcrumbs, tag lists
    (1, 1.0, 0, 0.0, 1, 1.0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0), (2, 1.0, 1, 1.0, 3, 1.0, 0), (3, 1.0, 2, 1.0, 2, 1.0, 0),
    (1, 1.0, 1, 1.0, 9, 0.0, 0), (4, 1.0, 4, 1.0, 12, 0.0, 0), (2, 1.0, 80, 0.0, 2, 1.0, 0), (6, 0.9, 60, 0.0, 5, 1.0, 0),
    (12, 0.8, 3, 1.0, 4, 1.0, 0), (25, 0.9, 12, 1.0, 2, 1.0, 0), (40, 0.95, 20, 0.9, 8, 0.0, 0), (7, 1.0, 7, 1.0, 0, 0.0, 0),
    (10, 1.0, 45, 0.0, 10, 1.0, 0), (9, 0.75, 10, 1.0, 9, 0.8, 0), (15, 0.6, 2, 1.0, 3, 1.0, 0), (3, 0.67, 2, 1.0, 4, 0.5, 0),
    (1, 1.0, 0, 0.0, 2, 1.0, 0), (2, 1.0, 0, 0.0, 1, 1.0, 0), (3, 1.0, 0, 0.0, 3, 1.0, 0), (2, 1.0, 0, 0.0, 4, 0.8, 0),
    (1, 1.0, 3, 1.0, 14, 0.0, 0), (2, 1.0, 1, 1.0, 11, 0.0, 0), (1, 1.0, 2, 1.0, 40, 0.0, 0), (3, 1.0, 1, 1.0, 20, 0.0, 0),
    # advertisements and notices between the menu and the text
    (9, 0.0, 1, 1.0, 8, 0.0, 0), (11, 0.0, 1, 1.0, 4, 0.0, 0), (7, 0.0, 2, 1.0, 10, 0.0, 0), (5, 0.0, 1, 1.0, 2, 0.0, 0),
    (14, 0.0, 3, 1.0, 6, 0.0, 0), (8, 0.0, 1, 1.0, 1, 0.0, 0), (4, 0.0, 1, 1.0, 9, 0.0, 0), (18, 0.0, 1, 1.0, 7, 0.0, 0),
    (2, 0.0, 1, 1.0, 1, 1.0, 0), (3, 0.0, 4, 1.0, 4, 1.0, 0), (12, 0.0, 2, 0.9, 3, 1.0, 0), (10, 0.0, 1, 1.0, 3, 0.0, 0),
    (22, 0.0, 1, 1.0, 9, 0.0, 0), (6, 0.0, 1, 1.0, 12, 0.0, 0), (1, 0.0, 1, 1.0, 6, 0.0, 0), (10, 0.0, 1, 1.0, 5, 0.0, 0),
    # footers, copyright lines
    (14, 0.0, 90, 0.0, 0, 0.0, 0), (10, 0.0, 4, 0.0, 0, 0.0, 0), (21, 0.0, 35, 0.0, 0, 0.0, 0), (6, 0.0, 12, 0.0, 0, 0.0, 0),
    (3, 0.0, 60, 0.0, 0, 0.0, 0), (18, 0.1, 5, 1.0, 0, 0.0, 0), (12, 0.3, 150, 0.0, 0, 0.0, 0), (26, 0.0, 20, 0.0, 0, 0.0, 0),
    (16, 0.0, 1, 0.0, 0, 0.0, 0), (8, 0.0, 250, 0.0, 0, 0.0, 0), (32, 0.0, 70, 0.0, 0, 0.0, 0), (24, 0.0, 2, 0.0, 0, 0.0, 0),
    (12, 0.0, 2, 1.0, 0, 0.0, 0), (5, 0.0, 6, 1.0, 0, 0.0, 0), (29, 0.0, 8, 0.0, 0, 0.0, 0), (38, 0.0, 15, 0.0, 0, 0.0, 0),
    # headlines between a notice and the text
    (9, 0.0, 9, 0.0, 9, 0.0, 1), (5, 0.0, 8, 0.0, 60, 0.0, 1), (3, 0.0, 11, 0.0, 3, 0.0, 1), (8, 0.0, 5, 0.0, 40, 0.0, 1),
    (11, 0.0, 14, 0.0, 12, 0.0, 1), (1, 0.0, 7, 0.0, 1, 0.0, 1), (6, 0.0, 120, 0.0, 75, 0.0, 1), (4, 0.0, 40, 0.0, 90, 0.0, 1),
    (2, 0.0, 10, 0.0, 150, 0.0, 1), (10, 0.0, 18, 0.0, 11, 0.0, 1), (7, 0.0, 22, 0.0, 8, 0.0, 1), (12, 0.0, 4, 0.0, 13, 0.0, 1),
    (8, 0.0, 8, 0.0, 1, 0.0, 1), (4, 0.0, 9, 0.0, 4, 0.0, 1), (9, 0.0, 12, 0.0, 5, 0.0, 1), (2, 0.0, 8, 0.0, 2, 0.0, 1),
    # paragraphs, long and short, with few links
    (60, 0.0, 9, 0.0, 45, 0.0, 1), (120, 0.0, 60, 0.0, 80, 0.0, 1), (35, 0.05, 70, 0.0, 55, 0.0, 1), (22, 0.0, 40, 0.0, 90, 0.0, 1),
    (4, 0.0, 85, 0.0, 60, 0.0, 1), (2, 0.0, 30, 0.0, 44, 0.0, 1), (1, 0.0, 50, 0.0, 20, 0.0, 1), (3, 0.0, 70, 0.0, 14, 0.0, 1),
    (5, 0.0, 100, 0.0, 12, 0.0, 1), (80, 0.0, 30, 0.0, 15, 0.0, 1), (45, 0.0, 6, 0.0, 18, 0.0, 1), (200, 0.02, 9, 0.0, 10, 0.0, 1),
    (16, 0.0, 16, 0.0, 16, 0.0, 1), (9, 0.0, 3, 0.0, 14, 0.0, 1), (13, 0.0, 9, 0.0, 11, 0.0, 1), (70, 0.1, 3, 1.0, 50, 0.0, 1),
    (300, 0.0, 8, 0.0, 13, 0.0, 1), (55, 0.15, 80, 0.0, 4, 1.0, 1), (90, 0.0, 1, 1.0, 30, 0.0, 1), (64, 0.0, 120, 0.0, 0, 0.0, 1),
    (40, 0.0, 108, 0.0, 2, 0.0, 1), (43, 0.0, 58, 0.0, 3, 0.0, 1), (12, 0.0, 20, 0.0, 1, 0.0, 1), (25, 0.0, 30, 0.0, 5, 0.0, 1),
    (30, 0.0, 9, 0.0, 3, 0.0, 1), (6, 0.0, 40, 0.0, 1, 0.0, 1), (18, 0.0, 25, 0.0, 2, 0.0, 1), (34, 0.0, 33, 0.0, 7, 0.0, 1),
    (3, 0.0, 14, 0.0, 9, 0.0, 1), (47, 0.0, 4, 0.0, 8, 0.0, 1), (28, 0.0, 2, 0.0, 6, 0.0, 1), (5, 0.0, 5, 0.0, 8, 0.0, 1),
    (150, 0.0, 0, 0.0, 0, 0.0, 1), (75, 0.0, 0, 0.0, 40, 0.0, 1), (7, 0.0, 2, 0.0, 21, 0.0, 1), (1, 0.0, 1, 0.0, 16, 0.0, 1),
    (3, 0.0, 1, 0.0, 10, 0.0, 1), (110, 0.0, 2, 1.0, 95, 0.0, 1), (50, 0.2, 60, 0.1, 70, 0.0, 1), (18, 0.0, 11, 0.0, 3, 0.0, 1),
], float)


@dataclass
class Tree:
    """A binary decision: go left if the feature is at most the cut. Leaves hold a share."""

    value: float
    feature: int = -1
    cut: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0 or self.left is None or self.right is None:
            return np.full(len(x), self.value)
        out, low = np.empty(len(x)), x[:, self.feature] <= self.cut
        out[low], out[~low] = self.left.predict(x[low]), self.right.predict(x[~low])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 5, least: int = 2) -> Tree:
    """A tree by the best drop of Gini impurity; ties take the first feature, the lowest cut."""
    node = Tree(float(y.mean()) if len(y) else 0.0)
    if depth == 0 or len(y) < 2 * least or node.value in (0.0, 1.0):
        return node
    best = (1e-9, -1, 0.0)
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v, t = x[order, k], y[order]
        n, up = np.arange(1, len(t)), np.cumsum(t)[:-1]
        rest = up[-1] + t[-1] - up
        impurity = up * (n - up) / n + rest * (len(t) - n - rest) / (len(t) - n)
        gain = y.sum() * (len(y) - y.sum()) / len(y) - impurity
        gain[(v[1:] == v[:-1]) | (n < least) | (len(t) - n < least)] = -1
        at = int(gain.argmax())
        if gain[at] > best[0] + 1e-12:
            best = (float(gain[at]), k, float((v[at] + v[at + 1]) / 2))
    if best[1] < 0:
        return node
    low = x[:, best[1]] <= best[2]
    node.feature, node.cut = best[1], best[2]
    node.left, node.right = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot "
    "th thead title tr ul".split())
#: Elements whose content is no text of the page; an unclosed one of the first kind runs to the end, of the
#: second to its own next tag, as text may follow. The head may lack its end tag: it holds elements of HEAD alone.
RAW, APART = "script|style|template", "noscript|svg|textarea|iframe"
HEAD = frozenset("base basefont bgsound link meta title noscript script style template".split())
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    rf"|<({RAW})\b(?:.*?</\1\s*>|.*)"
    rf"|<({APART})\b(?:.*?</\2\s*>|[^>]*>?)"
    r"|<!\[CDATA\[|<[!?][^>]*>?"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)(?:(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>?)"
    r"|([^<]+|<)", re.DOTALL | re.IGNORECASE)


def blocks(page: str) -> list[tuple[str, int, int]]:
    """(text, words, words in links) of each block with a word, in order."""
    found, inside, words, linked, anchor, head, title = [], [], 0, 0, 0, False, False

    def close():
        nonlocal inside, words, linked
        text = " ".join("".join(inside).split())
        if text:
            found.append((text, words, linked))
        inside, words, linked = [], 0, 0

    for token in TOKEN.finditer(page):
        tag, text = token.group(4), token.group(5)
        if head and not title and (text is not None and not text.isspace() or tag is not None and tag.lower() not in HEAD and not token.group(3)):
            head = False  # what can't be in a head ends it
        if tag is not None and tag.lower() in ("head", "title"):
            if tag.lower() == "head":
                head, title = not token.group(3), False
            else:
                title = head and not token.group(3)
            close()
        elif head:
            continue
        elif text is not None:
            text = entities.unescape(text) if "&" in text else text
            inside.append(text)
            n = len(text.split())
            words += n
            linked += n if anchor else 0
        elif tag is not None:
            tag = tag.lower()
            if tag in BREAKS:
                close()
                anchor = 0
            elif tag == "a":
                anchor = 0 if token.group(3) else 1
            elif tag == "br":
                inside.append(" ")
        elif token.group(1) is not None or token.group(2) is not None:
            close()
    close()
    return found


def features(sizes: np.ndarray, page: np.ndarray) -> np.ndarray:
    """The six features of blocks given (words, linked words) and their page's number."""
    own = np.stack([sizes[:, 0], sizes[:, 1] / np.maximum(sizes[:, 0], 1)], axis=1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = (page[1:] == page[:-1])[:, None]
    before[1:], after[:-1] = own[:-1] * same, own[1:] * same
    return np.concatenate([own, before, after], axis=1)


def tree() -> Tree:
    return grow(LABELLED[:, :-1], LABELLED[:, -1])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, blocks, kept): the content of each page, a line a block.

    Null and empty pages have no block and an empty text. Broken markup is read as far as
    it goes: an open tag or comment runs to the end, a lone ``<`` is text; a head without an end tag
    ends at the first thing that no head holds. Pages of any
    length are read whole; equal pages give equal texts; null ids and repeated rows are
    kept; other columns are ignored; an empty table gives an empty result."""
    kind = pages.schema["page_id"].dataType.simpleString()
    model = tree()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [blocks(x) if x else [] for x in part.column("html").to_pylist()]
                counts = np.array([len(x) for x in found], np.int64)
                flat = [b for x in found for b in x]
                if flat:
                    sizes = np.array([b[1:] for b in flat], float)
                    keep = model.predict(features(sizes, np.repeat(np.arange(len(found)), counts))) >= 0.5
                else:
                    keep = np.zeros(0, bool)
                ends = np.cumsum(counts)
                texts = ["\n".join(flat[i][0] for i in range(e - n, e) if keep[i]) for e, n in zip(ends, counts)]
                kept = [int(keep[e - n:e].sum()) for e, n in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(kept, pa.int32())],
                    ["page_id", "text", "blocks", "kept"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, text string, blocks int, kept int")


def query(spark, sf_dir):
    from tideline.llm.common import read

    return extract(read(spark, sf_dir, "pages"))
