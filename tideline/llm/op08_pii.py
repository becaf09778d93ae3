"""PII redaction: generated candidates, boosted trees, calibrated thresholds.

High-recall generators propose spans that may overlap: e-mail addresses around every
``@``; phone, address, card, social security, date and long-number shapes
around every run of digits; bank accounts and version 6 addresses in the whole text.
Names and street addresses have no format to go by and aren't sought. Gradient-boosted trees score each candidate by its format
and its context (neighbouring characters, telling words before it). Scores are
calibrated on held-out candidates, and each kind has the threshold that reaches the
wanted precision there. Of overlapping spans the best score is redacted.

The training table is made here by a seeded generator of labelled examples, so training
costs the same whatever the corpus and every run learns the same trees. Texts without a
digit, ``@`` or ``::`` can't have a candidate and never leave the JVM; the rest is one pass.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "ip", "card", "ssn", "iban", "date", "number")
PRECISION, SEED = 0.97, 11
CONTEXT = 40

RUN = re.compile(r"\d(?:[ .()\-/:+]{0,3}\d)*")
SHAPES = {
    "phone": re.compile(r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)|\d{2,4})(?:[ .\-]{0,2}\d{2,4}){2,4}"),
    "phone/us": re.compile(r"(?:\+?\d{1,2}[ .\-]?)?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]\d{4}"),
    "phone/short": re.compile(r"\d{3}[ .\-]\d{4}"),
    "phone/plus": re.compile(r"\+\d{1,3}(?:[ .\-]\d{2,4}){2,4}"),
    "ip": re.compile(r"\d{1,3}(?:\.\d{1,3}){3}"),
    "card": re.compile(r"\d(?:[ \-]?\d){12,18}"),
    "card/solid": re.compile(r"\d{13,19}"),
    "card/grouped": re.compile(r"\d{4}(?:[ \-]\d{4}){3}"),
    "ssn": re.compile(r"\d{3}[- ]\d{2}[- ]\d{4}"),
    "iban": re.compile(r"[A-Z]{2}\d{2}[ ]?(?:[A-Z0-9]{4}[ ]?){2,7}[A-Z0-9]{1,4}"),
    "date": re.compile(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"),
    "number": re.compile(r"\d{7,}"),
}
#: Solid and grouped account numbers, in the whole text; the last group may be short.
IBANS = (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"),
         re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?![A-Za-z0-9])"))
NUMBERS = {kind: k for k, kind in enumerate(KINDS)}
#: Version 6 addresses, and whatever else is groups of hexadecimal digits between colons.
COLONS = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:(?=[0-9A-Fa-f:])|::?(?=[0-9A-Fa-f]|:))(?:[0-9A-Fa-f]{1,4}:|:)*[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
DOMAIN = re.compile(r"[\w\-]*(?:\.[\w\-]+)*")
WORDS = {
    "phone": r"phone|tel\b|call|mobile|fax|cell|contact|sms|whatsapp|telefon|móvil",
    "mail": r"mail|contact|write|reach|@",
    "card": r"card|visa|credit|debit|mastercard|amex|payment|karte|tarjeta|carte",
    "net": r"\bip\b|address|host|server|login|client|from|connect",
    "person": r"ssn|social|security|birth|born|dob|passport|patient|tax id",
    "bank": r"iban|account|bank|konto|cuenta|compte|swift",
    "version": r"version|release|licen[sc]e|\bv\b|build|update|section|chapter|figure|rfc|firmware|sdk",
    "goods": r"order|invoice|ref\b|sku|isbn|item|part|serial|ticket|product|tracking|model|bytes|pixels|timestamp|epoch|id\b",
    "day": r"\bdate|\bon\b|published|posted|since|until|year",
}
HINTS = {k: re.compile(v, re.IGNORECASE) for k, v in WORDS.items()}


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, stop, kind number) of every proposed span; spans may overlap."""
    found = set()
    at = text.find("@")
    while at >= 0:
        start = at
        while start and ((c := text[start - 1]).isalnum() or c in "_.%+'-"):
            start -= 1
        right = DOMAIN.match(text, at + 1)
        stop = right.end() if right else at + 1
        if stop - start > 1:
            found.add((start, stop, 0))
        at = text.find("@", at + 1)
    for run in RUN.finditer(text):
        if run.end() - run.start() < 5:
            continue  # shorter than any shape
        low, high = max(0, run.start() - 4), min(len(text), run.end() + 8)
        window = text[low:high]
        for shape, pattern in SHAPES.items():
            number = NUMBERS[shape.partition("/")[0]]
            for hit in pattern.finditer(window):
                if hit.end() + low > run.start():
                    stop = hit.end() - (len(hit.group()) - len(hit.group().rstrip()))
                    found.add((low + hit.start(), low + stop, number))
    # Bank codes may be letters, so no run of digits need show where an account number is.
    for pattern in IBANS:
        for hit in pattern.finditer(text):
            found.add((hit.start(), hit.end(), NUMBERS["iban"]))
    for hit in COLONS.finditer(text):
        if hit.group().count(":") > 1:
            found.add((hit.start(), hit.end(), NUMBERS["ip"]))
    return sorted(found)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def describe(text: str, start: int, stop: int, kind: int) -> list[float]:
    """Format and context of a candidate as numbers."""
    span = text[start:stop]
    digits = "".join(c for c in span if c in "0123456789")
    before, after = text[start - 1:start], text[stop:stop + 1]
    left = text[max(0, start - CONTEXT):start]
    groups = re.findall(r"\d+", span)
    local, _, domain = span.partition("@")
    octets = [int(g) for g in groups[:4]] if kind == 2 and ":" not in span else []
    colons = span.split(":") if kind == 2 and ":" in span else []
    return [
        *[float(kind == k) for k in range(len(KINDS))],
        len(span), len(digits), sum(c.isalpha() for c in span), sum(not c.isalnum() for c in span), len(groups),
        max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(span.startswith("+") or before == "+"), float("(" in span), float(luhn(digits)) if 12 < len(digits) < 20 else -1.0,
        max(octets, default=-1), float(max(octets, default=256) <= 255), float(bool(octets) and any(len(g) > 1 and g[0] == "0" for g in groups)),
        float(before.isdigit() or before in (".", "-", "/") and text[start - 2:start - 1].isdigit()),
        float(after.isdigit() or after in (".", "-", "/", ":") and text[stop + 1:stop + 2].isdigit()),
        float(before.isalpha()), float(after.isalpha() or after == "_"), len(local) if kind == 0 else -1, domain.count(".") if kind == 0 else -1,
        float(len(domain.rpartition(".")[2]) > 1 and domain.rpartition(".")[2].isalpha()) if kind == 0 else -1,
        float(domain.rpartition(".")[2].lower() in ("png", "jpg", "gif", "svg", "js", "css", "py", "local")) if kind == 0 else -1,
        len(colons), float("::" in span), max(map(len, colons), default=0), min(map(len, colons), default=0), sum(c in "abcdefABCDEF" for c in span) if colons else -1,
        float(len(set(digits)) <= 2) if digits else 0.0, float(digits[:1] in ("3", "4", "5", "6")) if digits else 0.0,
        *[float(bool(h.search(left))) for h in HINTS.values()],
    ]


def _examples(seed: int = SEED, each: int = 60) -> tuple[list[str], list[tuple[int, int, str]]]:
    """Texts and the interval in each that is private (empty: nothing is) with its kind."""
    r = random.Random(seed)
    words = "the of and report when they said house river market then later open under small green la de der und que".split()

    def n(k: int, first: str = "0123456789") -> str:
        return r.choice(first) + "".join(r.choice("0123456789") for _ in range(k - 1))

    def filler() -> str:
        return " ".join(r.choice(words) for _ in range(r.randint(1, 8)))

    def card(valid: bool, k: int = 16) -> str:
        while True:
            d = n(k)
            if luhn(d) == valid:
                return d

    def octets(high: int = 255) -> str:
        return ".".join(str(r.randint(1, high)) for _ in range(4))

    def dotted() -> str:
        return ".".join(str(r.choice([r.randint(1, 9), r.randint(10, 99), r.randint(100, 255)])) for _ in range(4))

    def bank() -> str:
        return "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4))

    def hexed(k: int) -> str:
        return "".join(r.choice("0123456789abcdef") for _ in range(k))

    def six() -> str:
        groups = [r.choice([n(4), hexed(4), hexed(r.randint(1, 4))]) for _ in range(8)]
        if r.random() < 0.5:
            at, gone = r.randint(1, 5), r.randint(1, 4)
            return ":".join(groups[:at]) + "::" + ":".join(groups[at + gone:])
        return ":".join(groups)

    name = lambda: r.choice(words) + r.choice(["", "."]) + r.choice(words + ["", n(2)])
    host = lambda: r.choice(["mail", "corp", "post", "web", "x"]) + r.choice(["", n(1)]) + "." + r.choice(["example", "firm", "uni"]) + "." + r.choice(["com", "org", "net", "de", "fr", "co.uk"])
    private = [
        *[("email", m) for m in (lambda: f"{name()}@{host()}", lambda: f"{name()}.{n(2)}@{host()}",
                                 lambda: f"{name()}@{r.choice(words)}.{r.choice(['com', 'org', 'es'])}")],
        *[("phone", m) for m in (lambda: f"+1 ({n(3)}) {n(3)}-{n(4)}", lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"{n(3)}-{n(3)}-{n(4)}",
                                 lambda: f"{n(3)}.{n(3)}.{n(4)}", lambda: f"+{n(2, '3469')} {n(3)} {n(3)} {n(3)}",
                                 lambda: f"+1 {n(3)} {n(3)} {n(4)}", lambda: f"+{n(2, '3469')}-{n(3)}-{n(3)}-{n(4)}")],
        *[("ip", m) for m in (octets, octets, dotted, dotted, six, six)], ("ip", lambda: r.choice(["fe80", "2001:db8", "fd00"]) + "::" + hexed(r.randint(1, 4))),
        *[("card", m) for m in (lambda: card(True), lambda: card(False), lambda: card(True), lambda: card(False), lambda: card(True, 15),
                                lambda: re.sub(r"(....)(?=.)", r"\1 ", card(True)),
                                lambda: re.sub(r"(....)(?=.)", r"\1-", card(True)))],
        *[("ssn", lambda: f"{n(3)}-{n(2)}-{n(4)}")] * 2,
        ("iban", lambda: r.choice(["DE", "FR", "ES", "GB"]) + n(2) + " " + " ".join(n(4) for _ in range(4)) + " " + n(2)),
        ("iban", lambda: r.choice(["DE", "FR", "ES"]) + n(20)),
        ("iban", lambda: r.choice(["GB", "IE", "NL"]) + n(2) + " " + bank() + " " + " ".join(n(4) for _ in range(3)) + " " + n(2)),
        ("iban", lambda: r.choice(["GB", "IE"]) + n(2) + bank() + n(14)), ("iban", lambda: "NL" + n(2) + bank() + n(10)),
        # neighbours: only the first is marked, the second must not change its end
        ("card", lambda: card(False)), ("ip", octets),
    ]
    told = [
        ("number", "phone ", lambda: n(10)), ("number", "call ", lambda: n(7)), ("phone", "tel. ", lambda: f"{n(3)} {n(4)}"),
        ("date", "born on ", lambda: f"19{n(2)}-0{n(1, '123456789')}-1{n(1)}"), ("phone", "phone: ", lambda: f"{n(3)}-{n(4)}"),
        ("date", "date of birth ", lambda: f"1{n(1)}/0{n(1, '123456789')}/19{n(2)}"), ("number", "account ", lambda: n(10)),
        ("number", "bank account ", lambda: n(12)), ("number", "passport ", lambda: n(9)), ("card", "card ", lambda: card(True)),
        ("email", "mail ", lambda: f"{name()}@{host()}"), ("ip", "from ", octets),
    ]
    plain = [
        lambda: f"version {n(1)}.{n(1)}.{n(1)}.{n(1)}", lambda: f"release {n(1)}.{n(2)}.{n(3)}.{n(1)}", lambda: f"build {octets(60)}", lambda: f"version {n(1)}.0.",
        lambda: f"{n(3, '3456789')}.{n(3, '3456789')}.{n(3)}.{n(3)}", lambda: f"{octets()}.{n(2)}", lambda: f"order {n(10)}", lambda: f"invoice {n(12)}", lambda: f"isbn 978-{n(1)}-{n(4)}-{n(4)}-{n(1)}",
        lambda: f"isbn 978{n(10)}", lambda: f"sku {n(8)}", lambda: f"timestamp 17{n(8)}", lambda: f"timestamp 17{n(11)}", lambda: f"id {n(16)}", lambda: f"tracking {n(14)}",
        lambda: f"20{n(2, '012')}-0{n(1, '123456789')}-1{n(1)}", lambda: f"published on 1{n(1)}/0{n(1, '123456789')}/202{n(1)}", lambda: f"pages {n(3)}-{n(3)}", lambda: f"{n(1, '123456789')},{n(3)},{n(3)}",
        lambda: f"{n(1)}.{n(12)}", lambda: f"{n(4)} {n(4)}", lambda: f"19{n(2)}-20{n(2)}", lambda: f"{n(6)}", lambda: f"{n(8)}", lambda: f"part {n(3)}-{n(4)}", lambda: f"0.{n(9)}",
        lambda: f"@{r.choice(words)}", lambda: f"{r.choice(words)}@localhost", lambda: f"icon@2x.png", lambda: f"a @ b", lambda: f"x@y", lambda: f"@{r.choice(words)}.wire", lambda: f"user@{r.choice(words)}.local",
        *[lambda: f'"{hexed(40)}"', lambda: f'token = "{hexed(40)}"', lambda: hexed(32), lambda: hexed(64), lambda: hexed(40).upper()] * 3, lambda: f"v{n(1)}.{n(1)}.{n(2)}.{n(1)}",
        lambda: f"AB{n(8)}X", lambda: f"{n(24)}", lambda: "0000000000000000", lambda: f"1{'0' * 12}", lambda: f"{n(2)}:{n(2)}:{n(2)}", lambda: f"at {n(1)}:{n(2)}:{n(2)}", lambda: f"{n(2)}:{n(2)}:{n(2)}:{n(2)}", lambda: f"{r.choice('abcdef')}::{r.choice(words)}", lambda: f"{r.choice('abcdef')}::{r.choice('abcdef')}", lambda: f"ratio {n(1)}:{n(1)}:{n(1)}", lambda: f"{n(2)}.{n(2)}.{n(4)}", lambda: f"license {n(1)}.{n(1)}", lambda: f"{n(3)} - {n(3)}",
    ]
    texts: list[str] = []
    marks: list[tuple[int, int, str]] = []
    tails = ["", " ", " 4", ".", ",", "!!", "###", "$$$ ", "%%% ", "***", "&&& ", " | ", ")", "\n", '"', "; "]
    for _ in range(each):
        for kind, make in private:
            head, what = filler() + r.choice([" ", " ", " | ", "### ", " (", ": "]), make()
            what = what.upper() if r.random() < 0.15 else what
            texts.append(head + what + r.choice(tails) + (" " + filler() if r.random() < 0.8 else ""))
            marks.append((len(head), len(head) + len(what), kind))
        for kind, lead, make in told:
            head, what = filler() + " " + lead, make()
            texts.append(head + what + r.choice(tails) + " " + filler())
            marks.append((len(head), len(head) + len(what), kind))
        for make in plain:
            texts.append(filler() + " " + make() + r.choice(tails) + " " + filler())
            marks.append((0, 0, ""))
    return texts, marks


def training(seed: int = SEED, each: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels): a candidate is right if it has the kind of its text's private
    interval and its ends differ from the interval's by one character at most in all."""
    rows, labels = [], []
    for text, (low, high, wanted) in zip(*_examples(seed, each)):
        for start, stop, kind in candidates(text):
            rows.append(describe(text, start, stop, kind))
            labels.append(float(high > low and KINDS[kind] == wanted and abs(start - low) + abs(stop - high) <= 2))
    return np.array(rows), np.array(labels)


@dataclass
class Boosted:
    """Sum of depth-limited regression trees in heap order, with a logistic calibration."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    depth: int
    base: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: np.ndarray | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += leaf[at - (1 << self.depth) + 1]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, step: float = 0.2, bins: int = 32) -> Boosted:
    edges = [np.unique(np.quantile(np.unique(x[:, k]), np.linspace(0, 1, bins + 1)[:-1])) for k in range(x.shape[1])]
    coded = np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)], axis=1)
    base = float(np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3)))
    margin, inner = np.full(len(y), base), (1 << depth) - 1
    model = Boosted(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), depth, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            best = (1e-6, 0, np.inf)
            for k, e in enumerate(edges):
                if len(own) < 4 or not len(e):
                    continue
                gs = np.bincount(coded[own, k], g[own], len(e) + 1).cumsum()
                hs = np.bincount(coded[own, k], h[own], len(e) + 1).cumsum()
                gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (float(gain[j]), k, float(e[j]))
            model.feature[t, node], model.cut[t, node] = best[1], best[2]
            at[own] = 2 * node + 1 + (x[own, best[1]] > best[2])
        leaf = at - inner
        model.leaf[t] = step * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        margin += model.leaf[t][leaf]
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> Boosted:
    """Fits slope and shift on candidates not trained on, then a threshold for each kind:
    the least score from which on the share of private ones reaches the precision."""
    m = model.margin(x)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        w = p * (1 - p) + 1e-9
        ga, gb = ((y - p) * m).sum() - 1e-3 * (a - 1), (y - p).sum()
        haa, hab, hbb = (w * m * m).sum() + 1e-3, (w * m).sum(), w.sum()
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
    model.slope, model.shift = float(a), float(b)
    score, model.thresholds = model.score(x), np.full(len(KINDS), 0.5)
    for k in range(len(KINDS)):
        own = x[:, k] == 1
        order = np.argsort(-score[own], kind="stable")
        s, right = score[own][order], y[own][order].cumsum()
        fine = np.flatnonzero(right >= precision * np.arange(1, len(s) + 1))
        if len(fine):
            model.thresholds[k] = float(np.clip(s[fine[-1]], 0.3, 0.9))
    return model


def train(seed: int = SEED) -> Boosted:
    x, y = training(seed)
    held = np.random.default_rng(seed).random(len(y)) < 0.3
    return calibrate(boost(x[~held], y[~held]), x[held], y[held])


def choose(text: str, model: Boosted) -> list[tuple[int, int, str, float]]:
    """Disjoint (start, stop, kind, score) to redact, in order of place."""
    return choose_all([text], model)[0]


def choose_all(texts: list[str], model: Boosted) -> list[list[tuple[int, int, str, float]]]:
    proposed = [candidates(t) for t in texts]
    flat = [describe(t, *c) for t, own in zip(texts, proposed) for c in own]
    if not flat:
        return [[] for _ in texts]
    scores, out, at = model.score(np.array(flat)), [], 0
    for own in proposed:
        mine = scores[at:at + len(own)]
        at += len(own)
        taken: list[tuple[int, int, str, float]] = []
        good = sorted((-round(float(s), 6), -(b - a), a, b, k) for (a, b, k), s in zip(own, mine) if s >= model.thresholds[k])
        spans: list[tuple[int, int]] = []
        for s, _, a, b, k in good:
            if not _overlaps(spans, a, b):
                taken.append((a, b, KINDS[k], -s))
        out.append(sorted(taken))
    return out


def _overlaps(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether [a, b) meets a span of the sorted list; if not, it is put in."""
    from bisect import bisect_left

    i = bisect_left(spans, (a, b))
    if i < len(spans) and spans[i][0] < b or i and spans[i - 1][1] > a:
        return True
    spans.insert(i, (a, b))
    return False


def masked(text: str, chosen: list[tuple[int, int, str, float]]) -> str:
    parts, last = [], 0
    for a, b, kind, _ in chosen:
        parts += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*parts, text[last:]])


def redact(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """(doc_id, text, redactions) of the rows with something to redact.

    text is the redacted text; redactions is an array of (start, stop, kind, score) in
    characters of the input, disjoint and in order. Null, empty and clean texts have no
    row; very long texts are read whole; equal texts get equal redactions, each repeated
    row its own; null ids are kept; other columns are ignored; an empty table gives an
    empty result."""
    model = model or train()
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                found = choose_all(texts, model)
                rows = [i for i, x in enumerate(found) if x]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(rows)), pa.array([masked(texts[i], found[i]) for i in rows], pa.string()),
                         pa.array([[dict(zip(("start", "stop", "kind", "score"), x)) for x in found[i]] for i in rows], pa.list_(span))],
                        ["doc_id", "text", "redactions"])

    some = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]|::"))
    return some.mapInArrow(run, f"doc_id {kind}, text string, redactions array<struct<start:int,stop:int,kind:string,score:double>>")


def query(spark, sf_dir):
    from tideline.llm.common import read

    return redact(read(spark, sf_dir, "documents"))
