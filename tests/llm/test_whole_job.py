"""What was once left out: secrets inside URLs and JSON, weak ones beside an endpoint,
near copies below the threshold of the exact join,
neighbours behind repeated rows, account numbers with letters."""

import hashlib
import heapq
import html.parser
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tideline.llm import op01_ann, op02_secrets, op04_html, op06_sharding, op07_quality, op08_pii, op10_packing
from tideline.llm.common import read


def test_secrets_inside_urls_and_json(spark):
    value, token = "Ab1" + "x9" * 11, "ghp_" + "aB3" * 12
    texts = [f"see https://h/v1?api_key={value}&user=bob ok", f"git https://{token}@github.com/x", "db postgres://admin:hunter2pw@host.example.org/db now",
             '{"api_key": "' + value + '"}', r'x = "{\"api_key\": \"' + value + r'\"}"']
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((r["doc_id"], r["form"], r["value"], r["strong"], r["identifier"]) for r in op02_secrets.link(rows).collect())
    assert found == [(0, "query", value, True, "bob"), (1, "issued", token, True, None), (2, "userinfo", "hunter2pw", True, "admin"),
                     (3, "assigned", value, True, None), (4, "assigned", value, True, None)]
    made = {r["doc_id"]: r["text"] for r in op02_secrets.redact(rows).collect()}
    assert made == {i: t.replace(value, "[SECRET]").replace(token, "[SECRET]").replace("hunter2pw", "[SECRET]") for i, t in enumerate(texts)}


def test_tokens_of_headers(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dBjftJeZ4CVP_mB92K27"
    texts = [f"Authorization: Bearer {jwt}", "Authorization: bearer abcDEF0123456789abc", f"cookie {jwt};", "a bearer of good news arrives"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["form"], r["strong"]) for r in op02_secrets.link(rows).collect()) == [(0, "jwt", True), (1, "bearer", True), (2, "jwt", True)]
    assert {r["doc_id"]: r["text"] for r in op02_secrets.redact(rows).collect()} == {
        0: "Authorization: Bearer [SECRET]", 1: "Authorization: bearer [SECRET]", 2: "cookie [SECRET];", 3: texts[3]}


def test_a_row_is_masked_by_its_own_text_alone(spark):
    token = "ghp_" + "aB3" * 12
    texts = [(None, f"one {token} x"), (None, "a harmless text, as long as the first one is, and longer"), (7, f"two {token} and {token}"), (7, "another harmless one with the same id"),
             (7, f"two {token} and {token}"), (8, None), (None, None), (9, "")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    made = sorted((str(r["doc_id"]), str(r["text"])) for r in op02_secrets.redact(rows).collect())
    assert made == sorted((str(i), str(t.replace(token, "[SECRET]") if t else t)) for i, t in texts)
    assert len(op02_secrets.link(rows).collect()) == 3


def test_marks_in_texts_are_blanks(spark):
    token = "ghp_" + "aB3" * 12
    rows = spark.createDataFrame([(1, f"\x01a\x01{token}\x01b é {token}")], "doc_id long, text string")
    assert op02_secrets.redact(rows).first()["text"] == "\x01a\x01[SECRET]\x01b é [SECRET]"


def test_overlapping_spans_share_a_mask(spark, monkeypatch):
    text = "0123456789"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    scope = hashlib.md5(text.encode()).hexdigest()
    spans = spark.createDataFrame([(1, scope, 2, 5), (1, scope, 4, 7), (1, scope, 5, 6), (1, scope, 8, 9)], "doc_id long, scope string, start long, stop long")
    monkeypatch.setattr(op02_secrets, "linked", lambda docs, window: spans)
    assert op02_secrets.redact(rows).first()["text"] == "01[SECRET]7[SECRET]9"


def test_weak_secrets_beside_an_endpoint(spark):
    run = "0123456789abcdef" * 2
    rows = spark.createDataFrame([(1, "https://db.example.com password=hunter2"), (2, "10.20.30.40 " + run), (3, "https://x.example.org/commit/" + run),
                                  (4, "https://db.example.com " + "z " * 400 + "password=hunter2")], "doc_id long, text string")
    found = {r["doc_id"]: (r["value"], r["strong"], r["endpoint"]) for r in op02_secrets.link(rows).collect()}
    assert found == {1: ("hunter2", False, "https://db.example.com"), 2: (run, False, "10.20.30.40")}


def test_edited_copies_of_every_length_go(spark):
    r = random.Random(3)
    rows, want = [], set()
    for n, length in enumerate([8, 9, 12, 20, 30, 57, 100, 300, 1000, 3000]):
        words = [f"w{r.randrange(10 ** 6)}" for _ in range(length)]
        edited = list(words)
        # One word in twelve is replaced, none beside another or at an end.
        for at in range(4, length - 3, 12):
            edited[at] = f"x{at}"
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(edited))]
        want.add(2 * n)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want


@pytest.mark.parametrize("copies", [1, 3, 10])
def test_repeated_rows_take_one_place(spark, copies):
    r = np.random.default_rng(4)
    x = (np.ones((40, 8)) + r.normal(0, 0.01, (40, 8))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] * copies
    found = op01_ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    exact = y @ y.T
    np.fill_diagonal(exact, -2)
    for i in range(40):
        near = [f["neighbour_id"] for f in sorted(found, key=lambda f: f["rank"]) if f["vec_id"] == i]
        assert len(near) == 10 and np.allclose(exact[i, near], np.sort(exact[i])[::-1][:10], atol=1e-7)


def test_equal_vectors_are_ordered_by_id(spark):
    rows = [(i, [1.0, 0.5, 0.25, 0.125]) for i in range(30)] + [(99, [1.0, 0.5, 0.25, 0.124]), (99, [-1.0, 0.0, 0.0, 1.0])] + [(50, [1.0, 0.4, 0.3, 0.2])] * 4
    random.Random(1).shuffle(rows)
    found = op01_ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5).collect()
    by = {i: [r["neighbour_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["vec_id"] == i] for i in (0, 20, 99)}
    assert by == {0: [1, 2, 3, 4, 5], 20: [0, 1, 2, 3, 4], 99: [0, 1, 2, 3, 4]}


@pytest.mark.parametrize("iban", ["GB29 NWBK 6016 1331 9268 19", "NL91ABNA0417164300", "GB29NWBK60161331926819", "IE29AIBK93115212345678", "NL91 ABNA 0417 1643 00"])
def test_account_numbers_with_letters_are_proposed_and_masked_whole(spark, iban):
    text = f"please pay to account {iban} before then"
    assert (22, 22 + len(iban), op08_pii.NUMBERS["iban"]) in op08_pii.candidates(text)
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    made = op08_pii.redact(rows).collect()
    assert made and iban[-4:] not in made[0]["text"] and iban[:8] not in made[0]["text"]


@pytest.mark.parametrize("address", ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "2001:db8::8a2e:370:7334", "fe80::1ff:fe23:4567:890a", "fd12:3456:789a:1::1"])
def test_version_6_addresses_are_masked_whole(spark, address):
    rows = spark.createDataFrame([(1, f"the login was from {address} and then at 10:20:30 in the log")], "doc_id long, text string")
    assert [r["text"] for r in op08_pii.redact(rows).collect()] == ["the login was from [IP] and then at 10:20:30 in the log"]


def test_long_local_parts_are_masked_whole(spark):
    text = "write to " + "ab.c" * 60 + "@mail.example.org then"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert op08_pii.redact(rows).first()["text"] == "write to [EMAIL] then"


def test_heads_without_an_end_and_long_attributes():
    b = op04_html.blocks
    assert b("<html><head><title>x</title><body><p>hello world this is text</p></body></html>") == [("hello world this is text", 5, 0)]
    assert b("<head><meta a=b><script>x</script><p>text <b>more</b>") == [("text more", 2, 0)] and b("<head>words at once</head>") == [("words at once", 3, 0)]
    assert b("<head><title>gone</title></head><header>kept</header>") == [("kept", 1, 0)]
    assert b('<img alt="' + "x" * 9000 + ' > leaked words" src="y"><p>kept') == [("kept", 1, 0)]
    assert b("<p>one <svg>never closed <p>two") == [("one", 1, 0), ("never closed", 2, 0), ("two", 1, 0)] and b("<p>a <svg><text>b</text></svg> c") == [("a", 1, 0), ("c", 1, 0)]


class _Plain(html.parser.HTMLParser):
    """The blocks of well-formed pages by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.text, self.words, self.linked, self.anchor, self.hidden = [], [], 0, 0, 0, 0

    def close_block(self):
        if text := " ".join("".join(self.text).split()):
            self.found.append((text, self.words, self.linked))
        self.text, self.words, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "script", "style", "noscript", "template", "svg"):
            self.hidden += 1
            self.close_block()
        elif tag in op04_html.BREAKS:
            self.close_block()
            self.anchor = 0
        elif tag == "a":
            self.anchor = 1
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in ("head", "script", "style", "noscript", "template", "svg"):
            self.hidden -= 1
        elif tag in op04_html.BREAKS:
            self.close_block()
            self.anchor = 0
        elif tag == "a":
            self.anchor = 0

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)
            self.words += len(data.split())
            self.linked += len(data.split()) if self.anchor else 0


def test_html_query_against_another_parser_and_plain_features(spark):
    """The whole query: blocks by the standard library's parser, features block by block, the tree by its rules."""
    folder = "/root/testdata/sf0.01"
    model, want = op04_html.tree(), {}

    def leaf(row):
        node = model
        while node.feature >= 0 and node.left is not None:
            node = node.left if row[node.feature] <= node.cut else node.right
        return node.value

    for page in read(spark, folder, "pages").collect():
        parser = _Plain()
        parser.feed(page["html"])
        parser.close()
        parser.close_block()
        numbers = [(w, n / w) for _, w, n in parser.found]
        kept = [t for i, (t, _, _) in enumerate(parser.found)
                if leaf((*numbers[i], *(numbers[i - 1] if i else (0, 0)), *(numbers[i + 1] if i + 1 < len(numbers) else (0, 0)))) >= 0.5]
        want[page["page_id"]] = ("\n".join(kept), len(parser.found), len(kept))
    assert {r["page_id"]: (r["text"], r["blocks"], r["kept"]) for r in op04_html.query(spark, folder).collect()} == want


def _plain_features(text):
    raw, words = text.encode(), [w for w in re.split(rb"[ \t\n\r\f]+", text.encode()) if w]
    n, many = max(len(raw), 1), max(len(words), 1)
    share = lambda chars: sum(c in chars for c in raw) / n
    mark, symbol, upper = b",;:'\"?()-", b"#$%&*<>{}[]=+~^_@/\\`", bytes(range(65, 91))
    return [math.log1p(len(words)), share(upper), share(b"0123456789"), share(b" \t\r\f\n"), share(b"\n"), share(b"."), share(mark), share(symbol), share(b"|"), share(b"!"),
            share(bytes(range(128, 256))), sum(map(len, words)) / many, sum(a == b for a, b in zip(words, words[1:])) / many, sum(a == b for a, b in zip(words, words[2:])) / many,
            len(set(words)) / many ** 0.9, sum(w[-1] in symbol + b"|!" for w in words) / many, sum(w[0] in upper for w in words) / many,
            math.log1p(many / (1 + raw.count(b"\n")))]


def test_quality_query_against_plain_features(spark):
    """The whole query: features one by one, scores by summing bins row by row."""
    folder = "/root/testdata/sf0.001"
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    model = op07_quality.train(docs, labels)
    want = {}
    for r in docs.collect():
        x = _plain_features(r["text"] or "")
        total = model.intercept + sum(t[int(np.searchsorted(e, v, side="right"))] for t, e, v in zip(model.tables, model.edges, x))
        for (a, b), t in zip(model.pairs, model.pair_tables):
            total += t[int(np.searchsorted(model.pair_edges[a], x[a], side="right")), int(np.searchsorted(model.pair_edges[b], x[b], side="right"))]
        p = 1 / (1 + math.exp(-total))
        if x[0] > 0 and p >= model.threshold:
            want[r["doc_id"]] = p
    got = {r["doc_id"]: r["score"] for r in op07_quality.query(spark, folder).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


@pytest.mark.parametrize("part", [1_000_000, 3])
def test_shards_of_a_group_column_and_parts(spark, monkeypatch, part):
    monkeypatch.setattr(op06_sharding, "PART", part)
    rows = [(i, "x" * (1 + i % 5), f"g{i % 40}" if i % 7 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = op06_sharding.shard(docs, 5, "source").collect()
    groups, of, load = Counter(), {}, Counter()
    for i, text, g in rows:
        groups[g] += len(text)
    for r in made:
        g = rows[r["doc_id"]][2]
        assert of.setdefault(g, r["shard"]) == r["shard"] and r["group_size"] == groups[g]
        load[r["shard"]] += len(rows[r["doc_id"]][1])
    heap = [(0, i) for i in range(5)]
    for size in sorted(groups.values(), reverse=True):
        least, i = heapq.heappop(heap)
        heapq.heappush(heap, (least + size, i))
    assert len(made) == 400 and sorted(load.values()) == sorted(x for x, _ in heap)


def test_pieces_of_one_length_are_ranked_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (10 if i % 3 else 4))) for i in range(300)], "doc_id long, text string")
    monkeypatch.setattr(op10_packing, "PART", 7)
    rows = op10_packing.pack(docs, 10).collect()
    fill = Counter()
    for r in rows:
        fill[r["sequence"]] += r["n_tokens"]
    assert len({(r["sequence"], r["slot"]) for r in rows}) == len(rows) == 300 and max(fill.values()) == 10
    assert sorted(fill) == list(range(250)) and Counter(fill.values()) == {10: 200, 8: 50}


def _exact_fills(lengths, capacity):
    """Piece by piece: what the histogram's runs must come to."""
    left, bins = Counter(lengths), []
    longest = lambda most: next((n for n in range(most, 0, -1) if left[n]), 0)

    def fill(gap):
        if left[gap] > 0:
            return (gap,)
        for a in range(gap - 1, 0, -1):
            b = gap - a
            if a >= b and left[a] and left[b] and (a != b or left[a] > 1):
                return (a, b)
        for a in range(gap - 2, 0, -1):
            if left[a]:
                left[a] -= 1
                for b in range(gap - a - 1, 0, -1):
                    c = gap - a - b
                    if b >= c and left[b] and left[c] and (b != c or left[b] > 1):
                        left[a] += 1
                        return (a, b, c)
                left[a] += 1
        return None

    for n in range(capacity, 0, -1):
        while left[n]:
            left[n] -= 1
            rest = () if n == capacity else fill(capacity - n)
            if rest is None:
                left[n] += 1
                break
            for m in rest:
                left[m] -= 1
            bins.append((n, *rest))
    while n := longest(capacity):
        own, gap = [n], capacity - n
        left[n] -= 1
        while gap and (m := longest(gap)):
            own.append(m)
            left[m] -= 1
            gap -= m
        bins.append(tuple(own))
    return Counter(bins)


@given(st.lists(st.integers(1, 24), max_size=60))
@settings(max_examples=200, deadline=None)
def test_runs_are_those_of_one_by_one_packing(lengths):
    got = Counter()
    for pattern, times in op10_packing.runs(dict(Counter(lengths)), 24):
        got[pattern] += times
    assert got == _exact_fills(lengths, 24)
