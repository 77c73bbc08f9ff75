"""Each operator against a direct version, and on empty, null, repeated, tied and very long input."""

import base64
import collections
import gzip
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("cohortspan.llm")

from pyspark.sql import functions as F

from cohortspan.llm import (
    bpe, components, content_sort, jaccard, line_windows, mixing, passages, quality, secrets, suffixes, warc,
)
from cohortspan.llm.common import WordHashes
from cohortspan.llm.shingles import shingle_sets

WORDS = [a + b + c for a in ("ba", "de", "ki", "lo", "mu") for b in ("r", "st", "n", "l") for c in ("a", "en", "is", "ot", "u")]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(n))


def docs(spark, texts, ids=None):
    """A documents table with columns whose names operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None if k % 3 == 0 else "src", "x", k, "c") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _text string, kept int, _id string")


EDGE = ["", None, " \n\t", "one", "one two three", "one", "a" * 300, "ab " * 4000, "é漢字 ß  x\x1cy\n\n\nz", "one"]


@pytest.fixture(scope="module")
def edge(spark):
    return docs(spark, [*EDGE, "one"], [5, 6, 7, 8, 9, 10, 11, 12, None, 10, 10]).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, ["x"]).filter("false")


def as_dict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# -- 1 quality ---------------------------------------------------------------------------------------------------------------------------


def test_quality_counts_and_verdict(spark, edge, empty):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.profile(edge).collect()}
    assert (None, 4, 8, 0, 0, 0, True, False) in got, got  # 0x1c is a part of a word
    assert (12, 4000, 8000, 0, 0, 4000, True, False) in got and (6, 0, 0, 0, 0, 0, True, False) in got
    assert quality.profile(edge).count() == edge.count()
    assert quality.profile(empty).count() == 0 and quality.keep(empty).columns == empty.columns


def test_quality_order_does_not_change_verdict_and_keeps_columns(spark):
    rnd = random.Random(1)
    good = [prose(rnd, 80) for _ in range(6)]
    bad = ["".join(w + "*** " for w in prose(rnd, 80).split()), "go " * 90, prose(rnd, 10), "\n".join(["same line here"] * 40)]
    table = docs(spark, good + bad)
    for rules in (quality.RULES, quality.RULES[::-1], quality.ordered(table)):
        kept = quality.keep(table, rules)
        assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == list(range(6))
    cost, masks = [1.0, 1.0, 0.1], {0b011: 10, 0b001: 2, 0b100: 1, 0: 50}
    assert quality.cascade_order(cost, masks) == [0, 2, 1]  # after rule 0 nothing is left for rule 1


# -- 2 secrets ---------------------------------------------------------------------------------------------------------------------------


def test_secrets_found_held_out(spark, edge, empty):
    rnd = random.Random(2)
    texts, want = [], set()
    for i in range(300):
        t = prose(rnd, 30)
        if i % 3 == 0:
            s = "".join(rnd.choice("0123456789abcdef") for _ in range(40))
            t += f' token = "{s}" '
            want.add((i, len(t) - 42))
        if i % 4 == 1:
            t += " 1234567812345678 and " + "thingwithoutdigits" + "reallylongword"
        texts.append(t + " " + prose(rnd, 5))
    table = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(s), int((i, s) in want)) for i, s in [(r.doc_id, r.start) for r in secrets.scan(table).collect()] if i < 150],
                                   "doc_id long, start long, label int")
    got = {(r.doc_id, r.start) for r in secrets.scan(table, labels).collect() if r.is_secret}
    assert {x for x in got if x[0] >= 150} == {x for x in want if x[0] >= 150}
    for r in secrets.scan(table).limit(20).collect():
        assert texts[r.doc_id][r.start : r.start + r.length] == r.candidate
    assert secrets.scan(edge).count() == 1 and secrets.scan(empty).count() == 0


# -- 3 WARC ------------------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big, other = "<p>ü" * 400, "x" * 1000
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c\r\nX: y", big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", other), (8, "u", other), (9, "u", ""), (9, "u", "")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, id string").repartition(3)
    index = warc.write(pages, archive_bytes=600)
    assert index.select("file").distinct().count() > 3
    for gap, most in ((0, 1), (1 << 16, 1 << 23)):
        got = sorted((str(r.id), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in warc.read(index, gap=gap, read_bytes=most).collect())
        want = []
        for i, _, h in rows:
            data, last = (h or "").encode(), {big: 3, other: 8}.get(h)
            revisit = last is not None and i != last
            want.append((str(i), "revisit" if revisit else "response", last if revisit else None, len(data), hashlib.sha1(data).hexdigest(), b"" if revisit else data))
        assert got == sorted(want, key=lambda r: (r[0], r[1])) or sorted(map(repr, got)) == sorted(map(repr, want))
    one = warc.read(index.filter("id = 4")).collect()
    assert len(one) == 1 and bytes(one[0].payload) == b"short"
    assert warc.read(warc.write(pages.filter("false"))).count() == 0


def test_warc_rows_that_share_an_identifier(spark):
    """Each row is judged by its own payload: one record out per row in, no payload lost."""
    x, y = "<p>x" * 300, "<i>y" * 300
    rows = [(9, x), (None, x), (None, y), (None, "short"), (None, y), (8, y), (5, x), (5, y), (5, y), (7, "short")]
    pages = spark.createDataFrame([(i, "http://u", h) for i, h in rows], "page_id long, url string, html string").repartition(3)
    index = warc.write(pages)
    got = sorted(((r.id, r.record_type, r.refers_to, r.payload_digest, bytes(r.payload)) for r in warc.read(index).collect()), key=repr)
    want = []
    for i, h in rows:
        last = {x: 9, y: 8}.get(h)
        revisit = last is not None and i != last
        want.append((i, "revisit" if revisit else "response", last if revisit else None, hashlib.sha1(h.encode()).hexdigest(), b"" if revisit else h.encode()))
    assert got == sorted(want, key=repr)
    stored = {d for _, kind, _, d, _ in got if kind == "response"}
    assert {d for *_, d, _ in got} == stored  # every payload can be read back
    names = set()
    for r in index.collect():
        data = open(f"{r.folder.removeprefix('file://')}/{r.file}", "rb").read()[r.offset : r.offset + r.length]
        names.add(warc._parse(gzip.decompress(data))[0]["WARC-Record-ID"])
    assert len(names) == len(rows)


# -- 4 suffixes --------------------------------------------------------------------------------------------------------------------------


def brute_removed(items):
    """(id, text) in order of id: removed byte mask of each text, where rows with equal id and text are one."""
    first, masks = {}, {}
    for i, t in sorted(items, key=lambda x: x[0]):
        b = (t or "").encode()
        for k in range(len(b) - 99):
            first.setdefault(b[k : k + 100], (i, k))
    for i, t in items:
        b = (t or "").encode()
        m = bytearray(len(b))
        for k in range(len(b) - 99):
            if first[b[k : k + 100]] < (i, k):
                m[k : k + 100] = b"\1" * 100
        masks[i] = bytes(c for c, z in zip(b, m) if not z)
    return masks


def repeat_texts(rnd):
    shared, licence = prose(rnd, 60), prose(rnd, 25)
    texts = [prose(rnd, 40) for _ in range(4)] + [prose(rnd, rnd.randint(0, 30)) + shared + prose(rnd, rnd.randint(0, 30)) for _ in range(6)]
    texts += [prose(rnd, 20) + licence[rnd.randint(0, 60) :] + prose(rnd, 20) + licence for _ in range(6)]
    return texts + [texts[2], "ab" * 200, "ab" * 150 + "c", "é" * 180, "x" * 99, "", None, "Orre " * 100, "zOrre " + "Orre " * 40]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_removal_is_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_RUNS", hot)
    texts = repeat_texts(random.Random(4))
    want = brute_removed(list(enumerate(texts)))
    got = as_dict(suffixes.remove(docs(spark, texts).repartition(3)))
    assert {i: bytes(r.kept) for i, r in got.items()} == want
    for i, r in got.items():
        raw = (texts[i] or "").encode()
        assert r.n_bytes == len(raw) and r.n_removed == len(raw) - len(want[i]) and r.n_spans == len(r.spans)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_removal_of_repeated_lines(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_RUNS", hot)
    rnd = random.Random(6)
    texts = [(prose(rnd, 20)[: size - 1] + "\n") * times for size in (76, 77, 78, 100) for times in (3, 10, 40)]
    texts += [prose(rnd, 15) + (prose(rnd, 20)[:76] + "\n") * 3 + prose(rnd, 15)]
    want = brute_removed(list(enumerate(texts)))
    got = as_dict(suffixes.remove(docs(spark, texts).repartition(3)))
    assert {i: bytes(r.kept) for i, r in got.items()} == want
    assert all(r.n_removed > 0 for r in got.values())


def test_suffix_pieces_and_edges(spark, edge, empty, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 512)
    rnd = random.Random(5)
    base = prose(rnd, 300)
    texts = [base, prose(rnd, 50) + base[700:2000], "q" * 3000]
    got = as_dict(suffixes.remove(docs(spark, texts)))
    assert {i: bytes(r.kept) for i, r in got.items()} == brute_removed(list(enumerate(texts)))
    got = [r for r in suffixes.remove(edge).collect()]
    assert len(got) == edge.count() and sum(r.doc_id == 10 for r in got) == 3 and all(r.n_removed == 0 for r in got if r.doc_id == 10)
    assert next(r for r in got if r.doc_id == 11).n_removed == 299  # all but the first byte: 201 equal strings
    assert suffixes.remove(empty).count() == 0


def test_suffix_order():
    rnd = random.Random(3)
    for t in range(60):
        data = np.array([rnd.choice([1, 2, 3, 200]) if t % 3 else 5 for _ in range(rnd.randint(1, 300))] + [0], np.uint8)
        order, raw = suffixes.suffix_order(data), data.tobytes()
        keys = [raw[i : i + 100].ljust(100, b"\0") for i in order]
        assert sorted(order) == list(range(len(data))) and keys == sorted(keys)


# -- 5 BPE -------------------------------------------------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken(spark, edge, empty):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abcdeéñ漢 \nthingionA0  ") if rnd.random() < 0.9 else rnd.choice(["the", "ing", "aaaa", "    ", "\r\n", "<|endoftext|>"]) for _ in range(rnd.randint(0, 80))) for _ in range(400)]
    texts += ["a" * 30000, "ab" * 20000, "theing" * 5000, "".join(rnd.choice("abcdefghij") for _ in range(40000))]
    rows = bpe.decode(bpe.encode(docs(spark, texts), path, tokenizers.PATTERN), path, tokenizers.PATTERN).collect()
    for r in rows:
        ids = known.encode_ordinary(texts[r.doc_id])
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.n_tokens == len(ids) and bytes(r.decoded).decode() == texts[r.doc_id]
    got = bpe.decode(bpe.encode(edge, path, tokenizers.PATTERN), path, tokenizers.PATTERN).collect()
    assert len(got) == edge.count() and {r.n_tokens for r in got if r.doc_id in (5, 6)} == {0}
    assert bpe.encode(empty, path, tokenizers.PATTERN).count() == 0


def test_bpe_lower_rank_after_merge():
    """A merge that makes a pair of lower rank: that pair goes first, as pair by pair merging would have it."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abc": 257, b"ab": 258, b"aba": 259, b"cab": 260, b"abab": 261}
    ranks |= {b"xy": 300, b"yx": 270, b"xyx": 290, b"yxyx": 280}
    model, rnd = bpe.Bpe(ranks, "(?s).+"), random.Random(8)

    def plain(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for alphabet in ("ab", "abc", "xy", "abxy"):
        for _ in range(150):
            s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40)))
            want = [ranks[s.encode()]] if s.encode() in ranks else plain(s.encode())
            assert np.frombuffer(model.encode([s])[0], "<u4").tolist() == want, s


# -- 6 mixing ----------------------------------------------------------------------------------------------------------------------------


def test_mixing_reaches_targets_and_classifies(spark, edge, empty):
    rnd = random.Random(7)
    tell = {"clean": "garden meadow river", "toxic": "idiot moron clown"}
    truth = ["toxic" if rnd.random() < 0.3 else "clean" for _ in range(400)]
    table = docs(spark, [prose(rnd, rnd.randint(20, 60)) + " " + tell[t] for t in truth])
    labelled = spark.createDataFrame([(i, t) for i, t in enumerate(truth) if i % 2], "doc_id long, domain string")
    targets = {"clean": 0.9, "toxic": 0.05}
    rows = mixing.rates(table, labelled, targets).collect()
    held = [(r.domain == truth[r.doc_id]) for r in rows if r.doc_id % 2 == 0]
    assert np.mean(held) > 0.95
    tokens = np.array([r.tokens for r in rows])
    p, rate = np.array([r.p for r in rows]), np.array([r.rate for r in rows])
    assert (rate >= 0).all() and np.allclose((rate * tokens) @ p / tokens.sum(), [0.9, 0.05], atol=1e-3)
    mixed = mixing.resample(table, labelled, targets)
    ids = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == table.columns and all(ids[i] >= 1 for i, r in ((r.doc_id, r) for r in rows) if r.domain == "clean")
    none = labelled.filter("false")
    assert all(abs(r.rate - 0.95) < 0.02 for r in mixing.rates(edge, none, targets).collect())
    assert mixing.rates(empty, none, targets).count() == 0 and mixing.resample(empty, labelled, targets).count() == 0
    assert mixing.resample(edge, none, {"clean": 0.5, "toxic": 0.5}).count() == edge.count()


def test_mixing_has_no_highest_rate(spark, edge):
    draw = np.random.default_rng(5)
    rows = [(int(draw.integers(20, 90)), [0.9, 0.08, 0.02] if k < 30 else [0.05, 0.85, 0.1] if k < 270 else [0.1, 0.2, 0.7]) for k in range(300)]
    table = spark.createDataFrame(rows, "tokens long, p array<double>")
    targets = {"clean": 0.9, "low": 0.2, "toxic": 0.06}  # clean has under a fifth of what it shall have
    steps, reached, raised = mixing.fit_rates(table, targets)
    corpus = sum(n for n, _ in rows)
    rate = mixing._rates(np.array([p for _, p in rows]), list(map(np.array, steps)))
    assert np.allclose(np.array(list(reached.values())) / corpus, [0.9, 0.2, 0.06], rtol=1e-3) and rate.min() >= 0 and rate.max() > 2
    # nobody is most likely toxic: the others reach their targets and nothing is copied for the missing one
    two = spark.createDataFrame([(n, [p[0], p[1] + p[2] - 1e-4, 1e-4]) for n, p in rows], "tokens long, p array<double>")
    steps, reached, _ = mixing.fit_rates(two, targets)
    assert np.allclose([reached["clean"] / corpus, reached["low"] / corpus], [0.9, 0.2], rtol=1e-3) and reached["toxic"] / corpus < 0.001
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert {round(r.rate, 6) for r in mixing.rates(edge, none, {"clean": 0.9, "toxic": 0.05}).collect()} == {0.95}
    assert mixing.totals(edge, none, {"clean": 0.9, "toxic": 0.05}) == {"clean": (0.9, pytest.approx(0.475)), "toxic": (0.05, pytest.approx(0.475))}


# -- 7 content sort ----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_content_sort(spark, edge, empty, keep):
    rnd = random.Random(9)
    texts = [prose(rnd, 5) for _ in range(30)] + ["hot"] * 400 + ["", None, "hot "] + [prose(random.Random(1), 3)] * 3
    table = docs(spark, texts, list(np.random.default_rng(1).permutation(len(texts)).tolist())).repartition(5)
    groups = collections.defaultdict(list)
    for r in table.collect():
        groups[r.text or ""].append(r.doc_id)
    pick = max if keep == "largest" else min
    want = {i: (pick(g), len(g), i == pick(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in content_sort.mark_copies(table, keep=keep).collect()}
    assert got == want
    assert content_sort.hot_texts(content_sort.numbered(table, "doc_id", "text"), 4) == [hashlib.sha256(b"hot").hexdigest()]
    rows = content_sort.mark_copies(edge, keep=keep).collect()
    assert len(rows) == edge.count() and sum(r.group_size == 4 for r in rows) == 4
    assert content_sort.mark_copies(empty).count() == 0


# -- 8 line windows ----------------------------------------------------------------------------------------------------------------------


def test_line_windows(spark, edge, empty):
    rnd = random.Random(10)
    lines = [prose(rnd, 4) for _ in range(12)] + ["", ""]
    items = [(i, "\n".join(rnd.choice(lines[: rnd.choice([4, 14])]) for _ in range(rnd.randint(0, 14)))) for i in range(60)] + [(60, "a\nb\nc"), (61, "a\nb\nc\nd"), (62, "\n\n\n\n\n"), (63, None)]
    seen, want = {}, {}
    for i, t in items:
        x = (t or "").split("\n")
        gone = set()
        for k in range(len(x) - 2):
            w = tuple(x[k : k + 3])
            if "".join(w).strip():
                if w in seen:
                    gone |= {k, k + 1, k + 2}
                seen.setdefault(w, i)
        want[i] = (len(x), len(gone), "\n".join(y for k, y in enumerate(x) if k not in gone))
    table = docs(spark, [t for _, t in items]).repartition(4)
    got = {r.doc_id: (r.n_lines, r.n_removed_lines, r.text) for r in line_windows.clean(table, details=True).collect()}
    assert got == want
    rows = line_windows.clean(table)
    assert rows.columns == table.columns and {r.doc_id: r.text or "" for r in rows.collect()} == {i: w[2] for i, w in want.items()}
    rows = line_windows.clean(edge)
    assert rows.count() == edge.count() and rows.filter("doc_id = 10 AND text = 'one'").count() == 3
    assert line_windows.clean(empty).count() == 0


# -- 9 Jaccard join ----------------------------------------------------------------------------------------------------------------------


def near_texts(rnd):
    texts = []
    for size, count in ((60, 25), (200, 8), (30, 4)):
        base = prose(rnd, size).split()
        for _ in range(count):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(WORDS)
            texts.append(" ".join(w))
    return texts + [prose(rnd, 50) for _ in range(20)] + ["", None, "one two", "one two", "one two three"]


def brute_join(items):
    sets = {}
    for i, t in items:
        w = (t or "").split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1))))
    cls = {}
    for i in sorted(sets):
        cls.setdefault(sets[i], i)
    links, group = collections.defaultdict(set), {c: c for c in cls.values()}
    for a, x in cls.items():
        for b, y in cls.items():
            if x != y and a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[x].add(y)
    changed = True
    while changed:
        changed = False
        for x, ys in links.items():
            least = min([group[x], *(group[y] for y in ys)])
            for y in [x, *ys]:
                changed |= group[y] != least
                group[y] = least
    return {i: (cls[s], sum(sets[j] == s for j in sets), len(links[cls[s]]), group[cls[s]]) for i, s in sets.items()}


@pytest.mark.parametrize("block", [None, 8])
def test_jaccard_join(spark, edge, empty, monkeypatch, block):
    if block:
        monkeypatch.setattr(jaccard, "BUCKET_BLOCK", block)
        monkeypatch.setattr(jaccard, "VERIFY_BLOCK", block)
    texts = near_texts(random.Random(11))
    table = docs(spark, texts).repartition(4)
    got = {r.doc_id: (r.class_id, r.class_size, r.n_links, r.group_id) for r in jaccard.join(table).collect()}
    assert got == brute_join(list(enumerate(texts)))
    if not block:
        kept = jaccard.keep_one(table)
        assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {v[3] for v in got.values()}
        rows = jaccard.join(edge).collect()
        assert len(rows) == edge.count() and {r.class_size for r in rows if r.doc_id == 10} == {4}
        assert jaccard.join(empty).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    least = jaccard.least_matches()
    assert least == sorted(least) and least[-1] < 0.8 * jaccard.VALUES
    draw = np.random.default_rng(1)
    left = draw.integers(0, 256, (2000, jaccard.VALUES), np.uint8)
    for s, keeps in ((0.8, True), (0.3, False)):
        right = np.where(draw.random(left.shape) < s, left, draw.integers(0, 256, left.shape, np.uint8))
        assert (len(jaccard.likely(left, right, least)) == 2000) is keeps or len(jaccard.likely(left, right, least)) < 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (300, 300), (5, 4), (None, 3)]
    got = {r.id: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(41), 100]} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_runs_survive_batch_borders():
    values = np.repeat([1, 2, 3, 4, 5], [3, 7, 1, 10, 2])
    batches = [pa.RecordBatch.from_pydict({"k": values[i : i + 4]}) for i in range(0, len(values), 4)]
    runs = [t.column("k").to_pylist() for t in jaccard.runs_of(iter(batches), ["k"])]
    assert sum(runs, []) == values.tolist() and all(not set(a) & set(b) for a, b in zip(runs, runs[1:]))


# -- 10 passages -------------------------------------------------------------------------------------------------------------------------


def test_passages_recall_and_precision(spark, edge, empty):
    rnd = random.Random(12)
    plain = [prose(rnd, 150) for _ in range(40)]
    texts, exact, edited = list(plain), [], []
    for k in range(40):
        source = plain[k].split()
        at, size = rnd.randint(0, 60), rnd.randint(50, 80)
        part = source[at : at + size]
        kind = k % 4
        if kind:
            p = rnd.randrange(len(part))
            part = part[:p] + ([rnd.choice(WORDS)] if kind == 1 else [rnd.choice(WORDS), part[p]] if kind == 2 else []) + part[p + 1 :]
        lead = rnd.randint(20, 60)
        texts.append(prose(rnd, lead) + " " + " ".join(part) + " " + prose(rnd, rnd.randint(20, 60)))
        (edited if kind else exact).append((len(texts) - 1, k, lead, len(part)))
    short = " ".join(plain[0].split()[:44])  # 40 common tokens of 46 are too few
    texts += [prose(rnd, 30) + " " + short + " " + prose(rnd, 30), plain[3], plain[3]]
    got = as_dict(passages.near_passages(docs(spark, texts).repartition(5)))
    for i, k, lead, size in exact:
        covered = {w for s in got[i].spans for w in range(s["start"], s["stop"])}
        # a similar passage may reach five words beyond the equal ones
        assert got[i].matches == [k] and set(range(lead, lead + size)) <= covered <= set(range(lead - 5, lead + size + 5))
    assert np.mean([got[i].matches == [k] for i, k, _, _ in edited]) >= 0.9
    assert all(got[i].n_spans == 0 and got[i].matches == [] for i in range(40)) and got[80].n_spans == 0
    assert got[81].copy_of == 3 and got[82].copy_of == 3 and got[82].matches == [3] and got[81].n_spans == 0
    rows = passages.near_passages(edge).collect()
    assert len(rows) == edge.count() and sum(r.copy_of == 8 for r in rows) == 3
    assert passages.near_passages(empty).count() == 0


def test_passage_blocks_give_the_same(spark, monkeypatch):
    rnd = random.Random(13)
    shared = prose(rnd, 70)
    table = docs(spark, [prose(rnd, rnd.randint(5, 40)) + " " + shared + " " + prose(rnd, 20) for _ in range(30)])
    whole = {r.doc_id: r.spans for r in passages.near_passages(table).collect()}
    monkeypatch.setattr(passages, "BLOCK", 4)
    assert {r.doc_id: r.spans for r in passages.near_passages(table).collect()} == whole
    assert whole[0] == [] and all(sum(s["stop"] - s["start"] for s in whole[i]) >= 70 for i in range(1, 30))


def test_passages_keep_every_match_and_span(spark):
    rnd = random.Random(14)
    core, head, tail = prose(rnd, 100).split(), prose(rnd, 60).split(), prose(rnd, 60).split()
    a, b = list(core), list(core)
    for k in range(20, 100, 40):
        a[k], b[k + 8] = "left", "right"
    texts = [a, b, core, [*head, *core[:30]], [*core[:30], *tail], [*head, *core[:30], *tail]]
    texts += [[*prose(rnd, 30).split(), *head, *core[:30], *prose(rnd, 30).split()] for _ in range(8)]
    got = as_dict(passages.near_passages(docs(spark, [" ".join(w) for w in texts])))
    assert {0, 1} <= set(got[2].matches)  # though 0 settles what they share
    covered = {w for s in got[5].spans for w in range(s["start"], s["stop"])}
    assert covered == set(range(150)) and {3, 4} <= set(got[5].matches)
    assert all({3, 5} <= set(got[i].matches) for i in range(6, 14))


def test_bucket_matches_compare_every_two():
    draw = np.random.default_rng(3)
    base = draw.integers(1, 2**16, passages.WIDTH).astype(np.uint16)
    around = np.repeat(base[None], 40, axis=0)
    for r in range(40):
        around[r, draw.integers(0, passages.WIDTH, r % 9)] = 7
        if r % 4 == 0:
            around[r, : r // 2], around[r, passages.WIDTH - r // 3 :] = 0, 0
    around[10:13] = around[9]
    ids = np.sort(draw.integers(0, 30, 40))
    got = {r: (set(m.tolist()), a, b) for r, m, a, b in passages.bucket_matches(ids, around)}
    for r in range(40):
        hits = [(y, *(int(c[0]) for c in (a, b))) for y in range(40) if ids[y] < ids[r] for ok, a, b in [passages.alike(around[r : r + 1], around[y : y + 1])] if ok[0]]
        leads = {int(ids[min(z for z in range(40) if (around[z] == around[y]).all())]) for y, _, _ in hits}
        assert got.get(r) == ((leads, min(h[1] for h in hits), max(h[2] for h in hits)) if hits else None)


def test_compact_windows_are_where_a_token_is_least():
    draw = np.random.default_rng(2)
    for _ in range(30):
        n = int(draw.integers(passages.TOKENS, 200))
        rows = draw.integers(0, 2**63, n, np.uint64)
        x, nodes = passages.passage_minima(rows, np.array([n]), np.uint64(12345))
        want = sorted({s + int(np.argmin(x[s : s + passages.TOKENS])) for s in range(n - passages.TOKENS + 1)})
        assert nodes.tolist() == want
        for c, lo, hi in zip(want, *passages.compact_windows(x[want].tolist(), want, n)):
            assert x[lo : hi + 1].min() == x[c] and (lo == 0 or x[lo - 1] < x[c]) and (hi == n - 1 or x[hi + 1] < x[c])


def test_shingles():
    assert [len(s) for s in shingle_sets(["", "a", "a b c d", "a b c d e", "a b c d e f", "a a a a a a a a"], WordHashes())] == [0, 1, 1, 1, 2, 1]
    assert shingle_sets([], WordHashes()) == []


def test_windows_of_a_bucket_are_compared_together(monkeypatch):
    """Pairs of windows go through few comparisons; how many at once, and windows at a document's edge, change nothing."""
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1000, passages.WIDTH).astype(np.uint16)
    around = np.stack([np.where(rng.random(passages.WIDTH) < 0.02 * (i % 8), rng.integers(1, 1000, passages.WIDTH), np.roll(base, i % 3 - 1)) for i in range(40)]).astype(np.uint16)
    around[5::7, :20], around[3::7, -44:] = 0, 0
    ids = np.arange(40) // 2
    x, y = around[np.repeat(np.arange(40), 40)], around[np.tile(np.arange(40), 40)]
    hit, first, last = passages.alike(x, y)
    for k in range(0, 1600, 3):
        near = [bool(x[k, j] and y[k, j] and (x[k, j] == y[k, j] or (j and x[k, j] == y[k, j - 1]) or (j + 1 < passages.WIDTH and x[k, j] == y[k, j + 1]))) for j in range(passages.WIDTH)]
        ok = [s for s in range(passages.TOKENS) if sum(near[s : s + passages.TOKENS]) >= passages.MATCHES and x[k, s : s + passages.TOKENS].all() and y[k, s : s + passages.TOKENS].all()]
        assert bool(hit[k]) == bool(ok) and (not ok or (first[k], last[k]) == (ok[0], ok[-1]))
    calls, alike = [], passages.alike
    monkeypatch.setattr(passages, "alike", lambda *a: calls.append(len(a[0])) or alike(*a))
    run = lambda: [(r, m.tolist(), a, b) for r, m, a, b in passages.bucket_matches(ids, around)]
    whole = run()
    assert whole and len(calls) == 1
    monkeypatch.setattr(passages, "PAIRS", 5)
    assert run() == whole and len(calls) > 5
