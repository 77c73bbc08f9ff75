"""Removal of repeated byte strings: content-defined runs, a two-stage suffix sort, adjacent common prefixes.

A string of ``LENGTH`` bytes is repeated if it also starts earlier: in a document with a smaller identifier, or earlier in the
same one. Every byte that a repeated string covers is removed.

1. Each string has an anchor, the smallest hash of its ``GRAM``-byte substrings, so equal strings have equal anchors. The
   starts of a document fall into runs of starts with the same anchor, about one run for 39 bytes.
2. Runs are shuffled by anchor: hashes and positions, no text. Of runs with equal bytes (by two 64-bit hashes and the
   length) all but the first are repeated throughout; tasks already put those of their own slices aside before the shuffle.
   First runs with an anchor that no other bytes share are not repeated. What remains are runs that share their anchor but
   not all their bytes, as at the ends of a repeated passage, and runs in which the anchor occurs twice.
3. The bytes of these runs meet by anchor and are sorted as suffixes: first only those smaller than their successor, then the
   others are induced from them by scanning the buckets of first bytes. Common prefixes of neighbours of ``LENGTH``
   bytes or more make groups of equal strings, of which the earliest stays.
4. All repeated starts come together per document; the union of what they cover is removed.

An anchor shared by more than ``HOT_RUNS`` different runs, or ``SORT_BYTES`` of them, is not one task's work: the strings of such runs are compared by two 64-bit
hashes of each, pre-aggregated before the shuffle. The result is the same.

Defined results: a null text counts as empty; a text of fewer than ``LENGTH`` bytes loses nothing; a null identifier sorts before
every other one and stays null; rows that repeat an identifier and text have the same starts, so neither is earlier, and get
the same result; several texts under one identifier count as texts of one document, and what is removed at an offset is
removed in each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import given_id, materialize, mixed, numbered, slices
from cohortspan.llm.jaccard import run_bounds, runs_of

LENGTH, GRAM = 100, 24
#: Starts in a run at most; starts that a task looks at together.
RUN, PIECE = 2048, 1 << 20
#: Different runs of one anchor, and bytes, that one suffix sort takes.
HOT_RUNS, SORT_BYTES = 10_000, 1 << 20
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the two bases and of their inverses, enough for a piece."""

    def __init__(self, n: int = PIECE + RUN + 2 * LENGTH):
        self.up = [_powers(b, n) for b in (_BASE, _OTHER)]
        self.down = [_powers(pow(b, -1, 2**64), n) for b in (_BASE, _OTHER)]
        draw = np.random.default_rng(99)
        self.letters = draw.integers(1, 2**63, 256, np.uint64)

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letters[data] * self.up[which][: len(data)])])

    def hashes(self, sums: np.ndarray, starts: np.ndarray | slice, stops: np.ndarray | slice, which: int) -> np.ndarray:
        return mixed((sums[stops] - sums[starts]) * self.down[which][starts])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchored_runs(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """Runs of one piece: first start, number of starts, anchor, hash of all their bytes, whether the anchor occurs twice."""
    count = len(data) - LENGTH + 1
    sums = powers.sums(data, 0)
    grams = powers.hashes(sums, slice(0, len(data) - GRAM + 1), slice(GRAM, None), 0)
    anchors = sliding_min(grams, LENGTH - GRAM + 1)
    at = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    size = np.diff(np.r_[at, count])
    twice = np.zeros(len(at), bool)
    width = LENGTH - GRAM + 1
    padding = np.zeros(width - 1, np.uint64)
    places = np.flatnonzero(~sliding_min(~np.r_[padding, anchors, padding], width) == grams)  # where anchors are
    near = np.flatnonzero((np.diff(places) <= width) & (grams[places[1:]] == grams[places[:-1]]))
    if len(near):
        lo = np.searchsorted(at, np.maximum(places[near + 1] - width + 1, 0), side="right") - 1
        hi = np.searchsorted(at, places[near], side="right") - 1
        for k in range(int((hi - lo).max()) + 1):
            there = np.minimum(lo + k, hi)
            twice[there[anchors[at[there]] == grams[places[near]]]] = True
    if (size > RUN).any():
        parts = (size + RUN - 1) // RUN
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(np.repeat(size, parts) - nth * RUN, RUN)
        at, twice = np.repeat(at, parts) + nth * RUN, np.repeat(twice, parts)
    other = powers.sums(data, 1)
    whole = powers.hashes(other, at, at + size + LENGTH - 1, 1)
    return at, size, anchors[at], whole, twice


def _merged(ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """Touching or overlapping intervals of starts of one document as one."""
    order = np.lexsort((starts, ids))
    ids, starts, stops = ids[order], starts[order], stops[order]
    if not len(ids):
        return ids, starts, stops
    new = np.r_[True, ids[1:] != ids[:-1]]
    group = np.cumsum(new)
    offset = group * (int(stops.max()) + 2)
    reach = np.maximum.accumulate(stops + offset)
    opens = np.r_[True, (starts + offset)[1:] > reach[:-1]]
    first = np.flatnonzero(opens)
    return ids[first], starts[first], np.maximum.reduceat(stops, first)


#: ``place``: start * 4096 + number of starts * 2 - 2 + whether the anchor occurs twice. ``known``: an earlier run of the same slice
#: has the same bytes; such rows have no hashes, ``whole`` is the number of starts and ``place`` the start.
RUNS = "anchor long, whole long, _id long, place long, known boolean"
RUN_NAMES = [c.split()[0] for c in RUNS.split(", ")]


def document_runs(rows: DataFrame) -> DataFrame:
    """All runs (``RUNS``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches):
            found: list[list[np.ndarray]] = []
            for id_, text in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist()):
                raw = np.frombuffer(text.encode(), np.uint8)
                for begin in range(0, len(raw) - LENGTH + 1, PIECE):
                    at, size, anchor, whole, twice = anchored_runs(raw[begin : begin + PIECE + LENGTH - 1], powers)
                    found.append([anchor.view(np.int64), whole.view(np.int64), np.full(len(at), id_, np.int64), at + begin, size, twice])
            if not found:
                continue
            anchor, whole, ids, start, size, twice = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((start, ids, size, whole, anchor))
            anchor, whole, ids, start, size, twice = (c[order] for c in (anchor, whole, ids, start, size, twice))
            same = np.r_[False, (anchor[1:] == anchor[:-1]) & (whole[1:] == whole[:-1]) & (size[1:] == size[:-1])]
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
            repeats = same & ((ids != ids[first]) | (start != start[first]))
            fresh = ~same  # a repeated row has the same start again and is neither
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[fresh]) for c in (anchor, whole, ids, start * 4096 + size * 2 - 2 + twice, same)], names=RUN_NAMES)
            ids, start, stop = _merged(ids[repeats], start[repeats], (start + size)[repeats])
            if len(ids):
                spread = mixed(ids.astype(np.uint64)).view(np.int64)  # where such a row goes does not matter: evenly
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (spread, stop - start, ids, start, np.ones(len(ids), bool))], names=RUN_NAMES)

    return rows.mapInArrow(run, RUNS)


#: What a run turned out to be: repeated throughout, to be sorted with others of its anchor, or one of very many of its anchor.
REPEATED, TO_SORT, HOT = 0, 1, 2


def judged_runs(runs: DataFrame) -> DataFrame:
    """``kind``, ``anchor``, ``_id``, ``start``, ``n`` of every run that is repeated or shares its anchor with other bytes."""
    fresh = runs.repartition("anchor").sortWithinPartitions("anchor", "known", "whole", "_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, ["anchor"]):
            anchor, whole, ids, place, known = (table.column(c).to_numpy() for c in RUN_NAMES)
            start, size = np.where(known, place, place >> 12), np.where(known, whole, (place >> 1 & 2047) + 1)
            twice = ~known & (place & 1 == 1)
            order = np.lexsort((start, ids, size, whole, known, anchor))
            anchor, whole, ids, start, size, known, twice = (c[order] for c in (anchor, whole, ids, start, size, known, twice))
            bounds = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            opens = np.r_[True, (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]) | (size[1:] != size[:-1]) | (known[1:] != known[:-1])]
            first = np.maximum.accumulate(np.where(opens, np.arange(len(opens)), 0))
            repeated = known | (~opens & ((ids != ids[first]) | (start != start[first])))
            lead = opens & ~known
            different = np.repeat(np.add.reduceat(lead.astype(np.int64), bounds), np.diff(np.r_[bounds, len(anchor)]))
            size_of = np.repeat(np.add.reduceat(np.where(lead, size + LENGTH, 0), bounds), np.diff(np.r_[bounds, len(anchor)]))
            hot = (different > HOT_RUNS) | (size_of > SORT_BYTES)
            kind = np.where(repeated, REPEATED, np.where(lead & ((different > 1) | twice), np.where(hot, HOT, TO_SORT), -1))
            keep = kind >= 0
            if keep.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind[keep].astype(np.int32)), pa.array(anchor[keep]), pa.array(ids[keep]), pa.array(start[keep]), pa.array(size[keep].astype(np.int32))],
                    names=["kind", "anchor", "_id", "start", "n"])

    return fresh.mapInArrow(run, "kind int, anchor long, _id long, start long, n int")


def suffix_order(data: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``data`` (which ends in a unique smallest byte or in 0s), sorted by their first ``LENGTH`` bytes.

    Two stages: suffixes smaller than their successor are sorted directly; every other suffix takes its place when a scan of
    the buckets in order meets its successor, at the front of the bucket of its first byte.
    """
    n = len(data)
    # smaller than the successor: first differing byte of the run goes up
    change = np.flatnonzero(np.r_[data[1:] != data[:-1], True])
    up = np.zeros(n, bool)
    run = np.searchsorted(change, np.arange(n))  # the run of equal bytes that a position is in
    end = change[run]
    inside = end < n - 1
    up[inside] = data[end[inside] + 1] > data[end[inside]]
    small = np.flatnonzero(up)
    padded = np.concatenate([data, np.zeros(LENGTH, np.uint8)])
    window = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)
    direct = small[np.argsort(np.ascontiguousarray(window[small]).view(f"S{LENGTH}").ravel(), kind="stable")]
    first = data[direct]
    direct_of = np.split(direct, np.searchsorted(first, np.arange(1, 256)))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[int(data[-1])].append(np.array([n - 1]))  # the last suffix has no successor
    order: list[np.ndarray] = []

    def induce(found: np.ndarray) -> np.ndarray:
        """The suffixes before these that are larger than their successor, handed to their buckets; own bucket's come back."""
        before = found[found > 0] - 1
        before = before[~up[before]]
        letters = data[before]
        by = np.argsort(letters, kind="stable")
        letters, sorted_ = letters[by], before[by]
        cuts = np.flatnonzero(np.r_[True, letters[1:] != letters[:-1]]) if len(letters) else np.zeros(0, int)
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(letters)]):
            if letters[lo] != byte:
                waiting[int(letters[lo])].append(sorted_[lo:hi])
        return before[data[before] == byte]

    for byte in range(256):
        wave = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        waiting[byte] = []
        while len(wave):
            order.append(wave)
            wave = induce(wave)
        if len(direct_of[byte]):
            order.append(direct_of[byte])
            induce(direct_of[byte])
    return np.concatenate(order)


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each sorted suffix shares at least ``LENGTH`` bytes with the one before it."""
    padded = np.concatenate([data, np.zeros(LENGTH, np.uint8)])
    window = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)
    same, step = np.ones(len(order) - 1, bool), 20
    for k in range(0, LENGTH, step):
        live = np.flatnonzero(same)
        same[live] = (window[order[live], k : k + step] == window[order[live + 1], k : k + step]).all(axis=1)
    return np.r_[False, same]


def repeated_starts(blocks: list[bytes], ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and starts of the strings of these byte blocks (block k starts at ``starts[k]``) that also start earlier in them."""
    sizes = np.array([len(b) + 1 for b in blocks])
    data = np.frombuffer(b"\xff".join([*blocks, b""]), np.uint8) + np.uint8(1)  # a block ends in 0: UTF-8 has no 255
    owner = np.repeat(np.arange(len(blocks)), sizes)
    within = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = within <= sizes[owner] - 1 - LENGTH
    order = suffix_order(data)
    group = np.cumsum(~common_prefixes(data, order))
    valid = whole[order]
    order, group = order[valid], group[valid]
    doc, at = ids[owner[order]], starts[owner[order]] + within[order]
    by = np.lexsort((at, doc, group))
    group, doc, at = group[by], doc[by], at[by]
    first = np.r_[True, group[1:] != group[:-1]]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    later = (doc != doc[lead]) | (at != at[lead])
    return doc[later], at[later]


PIECES = "kind int, anchor long, _id long, start long, data binary"
PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]
PIECE_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def run_bytes(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """``PIECES``: the bytes of runs to sort; of runs with a hot anchor a row for each string, with two hashes of it as ``anchor`` and
    ``data``. Of equal strings of a slice only the earliest goes on; the others are repeated and leave as intervals (``data`` is the end)."""
    asked = judged.filter(F.col("kind") != REPEATED).groupBy("_id").agg(F.collect_list(F.struct("kind", "anchor", "start", "n")).alias("asked"))
    joined = rows.join(asked, "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(RUN + 2 * LENGTH)
        for batch in slices(batches):
            out, hot = [], []
            for id_, text, asked_ in zip(*(batch.column(c).to_pylist() for c in ("_id", "_text", "asked"))):
                raw = text.encode()
                for a in asked_:
                    data = raw[a["start"] : a["start"] + a["n"] + LENGTH - 1]
                    if len(data) != a["n"] + LENGTH - 1:
                        continue
                    if a["kind"] == TO_SORT:
                        out.append((TO_SORT, a["anchor"], id_, a["start"], data))
                    else:
                        letters = np.frombuffer(data, np.uint8)
                        one, two = (powers.hashes(powers.sums(letters, k), slice(0, a["n"]), slice(LENGTH, None), k) for k in (0, 1))
                        hot.append((one, two, np.full(a["n"], id_), a["start"] + np.arange(a["n"])))
            for k in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 20_000]), PIECE_TYPES)], names=PIECE_NAMES)
            if hot:
                one, two, ids, start = (np.concatenate(c) for c in zip(*hot))
                order = np.lexsort((start, ids, two, one))
                one, two, ids, start = one[order], two[order], ids[order], start[order]
                again = np.r_[False, (one[1:] == one[:-1]) & (two[1:] == two[:-1])]
                first = np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))
                later = again & ((ids != ids[first]) | (start != start[first]))  # not the same start of a repeated row
                # repeats of the slice leave as intervals, one for starts that follow each other
                doc, at, stop = _merged(ids[later], start[later], start[later] + 1)
                spread = mixed(doc.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), REPEATED, np.int32)), pa.array(spread), pa.array(doc), pa.array(at),
                                                  pa.array([x.tobytes() for x in stop.astype(np.int64)], pa.binary())], names=PIECE_NAMES)
                lead = ~again
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(lead.sum(), HOT, np.int32)), pa.array(one[lead].view(np.int64)), pa.array(ids[lead]), pa.array(start[lead]),
                     pa.array([x.tobytes() for x in two[lead]], pa.binary())], names=PIECE_NAMES)

    return joined.mapInArrow(run, PIECES)


def sorted_repeats(pieces: DataFrame) -> DataFrame:
    """``_id``, ``start``, ``stop``: repeated starts among the pieces, by suffix sorting the runs of each anchor; strings of hot anchors by
    their hashes."""
    keys = ["kind", "anchor"]
    wanted = pieces.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in _merged(doc, at, at + 1)], names=["_id", "start", "stop"])

        def settle(tables: list[pa.Table]) -> pa.RecordBatch:
            table = pa.concat_tables(tables)
            return told(*repeated_starts(table.column("data").to_pylist(), table.column("_id").to_numpy(), table.column("start").to_numpy()))

        held, size = [], 0
        for table in runs_of(batches, keys):
            kind = table.column("kind").to_numpy()
            done = table.filter(pa.array(kind == REPEATED))
            if done.num_rows:
                ends = np.frombuffer(b"".join(done.column("data").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (done.column("_id").to_numpy(), done.column("start").to_numpy(), ends)], names=["_id", "start", "stop"])
            hot = table.filter(pa.array(kind == HOT))
            if hot.num_rows:
                two = np.frombuffer(b"".join(hot.column("data").to_pylist()), np.uint64)
                one, ids, start = (hot.column(c).to_numpy() for c in ("anchor", "_id", "start"))
                order = np.lexsort((start, ids, two, one))
                one, two, ids, start = one[order], two[order], ids[order], start[order]
                again = np.r_[False, (one[1:] == one[:-1]) & (two[1:] == two[:-1])]
                first = np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))
                later = again & ((ids != ids[first]) | (start != start[first]))
                yield told(ids[later], start[later])
            rest = table.filter(pa.array(kind == TO_SORT))
            if not rest.num_rows:
                continue
            bounds = run_bounds(rest, ["anchor"])
            ends = np.cumsum(pa.compute.binary_length(rest.column("data")).to_numpy())
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                more = int(ends[hi - 1] - (ends[lo - 1] if lo else 0))
                if held and size + more > SORT_BYTES:
                    yield settle(held)
                    held, size = [], 0
                held.append(rest.slice(lo, hi - lo))
                size += more
        if held:
            yield settle(held)

    return wanted.mapInArrow(run, "_id long, start long, stop long")


def repeated(rows: DataFrame) -> DataFrame:
    """``_id`` and ``spans``, the intervals (``start``, ``stop``) of repeated starts of a document, in no order."""
    judged = materialize(judged_runs(document_runs(rows)), "runs")
    starts = judged.filter(F.col("kind") == REPEATED).select("_id", "start", (F.col("start") + F.col("n")).alias("stop"))
    starts = starts.unionByName(sorted_repeats(run_bytes(rows, judged)))
    return starts.groupBy("_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: identifier, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (removed byte intervals) and ``kept`` (what remains)."""
    rows = numbered(docs, id_col, text_col)
    joined = rows.join(repeated(rows), "_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for id_, text, spans in zip(*(batch.column(c).to_pylist() for c in ("_id", "_text", "spans"))):
                raw, cut = text.encode(), []
                if spans:
                    a, b = (np.array([s[c] for s in spans], np.int64) for c in ("start", "stop"))
                    _, a, b = _merged(np.zeros(len(a), np.int64), a, b + LENGTH - 1)
                    cut = [(x, min(y, len(raw))) for x, y in zip(a.tolist(), b.tolist()) if x < len(raw)]
                edges = [0, *(e for x in cut for e in x), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
                out.append((id_, len(raw), len(raw) - len(kept), len(cut), [{"start": x, "stop": y} for x, y in cut], kept))
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (*[pa.int64()] * 4, span, pa.binary()))],
                names=["_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    found = joined.mapInArrow(run, "_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept binary")
    return found.select(given_id("_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "spans", "kept")
