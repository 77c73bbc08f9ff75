"""Quality rules as a short-circuit cascade ordered by rejections per cost.

A document is rejected by the base test or by any of ``RULES``. The verdict does not depend on the order of the
rules; the order only decides how soon a bad document is given up. Every rule is timed on a sample, each time on a
fresh ``Doc``; then the rule that rejects most of the still living sample documents per second goes first, and so on
with what it leaves.

Defined results: a null or empty text has no word and fails the base test; a null identifier stays null; every row
gives one row (repeated rows give repeated rows); an empty table gives an empty result and the order as written;
other columns of the input are not read, so their names do not matter.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import given_id, numbered, slices

SYMBOLS = "#*$%&|<>"
#: Rows that cost and selectivity are estimated on (about; all rows of a smaller table).
SAMPLE_ROWS = 2000


class Doc:
    """One text and the counts that rules ask for, each computed when first asked for."""

    def __init__(self, text: str):
        self.text = text
        self.data = text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()  # bytes split at 0x20 and 0x09-0x0D only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.data.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_exclaims(self) -> int:
        return self.text.count("!")

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.data.split(b"\n") if line and not line.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        seen = Counter(windows)
        if len(seen) == len(windows):
            return 0
        total, covered = 0, 0  # covered: words before this position are counted or passed
        for i, window in enumerate(windows):
            if seen[window] > 1:
                total += i + 3 - max(covered, i)
                covered = i + 3
        return total

    @cached_property
    def top_count(self) -> int:
        return max(Counter(self.words).values(), default=0)

    @cached_property
    def n_letterless(self) -> int:
        return sum(c for w, c in Counter(self.words).items() if not any(x.isalpha() for x in w.decode()))


def base_failed(d: Doc) -> bool:
    return d.n_words < 50 or 100 * d.n_repeat_words > 50 * d.n_words


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Doc], bool]


#: Each compares whole counts, so that a verdict has no rounding edge.
RULES = (
    Rule("repeated_words", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
    Rule("too_short", lambda d: d.n_words < 50),
    Rule("duplicate_lines", lambda d: 2 * d.n_dup_lines > len(d.lines)),
    Rule("dominant_word", lambda d: 4 * d.top_count > d.n_words),
    Rule("no_letters", lambda d: 10 * d.n_letterless > 3 * d.n_words),
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words),
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("shouting", lambda d: 5 * d.n_exclaims > d.n_words),
)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, text_col: str = "text"):
    """Seconds of each rule on the sample, and how many sample documents each set of rules rejects (bit i: rule i)."""
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    rows = texts.count()
    sample = texts if rows <= sample_rows else texts.sample(sample_rows / rows, seed=7)

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            masks, cost = [], [0] * len(rules)
            for text in batch.column("_text").to_pylist():
                mask = 0
                for i, rule in enumerate(rules):
                    began = time.perf_counter_ns()
                    mask |= rule.rejects(Doc(text)) << i
                    cost[i] += time.perf_counter_ns() - began
                masks.append(mask)
            counts = Counter(masks)
            yield pa.RecordBatch.from_pydict({
                "mask": pa.array([*counts, *[-1 - i for i in range(len(rules))]], pa.int64()),
                "n": pa.array([*counts.values(), *cost], pa.int64()),
            })

    # at most 2 ** rules + rules sums reach the driver
    found = dict(sample.mapInArrow(timed, "mask long, n long").groupBy("mask").agg(F.sum("n")).collect())
    return [found.get(-1 - i, 0) / 1e9 for i in range(len(rules))], {m: n for m, n in found.items() if m >= 0}


def cascade_order(cost: list[float], masks: dict[int, int]) -> list[int]:
    """Greedy: always the rule with most rejections per second among documents that the rules before it let pass."""
    left, order, alive = list(range(len(cost))), [], dict(masks)
    while left:
        rejected = {i: sum(n for m, n in alive.items() if m >> i & 1) for i in left}
        best = max(left, key=lambda i: (rejected[i] / max(cost[i], 1e-9), -cost[i], -i))
        order.append(best)
        left.remove(best)
        alive = {m: n for m, n in alive.items() if not m >> best & 1}
    return order


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> tuple[Rule, ...]:
    return tuple(rules[i] for i in cascade_order(*estimate(docs, rules, sample_rows, text_col)))


def verdict(doc: Doc, rules: tuple[Rule, ...]) -> str | None:
    """Name of the first rule that rejects the document; the rules after it are not evaluated."""
    return next((rule.name for rule in rules if rule.rejects(doc)), None)


def profile(docs: DataFrame, rules: tuple[Rule, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: identifier, counts, base test, verdict and the rule that rejected it, by the cascade."""
    rules = rules or ordered(docs, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column("_text").to_pylist():
                d = Doc(text)
                failed = base_failed(d)
                why = "base" if failed else verdict(d, rules)
                rows.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, why is None, why))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.bool_()) for c in cols[5:7]), pa.array(cols[7], pa.string())],
                names=["_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"],
            )

    out = numbered(docs, id_col, text_col).mapInArrow(
        run, "_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, rejected_by string")
    return out.select(given_id("_id").alias(id_col), *out.columns[1:])


def keep(docs: DataFrame, rules: tuple[Rule, ...] | None = None, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that no rule rejects; a rejected text costs only the rules up to the first."""
    rules = rules or ordered(docs, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            yield batch.filter(pa.array([verdict(Doc(t or ""), rules) is None for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
