"""Conversation structure repair by rank-convergence parallel Viterbi (free style: chunk automata in Python over Spark's ranges).

A conversation should read ``(system? (user assistant)+)?``. Its rows are kept (cost 0), given role user or assistant (2) or deleted (3; blank
rows and repeats must be), empty turns are inserted (2), and a truncated row that stays adds 1. The cheapest edits, in order, are the audit; of
equally cheap ones the ASCII-least.

1. Rows without their texts (turn, role, digest of role and text, faults) fall together where they are equal, then are sorted by conversation
   and turn over ranges, so a long conversation lies in many tasks. A run of at most ``CHUNK`` rows of a conversation is one byte a row.
2. Backward costs: the cost of the rest from each of the four grammar states, a vector. A chunk starts from the vector at a conversation's
   end, a guess that is right for its last chunk. Chunks at the edges of ranges then run again from what their successors found, until no
   vector differs from the one used by more than a constant: such vectors give equal choices (min-plus products come near rank one quickly).
   The usual conversation lies in one chunk and needs no second pass.
3. The states in which chunks begin are settled likewise, from first to last. Every chunk then traces its edits, least first.
4. Texts are shuffled once, by conversation in order of turns, and meet the audit there: a stream that holds no more than a batch.

A pass carries vectors through all chunks of its range, so there are at most as many passes as ranges that hold a conversation. The audit
and the digest of a conversation are one value each: the last step reads a conversation in one task, as a stream.

Null roles and texts are one space, null turns come first and count in no gap, null ids are one conversation. Rows of one turn are ordered by
role and digest of the text. A role that does not begin with s, u or a (an empty one, too) can't be kept. Empty tables give no rows; very long texts
are read where they lie; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.llm.common import NO_ID, given_id, materialize

#: Rows of a conversation that are one chunk.
CHUNK = 4096
SPACE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Grammar states: nothing yet, after system, after user, after assistant; where an inserted or reroled turn leads; where a kept s, u, a leads.
STATES = range(4)
GIVEN = (2, 2, 3, 2)
KEPT = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}, 3: {}}
#: Cost of ending in each state: an assistant's turn is missing after a user's, both after a system's.
END = (0, 2 * INSERT, INSERT, 0)
ENDING = ("", "II", "I", "")
ROLE = ("user", "user", "assistant", "user")
#: A row's byte: initial (0 s, 1 u, 2 a, 3 other), truncated, duplicate, blank.
TRUNC, DUP, BLANK = 4, 8, 16
LEGAL = frozenset(((0, 1), (1, 2), (2, 1)))


class Edits:
    """Backward costs and least edits, remembered: up to a constant there are few cost vectors."""

    def __init__(self) -> None:
        self.costs: dict = {}
        self.choices: dict = {}

    @staticmethod
    def _solve(after: tuple, code: int) -> list[int]:
        """Cost from each state before the row, when ``after`` is the cost behind it."""
        if code >= DUP:
            return [c + DELETE for c in after]
        extra = TRUNCATED if code & TRUNC else 0
        step = [min(
            DELETE + after[q], REROLE + extra + after[GIVEN[q]],
            *(KEEP + extra + after[t] for t in (KEPT[code & 3].get(q),) if t is not None),
        ) for q in STATES]
        user, assistant = min(step[2], INSERT + step[3]), min(step[3], INSERT + step[2])
        return [min(step[0], INSERT + user), min(step[1], INSERT + user), user, assistant]

    def back(self, after: tuple, code: int) -> tuple:
        """The vector before a row, less its minimum."""
        found = self.costs.get((after, code))
        if found is None:
            costs = self._solve(after, code)
            found = self.costs[after, code] = tuple(c - min(costs) for c in costs)
        return found

    def forth(self, after: tuple, code: int, state: int) -> tuple[str, int, int]:
        """Least edits of one row with the inserts before it, the state behind it, their cost."""
        found = self.choices.get((after, code, state))
        if found is None:
            costs, letters, q, cost = self._solve(after, code), "", state, 0
            extra = TRUNCATED if code & TRUNC else 0
            while found is None:
                kept = KEPT[code & 3].get(q) if code < DUP else None
                if DELETE + after[q] == costs[q]:
                    found = letters + "D", q, cost + DELETE
                elif INSERT + costs[GIVEN[q]] == costs[q]:
                    letters, q, cost = letters + "I", GIVEN[q], cost + INSERT
                elif kept is not None and KEEP + extra + after[kept] == costs[q]:
                    found = letters + "K", kept, cost + KEEP + extra
                else:
                    found = letters + "R", GIVEN[q], cost + REROLE + extra
            self.choices[after, code, state] = found
        return found

    def start(self, codes: bytes, end: tuple) -> tuple:
        """Backward costs at a chunk's start."""
        for code in reversed(codes):
            end = self.back(end, code)
        return end

    def trace(self, codes: bytes, end: tuple, state: int) -> tuple[str, int, int]:
        """Edits, state at the end, cost of a chunk."""
        after, letters, total = [], [], 0
        for code in reversed(codes):
            after.append(end)
            end = self.back(end, code)
        for code, costs in zip(codes, reversed(after)):
            edit, state, cost = self.forth(costs, code, state)
            letters.append(edit)
            total += cost
        return "".join(letters), state, total


# -- rows to chunks ----------------------------------------------------------------------------------------------------------------------


def rows_of(table: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``_conv``, ``_turn`` (null: ``NO_ID``), ``_role``, ``_text`` (null: one space) and ``_key``, the digest of role and text."""
    whole = [F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(NO_ID)).alias(a) for c, a in ((conv, "_conv"), (turn, "_turn"))]
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(a) for c, a in ((role, "_role"), (text, "_text"))]
    return table.select(*whole, *said).withColumn("_key", F.unhex(F.sha1(F.concat("_role", F.lit("\0"), "_text"))))


def _faults(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number, and its byte."""
    last = F.rtrim("_text", F.lit(SPACE))
    initial = F.substring("_role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = code + F.when(last == "", BLANK).when(F.substring(last, -1, 1).isin(".", "!", "?"), 0).otherwise(TRUNC)
    one = rows.select("_conv", "_turn", "_role", "_key", code.alias("_code")).groupBy("_conv", "_turn", "_role", "_key").agg(
        F.min("_code").alias("_code"), F.count(F.lit(1)).alias("_n")
    )
    first = one.groupBy(F.col("_conv").alias("_c"), F.col("_key").alias("_k")).agg(F.min("_turn").alias("_first"), F.count(F.lit(1)).alias("_t"))
    later = (F.col("_first") < F.col("_turn")) & (F.col("_code") < BLANK)
    marked = one.join(first.filter("_t > 1"), (F.col("_conv") == F.col("_c")) & (F.col("_key") == F.col("_k")), "left")
    return marked.select(
        "_conv", "_turn", "_role", "_key", "_n",
        F.when(later, F.col("_code").bitwiseAND(3) + DUP).otherwise(F.col("_code")).cast("tinyint").alias("_code"),
    )


_CHUNKS = (
    "_conv long, part int, seq int, edge boolean, codes binary, blank long, duplicate long, truncated long, illegal long, head int, tail int, "
    "low long, high long, turns long"
)


def _chunk_row(conv: int, part: int, seq: int, edge: bool, codes: np.ndarray, turns: np.ndarray) -> tuple:
    blank, dup = codes >= BLANK, (codes & DUP) > 0
    initial = codes & 3
    pair = initial[:-1] * 4 + initial[1:]
    known = turns[turns != NO_ID]
    return (
        conv, part, seq, edge, codes.tobytes(), int(blank.sum()), int(dup.sum()), int(((codes & TRUNC) > 0).sum()),
        int((~np.isin(pair, [a * 4 + b for a, b in LEGAL])).sum()), int(initial[0]), int(initial[-1]),
        int(known[0]) if len(known) else None, int(known[-1]) if len(known) else None,
        int((np.diff(known) != 0).sum()) + 1 if len(known) else 0,
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_CHUNK_SCHEMA = pa.schema([
    ("_conv", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("edge", pa.bool_()), ("codes", pa.binary()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("head", pa.int32()), ("tail", pa.int32()),
    ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()),
])


def _pieces(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of one conversation with at most ``most`` rows: its id, bytes and turns; of equal rows, all but the first are deleted."""
    conv, turn = batch.column("_conv").to_numpy(), batch.column("_turn").to_numpy()
    code, n = batch.column("_code").to_numpy().astype(np.uint8), batch.column("_n").to_numpy()
    row = np.repeat(np.arange(len(n)), 1 + -(-(n - 1) // most))
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    size = np.ones(len(row), np.int64)
    rest = (n - 1)[row]
    nth = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))  # 0 for the row itself
    size[~first] = np.minimum(most, rest - (nth - 1) * most)[~first]
    code = np.where(first | (code[row] >= BLANK), code[row], (code[row] & 3) | DUP).astype(np.uint8)
    conv, turn = conv[row], turn[row]
    cuts = np.flatnonzero(np.diff(conv)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(conv)]):
        while a < b:
            stop = max(a + 1, a + int(np.searchsorted(np.cumsum(size[a:b]), most, side="right")))
            yield int(conv[a]), np.repeat(code[a:stop], size[a:stop]), np.repeat(turn[a:stop], size[a:stop])
            a = stop


def _to_chunks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), []
        now, codes, turns, held, seq, edge = None, [], [], 0, 0, True

        def close(last: bool) -> None:
            nonlocal codes, turns, held, seq
            if held:
                done.append(_chunk_row(now, part, seq, edge or last, np.concatenate(codes), np.concatenate(turns)))
                codes, turns, held, seq = [], [], 0, seq + 1

        for batch in batches:
            for conv, c, t in _pieces(batch, most):
                if conv != now:
                    close(False)
                    # the first conversation of a range may have begun in the one before
                    edge, now = now is None, conv
                elif held + len(c) > most:
                    edge = True
                    close(True)
                codes.append(c)
                turns.append(t)
                held += len(c)
            if len(done) >= 256:
                yield _batch(done, _CHUNK_SCHEMA)
                done.clear()
        close(True)
        if done:
            yield _batch(done, _CHUNK_SCHEMA)

    return run


# -- passes over the chunks at edges ------------------------------------------------------------------------------------------------------


def _pass(backward: bool):
    """One run over chunks in order; a chunk takes what its neighbour in the task just found, else what it found in the last pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, now, found = Edits(), None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                used = found if r["_conv"] == now else tuple(r["given"])
                now = r["_conv"]
                found = edits.start(r["codes"], used) if backward else (edits.trace(r["codes"], tuple(r["after"]), used[0])[1],)
                rows.append((now, r["part"], r["seq"], list(used), list(found)))
            if rows:
                yield _batch(rows, _PASS_SCHEMA)

    return run


_PASS = "_conv long, part int, seq int, used array<int>, found array<int>"
_PASS_SCHEMA = pa.schema([
    ("_conv", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("used", pa.list_(pa.int32())), ("found", pa.list_(pa.int32())),
])
_PLACE = ["_conv", "part", "seq"]


def _array(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def settle(edges: DataFrame, backward: bool) -> DataFrame:
    """``given`` of every chunk at an edge: what its neighbour hands over, once no hand-over differs from the one used."""
    order = [F.col(c).desc() if backward else F.col(c) for c in ("part", "seq")]
    base = _array(END) if backward else _array([0])
    neighbour = Window.partitionBy("_conv").orderBy(*order)
    state = edges.withColumn("given", base)
    while True:
        ran = state.repartitionByRange("_conv", *order).sortWithinPartitions("_conv", *order).mapInArrow(_pass(backward), _PASS)
        ran = materialize(ran, "pass")
        given = F.coalesce(F.lag("found").over(neighbour), base)
        handed = materialize(ran.select(*_PLACE, given.alias("given"), (given != F.col("used")).alias("stale")), "handed")
        if handed.filter("stale").isEmpty():
            return handed.drop("stale")
        state = edges.join(handed.drop("stale"), _PLACE)


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edits = Edits()
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            audit, state, cost = edits.trace(r["codes"], tuple(r["after"]), r["state"])
            if r["ends"]:
                audit, cost = audit + ENDING[state], cost + END[state]
            rows.append((r["_conv"], r["part"], r["seq"], audit, cost))
        if rows:
            yield _batch(rows, _TRACE_SCHEMA)


_TRACE = "_conv long, part int, seq int, audit string, cost long"
_TRACE_SCHEMA = pa.schema([("_conv", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("audit", pa.string()), ("cost", pa.int64())])


def audits(rows: DataFrame, most: int | None = None) -> DataFrame:
    """One row per ``_conv`` of ``rows_of``: faults, gaps, cost and audit."""
    order = ["_conv", "_turn", "_role", "_key"]
    sorted_rows = materialize(_faults(rows), "turns").repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = materialize(sorted_rows.mapInArrow(_to_chunks(most or CHUNK), _CHUNKS), "chunks")
    edges = chunks.filter("edge").select(*_PLACE, "codes")
    after = settle(edges, backward=True).withColumnRenamed("given", "after")
    edges = materialize(edges.join(after, _PLACE), "edges")
    state = settle(edges, backward=False).select(*_PLACE, F.col("given")[0].alias("state"))

    in_order = Window.partitionBy("_conv").orderBy("part", "seq")
    before = lambda c: F.lag(c).over(in_order)
    joint = before("tail") * 4 + F.col("head")
    seam = chunks.filter("edge").select(
        *_PLACE, F.lead("part").over(in_order).isNull().alias("ends"),
        (before("tail").isNotNull() & ~joint.isin([a * 4 + b for a, b in LEGAL])).cast("long").alias("seam"),
        F.coalesce((F.last("high", True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)) == F.col("low")).cast("long"), F.lit(0)).alias("shared"),
    )
    known = edges.select(*_PLACE, "after").join(state, _PLACE).join(seam, _PLACE)
    whole = chunks.join(known, _PLACE, "left").select(
        *chunks.columns, F.coalesce("after", _array(END)).alias("after"), F.coalesce("state", F.lit(0)).alias("state"),
        F.coalesce("ends", F.lit(True)).alias("ends"), F.coalesce("seam", F.lit(0)).alias("seam"), F.coalesce("shared", F.lit(0)).alias("shared"),
    )
    whole = materialize(whole, "settled")
    traced = whole.select(*_PLACE, "codes", "after", "state", "ends").mapInArrow(_trace, _TRACE)
    counts = whole.groupBy("_conv").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], (F.sum("illegal") + F.sum("seam")).alias("illegal"),
        F.coalesce(F.max("high") - F.min("low") + 1 - (F.sum("turns") - F.sum("shared")), F.lit(0)).alias("gaps"),
    )
    audit = traced.groupBy("_conv").agg(
        F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "audit"))), lambda s: s["audit"]), "").alias("audit"),
    )
    return counts.join(audit, "_conv")


# -- texts -------------------------------------------------------------------------------------------------------------------------------


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator]]:
    """For each batch, events in order: ('open', conv, head columns), ('turn', edit, role, text), ('close', conv)."""
    conv, audit, place, state, head = None, "", 0, 0, None

    def given() -> tuple:
        nonlocal place, state
        role, state, place = ROLE[state], GIVEN[state], place + 1
        return "I", role, ""

    def events(batch: pa.RecordBatch):
        nonlocal conv, audit, place, state, head
        for r in zip(*(batch.column(c).to_pylist() for c in ("_conv", "kind", "_role", "_text", "head"))):
            if r[1] == 0:
                if head is not None:
                    yield from ending()
                conv, head, place, state = r[0], r[4], 0, 0
                audit = head["audit"]
                yield "open", conv, head, None
                continue
            while audit[place] == "I":
                yield "turn", *given()
            edit, place = audit[place], place + 1
            if edit == "R":
                role, state = ROLE[state], GIVEN[state]
                yield "turn", "R", role, r[3]
            elif edit == "K":
                state = KEPT["sua".index(r[2][0])][state]
                yield "turn", "K", r[2], r[3]

    def ending():
        while place < len(audit):
            yield "turn", *given()
        yield "close", conv, None, None

    for batch in batches:
        yield events(batch)
    if head is not None:
        yield ending()


def _repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, position = None, 0
    for events in _edited(batches):
        rows = []
        for kind, a, b, c in events:
            if kind == "open":
                conv, position = a, 0
            elif kind == "turn":
                rows.append((conv, position, a, b, c))
                position += 1
        if rows:
            yield _batch(rows, _ROWS_SCHEMA)


_ROWS = "_conv long, position long, edit string, role string, text string"
_ROWS_SCHEMA = pa.schema([("_conv", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head, digest, any_turn = None, None, False
    for events in _edited(batches):
        rows = []
        for kind, a, b, c in events:
            if kind == "open":
                head, digest, any_turn = b, hashlib.sha256(), False
            elif kind == "turn":
                digest.update(f"{chr(10) if any_turn else ''}{b}:{c}".encode())
                any_turn = True
            else:
                rows.append((a, *(head[k] for k in _COUNTS), head["audit"], digest.hexdigest()))
        if rows:
            yield _batch(rows, _DIGEST_SCHEMA)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_HEAD = f"struct<{', '.join(f'{c}: bigint' for c in _COUNTS)}, audit: string>"
_DIGEST = "_conv long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
_DIGEST_SCHEMA = pa.schema([("_conv", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _with_audits(rows: DataFrame, conversations: DataFrame, most: int | None) -> DataFrame:
    """Each conversation's head, then its rows in order, in one task."""
    found = audits(rows, most)
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS}
    heads = conversations.distinct().join(found, "_conv", "left").select(
        "_conv", F.lit(0).alias("kind"), F.lit(NO_ID).alias("_turn"), F.lit("").alias("_role"), F.lit(None).cast("binary").alias("_key"),
        F.lit("").alias("_text"), F.struct(*zero.values(), F.coalesce("audit", F.lit("")).alias("audit")).alias("head"),
    )
    turns = rows.select("_conv", F.lit(1).alias("kind"), "_turn", "_role", "_key", "_text", F.lit(None).cast(_HEAD).alias("head"))
    order = ["_conv", "kind", "_turn", "_role", "_key"]
    return heads.unionByName(turns).repartition("_conv").sortWithinPartitions(*order)


def repair(
    table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int | None = None
) -> DataFrame:
    """The repaired turns: conversation, position, edit (K, R or I), role and text; deleted rows are not in it."""
    rows = rows_of(table, conv, turn, role, text)
    out = _with_audits(rows, rows.select("_conv"), most).mapInArrow(_repaired_rows, _ROWS)
    return out.select(given_id("_conv").alias(conv), "position", "edit", "role", "text")


def report(
    table: DataFrame, conversations: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    most: int | None = None,
) -> DataFrame:
    """One row per conversation: faults, cost, audit and the digest of its repaired turns; ``conversations`` adds those that have no row left."""
    rows = rows_of(table, conv, turn, role, text)
    known = (table if conversations is None else conversations).select(F.coalesce(F.col(f"`{conv}`").cast("long"), F.lit(NO_ID)).alias("_conv"))
    out = _with_audits(rows, known, most).mapInArrow(_digests, _DIGEST)
    return out.select(given_id("_conv").alias(conv), *_COUNTS, "audit", "repaired_sha256")


def damage(table: DataFrame) -> DataFrame:
    """Rows dropped, emptied, stripped of sentence ends, repeated or made the user's, by the checksum of ``conv_id:turn``."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    return table.filter(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")
