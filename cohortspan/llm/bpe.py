"""Byte-level BPE: encoding by a rank queue over hierarchical bitmaps, and decoding.

Text is cut by a pattern; each piece is merged by itself. The pieces that a task has not met before lie one after
another in one linked list of parts, without pairs across pieces. The queue has one bucket per merge rank, which holds
the positions of pairs with that rank. Bitmaps of 64-bit words in three levels, each bit of a level saying that a word of
the level below is not zero, give the lowest rank that has entries by find-first-set. A bucket may hold stale entries,
whose pair has changed since; they are skipped when met. All pairs of a bucket merge in one vector step, of overlapping
ones (as in a run of one letter) every other one from the left. Where a token could merge on at a lower rank than its
own, a step ends in each piece with the first merge after which such a pair waits. The cost of a merge does not depend on the length of a piece,
so pieces of megabytes are fine.

Defined results: a null or empty text has no ids and decodes to no bytes; a null identifier stays null; every row gives
one row; an empty table gives an empty result; other columns of the input are not read. An id that the vocabulary
lacks makes decoding fail.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm.common import NO_ID, given_back, given_id, numbered, slices

#: Bytes of text encoded together.
SLICE_BYTES = 2 << 20
#: Longest piece (characters) whose ids a task remembers, and how many it remembers at most.
MEMO_BYTES, MEMO_LIMIT = 64, 100_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class RankQueue:
    """Positions by rank; three levels of bitmaps find the lowest rank that has entries."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [positions]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        else:
            bucket.append(positions)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, start, stop in zip(ranks[np.r_[0, cuts]].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(ranks)]):
            self.push(rank, positions[start:stop])

    def pop(self) -> tuple[int, np.ndarray]:
        """The lowest rank and its positions, taken out. The queue must not be empty (``top``)."""
        a = (self.top & -self.top).bit_length() - 1
        bits = self.middle[a]
        b = a << 6 | (bits & -bits).bit_length() - 1
        word = self.low[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        self.low[b] = word = word & (word - 1)
        if not word:
            self.middle[a] = bits = bits & (bits - 1)
            if not bits:
                self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))


NONE = -1


class Bpe:
    """Encoder and decoder for one set of ranks and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.size = max(ranks.values(), default=0) + 1
        self.memo: dict[str, bytes] = {}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        made = [
            (ranks[token[:k]] << 32 | ranks[token[k:]], rank)
            for token, rank in ranks.items() for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks
        ]
        table = np.array(sorted(made), np.int64).reshape(-1, 2)
        self.keys, self.made = np.append(table[:, 0], -1), np.append(table[:, 1], NONE)  # the last entry matches nothing
        self.risky = np.zeros(self.size, bool)  # tokens that can be a part of one with a lower rank
        for part in (table[:, 0] >> 32, table[:, 0] & 0xFFFFFFFF):
            self.risky[part[table[:, 1] < part]] = True

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each piece. Among equal ranks the leftmost pair merges first."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        stops = np.cumsum(sizes)
        piece = np.repeat(np.arange(len(pieces)), sizes)
        stop = stops[piece]
        part = self.of_byte[data]  # token of the part that starts here; NONE when it has been merged into another
        after = np.arange(1, n + 1)  # where the part ends, and so where the next one starts
        before = np.arange(-1, n - 1)
        before[stops - sizes] = NONE
        pair = np.full(n, NONE)  # rank of the part with the next one of its piece
        inner = np.flatnonzero(after < stop)
        pair[inner] = self.rank_of(part[inner], part[inner + 1])
        queue = RankQueue(self.size)
        first = np.flatnonzero(pair != NONE)
        if len(first):
            queue.push_all(pair[first], first)
        while queue.top:
            rank, at = queue.pop()
            at = at[pair[at] == rank]  # without stale entries
            if not len(at):
                continue
            if len(at) > 1:
                bucket, chained = at, at[1:] == after[at[:-1]]
                if chained.any():
                    nth = np.arange(len(at))
                    at = at[(nth - np.maximum.accumulate(np.where(np.r_[False, chained], 0, nth))) % 2 == 0]
                if self.risky[rank]:
                    ready = self.until_lower(rank, at, part, after, before, stop, piece)
                    if not ready.all():
                        queue.push(rank, bucket)  # what has merged is stale by then
                    at = at[ready]
            middle = after[at]
            end = after[middle]
            after[at], part[at] = end, rank
            part[middle] = pair[middle] = NONE
            goes_on = end < stop[at]
            before[end[goes_on]] = at[goes_on]
            left = before[at]
            touched = np.concatenate([at, left[left >= 0]])
            right = after[touched]
            goes_on = right < stop[touched]
            new = np.full(len(touched), NONE)
            new[goes_on] = self.rank_of(part[touched[goes_on]], part[right[goes_on]])
            pair[touched] = new
            found = new != NONE
            if found.any():
                queue.push_all(new[found], touched[found])
        ids = part[part != NONE].astype("<u4").tobytes()
        counts = np.bincount(piece[part != NONE], minlength=len(pieces))
        ends = (4 * np.cumsum(counts)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def until_lower(self, rank, at, part, after, before, stop, piece) -> np.ndarray:
        """Marks in each piece the merges up to the first that makes a pair of lower rank, which has to go next."""
        end, left = after[after[at]], before[at]
        low = np.zeros(len(at), bool)
        goes_on = end < stop[at]
        ranks = self.rank_of(np.full(goes_on.sum(), rank), part[end[goes_on]])
        low[goes_on] = (ranks != NONE) & (ranks < rank)
        has_left = np.flatnonzero(left >= 0)
        to_left = part[left[has_left]]
        follows = np.r_[False, end[:-1] == at[1:]]  # the part to the left has just been made by a merge of this step
        ranks = self.rank_of(np.where(follows[has_left], rank, to_left), np.full(len(has_left), rank))
        low[has_left] |= (ranks != NONE) & (ranks < rank)
        earlier = np.cumsum(low) - low
        lead = np.r_[True, piece[at[1:]] != piece[at[:-1]]]
        return earlier == np.maximum.accumulate(np.where(lead, earlier, 0))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        memo = self.memo
        if len(memo) > MEMO_LIMIT:
            memo.clear()
        cut = [self.find(t) for t in texts]
        fresh = list({p for found in cut for p in found if p not in memo})
        raw = [p.encode() for p in fresh]
        whole = [self.ranks.get(p) for p in raw]
        merged = iter(self.pieces([p for p, w in zip(raw, whole) if w is None]))
        memo.update((p, next(merged) if w is None else w.to_bytes(4, "little")) for p, w in zip(fresh, whole))
        packed = [b"".join(map(memo.__getitem__, found)) for found in cut]
        for p in fresh:
            if len(p) > MEMO_BYTES:
                del memo[p]
        return packed

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def shared(spark: SparkSession, ranks_path: str, pattern: str) -> Callable[[], Bpe]:
    """Gives tasks their ``Bpe``. The vocabulary, a file of the driver and of fixed size, is broadcast; a Python worker
    builds its encoder once, beside its copy of the vocabulary, and later tasks find it there with what it remembers."""
    with open(ranks_path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast((f.read(), pattern, []))

    def get() -> Bpe:
        data, own_pattern, made = vocabulary.value
        if not made:
            made.append(Bpe(read_ranks(data), own_pattern))
        return made[0]

    return get


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: identifier, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers)."""
    bpe_here = shared(docs.sparkSession, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_here()
        for batch in slices(batches, most=SLICE_BYTES):
            packed = bpe.encode(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary())],
                names=["_id", "n_tokens", "ids"],
            )

    out = numbered(docs, id_col, text_col).mapInArrow(given_back(run), "_id long, n_tokens long, ids binary")
    return out.select(given_id("_id").alias(id_col), "n_tokens", "ids")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``encode``: its three columns and ``decoded``, the bytes that the ids stand for (null ids: none)."""
    bpe_here = shared(encoded.sparkSession, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_here()
        for batch in slices(batches, "ids"):
            found = [bpe.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=["_id", "n_tokens", "ids", "decoded"])

    rows = encoded.select(F.coalesce(F.col(f"`{id_col}`"), F.lit(NO_ID)).alias("_id"), "n_tokens", "ids")
    out = rows.mapInArrow(given_back(run), "_id long, n_tokens long, ids binary, decoded binary")
    return out.select(given_id("_id").alias(id_col), "n_tokens", "ids", "decoded")
