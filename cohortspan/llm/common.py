"""What the operators share: null-free inputs, bounded slices of Arrow batches, word hashes, written tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.session import materialize

#: Stands for a null identifier inside an operator: it sorts before every other one and becomes null again in results.
NO_ID = -(2**63)
#: Bytes of text that a task looks at together; only a single longer text goes beyond it.
SLICE_BYTES = 1 << 20

__all__ = ["NO_ID", "numbered", "given_id", "slices", "given_back", "WordHashes", "materialize", "mixed", "starts_of"]


def numbered(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id`` (null: ``NO_ID``) and ``_text`` (null: empty); all other columns, whatever their names, are left out."""
    return table.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"),
    )


def given_id(column: str | Column) -> Column:
    """The identifier as the input had it."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c != F.lit(NO_ID), c)


def slices(batches: Iterator[pa.RecordBatch], column: str = "_text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a slice have at most ``most`` bytes, or there is one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, start, total = np.cumsum(sizes), 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, total + most, side="right")))
            yield batch.slice(start, stop - start)
            start, total = stop, int(ends[stop - 1])


def given_back(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``; when a task ends, its worker, which lives on, hands what it freed back to the system."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


class WordHashes(dict):
    """64-bit hash of a word's bytes, remembered for the frequent words of a task."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each part begins when parts of these lengths lie one after another."""
    return np.cumsum(lengths, dtype=np.int64) - lengths
