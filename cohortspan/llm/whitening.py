"""Whitening of embeddings from an exact scatter matrix (free style: packed bits in NumPy inside Arrow batches).

Every entry c becomes the integer z = floor(64 c); the published x is z plus a constant, which no covariance sees. A task packs, for each
dimension, the bit planes of its rows' shifted values into 64-bit words: 64 rows share a word. The cross-product of two dimensions is the
sum of 2^(a+b) times the number of rows with bit a of one and bit b of the other, an AND and a popcount a word. Counts are integers, so the
products are exact; they leave a task as limbs of 40 bits, D(D+1)/2 rows a task, and are added by Spark. The driver gets D(D+1)/2 sums,
centres them as integers (n * sum(xy) - sum(x) * sum(y)) and only then takes eigenvectors. A second pass projects the rows.

Vectors that are null, hold null or non-finite entries, or entries beyond 2^61 / 64, are left out; so are vectors of another length than the
most frequent one (of equally frequent ones the longest) and empty ones. Repeated rows and null identifiers are rows like all others. Components
whose eigenvalue is rounding error (below ``FLAT`` of the largest) do not exist: equal vectors, a single row or an empty table give no rows. A deviation
beyond a long is null. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Bytes of integers that a task holds together (one row, if that is longer).
BLOCK_BYTES = 8 << 20
#: Pairs of planes are counted with at most this many bytes in memory.
PAIR_BYTES = 4 << 20
LIMB = 40
#: Largest absolute entry of 64 c.
MOST = 2.0**61
FLAT = 1e-12

_SCATTER = "i int, j int, l0 long, l1 long, l2 long, l3 long"


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``_id`` and ``_z`` (longs) of the vectors that take part."""
    entry = F.transform(F.col(f"`{vector_col}`"), lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    finite = F.forall(f"`{vector_col}`", lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < MOST, F.lit(False)))
    rows = table.filter(F.col(f"`{vector_col}`").isNotNull() & (F.size(f"`{vector_col}`") > 0) & finite)
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("_id"), entry.alias("_z"))


def planes(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of the columns of ``z`` above their minima: words (plane by word), each plane's column and bit, and the minima."""
    least = z.min(axis=0)
    shifted = (z - least).astype(np.uint64)
    columns, bits, packed = [], [], []
    for k in range(z.shape[1]):
        for b in range(int(shifted[:, k].max()).bit_length()):
            columns.append(k)
            bits.append(b)
            packed.append(np.packbits((shifted[:, k] >> np.uint64(b)).astype(np.uint8) & np.uint8(1)))
    if not packed:
        return np.zeros((0, 1), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), least
    words = np.zeros((len(packed), -(-len(packed[0]) // 8) * 8), np.uint8)
    words[:, : len(packed[0])] = packed
    return words.view(np.uint64), np.array(columns), np.array(bits), least


def cross_products(z: np.ndarray) -> tuple[list[int], dict[tuple[int, int], int]]:
    """Column sums and the sums of products of every two columns (i <= j), exact integers."""
    n, d = z.shape
    words, column, bit, least = planes(z)
    count = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    above = [0] * d
    for k, b, c in zip(column.tolist(), bit.tolist(), count.tolist()):
        above[k] += c << b
    products = {(i, j): 0 for i in range(d) for j in range(i, d)}
    first = np.searchsorted(column, np.arange(d + 1))
    step = max(1, PAIR_BYTES // max(1, words.nbytes))
    for i in range(d):
        mine = slice(first[i], first[i + 1])
        rest = words[first[i]:]
        if mine.start == mine.stop:
            continue
        counts = np.concatenate([
            np.bitwise_count(words[p : min(p + step, mine.stop), None] & rest[None]).sum(axis=2, dtype=np.int64)
            for p in range(mine.start, mine.stop, step)
        ])
        # a row of ``counts`` is a bit of column i; the columns of one j and bit sum lie together after the weights
        weights = bit[mine, None] + bit[None, first[i]:]
        where = column[None, first[i]:] * 128 + weights
        total = np.bincount((where - i * 128).ravel(), counts.ravel().astype(np.float64))
        for slot in np.flatnonzero(total).tolist():
            products[i, i + slot // 128] += int(total[slot]) << (slot % 128)
    low = [int(v) for v in least]
    for i, j in products:
        products[i, j] += low[i] * above[j] + low[j] * above[i] + n * low[i] * low[j]
    return [above[k] + n * low[k] for k in range(d)], products


def _limbs(value: int) -> tuple[int, int, int, int]:
    mask = (1 << LIMB) - 1
    return value & mask, value >> LIMB & mask, value >> 2 * LIMB & mask, value >> 3 * LIMB


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("_z").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products, most = 0, [0] * d, {}, max(1, BLOCK_BYTES // (8 * d))

        def add(block: np.ndarray) -> None:
            nonlocal n, sums
            s, p = cross_products(block)
            n += len(block)
            sums = [a + b for a, b in zip(sums, s)]
            for k, v in p.items():
                products[k] = products.get(k, 0) + v

        waiting, held = [], 0
        for batch in batches:
            z = _matrix(batch, d)
            for start in range(0, len(z), most):
                waiting.append(z[start : start + most])
                held += len(waiting[-1])
                if held >= most:
                    add(np.concatenate(waiting))
                    waiting, held = [], 0
        if held:
            add(np.concatenate(waiting))
        if not n:
            return
        # row and column -1 carry the sums and the count
        rows = [(-1, -1, n), *((-1, k, v) for k, v in enumerate(sums)), *((i, j, v) for (i, j), v in products.items())]
        limbs = list(zip(*(_limbs(v) for _, _, v in rows)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array(x, pa.int64()) for x in limbs)],
            names=["i", "j", "l0", "l1", "l2", "l3"],
        )

    return run


@dataclass
class Whitening:
    """What a fit gives: ``n`` rows, exact sums ``s`` of z, projection (one column a component) and shares of the variance."""

    n: int
    s: list[int]
    projection: np.ndarray
    explained: np.ndarray
    identity_error: float


def components(n: int, sums: list[int], products: dict[tuple[int, int], int], most: int = COMPONENTS) -> Whitening:
    """Eigenvectors of the covariance whose numerators n * sum(xy) - sum(x) * sum(y) are integers."""
    d = len(sums)
    v = np.zeros((d, d))
    for (i, j), p in products.items():
        v[i, j] = v[j, i] = (n * p - sums[i] * sums[j]) / (n * n)
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1], vector[:, ::-1]
    k = min(most, int((value > max(value[0], 0.0) * FLAT).sum()) if value[0] > 0 else 0)
    value, vector = value[:k], vector[:, :k]
    if k:
        vector = vector * np.where(vector[np.abs(vector).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    projection = vector / np.sqrt(value)
    whole = projection.astype(np.longdouble)
    error = float(np.abs(whole.T @ v.astype(np.longdouble) @ whole - np.eye(k)).max()) if k else 0.0
    return Whitening(n, sums, projection, value / np.trace(v) if k else value, error)


def fit(rows: DataFrame, d: int, most: int = COMPONENTS) -> Whitening | None:
    """Two sums a pair of dimensions reach the driver, however many rows there are."""
    limbs = rows.select("_z").mapInArrow(_sums(d), _SCATTER).groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(4)])
    total = {(r.i, r.j): sum(r[f"l{k}"] << (LIMB * k) for k in range(4)) for r in limbs.collect()}
    if not total:
        return None
    return components(total[-1, -1], [total[-1, k] for k in range(d)], {k: v for k, v in total.items() if k[0] >= 0}, most)


def _deviation(z: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Exact sums of (n z - S)^2, null beyond a long."""
    low, high = z.min(axis=0).tolist(), z.max(axis=0).tolist()
    widest = max(max(abs(a * n - t), abs(b * n - t)) for a, b, t in zip(low, high, s))
    longest = max(n * max(abs(a), abs(b), 1) + abs(t) for a, b, t in zip(low, high, s))
    if widest * widest * z.shape[1] < 2**63 and longest < 2**63:
        centred = z.astype(np.int64) * np.int64(n) - np.array(s, np.int64)
        return (centred * centred).sum(axis=1).tolist()
    exact = [sum((n * int(x) - t) ** 2 for x, t in zip(row, s)) for row in z.tolist()]
    return [e if e < 2**63 else None for e in exact]


def _whiten(model: Whitening):
    d, k = model.projection.shape
    step = max(1, BLOCK_BYTES // (8 * max(d, 7 * k)))
    whole = np.array([t // model.n for t in model.s], np.int64)
    part = np.array([t % model.n / model.n for t in model.s])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                some = batch.slice(start, step)
                z, rows = _matrix(some, d), some.num_rows
                # integer part first, so that large offsets cost no digits
                white = ((z - whole).astype(np.float64) - part) @ model.projection
                yield pa.RecordBatch.from_arrays([
                    some.column("_id").take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n, np.int64)),
                    pa.array(_deviation(z, model.n, model.s), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(white.ravel()),
                    pa.array(np.tile(model.explained, rows)),
                    pa.array(np.full(rows * k, model.identity_error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component up to ``most``, by falling eigenvalue."""
    rows = usable(table, id_col, vector_col)
    sizes = rows.groupBy(F.size("_z").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    model = fit(rows.filter(F.size("_z") == sizes[0].d), sizes[0].d, most) if sizes else None
    if model is None or not model.projection.shape[1]:
        return table.sparkSession.createDataFrame([], _RESULT)
    return rows.filter(F.size("_z") == sizes[0].d).mapInArrow(_whiten(model), _RESULT)
