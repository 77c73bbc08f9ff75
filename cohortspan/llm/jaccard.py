"""Jaccard join of documents on five-word shingles: MinHash buckets, Bayesian pruning, exact verification.

1. Documents with equal shingle sets are one class; from here on there is one text per class.
2. 128 MinHash values in 32 bands of 4 give candidate buckets: two texts of similarity 0.8 share none with a
   probability of 5e-8. Buckets of one are dropped.
3. In a bucket, pairs are compared by 16 MinHash values at a time. After each step the posterior probability (uniform prior)
   that the similarity reaches the threshold is known; below ``TOLERANCE`` the pair is dropped. A bucket emits only edges that
   connect texts not yet connected in it, never all its pairs: n texts give n - 1 edges at most.
4. The texts of a connected component meet in tasks, and every pair among them is verified exactly on its shingle sets. Links are
   counted there, not emitted; each text leaves with its number of links and the smallest identifier it is connected to.
5. Components of the verified links are the groups.

Buckets and components beyond a block size are cut into blocks, and every two blocks meet in a task of their own.

Defined results: a null text counts as empty; texts without a word have equal (empty) sets and form one class; texts of one
to four words have one shingle; a null identifier sorts before every other one and stays null; rows that repeat an identifier
and text count in ``class_size`` each and give a row each; an identifier with several texts has a row per row of the input;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import WordHashes, given_back, given_id, materialize, mixed, numbered, slices, starts_of
from cohortspan.llm.components import components
from cohortspan.llm.shingles import shingle_sets

#: Similarity of at least NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 4, 5
BANDS, BAND_ROWS, STEP = 32, 4, 16
VALUES = BANDS * BAND_ROWS
TOLERANCE = 1e-6
#: Texts of a bucket or component that one task compares, half of them per block when there are more; bytes per block.
BUCKET_BLOCK, VERIFY_BLOCK, VERIFY_BYTES = 4096, 1024, 2 << 20


def least_matches(threshold: float = NUMERATOR / DENOMINATOR, tolerance: float = TOLERANCE, values: int = VALUES, step: int = STEP) -> list[int]:
    """After 16, 32, ... values: the fewest matches at which the posterior of reaching the threshold is within tolerance.

    With a uniform prior and m matches among k values, P(similarity >= t) = P(Binomial(k + 1, t) <= m).
    """
    out = []
    for k in range(step, values + 1, step):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out.append(m)
    return out


def likely(left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of two tables of MinHash bytes may reach the threshold, looking at further values only while they may."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for i, fewest in enumerate(least):
        part = slice(i * STEP, (i + 1) * STEP)
        matches = matches + (left[alive, part] == right[alive, part]).sum(axis=1)
        passed = matches >= fewest
        alive, matches = alive[passed], matches[passed]
    return alive


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``key`` (digest of the shingle set), ``n_bytes``, ``bands`` (bucket of each band) and ``sig`` (a byte of each value)."""
    draw = np.random.default_rng(20240501)
    a = draw.integers(0, 2**63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
    b = draw.integers(0, 2**63, VALUES, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            texts = batch.column("_text").to_pylist()
            sets = shingle_sets(texts, hashes)
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            least = np.zeros((VALUES, len(sets)), np.uint64)
            if len(full):
                values, starts = np.concatenate([sets[i] for i in full]), starts_of(sizes[full])
                for k in range(VALUES):
                    least[k, full] = np.minimum.reduceat(values * a[k] + b[k], starts)
            least = mixed(least)
            bands = np.zeros((BANDS, len(sets)), np.uint64)
            for band in range(BANDS):
                total = np.full(len(sets), band, np.uint64)
                for row in range(BAND_ROWS):
                    total = mixed(total * np.uint64(31) + least[band * BAND_ROWS + row])
                bands[band] = total
            flat = np.ascontiguousarray(bands.T).view(np.int64).ravel()
            offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
            sig = np.ascontiguousarray((least >> np.uint64(56)).astype(np.uint8).T)
            yield pa.RecordBatch.from_arrays([
                batch.column("_id"), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(flat[np.repeat(sizes > 0, BANDS)])),
                pa.array([s.tobytes() for s in sig], pa.binary()),
            ], names=["_id", "key", "n_bytes", "bands", "sig"])

    return numbered(docs, id_col, text_col).mapInArrow(given_back(run), "_id long, key binary, n_bytes long, bands array<long>, sig binary")


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole runs of rows with equal keys, from rows that come sorted by the keys."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy() for k in keys]
        if kept:
            last = [kept[-1].column(k)[-1].as_py() for k in keys]
            opens = np.flatnonzero(np.logical_or.reduce([v != x for v, x in zip(values, last)]))
            if not len(opens):
                kept.append(batch)
                continue
            yield pa.Table.from_batches([*kept, batch.slice(0, opens[0])])
            batch, values, kept = batch.slice(opens[0]), [v[opens[0] :] for v in values], []
        changes = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values]))
        if len(changes):
            yield pa.Table.from_batches([batch.slice(0, changes[-1] + 1)])
            batch = batch.slice(changes[-1] + 1)
        kept = [batch]
    if kept:
        yield pa.Table.from_batches(kept)


def run_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where runs begin in a table, and its end."""
    changes = np.logical_or.reduce([(v := table.column(k).to_numpy())[1:] != v[:-1] for k in keys])
    return np.r_[0, np.flatnonzero(changes) + 1, table.num_rows]


def in_blocks(rows: DataFrame, key: str, unit: str, blocks: str) -> DataFrame:
    """Rows with ``i`` and ``j``, the two blocks that meet, and ``own``, the block of the row; one block meets itself alone."""
    own = F.pmod(F.xxhash64(unit), F.col(blocks)).cast("int")
    meets = F.when(F.col(blocks) == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1), lambda j: j != own))
    out = rows.withColumn("_m", F.explode(meets)).withColumn("own", own)
    return out.withColumn("i", F.least("own", "_m").cast("int")).withColumn("j", F.greatest("own", "_m").cast("int")).drop("_m")


def spanning(sig: np.ndarray, least: list[int]) -> list[tuple[int, int]]:
    """Edges between likely pairs that connect whatever any likely pairs connect; pairs connected before are not compared."""
    n = len(sig)
    part, edges = np.arange(n), []

    def compare(x: int) -> None:
        others = np.flatnonzero(part != part[x])
        for y in others[likely(np.broadcast_to(sig[x], (len(others), sig.shape[1])), sig[others], least)]:
            if part[y] != part[x]:
                edges.append((x, y))
                part[part == part[y]] = part[x]

    compare(0)
    base = np.bincount(part).argmax()
    for x in range(1, n):  # a pair across components has an end outside the base, and is compared from there
        if part[x] != part[base]:
            compare(x)
    return edges


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Distinct edges ``a``, ``b`` between classes that share a bucket and survive the pruning."""
    least = least_matches()
    rows = classes.select("class_id", F.explode("bands").alias("bucket"))
    counts = rows.groupBy("bucket").count().filter("count > 1")
    rows = rows.join(counts, "bucket").withColumn(
        "blocks", F.when(F.col("count") <= BUCKET_BLOCK, F.lit(1)).otherwise(F.ceil(F.col("count") * 2 / BUCKET_BLOCK)).cast("int"))
    rows = in_blocks(rows, "bucket", "class_id", "blocks").select("bucket", "i", "j", "class_id")
    rows = rows.join(classes.select("class_id", "sig"), "class_id")
    keys = ["bucket", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, keys):
            ids = table.column("class_id").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, VALUES)
            bounds = run_bounds(table, keys)
            sizes = np.diff(bounds)
            run_no = np.repeat(np.arange(len(sizes)), sizes)
            left, right = [], []
            for distance in range(1, 8):  # runs of up to 8 rows: all their pairs at once
                p = np.flatnonzero((run_no[distance:] == run_no[:-distance]) & (sizes[run_no[distance:]] <= 8))
                alive = p[likely(sig[p], sig[p + distance], least)]
                left.append(ids[alive])
                right.append(ids[alive + distance])
            for k in np.flatnonzero(sizes > 8):
                edges = np.array(spanning(sig[bounds[k] : bounds[k + 1]], least), np.int64).reshape(-1, 2) + bounds[k]
                left.append(ids[edges[:, 0]])
                right.append(ids[edges[:, 1]])
            a, b = np.concatenate(left), np.concatenate(right)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    found = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(given_back(run), "a long, b long")
    return found.distinct()


def linked(sets: list[np.ndarray], own: np.ndarray, i: int, j: int, blocks: int) -> np.ndarray:
    """Boolean matrix of the links that this meeting of blocks i and j has to count."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    _, word, times = np.unique(values, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = times[word] > 1  # a shingle of one text only is in no intersection
    word, owner = word[shared], owner[shared]
    order = np.argsort(word, kind="stable")
    word, owner = word[order], owner[order]
    word = np.cumsum(np.r_[0, word[1:] != word[:-1]]) if len(word) else word
    common, width = np.zeros((n, n), np.float32), 2048
    for start in range(0, int(word[-1]) + 1 if len(word) else 0, width):
        lo, hi = np.searchsorted(word, [start, start + width])
        table = np.zeros((n, width), np.float32)
        table[owner[lo:hi], word[lo:hi] - start] = 1
        common += table @ table.T
    common = np.rint(common).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    link = DENOMINATOR * common >= NUMERATOR * union
    np.fill_diagonal(link, False)
    if blocks > 1:  # pairs inside block b belong to the meeting of b and b + 1, of the last block to the last meeting
        same = own[:, None] == own[None, :]
        inside = np.zeros(n, bool)
        if j == i + 1:
            inside |= own == i
            if j == blocks - 1:
                inside |= own == j
        link &= ~same | (inside[:, None] & inside[None, :])
    return link


def verified(docs: DataFrame, candidates: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per meeting and class with links there: ``class_id``, ``near`` (smallest class connected to it) and ``links``."""
    inside = candidates.withColumnRenamed("id", "class_id").join(classes.select("class_id", "key", "n_bytes"), "class_id")
    totals = inside.groupBy("label").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size"))
    totals = totals.select("label", F.when((F.col("n") <= VERIFY_BLOCK) & (F.col("size") <= VERIFY_BYTES), F.lit(1)).otherwise(
        F.greatest(F.ceil(F.col("n") * 2 / VERIFY_BLOCK), F.ceil(F.col("size") / VERIFY_BYTES), F.lit(2))).cast("int").alias("blocks"))
    inside = inside.join(totals, "label").select(F.col("class_id").alias("_id"), "key", "label", "blocks")
    texts = numbered(docs, id_col, text_col).join(inside, "_id")
    rows = in_blocks(texts, "label", "_id", "blocks").select("label", "i", "j", "blocks", "own", "_id", "key", "_text")
    keys = ["label", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for table in runs_of(batches, keys):
            bounds = run_bounds(table, keys)
            cols = {c: table.column(c).to_numpy() for c in ("_id", "i", "j", "blocks", "own")}
            out = []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                sets = shingle_sets(table.column("_text").slice(lo, hi - lo).to_pylist(), hashes)
                own_key = table.column("key").slice(lo, hi - lo).to_pylist()
                # a repeated row, or another text under the same identifier, does not stand for the class
                seen, use = set(), []
                for r, (s, k) in enumerate(zip(sets, own_key)):
                    if k not in seen and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == k:
                        seen.add(k)
                        use.append(r)
                if len(use) < 2:
                    continue
                at = np.array(use) + lo
                ids = cols["_id"][at]
                link = linked([sets[r] for r in use], cols["own"][at], int(cols["i"][lo]), int(cols["j"][lo]), int(cols["blocks"][lo]))
                near = ids.copy()
                while True:  # the smallest identifier spreads along links
                    least = np.where(link, near[None, :], near[:, None]).min(axis=1)
                    least = np.minimum(least, near)
                    if (least == near).all():
                        break
                    near = least
                links = link.sum(axis=1)
                some = links > 0
                out.append((ids[some], near[some], links[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=["class_id", "near", "links"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(given_back(run), "class_id long, near long, links long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: identifier, ``class_id`` (smallest identifier with the same shingle set), ``class_size`` (rows),
    ``n_links`` (other classes of similarity 0.8 or more) and ``group_id`` (smallest identifier that links lead to)."""
    sig = materialize(signatures(docs, id_col, text_col), "signatures")
    classes = materialize(sig.groupBy("key").agg(
        F.min("_id").alias("class_id"), F.count("*").alias("class_size"), F.first("n_bytes").alias("n_bytes"),
        F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    near = components(candidate_edges(classes))
    links = materialize(verified(docs, near, classes, id_col, text_col), "links")
    groups = components(links.select(F.col("class_id").alias("a"), F.col("near").alias("b")))
    counts = links.groupBy("class_id").agg(F.sum("links").alias("n_links"))
    known = counts.join(groups.withColumnRenamed("id", "class_id"), "class_id")
    told = classes.select("key", "class_id", "class_size").join(known, "class_id", "left")
    return sig.select("_id", "key").join(told, "key").select(
        given_id("_id").alias(id_col), given_id("class_id").alias("class_id"), "class_size",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), given_id(F.coalesce("label", "class_id")).alias("group_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, of each group only the document with the smallest identifier.

    A null identifier counts as smallest; rows that repeat the kept identifier and text all stay.
    """
    first = join(docs, id_col, text_col).filter(F.col(id_col).eqNullSafe(F.col("group_id"))).select(F.col(id_col).alias("_first")).distinct()
    return docs.join(first, F.col(f"`{id_col}`").eqNullSafe(F.col("_first")), "left_semi")
