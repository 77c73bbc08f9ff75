"""Nearest-neighbour and mode imputation.

The neighbours of a row are the k nearest of the whole table, whatever its size. Rows with gaps in the same columns that lie close
together form blocks, and each block has a box: the range of every column. Boxes of neighbouring blocks are joined to larger boxes,
``FANOUT`` at a time, up to one: a tree, kept as a table. How far a row is from a box bounds how near any row in it can be. Rows that look for
neighbours form blocks in the same order, cells, and cells go down the tree level by level as joins: first along the nearest boxes, of which each row
takes those that hold more than k rows, which bounds the distance of its k-th neighbour, then into all boxes that are no further than the largest
bound of the cell; its rows keep those within their own. Distances stay inside NumPy tasks of one block each; no pair becomes a row.

Two rows are compared on the columns that both have, and the widest of those decides which blocks are near. Where one order of the reference
rows would leave many pairs without such a column (``PAIRS``), there is a tree for each set of widest columns, with a root for each set of
gaps, and every pair belongs to one tree. The neighbours are the same whatever the trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import at_once, from_rows, materialize

#: Rows looking for neighbours that one task compares with a block; a block that more of them need is read by several tasks.
TARGETS_PER_TASK = 5_000
#: Rows (target and what it meets) a task, where that is fewer tasks than the session has partitions.
TASK_ROWS = 10_000
#: Boxes that are joined to one of the next level.
FANOUT = 32
#: Rows looking for neighbours that go down a tree together.
CELL = 500
#: Boxes nearest to a cell, at least, among which its rows choose where to look first.
NEAR = 16
#: Rows that a task cuts into blocks, where that is fewer tasks than the session has partitions.
CUT_ROWS = 20_000
#: Reference rows of a block that are compared with a row exactly, before the estimates are ordered to leave some out.
FEW = 100
#: Cuts of each column that decide which rows lie close together.
CUTS = 15
#: Pairs (row with a gap, reference row) from which a set of widest columns gets a tree of its own.
PAIRS = 100_000_000
#: Trees at most; other pairs share one that is ordered by the widest columns of all.
TREES = 8
#: Sets of gaps up to which trees are told apart by them.
KINDS = 64


@dataclass(frozen=True)
class ImputeModel:
    """Column means and the size of blocks; p values on the driver."""

    columns: tuple[str, ...]
    means: dict[str, float]
    n_rows: int
    usable: int
    block_rows: int
    k: int
    row_limit: float


def missing_cells(columns):
    return sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))


def fit(df: DataFrame, columns, *, k: int = 10, max_block: int = 1500, row_limit: float = 0.8, col_limit: float = 0.8) -> ImputeModel:
    columns = tuple(columns)
    usable = missing_cells(columns) <= row_limit * len(columns)
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(usable.cast("bigint")).alias("usable"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)],
    ).first()
    n = row["n"]
    for i, c in enumerate(columns):
        if n - row[f"c{i}"] > col_limit * n:
            raise ValueError(f"column {c} is missing in more than {col_limit:.0%} of the rows")
    usable_rows = row["usable"] or 0
    return ImputeModel(columns, {c: row[f"m{i}"] for i, c in enumerate(columns)}, n, usable_rows, max_block, k, row_limit)


def apart(targets: np.ndarray, pool: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean squared difference over shared columns of pairs (place of a target, place in the pool); infinite without any."""
    total, shared = np.zeros((2, len(row)))
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        for j in np.flatnonzero(~np.isnan(targets).all(axis=0)):
            x, y = targets[row, j], pool[at, j]
            both = ~np.isnan(x) & ~np.isnan(y)
            total += np.where(both, (x - y) ** 2, 0.0)
            shared += both
        return np.where(shared > 0, total / shared, np.inf)


def distances(targets: np.ndarray, pool: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The same for all pairs; infinite where ``own`` marks a row and itself."""
    row, at = np.indices(own.shape)
    dist = apart(targets, pool, row.ravel(), at.ravel()).reshape(own.shape)
    dist[own] = np.inf
    return dist


def estimates(targets: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of targets with the same gaps to all rows of the pool by one matrix product; and how far off a target's may be."""
    have = np.flatnonzero(~np.isnan(targets[0]))
    there = ~np.isnan(pool[:, have])
    shared = there.sum(axis=1)
    centre = np.where(there, pool[:, have], 0.0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)
    a, b = targets[:, have] - centre, np.where(there, pool[:, have] - centre, 0.0)
    far = (b * b).sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        if there.all():
            total = (-2.0 * a) @ b.T
            total += (a * a).sum(axis=1)[:, None]
        else:
            total = np.hstack([a * a, -2.0 * a]) @ np.hstack([there, b]).T
        total += far
        total /= shared
        # sums of squares of this size, to some hundred times the last bit
        slack = 1e-12 * ((a * a).sum(axis=1) + far.max(initial=0.0))
    total[:, shared == 0] = np.inf
    return total, slack


def itself(ids: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Which pairs of ids are equal; only ids that occur in the pool are compared with all of it."""
    own = np.zeros((len(ids), len(pool)), bool)
    held = np.flatnonzero(pd.Series(ids).isin(pool))
    if len(held):
        own[held] = ids[held, None] == pool[None, :]
    return own


def _tasks(df: DataFrame, rows: int) -> int:
    return max(1, min(math.ceil(rows / TASK_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _chunks(n: int, size: int = 512):
    return (slice(a, min(a + size, n)) for a in range(0, n, size))


def _alike(values: np.ndarray, size: int = 256) -> Iterator[np.ndarray]:
    """Places of rows with the same gaps, ``size`` at a time."""
    bits = np.packbits(np.isnan(values), axis=1)
    kinds, kind = np.unique(bits.view(f"S{bits.shape[1]}")[:, 0], return_inverse=True)
    for i in range(len(kinds)):
        rows = np.flatnonzero(kind == i)
        yield from (rows[s] for s in _chunks(len(rows), size))


@dataclass(frozen=True)
class Tree:
    """The reference rows with ``_block``, and the boxes: (level, node, parent, n, mixed, low0, high0, ...), blocks at level 0, one box at ``top``.

    ``kinds`` are the sets of gaps that have a root each; without them there is one root. ``order`` are the columns that order the rows, with
    the cuts of each, where that is known.
    """

    rows: DataFrame
    nodes: DataFrame
    top: int
    kinds: tuple[str, ...] = ()
    order: dict[int, list[float]] | None = None


@dataclass(frozen=True)
class Forest:
    """Trees over the same reference rows for targets that are not known yet, each for a set of widest columns (empty: all other pairs).

    ``spread`` is how much each column varies; it tells which columns of a pair are the widest.
    """

    trees: tuple[tuple[tuple[int, ...], Tree], ...]
    spread: tuple[float, ...]


def gaps_of(columns) -> Column:
    """The gaps of a row as text: a digit a column, 0 where it is missing."""
    return F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])


def widest(spread: list[float], among) -> tuple[int, ...]:
    """The columns that spread most, down to a tenth of the widest."""
    order = sorted(among, key=lambda i: -spread[i])[:15]
    return tuple(i for i in order if spread[i] >= spread[order[0]] / 10)


def _cut(df: DataFrame, columns: list[str], id_column: str, model: ImputeModel, size: int, name: str, leading: tuple[int, ...] | None,
         kinds: tuple[str, ...] = (), known: dict[int, list[float]] | None = None) -> tuple[DataFrame, dict[int, list[float]]]:
    """``df`` with ``_gaps`` and the block of ``size`` rows that each row lies in as ``name``; and the columns that order the rows, with their cuts.

    Rows are range-partitioned by which columns they have and by an interleaving of the cuts of the ``leading`` columns (by default, those that spread
    most), so that rows that are close to each other lie together; a partition's rows of one kind are cut into blocks. ``known`` are columns and cuts
    of rows like these.
    """
    share = [q / (CUTS + 1) for q in range(1, CUTS + 1)]
    cuts = lambda among: [F.percentile_approx(columns[i], share, 1000).alias(f"q{i}") for i in among]
    if known:
        leading, stats = tuple(known), {f"q{i}": cut for i, cut in known.items()}
    elif leading:
        # one column orders the rows by itself
        stats = df.agg(*cuts(leading)).first() if len(leading) > 1 else {f"q{leading[0]}": None}
    else:
        stats = df.agg(*cuts(range(len(columns))), *[F.stddev(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
        leading = widest([stats[f"s{i}"] or 0.0 for i in range(len(columns))], range(len(columns)))
    order_by = {i: stats[f"q{i}"] or [] for i in leading}
    # how many cuts a value is above, halving from column to column: the code of a row stays below what the JVM compiles (8,000 bytes)
    split, keyed = [i for i in leading if order_by[i]], df.withColumns({"_gaps": gaps_of(columns), **{f"_above{i}": F.lit(0) for i in leading}})
    for half in (8, 4, 2, 1):
        keyed = keyed.withColumns({f"_above{i}": F.col(f"_above{i}") + F.when(
            F.col(columns[i]) > F.get(F.lit([float(m) for m in order_by[i]]), F.col(f"_above{i}") + F.lit(half - 1)), half).otherwise(0) for i in split})
    key = F.lit(0).cast("long")
    for at, i in enumerate(reversed(leading)):
        # its four bits spread over the key
        spread = [sum((n >> bit & 1) << (bit * len(leading) + at) for bit in range(4)) for n in range(CUTS + 1)]
        key = key + F.get(F.lit(spread).cast("array<long>"), F.col(f"_above{i}"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(math.ceil(model.usable / max(size, CUT_ROWS)), 4 * tasks))
    order = ["_gaps", "_key", *[columns[i] for i in leading[:1]], id_column]
    keyed = keyed.withColumn("_key", key).select(*df.columns, "_gaps", "_key")
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    roots = {g: i << 52 for i, g in enumerate(kinds)}

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, kind, held, block = TaskContext.get().partitionId(), None, 0, -1
        for pdf in batches:
            blocks = []
            for g in pdf["_gaps"]:
                if g != kind or held == size:
                    kind, held, block = g, 0, block + 1
                held += 1
                blocks.append(roots.get(g, 0) + (part << 32) + block)
            yield pdf.drop(columns="_key").assign(**{name: np.array(blocks, np.int64)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return materialize(ranged.mapInPandas(number, f"{fields}, _gaps string, {name} long"), "blocks"), order_by


def grown(pool: DataFrame, columns: list[str], id_column: str, model: ImputeModel, leading: tuple[int, ...] | None = None,
          kinds: tuple[str, ...] = ()) -> Tree:
    """Blocks of the reference rows and the tree over their boxes, ordered by the ``leading`` columns (by default, those that spread most).

    Which rows share a block decides how fast neighbours are found, never which.
    """
    rows, order = _cut(pool.select(id_column, *columns), columns, id_column, model, model.block_rows, "_block", leading, kinds)
    sides = [f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max))]
    level = rows.groupBy(F.col("_block").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("_gaps").alias("first"), F.max("_gaps").alias("last"), *sides)
    level = level.withColumn("kind", F.shiftright("node", 52)).withColumn("part", F.shiftright("node", 32).bitwiseAND(F.lit((1 << 20) - 1)))
    level, levels = materialize(level.withColumn("place", F.col("node").bitwiseAND(F.lit((1 << 32) - 1))), "boxes"), []
    joined = [f(f"{n}{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("low", F.min), ("high", F.max))]
    most = level.agg(F.max("part").alias("part"), F.max("place").alias("place")).first()
    part, place = most["part"] or 0, most["place"] or 0
    while True:
        # blocks of a partition are joined first, then partitions
        at = (F.col("part"), F.floor(F.col("place") / FANOUT)) if place else (F.floor(F.col("part") / FANOUT), F.lit(0).cast("long"))
        parent = F.shiftleft("kind", 52) + F.shiftleft(at[0], 32) + at[1]
        levels.append(level.select(F.lit(len(levels)).alias("level"), "node", parent.alias("parent"), "n", (F.col("first") != F.col("last")).alias("mixed"),
                                   *[f"{s}{i}" for i in range(len(columns)) for s in ("low", "high")]))
        if not part and not place:
            break
        level = level.groupBy("kind", at[0].alias("part"), at[1].alias("place")).agg(
            F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), *joined
        ).withColumn("node", F.shiftleft("kind", 52) + F.shiftleft("part", 32) + F.col("place"))
        part, place = (part, place // FANOUT) if place else (part // FANOUT, 0)
    return Tree(rows.drop("_gaps"), materialize(reduce(DataFrame.unionByName, levels), "tree"), len(levels) - 1, tuple(kinds), order)


def bound(columns: list[str]) -> tuple[Column, Column]:
    """How near rows of a box can be to rows of a cell, null if they share no column; and how near their centres are.

    In a box of rows with different gaps, the nearest column decides.
    """
    each = range(len(columns))
    shared = [f"from{i} is not null and low{i} is not null" for i in each]
    gap = [f"greatest(low{i} - to{i}, from{i} - high{i}, 0d)" for i in each]
    apart = [f"(low{i} + high{i} - from{i} - to{i}) / 2" for i in each]
    # as text: an expression a call to the JVM takes longer than the boxes do
    total, centres = (" + ".join(f"if({s}, ({g}) * ({g}), 0d)" for s, g in zip(shared, far)) for far in (gap, apart))
    count = " + ".join(f"cast({s} as int)" for s in shared)
    nearest = ", ".join(f"if({s}, {g} * {g}, cast(null as double))" for s, g in zip(shared, gap))
    nearest = f"least({nearest})" if len(columns) > 1 else nearest
    return F.expr(f"if({count} > 0, if(mixed, {nearest}, ({total}) / ({count})), null)"), F.expr(f"try_divide({centres}, {count})")


def bounds(values: np.ndarray, low: np.ndarray, high: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for rows with the same gaps and boxes; infinite if they share no column."""
    total, centres, nearest = np.zeros((3, len(values), len(low)))
    nearest += np.inf
    count = np.zeros(len(low))
    for j in np.flatnonzero(~np.isnan(values).all(axis=0)):
        there = np.flatnonzero(~np.isnan(low[:, j]))
        x = values[:, j, None]
        gap = np.maximum(np.maximum(low[there, j] - x, x - high[there, j]), 0.0) ** 2
        total[:, there] += gap
        centres[:, there] += ((low[there, j] + high[there, j]) / 2 - x) ** 2
        nearest[:, there] = np.minimum(nearest[:, there], gap)
        count[there] += 1
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(count > 0, np.where(mixed, nearest, total / count), np.inf), centres / count


def _roots(front: DataFrame, tree: Tree, pairs: set[tuple[str, str]] | None) -> DataFrame:
    """Every row of ``front``, which has ``_gaps``, at the roots it starts from: with ``pairs``, those of the kinds that it meets in this tree."""
    nodes = [r["node"] for r in tree.nodes.filter(F.col("level") == tree.top).select("node").collect()]  # one box a kind
    if not tree.kinds or not nodes:
        return front.withColumn("_at", F.lit(nodes[0] if nodes else None).cast("long")).filter(F.lit(bool(nodes)))
    if pairs is None:
        return front.crossJoin(from_rows(front.sparkSession, [(n,) for n in nodes], "_at long"))
    starts = [(g, node) for g, h in pairs for node in nodes if tree.kinds[node >> 52] == h]
    return front.join(from_rows(front.sparkSession, starts, "_gaps string, _at long"), "_gaps")


def _celled(targets: DataFrame, columns: list[str], id_column: str, tree: Tree, model: ImputeModel, pairs: set[tuple[str, str]] | None) -> DataFrame:
    """The targets that meet the tree, with ``_gaps`` and the ``_cell`` of each."""
    if pairs is not None:
        targets = targets.filter(gaps_of(columns).isin(*{g for g, _ in pairs}))
    return _cut(targets, columns, id_column, model, CELL, "_cell", None, known=tree.order)[0]


def _routed(targets: DataFrame, columns: list[str], tree: Tree, k: int, reach: str | None, pairs: set[tuple[str, str]] | None = None,
            rows: int | None = None) -> DataFrame:
    """A row for each target and block to search: the nearest that hold more than k rows, or all within ``reach``. ``rows`` is the number of targets, where that is known."""
    names = [c for c in targets.columns if c not in ("_gaps", "_cell")]
    if "_cell" not in targets.columns:
        # each row goes down by itself
        targets = targets.withColumns({"_gaps": gaps_of(columns), "_cell": F.xxhash64(*names)})
    if not tree.top:
        return _roots(targets, tree, pairs).select(*names, F.col("_at").alias("_block"))
    ends = [f"{n}{i}" for i in range(len(columns)) for n in ("from", "to")]
    sides = [f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("from", F.min), ("to", F.max))]
    cells = targets.groupBy(F.col("_cell").alias("_of"), "_gaps").agg((F.max(reach) if reach else F.lit(0.0)).alias("_far"), *sides)
    front, box = _roots(cells, tree, pairs).select("_of", "_far", *ends, "_at"), [c for c in tree.nodes.columns if c not in ("level", "parent")]
    near, centre = bound(columns)
    for level in range(tree.top - 1, -1, -1):
        children = tree.nodes.filter(F.col("level") == level).drop("level")
        met = front.join(children, F.col("_at") == F.col("parent")).withColumns({"_bound": near, "_centre": centre}).filter(F.col("_bound").isNotNull())
        if reach:
            met = met.filter(F.col("_bound") <= F.col("_far") * (1 + 1e-9))
        else:
            order = Window.partitionBy("_of").orderBy("_bound", "_centre", "node")
            before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            met = met.withColumns({"_before": before, "_place": F.row_number().over(order)}).filter((F.col("_before") <= k) | (F.col("_place") <= NEAR))
        front = met.select("_of", "_far", *ends, F.col("node").alias("_at"), *(box if not level else []))

    low, high = ([f"{n}{i}" for i in range(len(columns))] for n in ("low", "high"))

    def choose(rows: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        boxes = boxes.sort_values("node")
        x, nodes, size = rows[columns].to_numpy(dtype=float), boxes["node"].to_numpy(dtype=np.int64), boxes["n"].to_numpy(dtype=float)
        sides = boxes[low].to_numpy(dtype=float), boxes[high].to_numpy(dtype=float), boxes["mixed"].to_numpy(dtype=bool)
        taken = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for part in _alike(x, max(1, 1_000_000 // max(len(nodes), 1))) if len(nodes) else ():
            far, centre = bounds(x[part], *sides)
            if reach:
                row, at = np.nonzero((far <= rows[reach].to_numpy(dtype=float)[part, None] * (1 + 1e-9)) & (centre == centre))
            else:
                order = np.lexsort((centre, far), axis=-1)
                held = size[order]
                row, place = np.nonzero((np.cumsum(held, axis=1) - held <= k) & np.isfinite(np.take_along_axis(far, order, axis=1)))
                at = order[row, place]
            taken.append((part[row], nodes[at]))
        row, node = (np.concatenate(c) for c in zip(*taken))
        return rows[names].iloc[row].assign(_block=node)

    parts = _tasks(targets, targets.count() if rows is None else rows)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in targets.select(*names).schema.fields)
    left, right = targets.drop("_gaps").repartition(parts, "_cell"), front.select("_of", *box).repartition(parts, "_of")
    return left.groupBy("_cell").cogroup(right.groupBy("_of")).applyInPandas(choose, f"{fields}, _block long")


def _searched(routed: DataFrame, rows: DataFrame, columns: list[str], id_column: str, own_table: bool, pick, schema: str) -> DataFrame:
    """``pick`` applied to every block and targets with the same gaps that meet it: it gets the targets, their values, the block's ids and rows, and
    which of the pairs are a row and itself."""
    routed = materialize(routed, "routed")
    counts = routed.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / TARGETS_PER_TASK).cast("int").alias("_ways"))
    left = routed.join(F.broadcast(counts), "_block").withColumn("_way", F.pmod(F.xxhash64(id_column, F.lit(17)), F.col("_ways")).cast("int"))
    ways = counts.toDF("_at", "_parts")
    right = rows.join(F.broadcast(ways), F.col("_block") == F.col("_at")).withColumn("_way", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    # little data, much work: tasks by the rows that meet blocks, not as few as the bytes would fit
    parts, meet = _tasks(routed, routed.count()), ["_block", "_way"]
    left, right = left.drop("_ways").repartition(parts, *meet), right.drop("_at", "_parts").repartition(parts, *meet)

    def across(targets: pd.DataFrame, reference: pd.DataFrame) -> pd.DataFrame:
        pool, ids = reference[columns].to_numpy(dtype=float), reference[id_column].to_numpy()
        values, out = targets[columns].to_numpy(dtype=float), []
        for rows in _alike(values) if len(pool) else ():
            part = targets.iloc[rows]
            own = itself(part[id_column].to_numpy(), ids) if own_table else np.zeros((len(part), len(ids)), bool)
            out.append(pick(part, values[rows], ids, pool, own))
        return pd.concat(out) if out else pd.DataFrame()

    return left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInPandas(across, schema)


def reference(train: DataFrame, columns, model: ImputeModel, id_column: str = "subject_id") -> Tree:
    """The rows that may be neighbours, in blocks, and the tree over them: all that new rows need of the training table."""
    columns = list(columns)
    return grown(train.filter(missing_cells(columns) <= model.row_limit * len(columns)), columns, id_column, model)


def _kinds(rows: DataFrame, columns: list[str], measured: bool) -> list:
    """Rows for each set of gaps, ``KINDS`` + 1 at most; if ``measured``, with number, mean and variance of each column."""
    parts = [f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("c", F.count), ("a", F.avg), ("v", F.var_pop))] if measured else []
    return rows.groupBy(gaps_of(columns).alias("gaps")).agg(F.count(F.lit(1)).alias("n"), *parts).limit(KINDS + 1).collect()


def _few(asking: list, kinds: list) -> bool:
    """Whether one tree does: few pairs, or more sets of gaps than trees are told apart by."""
    return max(len(kinds), len(asking)) > KINDS or sum(r["n"] for r in asking) * sum(r["n"] for r in kinds) < PAIRS


def _spread(kinds: list, width: int) -> list[float]:
    """Standard deviation of every column from those of the sets of gaps."""
    def deviation(i: int) -> float:
        held = [(r[f"c{i}"], r[f"a{i}"], r[f"v{i}"]) for r in kinds if r[f"c{i}"]]
        n = sum(c for c, _, _ in held)
        mean = sum(c * a for c, a, _ in held) / max(n, 1)
        return math.sqrt(sum(c * (v + (a - mean) ** 2) for c, a, v in held) / max(n, 1))

    return [deviation(i) for i in range(width)]


def _met(asking, kinds, spread) -> dict[tuple[int, ...], dict[tuple[str, str], int]]:
    """The pairs (gaps of a target, gaps of a reference row) by their widest columns, with the number of pairs of rows."""
    met: dict[tuple[int, ...], dict[tuple[str, str], int]] = {}
    for g, m in asking:
        for h, n in kinds:
            shared = [i for i, (x, y) in enumerate(zip(g, h)) if x == y == "1"]
            if shared:
                met.setdefault(tuple(sorted(widest(spread, shared))), {})[g, h] = m * n
    return met


def _large(met: dict[tuple[int, ...], dict[tuple[str, str], int]]) -> list[tuple[int, ...]]:
    """Sets of widest columns that get a tree of their own."""
    size = {m: sum(met[m].values()) for m in met}
    return sorted((m for m in met if size[m] >= PAIRS), key=lambda m: -size[m])[:TREES - 1]


def _likest(large, m: tuple[int, ...]) -> tuple[int, ...]:
    """The set among ``large`` that few pairs with the widest columns ``m`` go with; empty if none has a column of theirs."""
    best = max(large, key=lambda w: len(set(w) & set(m)) / len(w), default=())
    return best if set(best) & set(m) else ()


def _grown_for(pool: DataFrame, columns: list[str], id_column: str, model: ImputeModel, leading: tuple[int, ...], held, spread: list[float]) -> Tree:
    """The tree of the rows with the gaps ``held``, ordered by ``leading``."""
    # rows with few columns first: their distances count few differences, so they bound the others
    held = tuple(sorted(held, key=lambda h: (h.count("1"), h)))
    order = tuple(sorted(leading, key=lambda i: -spread[i]))
    return grown(pool.filter(gaps_of(columns).isin(*held)), columns, id_column, model, order, held)


def _trees(targets: DataFrame, pool: DataFrame, columns: list[str], id_column: str, model: ImputeModel,
           own_table: bool) -> list[tuple[Tree, set[tuple[str, str]] | None]]:
    """The trees to search, with the pairs (gaps of a target, gaps of a reference row) of each; one tree for all pairs where they are few."""
    kinds = _kinds(pool, columns, True)
    asking = [r for r in kinds if "0" in r["gaps"]] if own_table else _kinds(targets, columns, False)
    if _few(asking, kinds):
        return [(grown(pool, columns, id_column, model), None)]
    spread = _spread(kinds, len(columns))
    met = _met([(r["gaps"], r["n"]) for r in asking], [(r["gaps"], r["n"]) for r in kinds], spread)
    large = _large(met)
    if large:
        groups: dict[tuple[int, ...], set[tuple[str, str]]] = {m: set(met[m]) for m in large}
        for m in met.keys() - groups.keys():
            # few pairs go with a tree that is ordered by a column of theirs
            groups.setdefault(_likest(large, m), set()).update(met[m])
        made = lambda m, pairs: (_grown_for(pool, columns, id_column, model, m, {h for _, h in pairs}, spread), pairs)
        return at_once(pool.sparkSession, [lambda g=g: made(*g) for g in groups.items()])
    return [(grown(pool, columns, id_column, model), None)]


def forest(train: DataFrame, columns, model: ImputeModel, id_column: str = "subject_id") -> Forest:
    """The rows that may be neighbours in trees for targets that are not known yet, whose gaps are expected to be like those of the rows.

    Gaps that no row has are served, too: every tree but the last holds all rows that have its columns, the last holds all rows.
    """
    columns = list(columns)
    pool = train.filter(missing_cells(columns) <= model.row_limit * len(columns))
    kinds = _kinds(pool, columns, True)
    asking = [(r["gaps"], r["n"]) for r in kinds if "0" in r["gaps"]]
    spread = _spread(kinds, len(columns))
    held = [(r["gaps"], r["n"]) for r in kinds]
    large = [] if _few([r for r in kinds if "0" in r["gaps"]], kinds) else _large(_met(asking, held, spread))
    if not large:
        return Forest((((), grown(pool, columns, id_column, model)),), tuple(spread))
    having = {m: {h for h, _ in held if all(h[i] == "1" for i in m)} for m in large} | {(): {h for h, _ in held}}
    made = at_once(pool.sparkSession, [lambda g=g: (g[0], _grown_for(pool, columns, id_column, model, *g, spread)) for g in having.items()])
    return Forest(tuple(made), tuple(spread))


def _planted(index: Forest, targets: DataFrame, columns: list[str]) -> list[tuple[Tree, set[tuple[str, str]] | None]]:
    """The trees of a forest that these targets search, with the pairs of each; every pair belongs to one tree."""
    trees = dict(index.trees)
    rest = trees[()]
    if len(trees) == 1:
        return [(rest, None)]
    asking = _kinds(targets, columns, False)
    if len(asking) > KINDS:
        return [(rest, None)]
    groups: dict[tuple[int, ...], set[tuple[str, str]]] = {}
    for m, pairs in _met([(r["gaps"], r["n"]) for r in asking], [(h, 1) for h in rest.kinds], list(index.spread)).items():
        likest = m if m in trees else _likest([w for w in trees if w], m)
        for g, h in pairs:
            groups.setdefault(likest if h in trees[likest].kinds else (), set()).add((g, h))
    return [(trees[m], pairs) for m, pairs in groups.items()] or [(rest, None)]


def _neighbours(targets: DataFrame, pool: DataFrame | None, columns: list[str], id_column: str, model: ImputeModel, own_table: bool,
                index: Tree | Forest | None = None) -> DataFrame:
    """The k nearest reference rows of every target: (id, neighbour_id, place, distance, _v0, _v1, ...); ties go to the smaller id."""
    k, kind, spark = model.k, dict(targets.dtypes)[id_column], targets.sparkSession
    if isinstance(index, Forest):
        trees = _planted(index, targets, columns)
    else:
        trees = [(index, None)] if index else _trees(targets, pool, columns, id_column, model, own_table)
    targets = targets.select(id_column, *columns)

    def nearest(part, values, ids, pool, own):
        if len(ids) > k:
            guess, _ = estimates(values, pool)
            guess[own] = np.inf
            # any k rows bound the distance of the k-th
            at = np.argpartition(guess, k - 1, axis=1)[:, :k]
            least = apart(values, pool, np.repeat(np.arange(len(at)), k), at.ravel()).reshape(at.shape)
            least[np.take_along_axis(own, at, axis=1)] = np.inf
        else:
            least = distances(values, pool, own)
        return pd.DataFrame({id_column: part[id_column].to_numpy(), "least": pd.Series(list(least), dtype=object)})

    def within(part, values, ids, pool, own):
        guess, slack = estimates(values, pool)
        guess[own] = np.inf
        reach = part["_reach"].to_numpy(dtype=float) * (1 + 1e-9)
        limit = reach + slack
        far = guess > limit[:, None]
        many = np.flatnonzero(len(ids) - np.count_nonzero(far, axis=1) > max(k, FEW))
        if len(many):
            limit[many] = np.fmin(limit[many], np.partition(guess[many], k - 1, axis=1)[:, k - 1] + 2 * slack[many])
            far[many] = guess[many] > limit[many, None]
        far |= own
        row, at = np.divmod(np.flatnonzero(~far), len(ids))
        dist = apart(values, pool, row, at)
        close = (dist <= reach[row]) & np.isfinite(dist)
        row, at, dist = row[close], at[close], dist[close]
        if len(row) and np.bincount(row).max() > k:
            # a block gives no more than k, of equal distances those of the smallest ids, null before all
            by_id = pd.Series(ids).rank(method="dense").fillna(0).to_numpy()
            order = np.lexsort((by_id[at], dist, row))
            order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
            row, at, dist = row[order], at[order], dist[order]
        return pd.DataFrame({id_column: part[id_column].to_numpy()[row], "neighbour_id": ids[at], "distance": dist}
                            | {f"_v{i}": pool[at, i] for i in range(len(columns))})

    asked = at_once(spark, [lambda tree=tree, pairs=pairs: _celled(targets, columns, id_column, tree, model, pairs) if tree.top else targets for tree, pairs in trees])

    size = at_once(spark, [rows.count if tree.top else lambda: 0 for rows, (tree, _) in zip(asked, trees)])

    def over_trees(known: DataFrame | None, reach: str | None, pick, schema: str) -> DataFrame:
        looking = [rows if known is None else rows.join(known, id_column, "left").withColumn(reach, F.coalesce(reach, F.lit(float("inf")))) for rows in asked]
        return reduce(DataFrame.unionByName, at_once(spark, [
            lambda rows=rows, tree=tree, pairs=pairs, n=n: _searched(_routed(rows, columns, tree, k, reach, pairs, n), tree.rows, columns, id_column, own_table, pick, schema)
            for rows, n, (tree, pairs) in zip(looking, size, trees)
        ]))

    near = over_trees(None, None, nearest, f"{id_column} {kind}, least array<double>")
    bounded = materialize(near.groupBy(id_column).agg(F.get(F.sort_array(F.flatten(F.collect_list("least"))), F.lit(k - 1)).alias("_reach")), "reach")
    cells = ", ".join(f"_v{i} double" for i in range(len(columns)))
    found = over_trees(bounded, "_reach", within, f"{id_column} {kind}, neighbour_id {kind}, distance double, {cells}")
    place = F.row_number().over(Window.partitionBy(id_column).orderBy("distance", "neighbour_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def neighbours(df: DataFrame, columns, id_column: str = "subject_id", *, k: int = 10, max_block: int = 1500,
               row_limit: float = 0.8) -> DataFrame:
    """The k nearest rows of every row that has a missing cell: (id, neighbour, place, distance)."""
    columns = list(columns)
    model = fit(df, columns, k=k, max_block=max_block, row_limit=row_limit, col_limit=1.0)
    pool = df.filter(missing_cells(columns) <= row_limit * len(columns))
    found = _neighbours(pool.filter(missing_cells(columns) > 0), pool, columns, id_column, model, True)
    return found.select(id_column, "neighbour_id", "place", "distance")


def knn_impute(df: DataFrame, columns, id_column: str = "subject_id", *, pool: DataFrame | None = None,
               model: ImputeModel | None = None, index: Tree | Forest | None = None, max_block: int = 1500, **limits) -> DataFrame:
    """Fill missing numerics with the mean of the k nearest rows, else with the column mean.

    Rows above the row limit get column means and never act as neighbours. With ``pool``, or its tree or forest as ``index`` (and the model fitted on
    them), the neighbours come from those reference rows only, so new subjects cannot change one another.
    """
    columns = list(columns)
    whole = df if pool is None else pool
    model = model or fit(whole, columns, max_block=max_block, **limits)
    few_missing = missing_cells(columns) <= model.row_limit * len(columns)
    targets = df.filter(few_missing & (missing_cells(columns) > 0))
    near = _neighbours(targets, None if index else whole.filter(few_missing), columns, id_column, model, pool is None and index is None, index)
    guess = near.groupBy(F.col(id_column).alias("_id")).agg(*[F.avg(f"_v{i}").alias(f"_f{i}") for i in range(len(columns))])
    filled = df.join(guess, F.col(id_column) == F.col("_id"), "left")
    return filled.select(*[
        F.coalesce(F.col(c), F.col(f"_f{columns.index(c)}"), F.lit(model.means[c])).alias(c) if c in columns else F.col(c) for c in df.columns
    ])


def mode_values(df: DataFrame, columns) -> dict[str, str | None]:
    """Most frequent value per column, smallest on ties: one shuffle for all columns."""
    counts = (
        df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns])).alias("s"))
        .select("s.*").filter(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("v").alias("v"))).alias("b"))
    return {r["c"]: r["v"] for r in best.select("c", "b.v").collect()}


def mode_impute(df: DataFrame, columns, values: dict[str, str | None] | None = None) -> DataFrame:
    values = values if values is not None else mode_values(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(values.get(c))) for c in columns})
