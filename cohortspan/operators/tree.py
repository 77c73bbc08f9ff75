"""Regression and survival trees grown level by level, and their rule tables.

One pass per level serves all open nodes: rows are combined per (node, feature, value), running
totals over the values give the left side of every threshold, and the best gain per node wins. Of two
children only the smaller is counted; the other is what is left of their parent's counts, so a level
reads at most half of the rows of the nodes it splits. Nodes of up to ``LOCAL_ROWS`` rows are not searched level by
level: their rows meet in one task each, which grows all that is below them by the same rules. The tree itself stays on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import longest_group, running_totals
from ..session import from_rows, materialize
from .strata import condition
from .survival import nelson_aalen

#: Rows of a node below which one task grows the tree.
LOCAL_ROWS = 200_000


@dataclass
class Node:
    """A node in heap numbering: children of k are 2k and 2k + 1."""

    id: int
    n: int
    s1: float
    s2: float
    feature: str | None = None
    threshold: float | None = None
    left_levels: tuple[str, ...] = ()
    gain: float | None = None

    @property
    def test(self) -> tuple[str, str, object]:
        return (self.feature, "in", self.left_levels) if self.left_levels else (self.feature, "<", self.threshold)

    @property
    def value(self) -> float:
        return self.s1 / self.n


def _loss_gain(kind: str, left: list[Column], total: list[Column]) -> Column:
    """Loss drop of a split from (n, s1, s2) of the left side and the node."""
    right = [t - l for t, l in zip(total, left)]
    if kind == "anova":
        part = lambda s: F.try_divide(s[1] * s[1], s[0])
    else:
        part = lambda s: F.when(s[1] > 0, s[1] * F.ln(F.try_divide(s[1], s[2]))).otherwise(0.0)
    return part(left) + part(right) - part(total)


def node_loss(kind: str, n: float, s1: float, s2: float) -> float:
    """Loss of a node: squared error, or the exponential deviance up to the saturated model."""
    import math

    if kind == "anova":
        return s2 - s1 * s1 / n if n else 0.0
    return 2.0 * (-s1 * math.log(s1 / s2)) if s1 > 0 and s2 > 0 else 0.0


def cell_counts(rows: DataFrame, numerics, categoricals) -> DataFrame:
    """(node, feature, value or level) with n, s1, s2.

    Numbers that agree to nine decimals are one value, so last-bit noise makes no cut points.
    """
    nothing = F.lit(None)
    cells = [F.struct(F.lit(c).alias("feature"), F.round(F.col(c).cast("double"), 9).alias("value"), nothing.cast("string").alias("level")) for c in numerics]
    cells += [F.struct(F.lit(c).alias("feature"), nothing.cast("double").alias("value"), F.col(c).alias("level")) for c in categoricals]
    each = rows.select("node", "_a", "_b", F.explode(F.array(*cells)).alias("c")).select("node", "_a", "_b", "c.*")
    return each.filter(F.col("value").isNotNull() | F.col("level").isNotNull()).groupBy("node", "feature", "value", "level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_a").alias("s1"), F.sum("_b").alias("s2")
    )


def siblings(parents: DataFrame, small: DataFrame) -> DataFrame:
    """Counts of the other child of each node in ``small``: the parent's less its own."""
    heads = small.select(F.shiftright("node", 1).alias("_parent"), F.col("node").alias("_small")).distinct()
    wanted = parents.join(F.broadcast(heads), parents["node"] == heads["_parent"]).drop("node", "_parent")
    mine = small.select(F.col("node").alias("_small"), "feature", "value", "level", F.col("n").alias("_n"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("_small", "feature", "value", "level")]
    left = lambda c: F.col(f"l.{c}") - F.coalesce(F.col(f"r._{c}"), F.lit(0))
    return wanted.alias("l").join(mine.alias("r"), same[0] & same[1] & same[2] & same[3], "left").select(
        F.col("l._small").bitwiseXOR(F.lit(1)).cast("bigint").alias("node"), "l.feature", "l.value", "l.level",
        left("n").cast("bigint").alias("n"), left("s1").alias("s1"), left("s2").alias("s2"),
    ).filter("n > 0")


def _level_key(kind: str) -> Column:
    """Categories are ordered by their mean response."""
    base = F.col("n") if kind == "anova" else F.col("s2")
    return F.coalesce(F.try_divide(F.col("s1"), base.cast("double")), F.lit(0.0))


def keyed_counts(cells: DataFrame, kind: str) -> DataFrame:
    """(node, feature, key) with n, s1, s2; levels of equal mean response are one key."""
    key = F.when(F.col("level").isNull(), F.col("value")).otherwise(_level_key(kind))
    return cells.withColumn("key", key).groupBy("node", "feature", "key").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))


def value_counts(rows: DataFrame, numerics, categoricals, kind: str) -> DataFrame:
    return keyed_counts(cell_counts(rows, numerics, categoricals), kind)


def split_gains(counts: DataFrame, kind: str, minbucket: int) -> DataFrame:
    """Gain of cutting after each key, for every (node, feature); both sides hold ``minbucket`` rows."""
    keys = ["node", "feature"]
    run = running_totals(counts, keys, "key", {"ln": "n", "l1": "s1", "l2": "s2"}, longest=longest_group(counts, keys))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("tn"), F.sum("s1").alias("t1"), F.sum("s2").alias("t2"))
    both = run.join(total, keys).filter((F.col("ln") >= minbucket) & (F.col("tn") - F.col("ln") >= minbucket))
    gain = _loss_gain(kind, [F.col("ln"), F.col("l1"), F.col("l2")], [F.col("tn"), F.col("t1"), F.col("t2")])
    factor = 1.0 if kind == "anova" else 2.0
    return both.withColumn("gain", gain * factor)


def best_per(gains: DataFrame, keys: list[str], loss: float | None = None) -> DataFrame:
    """Best split per key; equal gains go to the smaller (feature, key).

    Gains count as equal when they agree to six decimals, or to nine of their share of ``loss``.
    """
    scale = F.round(F.col("gain"), 6) if not loss else F.round(F.col("gain") / F.lit(loss), 9)
    pick = F.min(F.struct((-scale).alias("g"), F.col("feature"), F.col("key"), F.col("gain"), F.col("ln"), F.col("l1"), F.col("l2"),
                          F.col("tn"), F.col("t1"), F.col("t2"))).alias("b")
    return gains.groupBy(*keys).agg(pick).select(*keys, *[
        F.col(f"b.{c}").alias(c) for c in ("feature", "key", "gain", "ln", "l1", "l2", "tn", "t1", "t2") if c not in keys
    ])


def thresholds(best: DataFrame, counts: DataFrame, categoricals) -> DataFrame:
    """Numeric cut points lie halfway between the best key and the next larger one."""
    after = counts.alias("c").join(
        best.alias("b"), (F.col("c.node") == F.col("b.node")) & (F.col("c.feature") == F.col("b.feature"))
    ).filter(F.col("c.key") > F.col("b.key")).groupBy(F.col("b.node").alias("node"), F.col("b.feature").alias("feature")).agg(
        F.min("c.key").alias("_next")
    )
    half = (F.col("key") + F.col("_next")) / 2.0
    return best.join(after, ["node", "feature"], "left").withColumn(
        "threshold", F.when(~F.col("feature").isin(*categoricals, ""), half)
    ).drop("_next")


def response_rows(rows: DataFrame, kind: str, y: str = "slope", time: str = "time_event", status: str = "status") -> DataFrame:
    """Columns ``_a``/``_b`` whose sums drive the gain: y and y^2, or events and rescaled time."""
    if kind == "anova":
        return rows.filter(F.col(y).isNotNull()).withColumn("_a", F.col(y).cast("double")).withColumn("_b", F.col("_a") * F.col("_a"))
    kept = rows.filter(F.col(time).isNotNull() & F.col(status).isNotNull()).withColumn("_all", F.lit(1))
    curve = nelson_aalen(kept, ["_all"], time, status).select(F.col("time").alias("_time"), "cumulative_hazard")
    return kept.join(curve, kept[time] == curve["_time"]).withColumn("_a", F.col(status).cast("double")).withColumn(
        "_b", F.col("cumulative_hazard")
    ).drop("_all", "_time", "cumulative_hazard")


def node_column(nodes: dict[int, Node], root: int = 1) -> Column:
    """Node id of each row as nested CASE expressions."""
    node = nodes[root]
    if node.feature is None:
        return F.lit(root).cast("bigint")
    return F.when(condition(*node.test), node_column(nodes, 2 * root)).otherwise(node_column(nodes, 2 * root + 1))


def best_splits(rows: DataFrame, numerics, categoricals, *, kind: str = "anova", minbucket: int = 1, by=("node",)) -> DataFrame:
    """Best split per node (or per node and feature) over rows with ``node``, ``_a``, ``_b``."""
    counts = materialize(value_counts(rows, numerics, categoricals, kind), "splits")
    best = best_per(split_gains(counts, kind, minbucket), list(by))
    return thresholds(best, counts, categoricals)


def _gains(kind: str, left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``split_gains`` of columns of (n, s1, s2) of the left side; -inf where there is none."""
    def part(s):
        with np.errstate(all="ignore"):
            return s[1] * s[1] / s[0] if kind == "anova" else np.where(s[1] > 0, s[1] * np.log(s[1] / s[2]), 0.0)

    total = total[:, None]
    gain = (part(left) + part(total - left) - part(total)) * (1.0 if kind == "anova" else 2.0)
    return np.where(np.isnan(gain), -np.inf, gain)


class _Local:
    """The rows of one node, ordered once by every number; nodes below it are subsets in the same orders."""

    def __init__(self, values: np.ndarray, codes: np.ndarray, levels: list[list[str]], sums: np.ndarray, numerics, categoricals, kind: str, minbucket: int, loss: float) -> None:
        self.values, self.codes, self.levels, self.sums = values, codes, levels, sums
        self.numerics, self.categoricals, self.kind, self.minbucket, self.loss = list(numerics), list(categoricals), kind, minbucket, loss
        order = np.argsort(values, axis=0, kind="stable")
        # rows without a number are not counted under it
        self.all = [order[: len(values) - np.isnan(values[:, j]).sum(), j] for j in range(values.shape[1])]

    def _keys(self, rows: np.ndarray, orders: list[np.ndarray]):
        """Per feature its place, keys in order and (n, s1, s2) of each; categories by the key of their level, with the levels."""
        for j, order in enumerate(orders):
            v = self.values[order, j]
            first = np.flatnonzero(np.diff(v, prepend=np.nan) != 0)
            if len(first) > 1:
                yield self.numerics[j], v[first], np.add.reduceat(self.sums[:, order], first, axis=1), None
        for j, name in enumerate(self.categoricals):
            some = rows[self.codes[rows, j] >= 0]
            sums = np.stack([np.bincount(self.codes[some, j], s[some], len(self.levels[j])) for s in self.sums])
            there = np.flatnonzero(sums[0] > 0)
            base = sums[0 if self.kind == "anova" else 2, there]
            level = np.divide(sums[1, there], base, out=np.zeros(len(there)), where=base != 0)
            keys, which = np.unique(level, return_inverse=True)
            if len(keys) > 1:
                yield name, keys, np.stack([np.bincount(which, s[there]) for s in sums]), (there, level, j)

    def best(self, rows: np.ndarray, orders: list[np.ndarray]):
        """The best split: (rank, feature, key), gain, sums of the left side, sums of both, next key, levels."""
        found = None
        for feature, keys, sums, levels in self._keys(rows, orders):
            left, total = np.cumsum(sums, axis=1), sums.sum(axis=1)
            cut = np.flatnonzero((left[0] >= self.minbucket) & (total[0] - left[0] >= self.minbucket))
            if not len(cut):
                continue
            gain = _gains(self.kind, left[:, cut], total)
            with np.errstate(invalid="ignore"):
                rank = -(np.round(gain / self.loss, 9) if self.loss else np.round(gain, 6))
            at = int(np.argmin(np.where(np.isneginf(gain), np.inf, rank)))
            here = (float(rank[at]), feature, float(keys[cut[at]]))
            if not np.isneginf(gain[at]) and (found is None or here < found[0]):
                found = here, float(gain[at]), left[:, cut[at]], total, float(keys[cut[at] + 1]) if cut[at] + 1 < len(keys) else None, levels
        return found

    def grow(self, root: int, minsplit: int, cp: float, max_depth: int) -> list[tuple]:
        """The nodes below ``root`` (and its split), as rows of ``_NODE``."""
        out, waiting = [], [(root, np.arange(len(self.values)), self.all, None)]
        mine = np.zeros(len(self.values), bool)
        while waiting:
            id_, rows, orders, sums = waiting.pop()
            node = [id_, *([None] * 3 if sums is None else [int(sums[0]), float(sums[1]), float(sums[2])]), None, None, [], None]
            out.append(node)
            # the root was found large enough where it was made
            split = self.best(rows, orders) if (sums is None or sums[0] >= minsplit) and id_.bit_length() - 1 < max_depth else None
            if split is None or not split[1] >= cp * self.loss:
                continue
            (_, feature, key), gain, left, total, after, levels = split
            node[4], node[7] = feature, gain
            if levels is None:
                node[5] = (key + after) / 2.0
                goes = self.values[rows, self.numerics.index(feature)] < node[5]
            else:
                there, level, j = levels
                chosen = there[level <= key + 1e-9 * max(abs(key), 1e-3)]
                node[6] = sorted(self.levels[j][c] for c in chosen)
                goes = np.isin(self.codes[rows, j], chosen)
            for offset, (some, s) in enumerate(((rows[goes], left), (rows[~goes], total - left))):
                if s[0] < minsplit:
                    out.append([2 * id_ + offset, int(s[0]), float(s[1]), float(s[2]), None, None, [], None])
                    continue
                mine[some] = True
                waiting.append((2 * id_ + offset, some, [o[mine[o]] for o in orders], s))
                mine[some] = False
        return [tuple(n) for n in out]


_NODE = "id bigint, n bigint, s1 double, s2 double, feature string, threshold double, left_levels array<string>, gain double"


def _grow_below(data: DataFrame, nodes: dict[int, Node], ids: list[int], numerics, categoricals, *, kind: str, minsplit: int, minbucket: int, cp: float, loss: float, max_depth: int) -> None:
    """Grow what is below the nodes ``ids``, each in one task, into ``nodes``."""
    numerics, categoricals = list(numerics), list(categoricals)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        coded = [pd.factorize(pdf[c]) for c in categoricals]
        codes = np.stack([c for c, _ in coded], axis=1) if coded else np.zeros((len(pdf), 0), np.int64)
        sums = np.stack([np.ones(len(pdf)), pdf["_a"].to_numpy(dtype=float), pdf["_b"].to_numpy(dtype=float)])
        local = _Local(pdf[numerics].to_numpy(dtype=float), codes, [list(v) for _, v in coded], sums, numerics, categoricals, kind, minbucket, loss)
        return pd.DataFrame(local.grow(int(pdf["node"].iloc[0]), minsplit, cp, max_depth), columns=[c.split()[0] for c in _NODE.split(", ")]).astype({"n": "Int64"})

    here = data.withColumn("node", node_column(nodes)).filter(F.col("node").isin(*ids))
    here = here.withColumns({c: F.round(F.col(c).cast("double"), 9) for c in numerics})
    for r in here.groupBy("node").applyInPandas(run, _NODE).collect():
        if r["n"] is not None:
            nodes[r["id"]] = Node(r["id"], r["n"], r["s1"], r["s2"])
        node = nodes[r["id"]]
        node.feature, node.threshold, node.left_levels, node.gain = r["feature"], r["threshold"], tuple(r["left_levels"]), r["gain"]


def grow(rows: DataFrame, numerics, categoricals, *, kind: str = "anova", minsplit: int = 20, cp: float = 0.005,
         max_depth: int = 30, counted: list[tuple[int, int]] | None = None, **response) -> dict[int, Node]:
    """Grow the tree; one job per level for all open nodes of more than ``LOCAL_ROWS`` rows, one for all that is below the others.

    ``counted`` gets, for each level, the rows that were counted and the rows of the nodes that were searched.
    """
    data = materialize(
        response_rows(rows, kind, **response).select(*numerics, *categoricals, "_a", "_b"), "tree"
    )
    minbucket = max(1, round(minsplit / 3))
    first = data.agg(F.count(F.lit(1)).alias("n"), F.sum("_a").alias("a"), F.sum("_b").alias("b")).first()
    nodes = {1: Node(1, first["n"], first["a"] or 0.0, first["b"] or 0.0)}
    loss = node_loss(kind, nodes[1].n, nodes[1].s1, nodes[1].s2)
    open_ids = [1] if nodes[1].n >= minsplit else []
    cells: DataFrame | None = None
    below: list[int] = []
    for _ in range(max_depth):
        below += [k for k in open_ids if nodes[k].n <= LOCAL_ROWS]
        open_ids = [k for k in open_ids if nodes[k].n > LOCAL_ROWS]
        if not open_ids:
            break
        smaller = [min((k, k ^ 1), key=lambda c: (nodes[c].n, c)) if k > 1 else 1 for k in open_ids]
        here = data.withColumn("node", node_column(nodes)).filter(F.col("node").isin(*smaller))
        if counted is not None:
            counted.append((sum(nodes[k].n for k in set(smaller)), sum(nodes[k].n for k in open_ids)))
        small = cell_counts(here, numerics, categoricals)
        if cells is None:
            cells = materialize(small, "cells")
        else:
            small = materialize(small, "cells-small")
            both = small.unionByName(siblings(cells, small))
            cells = materialize(both.filter(F.col("node").isin(*open_ids)), "cells")
        counts = materialize(keyed_counts(cells, kind), "splits")
        best = best_per(split_gains(counts, kind, minbucket), ["node"], loss).filter(F.col("gain") >= cp * loss)
        found = thresholds(best, counts, categoricals).collect()  # at most one row per open node
        chosen = [(r["node"], r["feature"], r["key"]) for r in found if r["feature"] in categoricals]
        left: dict[int, list[str]] = {}
        if chosen:
            marks = from_rows(data.sparkSession, chosen, "node bigint, feature string, _cut double")
            cut = F.col("_cut") + F.lit(1e-9) * F.greatest(F.abs("_cut"), F.lit(1e-3))
            for r in cells.join(marks, ["node", "feature"]).filter(_level_key(kind) <= cut).select("node", "level").collect():
                left.setdefault(r["node"], []).append(r["level"])
        open_ids = []
        for r in found:
            node = nodes[r["node"]]
            node.feature, node.gain = r["feature"], r["gain"]
            node.threshold, node.left_levels = r["threshold"], tuple(sorted(left.get(r["node"], ())))
            sides = [(r["ln"], r["l1"], r["l2"]), (r["tn"] - r["ln"], r["t1"] - r["l1"], r["t2"] - r["l2"])]
            for offset, (n, a, b) in enumerate(sides):
                child = Node(2 * node.id + offset, n, a, b)
                nodes[child.id] = child
                if n >= minsplit:
                    open_ids.append(child.id)
    if below:
        _grow_below(data, nodes, below, numerics, categoricals, kind=kind, minsplit=minsplit, minbucket=minbucket, cp=cp, loss=loss, max_depth=max_depth)
    return nodes


def node_table(spark, nodes: dict[int, Node]) -> DataFrame:
    return from_rows(
        spark,
        [(n.id, n.n, float(n.value), n.feature, None if n.threshold is None else float(n.threshold), ",".join(n.left_levels) or None,
          None if n.gain is None else float(n.gain)) for n in nodes.values()],
        "node bigint, n bigint, mean double, feature string, threshold double, left_levels string, gain double",
    )


def rules(nodes: dict[int, Node]) -> tuple:
    """The tree as a rule table: one rule per leaf, labelled by its node id."""
    out = []

    def walk(i: int, tests: tuple):
        node = nodes[i]
        if node.feature is None:
            out.append((i, tests))
            return
        column, op, value = node.test
        other = "not in" if op == "in" else ">="
        walk(2 * i, (*tests, (column, op, value)))
        walk(2 * i + 1, (*tests, (column, other, value)))

    walk(1, ())
    return tuple(out)


def rule_table(spark, nodes: dict[int, Node]) -> DataFrame:
    rows = []
    for label, tests in rules(nodes):
        for step, (column, op, value) in enumerate(tests, 1):
            numeric = op in ("<", ">=")
            rows.append((label, step, column, op, float(value) if numeric else None, None if numeric else ",".join(value)))
    return from_rows(spark, rows, "label bigint, step int, feature string, op string, threshold double, levels string")
