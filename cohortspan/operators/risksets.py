"""Hold-out search of Cox models from compact rows: no row per subject, repetition and model ever exists.

Subjects of a stratum are cut by time into bins of about ``BIN_ROWS``; a bin is one row with its times, events, design columns and, for
every repetition, a bit telling test from train. A Newton step is one pass over the bins: exp(X beta) of all repetitions at once is a matrix product,
masked by the membership bits, and risk sets are running sums down the bin. A stratum of one bin takes all its steps where it lies. Where a
stratum has several, a step is two passes: the first takes each bin's totals, and their suffix sums are what a bin starts from. A day that holds more than a bin's worth of subjects is spread over bins of its
own, whose event sums are added up before the tie formula is applied.

Of strata with several bins the driver holds parameters and sums of the fits that advance together, at most ``SUM_BYTES``, never rows; more
fits advance in turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running_totals
from ..session import materialize
from . import metrics, resample
from .linear import unpack

BIN_ROWS = 16_384
#: Sums of all bins and fits that advance together, in bytes; a larger search takes more turns.
SUM_BYTES = 64 << 20
#: Bytes of a matrix inside a task.
CELL_BYTES = 8 << 20
BLOCK = 64
DIRECT_TIES = 64


# --- compact rows --------------------------------------------------------------------------------------------------------------------------
def with_members(rows: DataFrame, cuts: DataFrame, seed: int, id_column: str = "subject_id") -> DataFrame:
    """``member``: one long per 64 repetitions, bit i set where the row is in the test part of the block's i-th repetition."""
    blocks = resample.cut_blocks(cuts, BLOCK).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("rep_block", "cuts"))).alias("_blocks"))
    hit = lambda c: resample.is_test(seed, c["rep"], id_column, c["cut_draw"], c["cut_tie"])
    bits = lambda b: F.aggregate(
        b["cuts"], F.lit(0).cast("bigint"),
        lambda acc, c: acc.bitwiseOR(F.when(hit(c), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(c["rep"] - 1, F.lit(BLOCK)).cast("int"))).otherwise(F.lit(0).cast("bigint"))),
    )
    return rows.join(blocks, "cluster").withColumn("member", F.transform("_blocks", bits)).drop("_blocks")


def _packed(table: pa.Table) -> pa.Table:
    """All rows of a bin as one, latest first."""
    table = table.combine_chunks()
    time = table["time"].to_numpy()
    order = np.argsort(-time, kind="stable")
    matrix = lambda name, kind: table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(time), -1)[order]
    return pa.table({
        "cluster": table["cluster"][:1], "bin": table["bin"][:1], "sub": table["sub"][:1], "n": pa.array([len(time)], pa.int64()),
        "time": [time[order].astype(np.float64).tobytes()], "status": [table["status"].to_numpy()[order].astype(np.int8).tobytes()],
        "x": [matrix("x", np.float64).tobytes()], "member": [matrix("member", np.int64).tobytes()],
    })


_BIN = "cluster int, bin bigint, sub int, n bigint, time binary, status binary, x binary, member binary"


def bins(rows: DataFrame, size: int | None = None) -> DataFrame:
    """``rows(cluster, time, status, x, member, subject_id)`` as one row per bin; a bin with an odd number holds a part of a single day."""
    size = size or BIN_ROWS
    days = rows.groupBy("cluster", "time").agg(F.count(F.lit(1)).alias("_day"))
    before = running_totals(days, ["cluster"], "time", {"_before": "_day"}, exclusive=True)
    hot = F.col("_day") > size
    placed = before.select(
        F.col("cluster").alias("_c"), F.col("time").alias("_t"), (2 * F.floor(F.col("_before") / size) + hot.cast("int")).alias("bin"),
        F.when(hot, F.ceil(F.col("_day") / size)).otherwise(1).cast("int").alias("_ways"),
    )
    both = rows.join(placed, (F.col("cluster") == F.col("_c")) & (F.col("time") == F.col("_t"))).withColumn(
        "sub", F.pmod(F.xxhash64("subject_id"), F.col("_ways")).cast("int")
    )
    slim = both.select("cluster", "bin", "sub", "time", "status", "x", "member")
    return slim.groupBy("cluster", "bin", "sub").applyInArrow(_packed, _BIN)


@dataclass
class Rows:
    """A bin inside a task: latest rows first."""

    time: np.ndarray
    status: np.ndarray
    x: np.ndarray
    member: np.ndarray

    @classmethod
    def of(cls, row) -> Rows:
        n = int(row["n"])
        read = lambda name, kind: np.frombuffer(row[name], kind)
        return cls(read("time", np.float64), read("status", np.int8), read("x", np.float64).reshape(n, -1), read("member", np.int64).reshape(n, -1))

    def tested(self, rep: int) -> np.ndarray:
        """Whether each row is in the test part of a repetition (numbered from 1)."""
        return (self.member[:, (rep - 1) // BLOCK] >> ((rep - 1) % BLOCK) & 1).astype(bool)


# --- risk-set sums -------------------------------------------------------------------------------------------------------------------------
def tie_sums(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over l < d of ln(a - l b), 1/(a - l b) and 1/(a - l b)^2; all but the last terms of many ties by the Euler-Maclaurin formula."""
    start = np.maximum(d - DIRECT_TIES, 0.0)
    f0, f1, f2 = np.zeros_like(a), np.zeros_like(a), np.zeros_like(a)
    for k in range(int(min(d.max(initial=0), DIRECT_TIES))):
        some = k < d
        p = np.where(some, a - (start + k) * b, 1.0)
        f0 += np.where(some, np.log(p), 0.0)
        f1 += np.where(some, 1.0 / p, 0.0)
        f2 += np.where(some, 1.0 / (p * p), 0.0)
    many = start > 0
    if many.any():
        p0, q, s = a[many], b[many], start[many]
        p1 = p0 - s * q
        smooth = lambda area, g, g1, g3: area - (g(p1) - g(p0)) / 2 + (g1(p1) - g1(p0)) / 12 - (g3(p1) - g3(p0)) / 720
        f0[many] += smooth(((p0 * np.log(p0) - p0) - (p1 * np.log(p1) - p1)) / q, np.log, lambda p: -q / p, lambda p: -2 * q**3 / p**3)
        f1[many] += smooth((np.log(p0) - np.log(p1)) / q, lambda p: 1 / p, lambda p: q / p**2, lambda p: 6 * q**3 / p**4)
        f2[many] += smooth((1 / p1 - 1 / p0) / q, lambda p: 1 / p**2, lambda p: 2 * q / p**3, lambda p: 24 * q**3 / p**5)
    return f0, f1, f2


def products(x: np.ndarray) -> np.ndarray:
    """1, the columns, and the products of every two of them: what risk sets are summed over."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], axis=1)


def contributions(r: np.ndarray, e: np.ndarray, d: np.ndarray, xb: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Log likelihood, gradient and information from risk-set sums ``r``, event sums ``e`` (sums x times x fits), events, and event sums of
    eta and x; summed over times: (1 + p + triangle + events) x fits."""
    p = len(xs)
    some = d > 0
    r0, e0 = np.where(some, r[0], 1.0), np.where(some, e[0], 1.0)
    with np.errstate(all="ignore"):
        f0, f1, f2 = tie_sums(r0, np.where(some, e0 / np.maximum(d, 1.0), 0.0), d)
        ratio = r0 / e0
        u = [r[1 + i] - ratio * e[1 + i] for i in range(p)]
        v = [e[1 + i] / e0 for i in range(p)]
        out = [np.where(some, xb - f0, 0.0).sum(axis=0)]
        out += [np.where(some, xs[i] - (u[i] * f1 + d * v[i]), 0.0).sum(axis=0) for i in range(p)]
        for k, (i, j) in enumerate(zip(*np.triu_indices(p))):
            second = (r[1 + p + k] - ratio * e[1 + p + k]) * f1 + d * e[1 + p + k] / e0
            cross = u[i] * u[j] * f2 + (u[i] * v[j] + v[i] * u[j]) * f1 + d * v[i] * v[j]
            out.append(np.where(some, second - cross, 0.0).sum(axis=0))
    return np.stack([*out, d.sum(axis=0)])


@dataclass
class Unit:
    """Fits of one stratum and model over some repetitions that advance together: their columns and coefficients."""

    cluster: int
    model: int
    columns: list[int]
    reps: np.ndarray
    beta: np.ndarray
    start: np.ndarray | None = None  # what each bin starts from: {bin: sums x fits}
    whole: dict[int, np.ndarray] = field(default_factory=dict)

    @property
    def sums(self) -> int:
        p = len(self.columns)
        return 1 + p + p * (p + 1) // 2


def _parts(rows: Rows, unit: Unit) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the unit's repetitions with x, products, eta and train weights; rows with a gap in the model's columns weigh nothing."""
    x = rows.x[:, unit.columns]
    whole = ~np.isnan(x).any(axis=1)
    x = np.where(whole[:, None], x, 0.0)
    z = products(x)
    step = max(1, CELL_BYTES // (8 * max(1, len(x))))
    for at in range(0, len(unit.reps), step):
        some = slice(at, at + step)
        train = np.stack([~rows.tested(r) & whole for r in unit.reps[some]], axis=1).astype(float)
        eta = x @ unit.beta[some].T
        yield some, x, z, eta, train


def _event_sums(rows: Rows, x: np.ndarray, z: np.ndarray, eta: np.ndarray, train: np.ndarray, weight: np.ndarray):
    """Per day with an event: its last row, and event sums (weights, counts, eta, x)."""
    event = np.flatnonzero(rows.status == 1)
    if not len(event):
        return None
    first = np.flatnonzero(np.diff(rows.time[event], prepend=np.inf) != 0)
    last = np.searchsorted(-rows.time, -rows.time[event[first]], side="right") - 1
    add = lambda m: np.add.reduceat(m, first, axis=0)
    t, w = train[event], weight[event]
    e = np.stack([add(w * z[event, k, None]) for k in range(z.shape[1])])
    return last, e, add(t), add(eta[event] * t), np.stack([add(t * x[event, i, None]) for i in range(x.shape[1])]) if x.shape[1] else np.zeros((0, len(first), t.shape[1]))


def bin_sums(rows: Rows, unit: Unit, odd: bool, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Totals of a bin (sums x fits), and its contributions given what it starts from; an odd bin (part of a day) gives its event sums instead."""
    totals, given = [], []
    for some, x, z, eta, train in _parts(rows, unit):
        with np.errstate(over="ignore", invalid="ignore"):
            weight = np.exp(eta) * train
            total = np.stack([(weight * z[:, k, None]).sum(axis=0) for k in range(z.shape[1])])
            totals.append(total)
            found = _event_sums(rows, x, z, eta, train, weight)
            fits = train.shape[1]
            if odd:
                if found is None:
                    given.append(np.zeros((z.shape[1] + 2 + x.shape[1], fits)))
                else:
                    _, e, d, xb, xs = found
                    given.append(np.concatenate([e.sum(axis=1), d.sum(axis=0)[None], xb.sum(axis=0)[None], xs.sum(axis=1)]))
            elif found is None:
                given.append(np.zeros((z.shape[1] + 1, fits)))
            else:
                last, e, d, xb, xs = found
                base = np.zeros((z.shape[1], fits)) if start is None else start[:, some]
                r = np.stack([np.cumsum(weight * z[:, k, None], axis=0)[last] for k in range(z.shape[1])]) + base[:, None, :]
                given.append(contributions(r, e, d, xb, xs))
    return np.concatenate(totals, axis=1), np.concatenate(given, axis=1)


def _dealt(table: DataFrame, ways: dict[int, int]) -> DataFrame:
    """The bins of the strata in ``ways``, each as often as its stratum's ways, dealt over tasks."""
    spread = F.create_map(*[F.lit(v) for kv in ways.items() for v in kv])[F.col("cluster")]
    wide = table.filter(F.col("cluster").isin(*ways)).withColumn("ways", spread).withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    return wide.repartition(max(1, sum(ways.values())))


def _ways(units: list[Unit], bins_of: dict[int, list[int]], parts: int) -> dict[int, int]:
    clusters = {u.cluster for u in units}
    return {c: max(1, min(sum(u.cluster == c for u in units), -(-parts // (len(bins_of[c]) * len(clusters))))) for c in clusters}


def _pass(table: DataFrame, units: list[Unit], ways: dict[int, int], only_totals: bool) -> dict:
    """One pass over the bins: {(unit, bin): (totals, contributions)}, sub-bins of a day added up."""
    spark = table.sparkSession
    # at most SUM_BYTES; by value with its class, as executors need no copy of this package
    given = spark.sparkContext.broadcast(cloudpickle.dumps(units))

    def run(batches):
        mine = cloudpickle.loads(given.value)
        for pdf in batches:
            for _, row in pdf.iterrows():
                rows, bin_ = Rows.of(row), int(row["bin"])
                for u in range(len(mine)):
                    unit = mine[u]
                    if unit.cluster != row["cluster"] or u % row["ways"] != row["way"]:
                        continue
                    start = unit.whole.get(bin_)
                    totals, sums = bin_sums(rows, unit, bin_ % 2 == 1, start)
                    yield pd.DataFrame({"unit": [u], "bin": [bin_], "totals": [totals.tobytes() if only_totals else b""], "sums": [b"" if only_totals and bin_ % 2 == 0 else sums.tobytes()]})

    found = _dealt(table, ways).mapInPandas(run, "unit int, bin bigint, totals binary, sums binary").collect()
    given.destroy()
    out: dict = {}
    for r in found:
        key, fits = (r["unit"], r["bin"]), len(units[r["unit"]].reps)
        got = [np.frombuffer(b, float).reshape(-1, fits) if b else None for b in (r["totals"], r["sums"])]
        out[key] = [g if old is None else old if g is None else old + g for g, old in zip(got, out.get(key, (None, None)))]
    return out


def newton_sums(table: DataFrame, units: list[Unit], bins_of: dict[int, list[int]], parts: int) -> list[np.ndarray]:
    """Log likelihood, gradient, information and events of every unit's fits at their coefficients."""
    ways = _ways(units, bins_of, parts)
    several = [k for k, u in enumerate(units) if len(bins_of[u.cluster]) > 1 or bins_of[u.cluster][0] % 2]
    result = [0.0] * len(units)
    if several:
        longer = [units[k] for k in several]
        first = _pass(table, longer, {u.cluster: ways[u.cluster] for u in longer}, True)
        for at, k in enumerate(several):
            unit, running = units[k], np.zeros((units[k].sums, len(units[k].reps)))
            unit.whole = {}
            for b in sorted(bins_of[unit.cluster], reverse=True):
                totals, events = first[at, b]
                if b % 2:  # a whole day: the risk set holds it, and its event sums are complete here
                    s, p = unit.sums, len(unit.columns)
                    running = running + totals
                    result[k] = result[k] + contributions(running[:, None], events[:s, None], events[s][None], events[s + 1][None], events[s + 2 :, None] if p else np.zeros((0, 1, running.shape[1])))
                else:
                    unit.whole[b] = running
                    running = running + totals
    even = table.filter(F.col("bin") % 2 == 0)
    for (k, _), (_, sums) in _pass(even, units, ways, False).items():
        result[k] = result[k] + sums
    for unit in units:
        unit.whole = {}
    return [np.zeros((u.sums + 1, len(u.reps))) if isinstance(r, float) else r for u, r in zip(units, result)]


# --- Newton steps ----------------------------------------------------------------------------------------------------------------------------
class Steps:
    """Where the fits of a unit are: a step that lowers the likelihood is halved, a fit that moves no more is left alone."""

    LIMIT, TOLERANCE = 20, 1e-9

    def __init__(self, unit: Unit) -> None:
        self.unit, self.taken = unit, 0
        self.good, self.best = unit.beta.copy(), np.full(len(unit.reps), np.nan)
        self.done = np.zeros(len(unit.reps), bool)

    @property
    def open(self) -> bool:
        return self.taken < self.LIMIT and not self.done.all()

    def now(self) -> Unit:
        """The fits that still move, at their coefficients."""
        u = self.unit
        return Unit(u.cluster, u.model, u.columns, u.reps[~self.done], u.beta[~self.done])

    def take(self, sums: np.ndarray) -> None:
        """One step of the fits that ``now`` gave, from their likelihood, gradient, information and events."""
        from .survival import _newton

        at, p = np.flatnonzero(~self.done), len(self.unit.columns)
        ll, last, beta, kept = sums[0], self.best[at], self.unit.beta[at], self.good[at]
        gradient, info = sums[1 : 1 + p].T, unpack(sums[1 + p : self.unit.sums].T, p)
        with np.errstate(invalid="ignore"):
            worse = ~np.isfinite(ll) | (ll < last - self.TOLERANCE * np.abs(last))
            settled = ~worse & (np.abs(ll - last) <= self.TOLERANCE * np.maximum(np.abs(ll), 1.0))
        move, _ = _newton(np.where(np.isfinite(info), info, 0.0), np.where(np.isfinite(gradient), gradient, 0.0))
        self.unit.beta[at] = np.where(worse[:, None], (beta + kept) / 2, np.where(settled[:, None], beta, beta + move))
        self.good[at] = np.where(worse[:, None], kept, beta)
        self.best[at] = np.where(worse, last, ll)
        self.done[at[settled | (sums[-1] == 0)]] = True  # without any event there is nothing to fit
        self.taken += 1

    def result(self) -> np.ndarray:
        return np.where(self.done[:, None], self.unit.beta, self.good)


def fit(table: DataFrame, units: list[Unit], bins_of: dict[int, list[int]], *, parts: int) -> list[np.ndarray]:
    """Coefficients of every unit's fits, a pass over the bins a step."""
    steps = [Steps(u) for u in units]
    while active := [s for s in steps if s.open]:
        for step, sums in zip(active, newton_sums(table, [s.now() for s in active], bins_of, parts)):
            step.take(sums)
    return [s.result() for s in steps]


def fit_inside(rows: Rows, unit: Unit) -> np.ndarray:
    """The same where all rows of the stratum are at hand."""
    steps = Steps(unit)
    while steps.open:
        steps.take(bin_sums(rows, steps.now(), False, None)[1])
    return steps.result()


def turns(models: dict[int, list[list[int]]], reps: int, bins_of: dict[int, list[int]], most: int | None = None) -> Iterator[list[Unit]]:
    """Units of at most 64 repetitions, in groups whose sums over all bins stay within ``SUM_BYTES``."""
    most, group, size = most or SUM_BYTES, [], 0
    for at in range(1, reps + 1, BLOCK):
        number = np.arange(at, min(at + BLOCK, reps + 1))
        for cluster, found in models.items():
            if not bins_of.get(cluster):
                continue
            for m, columns in enumerate(found):
                unit = Unit(cluster, m, columns, number, np.zeros((len(number), len(columns))))
                cost = 8 * unit.sums * len(number) * len(bins_of[cluster])
                if group and size + cost > most:
                    yield group
                    group, size = [], 0
                group.append(unit)
                size += cost
    if group:
        yield group


# --- hold-out metrics ------------------------------------------------------------------------------------------------------------------------
CHUNK = 512


def pairs(risk: np.ndarray, events: np.ndarray, longer: np.ndarray) -> tuple[float, int]:
    """Of the pairs of an event (its place) and a row from its place in ``longer`` on: those where the event's risk is higher, ties half; and all.

    Chunks of rows join a sorted suffix from the last one on.
    """
    n, comparable, right = len(risk), 0, 0.0
    later = np.zeros(0)
    chunk = longer // CHUNK
    for c in range((n - 1) // CHUNK, -1, -1):
        lo, hi = c * CHUNK, min((c + 1) * CHUNK, n)
        some = chunk == c
        if some.any():
            mine, at = risk[events[some]], longer[some]
            below, upto = np.searchsorted(later, mine), np.searchsorted(later, mine, side="right")
            inside = np.arange(lo, hi)[None, :] >= at[:, None]
            near = risk[None, lo:hi]
            right += below.sum() + (upto - below).sum() / 2
            right += (inside & (near < mine[:, None])).sum() + (inside & (near == mine[:, None])).sum() / 2
            comparable += len(mine) * len(later) + inside.sum()
        part = np.sort(risk[lo:hi])
        later = np.insert(later, np.searchsorted(later, part), part)
    return right, comparable


def kept_share(n: np.ndarray, died: np.ndarray, followed: np.ndarray) -> np.ndarray:
    """Share of those followed up to a day (less its events) that is not censored on it."""
    base = followed - died
    return np.where(base > 0, 1.0 - (n - died) / np.maximum(base, 1), 1.0)


class HeldOut:
    """Subjects of one test part, ordered once: all models of a repetition are scored on them.

    If they are a part of one, ``beyond`` is how many are followed longer than all of them; weights then start from 1, and ``kept`` is the share
    that is still not censored after them.
    """

    def __init__(self, time: np.ndarray, status: np.ndarray, horizons: np.ndarray, beyond: int = 0) -> None:
        self.beyond = beyond
        self.order = np.lexsort((1 - status, time))
        self.time, self.status, self.horizons = time[self.order], status[self.order], horizons
        # an event compares with who is followed longer: later days, and those censored on its own
        number = np.searchsorted(self.time, self.time, side="right")
        day = np.searchsorted(self.time, self.time, side="left")
        events = np.concatenate([[0], np.cumsum(self.status)])
        self.events = np.flatnonzero(self.status == 1)
        self.longer = (day + events[number] - events[day])[self.events]
        self.weight = self._weights()

    def _weights(self) -> np.ndarray:
        days, first, n = np.unique(self.time, return_index=True, return_counts=True)
        died = np.add.reduceat(self.status, first) if len(first) else np.zeros(0)
        left = kept_share(n, died, n[::-1].cumsum()[::-1] + self.beyond)
        self.kept = float(np.prod(left))
        before = np.concatenate([[1.0], np.cumprod(left)[:-1]])[np.searchsorted(days, self.time)]
        return np.divide(self.status.astype(float), before, out=np.zeros(len(before)), where=before > 0)

    def c_index(self, risk: np.ndarray) -> float:
        """Share of comparable pairs in the right order, ties half."""
        right, comparable = pairs(risk, self.events, self.longer)
        return right / comparable if comparable else np.nan

    def aucs(self, risk: np.ndarray) -> np.ndarray:
        out = np.full(len(self.horizons), np.nan)
        for k, h in enumerate(self.horizons):
            cut = np.searchsorted(self.time, h, side="right")
            weight, controls = self.weight[:cut], np.sort(risk[cut:])
            total = weight.sum()
            if total > 0 and len(controls):
                below, upto = np.searchsorted(controls, risk[:cut]), np.searchsorted(controls, risk[:cut], side="right")
                out[k] = (weight * (below + upto)).sum() / 2 / (total * len(controls))
        return out


CARD = "cluster int, model int, rep int, c_index double, auc12 double, auc18 double, auc24 double, iauc double"


def search_bins(table: DataFrame, models: dict[int, list[list[int]]], reps: int, parts: int, months: int = 30, marks=(12, 18, 24)) -> DataFrame:
    """Fits and hold-out metrics of strata that are one bin: (cluster, model, rep, metrics).

    Such a stratum needs nothing from elsewhere, so its steps run where it lies; its models and repetitions are dealt over ``ways`` copies.
    """
    grid = np.array([m * metrics.MONTH for m in range(months + 1)])
    shares = {c: (len(found), -(-reps // BLOCK)) for c, found in models.items()}
    ways = {c: max(1, min(m * b, -(-4 * parts // len(models)))) for c, (m, b) in shares.items()}

    def run(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                rows, parts_, out, cluster = Rows.of(row), {}, [], int(row["cluster"])
                found, blocks = shares[cluster]
                # a way takes whole blocks of repetitions as far as it can: their test parts are ordered once for all models
                for k in range(int(row["way"]) * found * blocks // int(row["ways"]), (int(row["way"]) + 1) * found * blocks // int(row["ways"])):
                    block, model = divmod(k, found)
                    columns = models[cluster][model]
                    number = np.arange(block * BLOCK + 1, min((block + 1) * BLOCK, reps) + 1)
                    unit = Unit(cluster, model, columns, number, np.zeros((len(number), len(columns))))
                    beta = fit_inside(rows, unit)
                    x = rows.x[:, columns]
                    whole = ~np.isnan(x).any(axis=1)
                    eta = np.where(whole[:, None], x, 0.0) @ beta.T
                    for i, rep in enumerate(number.tolist()):
                        key = rep, whole.tobytes()
                        if key not in parts_:
                            if len(parts_) > 4 * BLOCK:
                                parts_.clear()
                            at = np.flatnonzero(rows.tested(rep) & whole)
                            parts_[key] = at, HeldOut(rows.time[at], rows.status[at].astype(np.int64), grid)
                        at, part = parts_[key]
                        if not len(at):
                            continue
                        risk = np.round(eta[at, i], 9)[part.order]
                        areas = part.aucs(risk)
                        out.append((cluster, model, rep, part.c_index(risk), *(areas[m] for m in marks), metrics.integrate(areas, grid, grid[-1])))
                if out:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in CARD.split(", ")]).astype({"iauc": float})

    return _dealt(table, ways).mapInPandas(run, CARD)


# --- hold-out metrics over several bins ------------------------------------------------------------------------------------------------------
#: Cuts of the scores of a test part at most, and rows per stratum that they are taken from.
SCORE_CUTS, SAMPLE_ROWS = 64, 4_096


def areas(risk: np.ndarray, weight: np.ndarray, mark: np.ndarray, n: np.ndarray, horizons: int) -> np.ndarray:
    """Per horizon: weighted pairs of a case and a control with lower risk (ties half), weight of the cases, number of controls.

    A row stands for ``n`` subjects that are cases (weight) from the horizon ``mark`` on and controls before it.
    """
    order = np.argsort(risk, kind="stable")
    weight, mark, n = weight[order], mark[order], n[order]
    first = np.flatnonzero(np.diff(risk[order], prepend=np.nan) != 0)
    out = np.zeros((3, horizons))
    for h in range(horizons):
        case, control = np.add.reduceat(np.where(mark <= h, weight, 0.0), first), np.add.reduceat(np.where(mark > h, n, 0), first).astype(float)
        out[:, h] = (case * (np.cumsum(control) - control / 2)).sum(), case.sum(), control.sum()
    return out


def _sampled(table: DataFrame, clusters: set[int]) -> dict[int, np.ndarray]:
    """Design rows of every stratum from all its bins, for the driver to cut scores by; any cuts give the same metrics."""
    rows = {r["cluster"]: r["n"] for r in table.filter(F.col("cluster").isin(*clusters)).groupBy("cluster").agg(F.sum("n").alias("n")).collect()}

    def run(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                x = Rows.of(row).x
                yield pd.DataFrame({"cluster": [row["cluster"]], "x": [x[:: max(1, rows[row["cluster"]] // SAMPLE_ROWS)].tobytes()], "width": [x.shape[1]]})

    found: dict[int, list] = {c: [] for c in rows}
    for r in table.filter(F.col("cluster").isin(*clusters)).mapInPandas(run, "cluster int, x binary, width int").collect():
        found[r["cluster"]].append(np.frombuffer(r["x"], float).reshape(-1, r["width"]))
    return {c: np.concatenate(x) for c, x in found.items()}


def _tested(rows: Rows, unit: Unit) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per repetition: its place, the rows of its test part, and their risk; scores that agree to nine decimals count as tied."""
    x = rows.x[:, unit.columns]
    whole = ~np.isnan(x).any(axis=1)
    x = np.where(whole[:, None], x, 0.0)
    for i, rep in enumerate(unit.reps.tolist()):
        risk = np.round(x @ unit.beta[i], 9)
        at = np.flatnonzero(rows.tested(rep) & whole & ~np.isnan(risk))
        yield i, at, risk[at]


def _counted(table: DataFrame, units: list[Unit], ways: dict[int, int]) -> dict[tuple[int, int], np.ndarray]:
    """Rows and events (2 x repetitions) of the test parts by (unit, bin)."""
    given = table.sparkSession.sparkContext.broadcast(cloudpickle.dumps(units))

    def run(batches):
        mine = cloudpickle.loads(given.value)
        for pdf in batches:
            for _, row in pdf.iterrows():
                rows = Rows.of(row)
                for u, unit in enumerate(mine):
                    if unit.cluster == row["cluster"] and u % row["ways"] == row["way"]:
                        counts = np.array([(len(at), rows.status[at].sum()) for _, at, _ in _tested(rows, unit)], np.int64).T
                        yield pd.DataFrame({"unit": [u], "bin": [int(row["bin"])], "counts": [counts.tobytes()]})

    out: dict = {}
    for r in _dealt(table, ways).mapInPandas(run, "unit int, bin bigint, counts binary").collect():
        key, got = (r["unit"], r["bin"]), np.frombuffer(r["counts"], np.int64).reshape(2, -1)
        out[key] = out.get(key, 0) + got
    given.destroy()
    return out


_SCORED = "unit int, fit int, bucket int, bin bigint, risk binary, weight binary, mark binary, n binary, event binary, right double, comparable double, kept double"


def _scored_parts(table: DataFrame, units: list[Unit], ways: dict[int, int], beyond: dict, cuts: dict, grid: np.ndarray) -> DataFrame:
    """The test parts by ranges of score: rows of a bin and range, and (range -1) each bin's pairs with its rows and events by range.

    An odd range holds a single score, so its rows fall together by horizon.
    """
    given = table.sparkSession.sparkContext.broadcast(cloudpickle.dumps((units, beyond, cuts)))

    def run(batches):
        mine, beyond_, cuts_ = cloudpickle.loads(given.value)
        for pdf in batches:
            for _, row in pdf.iterrows():
                rows, bin_, held, out = Rows.of(row), int(row["bin"]), {}, []
                for u, unit in enumerate(mine):
                    if unit.cluster != row["cluster"] or u % row["ways"] != row["way"]:
                        continue
                    for i, at, risk in _tested(rows, unit):
                        if not len(at):
                            continue
                        time, status = rows.time[at], rows.status[at].astype(np.int64)
                        right = comparable = 0.0
                        if bin_ % 2:  # part of a day: its pairs lie in other parts, too
                            order, weight, kept = slice(None), status.astype(float), 1.0
                        else:
                            key = at.tobytes(), int(beyond_[u, bin_][i])
                            if key not in held:
                                if len(held) > 4 * BLOCK:
                                    held.clear()
                                held[key] = HeldOut(time, status, grid, key[1])
                            part = held[key]
                            order, weight, kept = part.order, part.weight, part.kept
                            right, comparable = pairs(risk[order], part.events, part.longer)
                        risk, status = risk[order], status[order]
                        mark = np.searchsorted(grid, time[order]).astype(np.uint8)
                        edges = cuts_[u][i]
                        bucket = np.searchsorted(edges, risk) + np.searchsorted(edges, risk, side="right")
                        ranges = 2 * len(edges) + 1
                        sides = np.stack([np.bincount(bucket, minlength=ranges), np.bincount(bucket[status == 1], minlength=ranges)])
                        out.append((u, i, -1, bin_, b"", b"", b"", sides.astype(np.int64).tobytes(), b"", float(right), float(comparable), kept))
                        by = np.argsort(bucket, kind="stable")
                        for some in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
                            k = int(bucket[some[0]])
                            if k % 2:
                                marks, which = np.unique(mark[some], return_inverse=True)
                                out.append((u, i, k, bin_, np.full(len(marks), risk[some[0]]).tobytes(), np.bincount(which, weight[some]).tobytes(), marks.tobytes(), np.bincount(which).tobytes(), b"", 0.0, 0.0, 1.0))
                            else:
                                out.append((u, i, k, bin_, risk[some].tobytes(), weight[some].tobytes(), mark[some].tobytes(), b"", status[some].astype(np.int8).tobytes(), 0.0, 0.0, 1.0))
                        if len(out) > 1_000:
                            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCORED.split(", ")])
                            out = []
                if out:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCORED.split(", ")])

    stored = materialize(_dealt(table, ways).mapInPandas(run, _SCORED), "cv-scored")
    given.destroy()
    return stored


def _range_sums(parts: DataFrame, scale: dict, horizons: int) -> DataFrame:
    """Per range of score: its pairs of rows in different bins (or parts of a day), and what its areas need."""
    given = parts.sparkSession.sparkContext.broadcast(cloudpickle.dumps(scale))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        scales, u, i, k = cloudpickle.loads(given.value), int(pdf["unit"].iloc[0]), int(pdf["fit"].iloc[0]), int(pdf["bucket"].iloc[0])
        pdf = pdf.sort_values("bin", kind="stable")
        read = lambda name, kind: np.frombuffer(b"".join(pdf[name]), kind)
        risk, weight, mark, each = read("risk", np.float64), read("weight", np.float64), read("mark", np.uint8), pdf["mark"].str.len().to_numpy()
        bins_ = np.repeat(pdf["bin"].to_numpy(), each)
        weight = weight * np.repeat([scales[u, b][i] for b in pdf["bin"]], each)
        right = 0.0
        if k % 2:
            n = read("n", np.int64)
        else:
            n, event = np.ones(len(risk), np.int64), read("event", np.int8)
            # of a day in parts, events come first and compare with who is censored on it
            order = np.lexsort((np.where(bins_ % 2, 1 - event, 0), bins_))
            placed, died = bins_[order], np.concatenate([[0], np.cumsum(event[order])])
            events = np.flatnonzero(event[order] == 1)
            begin, end = np.searchsorted(placed, placed[events]), np.searchsorted(placed, placed[events], side="right")
            right, _ = pairs(risk[order], events, np.where(placed[events] % 2, begin + died[end] - died[begin], end))
        return pd.DataFrame({"unit": [u], "fit": [i], "bucket": [k], "right": [float(right)], "areas": [areas(risk, weight, mark, n, horizons).tobytes()]})

    return parts.groupBy("unit", "fit", "bucket").applyInPandas(run, "unit int, fit int, bucket int, right double, areas binary")


def score(table: DataFrame, units: list[Unit], bins_of: dict[int, list[int]], *, parts: int, size: int | None = None, months: int = 30, marks=(12, 18, 24)) -> list[tuple]:
    """Hold-out metrics of units of strata with several bins, at their coefficients: rows of ``CARD``.

    Pairs in one bin are counted there, pairs in one range of score meet there, and of all others the counts by bin and range tell the order. No test part
    is in one task; the driver holds counts by (fit, bin, range).
    """
    grid = np.array([m * metrics.MONTH for m in range(months + 1)])
    ways, size = _ways(units, bins_of, parts), size or BIN_ROWS
    counts = _counted(table, units, ways)
    sample = _sampled(table, {u.cluster for u in units})
    order = [sorted(bins_of[u.cluster]) for u in units]
    tested = [np.stack([counts[k, b] for b in order[k]]) for k in range(len(units))]  # bins x 2 x fits
    later = [np.cumsum(c[::-1, 0], axis=0)[::-1] - c[:, 0] for c in tested]
    beyond = {(k, b): later[k][at] for k in range(len(units)) for at, b in enumerate(order[k])}
    cuts = []
    for u, c in zip(units, tested):
        x = sample[u.cluster][:, u.columns]
        risk, n = np.round(x[~np.isnan(x).any(axis=1)] @ u.beta.T, 9), c[:, 0].sum(axis=0)
        pieces = [min(SCORE_CUTS, -(-int(m) // size)) for m in n]
        cuts.append([np.unique(np.quantile(r[np.isfinite(r)], np.arange(1, p) / p, method="lower")) if p > 1 and np.isfinite(r).any() else np.zeros(0) for r, p in zip(risk.T, pieces)])
    stored = _scored_parts(table, units, ways, beyond, cuts, grid)
    sides = [[np.zeros((len(order[k]), 2, 2 * len(cuts[k][i]) + 1), np.int64) for i in range(len(u.reps))] for k, u in enumerate(units)]
    right, comparable = np.zeros((2, len(units), max(len(u.reps) for u in units)))
    kept = [np.ones(c[:, 0].shape) for c in tested]
    for r in stored.filter("bucket = -1").select("unit", "fit", "bin", "n", "right", "comparable", "kept").collect():
        k, i, at = r["unit"], r["fit"], order[r["unit"]].index(r["bin"])
        sides[k][i][at] += np.frombuffer(r["n"], np.int64).reshape(2, -1)
        right[k, i] += r["right"]
        comparable[k, i] += r["comparable"]
        kept[k][at, i] *= r["kept"]
    scale = {}
    for k, bins_ in enumerate(order):
        for at, b in enumerate(bins_):
            if b % 2:
                n, died = tested[k][at]
                kept[k][at] = kept_share(n, died, n + later[k][at])
        before = np.concatenate([np.ones((1, kept[k].shape[1])), np.cumprod(kept[k], axis=0)[:-1]])
        for at, b in enumerate(bins_):
            scale[k, b] = np.divide(1.0, before[at], out=np.zeros_like(before[at]), where=before[at] > 0)
    found: dict[tuple[int, int], list] = {}
    for r in _range_sums(stored.filter("bucket >= 0"), scale, len(grid)).collect():
        right[r["unit"], r["fit"]] += r["right"]
        found.setdefault((r["unit"], r["fit"]), []).append((r["bucket"], np.frombuffer(r["areas"], float).reshape(3, -1)))
    out = []
    for (k, i), ranges in found.items():
        n, e = sides[k][i][:, 0], sides[k][i][:, 1]
        single, day = np.arange(n.shape[1]) % 2 == 1, np.array(order[k]) % 2 == 1
        longer = np.cumsum(n[::-1], axis=0)[::-1] - n
        # in ranges of one score no rows met: ties in later bins, and among those of a day in parts
        for other, own in ((longer, e), ((n - e)[day], e[day])):
            right[k, i] += (own * (np.cumsum(other, axis=1) - other)).sum() + (own * other)[:, single].sum() / 2
            comparable[k, i] += (own.sum(axis=1) * other.sum(axis=1)).sum()
        sums = np.stack([a for _, a in sorted(ranges, key=lambda r: r[0])])
        inside, cases, controls = sums[:, 0].sum(axis=0), sums[:, 1], sums[:, 2]
        whole = inside + (cases * (np.cumsum(controls, axis=0) - controls)).sum(axis=0)
        total = cases.sum(axis=0) * controls.sum(axis=0)
        aucs = np.divide(whole, total, out=np.full(len(grid), np.nan), where=total > 0)
        index = right[k, i] / comparable[k, i] if comparable[k, i] else np.nan
        values = [index, *(aucs[m] for m in marks), metrics.integrate(aucs, grid, grid[-1])]
        out.append((units[k].cluster, units[k].model, int(units[k].reps[i]), *[None if v is None or np.isnan(v) else float(v) for v in values]))
    return out


def score_turns(units: list[Unit], bins_of: dict[int, list[int]]) -> Iterator[list[Unit]]:
    """The units in groups whose counts by bin and range stay within ``SUM_BYTES``."""
    group, held = [], 0
    for u in units:
        cost = 8 * len(u.reps) * len(bins_of[u.cluster]) * 2 * (2 * min(SCORE_CUTS, len(bins_of[u.cluster])) + 1)
        if group and held + cost > SUM_BYTES:
            yield group
            group, held = [], 0
        group.append(u)
        held += cost
    if group:
        yield group


def stored_bins(rows: DataFrame, cuts: DataFrame, seed: int, size: int | None = None) -> tuple[DataFrame, dict[int, list[int]]]:
    """The bins of all strata, written once, and their numbers by stratum."""
    table = materialize(bins(with_members(rows, cuts, seed), size), "bins")
    found: dict[int, list[int]] = {}
    for r in table.select("cluster", "bin").distinct().collect():  # a row per BIN_ROWS subjects
        found.setdefault(r["cluster"], []).append(r["bin"])
    return table, found
