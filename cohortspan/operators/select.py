"""Stepwise selection by repeated hold-out.

Cross products add up, so train = all - test + added rows holds for every repetition. Each task
multiplies its 0/1 test-membership matrix with the matrix of column products: one matrix product
gives the test sums of all repetitions and all candidate models. The data is read once however many
models are tried, and only sums are shuffled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import design as dz
from . import resample
from .linear import solve
from ..session import materialize, small_or_stored

FLUSH_BYTES = 64 << 20


# --- candidate models --------------------------------------------------------------------------------
def abundance(rows: DataFrame, columns) -> DataFrame:
    """Share of the most frequent value per (stratum, feature), nulls left out.

    Doubles count as one value when they agree to nine decimals (sums differ in the last bits).
    """
    kinds = dict(rows.dtypes)
    value = lambda c: (F.round(c, 9) if kinds[c] == "double" else F.col(c)).cast("string")
    cells = rows.filter(F.col("cluster").isNotNull()).select("cluster", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), value(c).alias("v")) for c in columns
    ])).alias("s")).select("cluster", "s.*").filter(F.col("v").isNotNull())
    counts = cells.groupBy("cluster", "feature", "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("cluster", "feature").agg((F.max("n") / F.sum("n")).alias("abundance"))


def addition_models(start: dict[int, tuple[str, ...]], candidates, rates: dict[tuple[int, str], float],
                    limit: float = 0.77, retry: bool = False) -> dict[int, dict[str, list[dz.Term]]]:
    """Each candidate alone, and with one product per starting term when no value dominates it."""
    out: dict[int, dict[str, list[dz.Term]]] = {}
    for cluster, base in start.items():
        inside = {c for t in dz.terms(base) for c in t}
        models = {}
        for f in candidates:
            if f in inside and not retry:
                continue
            names = [*base, f]
            models[" + ".join(names)] = dz.terms(names)
            if rates.get((cluster, f), 1.0) < limit:
                for b in base:
                    more = [*names, f"{b}*{f}"]
                    models[" + ".join(more)] = dz.terms(more)
        out[cluster] = models
    return out


def removal_models(start: dict[int, tuple[str, ...]]) -> dict[int, dict[str, list[dz.Term]]]:
    """The starting model with one term left out at a time."""
    out = {}
    for cluster, base in start.items():
        out[cluster] = {}
        for dropped in base:
            kept = [b for b in base if b != dropped]
            out[cluster][" + ".join(kept) or "1"] = dz.terms(kept)
    return out


def candidate_table(rows: DataFrame, models: dict[int, dict[str, list[dz.Term]]]) -> DataFrame:
    return rows.sparkSession.createDataFrame(
        [(c, m, len(t)) for c, ms in models.items() for m, t in ms.items()], "cluster int, model_id string, n_terms int"
    )


# --- cross products of all candidates ------------------------------------------------------------------
class _Plan:
    """Design columns, product pairs and model index maps of one stratum."""

    def __init__(self, models: dict[str, list[dz.Term]], level_map):
        designs = {m: dz.design(t, level_map) for m, t in models.items()}
        columns = list(dict.fromkeys(c for d in designs.values() for c in d))
        place = {c: i + 1 for i, c in enumerate(columns)}  # 0 is the intercept
        self.y = len(columns) + 1
        self.columns = columns
        pairs: dict[tuple[int, int], int] = {}
        self.maps = {}
        for m, d in designs.items():
            use = [0, *[place[c] for c in d], self.y]
            grid = np.empty((len(use), len(use)), dtype=int)
            for a, i in enumerate(use):
                for b, j in enumerate(use):
                    key = (min(i, j), max(i, j))
                    grid[a, b] = pairs.setdefault(key, len(pairs))
            self.maps[m] = grid
        self.left = np.array([i for i, _ in pairs], dtype=int)
        self.right = np.array([j for _, j in pairs], dtype=int)
        self.mean = self.sd = None


def _products(x: np.ndarray, plan: _Plan) -> np.ndarray:
    x = (x - plan.mean) / plan.sd
    return x[:, plan.left] * x[:, plan.right]


def _sums(rows: DataFrame, plans: dict[int, _Plan]) -> DataFrame:
    """Test sums per (cluster, rep) and whole sums per cluster (rep 0), combined inside each task."""
    width = {c: len(p.left) for c, p in plans.items()}

    def run(batches):
        acc: dict[tuple[int, int], np.ndarray] = {}

        def flush():
            if acc:
                yield pd.DataFrame({
                    "cluster": [c for c, _ in acc], "rep": [r for _, r in acc], "sums": [v for v in acc.values()],
                })
                acc.clear()

        for pdf in batches:
            for (cluster, _), part in pdf.groupby(["cluster", "rep_block"], sort=False):
                plan = plans[int(cluster)]
                z = _products(np.vstack(part["x"].to_numpy()), plan)
                test = np.vstack(part["in_test"].to_numpy()).T @ z
                reps = part["reps"].iloc[0]
                for i, r in enumerate(reps):
                    key = (int(cluster), int(r))
                    acc[key] = acc[key] + test[i] if key in acc else test[i]
                whole = part["whole"].to_numpy(dtype=float) @ z
                if whole.any():
                    key = (int(cluster), 0)
                    acc[key] = acc[key] + whole if key in acc else whole
                if sum(width[c] for c, _ in acc) * 8 > FLUSH_BYTES:
                    yield from flush()
        yield from flush()

    parts = rows.select("cluster", "rep_block", "reps", "in_test", "whole", "x").mapInPandas(
        run, "cluster int, rep int, sums array<double>"
    )
    return (
        parts.withColumn("v", array_to_vector("sums")).groupBy("cluster", "rep")
        .agg(Summarizer.sum(F.col("v")).alias("v")).select("cluster", "rep", vector_to_array("v").alias("sums"))
    )


def _design_rows(rows: DataFrame, plans: dict[int, _Plan], y: str) -> DataFrame:
    """Complete rows with their stratum's design vector [1, columns..., y]."""
    out, whole = None, None
    for c, plan in plans.items():
        cells = F.array(F.lit(1.0), *[dz.expression(d) for d in plan.columns], F.col(y).cast("double"))
        used = sorted({a for d in plan.columns for a, _ in d} | {y})
        full = reduce(lambda p, q: p & q, [F.col(u).isNotNull() for u in used])
        hit = F.col("cluster") == F.lit(c)
        out = F.when(hit, cells) if out is None else out.when(hit, cells)
        whole = F.when(hit, full) if whole is None else whole.when(hit, full)
    return rows.filter(whole).withColumn("x", out)


def _centre(design_rows: DataFrame, plans: dict[int, _Plan]) -> None:
    """Mean and spread of every design column inside its stratum; one vector per stratum comes back.

    Every model has an intercept, so centring changes no residual, but cross products stay well
    conditioned.
    """
    stats = design_rows.select("cluster", array_to_vector("x").alias("v")).groupBy("cluster").agg(
        Summarizer.mean(F.col("v")).alias("mean"), Summarizer.std(F.col("v")).alias("sd")
    ).collect()
    for r in stats:
        plan = plans[r["cluster"]]
        plan.mean, plan.sd = np.array(r["mean"]), np.array(r["sd"])
        plan.mean[0] = 0.0
        plan.sd[plan.sd < 1e-12] = 1.0
        plan.sd[[0, -1]] = 1.0


def cv_slope(rows: DataFrame, models: dict[int, dict[str, list[dz.Term]]], level_map: dict[str, list[str]], *,
             reps: int, seed: int, share: float = 0.333334, y: str = "slope", support: tuple[str, ...] = (),
             pool: DataFrame | None = None, pool_size: int = 0, block: int = 64) -> DataFrame:
    """Hold-out RMSE per (cluster, model_id, rep) for every candidate model.

    ``support``: factors whose levels absent from a train part get one donor row there. ``pool``:
    extra rows of which ``pool_size`` join each test part.
    """
    models = {c: m for c, m in models.items() if m}
    plans = {c: _Plan(m, level_map) for c, m in models.items()}
    columns = sorted({a for p in plans.values() for c in p.columns for a, _ in c} | set(support))
    base = rows.filter(F.col("cluster").isin(*plans) & F.col(y).isNotNull()).select("subject_id", "cluster", y, *columns)
    rows_x = materialize(_design_rows(base, plans, y).select("subject_id", "cluster", "x"), "design")
    _centre(rows_x, plans)
    cuts = small_or_stored(resample.holdout_cuts(base, reps=reps, seed=seed, share=share), "cuts")
    flagged = resample.test_flags(rows_x, cuts, seed, block=block)
    flagged = flagged.withColumn("whole", (F.col("rep_block") == 0).cast("double")).drop("subject_id")
    if pool is not None and pool_size:
        spread = pool.filter(F.col(y).isNotNull()).drop("cluster").withColumn(
            "cluster", F.explode(F.array(*[F.lit(c) for c in plans]))
        )
        spread = _design_rows(spread.select("subject_id", "cluster", y, *columns), plans, y).select("subject_id", "cluster", "x")
        pool_cuts = small_or_stored(resample.holdout_cuts(spread, reps=reps, seed=seed + 1, size=pool_size), "cuts")
        drawn = resample.test_flags(spread, pool_cuts, seed + 1, block=block)
        flagged = flagged.unionByName(drawn.withColumn("whole", F.lit(0.0)).drop("subject_id"))
    sums = materialize(_sums(flagged, plans), "sums")
    test = sums.filter("rep > 0").withColumnRenamed("sums", "test")
    whole = sums.filter("rep = 0").select("cluster", F.col("sums").alias("whole"))
    both = test.join(whole, "cluster")
    if support:
        donors = resample.void_donors(base, cuts, {c: level_map[c] for c in support}, seed)
        donors = materialize(resample.override(donors, support), "donors")
        extra = _design_rows(donors, plans, y).select(
            "cluster", F.lit(0).alias("rep_block"), F.array("rep").alias("reps"), F.array(F.lit(1.0)).alias("in_test"),
            F.lit(0.0).alias("whole"), "x", "rep",
        )
        added = materialize(_sums(extra.withColumn("rep_block", F.col("rep")).drop("rep"), plans), "added")
        both = both.join(added.withColumnRenamed("sums", "added"), ["cluster", "rep"], "left")
    else:
        both = both.withColumn("added", F.lit(None).cast("array<double>"))
    pooled = pool is not None and pool_size > 0

    if pooled:
        # pool rows sit in the test sums but never in the whole sums
        own = materialize(_sums(
            resample.test_flags(rows_x, cuts, seed, block=block)
            .withColumn("whole", F.lit(0.0)).drop("subject_id"), plans), "own")
        both = both.join(own.withColumnRenamed("sums", "own"), ["cluster", "rep"])
    else:
        both = both.withColumn("own", F.col("test"))

    def score(batches):
        for pdf in batches:
            for cluster, part in pdf.groupby("cluster", sort=False):
                plan = plans[int(cluster)]
                test_sums = np.vstack(part["test"].to_numpy())
                train = np.vstack(part["whole"].to_numpy()) - np.vstack(part["own"].to_numpy())
                for i, a in enumerate(part["added"]):
                    if a is not None:
                        train[i] += a
                for name, grid in plan.maps.items():
                    coef, _, _, _ = solve(train[:, grid])
                    g = test_sums[:, grid]
                    full = np.concatenate([-coef, np.ones((len(coef), 1))], axis=1)
                    sse = np.einsum("bi,bij,bj->b", full, g, full)
                    n = g[:, 0, 0]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        value = np.sqrt(np.maximum(sse, 0.0) / n)
                    yield pd.DataFrame({"cluster": int(cluster), "model_id": name, "rep": part["rep"], "rmse": value})

    return both.select("cluster", "rep", "test", "whole", "own", "added").mapInPandas(
        score, "cluster int, model_id string, rep int, rmse double"
    )


# --- summaries -------------------------------------------------------------------------------------------
def summarise(metrics: DataFrame, columns, *, skip_missing: bool) -> DataFrame:
    """Mean metric per model; a failed repetition voids the mean unless ``skip_missing``."""
    aggs = [F.count(F.lit(1)).alias("n_reps")]
    for c in columns:
        ok = F.col(c).isNotNull() & ~F.isnan(c)
        mean = F.avg(F.when(ok, F.col(c)))
        bad = F.sum((~ok).cast("bigint"))
        aggs.append((mean if skip_missing else F.when(bad == 0, mean)).alias(f"mean_{c}"))
        aggs.append(bad.alias(f"failed_{c}"))
    return metrics.groupBy("cluster", "model_id").agg(*aggs)


def best_model(summary: DataFrame, metric: str, *, largest: bool = False) -> DataFrame:
    key = F.struct((-F.col(metric) if largest else F.col(metric)).alias("m"), F.col("model_id").alias("id"))
    return summary.filter(F.col(metric).isNotNull()).groupBy("cluster").agg(F.min(key).alias("b")).select(
        "cluster", F.col("b.id").alias("model_id"), (-F.col("b.m") if largest else F.col("b.m")).alias(metric)
    )


def top_models(summary: DataFrame, metric: str, k: int = 20, *, largest: bool = False) -> DataFrame:
    """Best k models per stratum; the input holds one row per candidate model, never per subject."""
    from pyspark.sql import Window

    order = F.col(metric).desc_nulls_last() if largest else F.col(metric).asc_nulls_last()
    w = Window.partitionBy("cluster").orderBy(order, "model_id")
    return summary.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


# --- survival search -------------------------------------------------------------------------------------
FIT_KEYS = ["cluster", "model_id", "rep"]
SURVIVAL_METRICS = ("c_index", "auc12", "auc18", "auc24", "iauc")


def cv_survival(rows: DataFrame, models: dict[int, dict[str, list[dz.Term]]], level_map: dict[str, list[str]], *,
                reps: int, seed: int, share: float = 0.333334, bin_rows: int | None = None) -> DataFrame:
    """Hold-out concordance and AUCs per (cluster, model_id, rep).

    All fits advance together over compact rows (see ``risksets``). Strata of one bin are scored there, too; test parts of larger ones by bins
    and ranges of score.
    """
    from . import risksets

    models = {c: m for c, m in models.items() if m}
    designs = {c: {m: dz.design(t, level_map) for m, t in ms.items()} for c, ms in models.items()}
    columns = {c: list(dict.fromkeys(x for d in ds.values() for x in d)) for c, ds in designs.items()}
    place = {c: {x: i for i, x in enumerate(found)} for c, found in columns.items()}
    names = {c: list(ds) for c, ds in designs.items()}
    used = sorted({a for found in columns.values() for x in found for a, _ in x})
    base = materialize(
        rows.filter(F.col("cluster").isin(*models) & F.col("time_event").isNotNull() & F.col("status").isNotNull())
        .select("subject_id", "cluster", "time_event", "status", *used), "cv-rows",
    )
    cuts = small_or_stored(resample.holdout_cuts(base, reps=reps, seed=seed, share=share), "cuts")
    x = None
    for c, found in columns.items():
        cells = F.array(*[F.coalesce(dz.expression(d), F.lit(float("nan"))) for d in found] or [F.lit(0.0)])
        hit = F.col("cluster") == F.lit(c)
        x = F.when(hit, cells) if x is None else x.when(hit, cells)
    compact = base.select("subject_id", "cluster", F.col("time_event").cast("double").alias("time"), F.col("status").cast("int").alias("status"), x.alias("x"))
    table, bins_of = risksets.stored_bins(compact, cuts, seed, bin_rows)
    spark, parts = rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = {c: [[place[c][x] for x in d] for d in ds.values()] for c, ds in designs.items()}
    single = {c: m for c, m in wanted.items() if len(bins_of.get(c, ())) == 1 and bins_of[c][0] % 2 == 0}
    scored = [materialize(risksets.search_bins(table, single, reps, parts), "cv-scored")] if single else []
    larger = []
    for units in risksets.turns({c: m for c, m in wanted.items() if c not in single}, reps, bins_of):
        for u, beta in zip(units, risksets.fit(table, units, bins_of, parts=parts)):
            u.beta = beta
        for some in risksets.score_turns(units, bins_of):
            larger += risksets.score(table, some, bins_of, parts=parts, size=bin_rows)
    if larger:
        scored.append(spark.createDataFrame(larger, risksets.CARD))
    labels = spark.createDataFrame([(c, i, m) for c, ms in names.items() for i, m in enumerate(ms)], "cluster int, model int, model_id string")
    out = [df.join(F.broadcast(labels), ["cluster", "model"]).select(*FIT_KEYS, *SURVIVAL_METRICS) for df in scored]
    if not out:
        return spark.createDataFrame([], "cluster int, model_id string, rep int, " + ", ".join(f"{m} double" for m in SURVIVAL_METRICS))
    return reduce(DataFrame.unionByName, out)
