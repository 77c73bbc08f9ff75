"""Kaplan-Meier, Cox regression (Efron ties) and survival probabilities as grouped Spark jobs.

Rows are first combined per (stratum, distinct time); all further work is running totals over those
times. Each Newton step is one aggregate for all models together: strata, candidate models and
repetitions are key columns, and only p + p^2 sums per model leave the cluster's grouped stage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import longest_group, running_totals
from ..session import materialize
from .linear import unpack

DIRECT_TIES = 64


# --- counts per time, Kaplan-Meier, Nelson-Aalen -----------------------------------------------------
def risk_table(rows: DataFrame, keys: list[str], time: str = "time_event", status: str = "status") -> tuple[DataFrame, int]:
    """Events, censored and at-risk counts per (key, distinct time), and the longest key's length."""
    per = materialize(
        rows.filter(F.col(time).isNotNull() & F.col(status).isNotNull()).groupBy(*keys, F.col(time).alias("time")).agg(
            F.sum(status).cast("bigint").alias("events"), F.count(F.lit(1)).alias("_n")
        ), "times",
    )
    longest = longest_group(per, keys)
    out = running_totals(per, keys, "time", {"at_risk": "_n"}, descending=True, longest=longest)
    return out.withColumn("censored", F.col("_n") - F.col("events")).drop("_n"), longest


def km_curve(rows: DataFrame, keys: list[str], time: str = "time_event", status: str = "status") -> DataFrame:
    """Survival after each distinct time; exact zero once everyone at risk has had the event."""
    table, longest = risk_table(rows, keys, time, status)
    return _product_limit(table, keys, F.col("events"), F.col("at_risk"), "survival", longest)


def _product_limit(table: DataFrame, keys, drop: Column, base: Column, name: str, longest: int) -> DataFrame:
    whole = (base > 0) & (drop >= base)
    logs = table.withColumn("_log", F.when(whole | (base <= 0), 0.0).otherwise(F.log1p(-drop / base))).withColumn(
        "_end", whole.cast("int")
    )
    run = running_totals(logs, keys, "time", {"_slog": "_log", "_send": "_end"}, longest=longest)
    value = F.when(F.col("_send") > 0, 0.0).otherwise(F.exp("_slog"))
    before = F.when(F.col("_send") - F.col("_end") > 0, 0.0).otherwise(F.exp(F.col("_slog") - F.col("_log")))
    return run.withColumns({name: value, f"{name}_before": before}).drop("_log", "_end", "_slog", "_send")


def censoring_curve(rows: DataFrame, keys: list[str], time: str = "time_event", status: str = "status") -> DataFrame:
    """Probability of staying uncensored; events at a time leave the risk set before censorings."""
    table, longest = risk_table(rows, keys, time, status)
    return _product_limit(table, keys, F.col("censored"), F.col("at_risk") - F.col("events"), "g", longest)


def nelson_aalen(rows: DataFrame, keys: list[str], time: str = "time_event", status: str = "status") -> DataFrame:
    table, longest = risk_table(rows, keys, time, status)
    steps = table.withColumn("_h", F.col("events") / F.col("at_risk"))
    return running_totals(steps, keys, "time", {"cumulative_hazard": "_h"}, longest=longest).drop("_h")


# --- Cox regression ----------------------------------------------------------------------------------
def _tie_sums(a: Column, b: Column, d: Column) -> tuple[Column, tuple[Column, Column, Column]]:
    """Sums over l < d of ln(a - l b), 1/(a - l b) and 1/(a - l b)^2.

    The last terms are added one by one; when very many events share one time the smooth first part
    uses the Euler-Maclaurin formula, so the cost does not grow with the number of ties.
    """
    start = F.greatest(d - F.lit(DIRECT_TIES), F.lit(0)).cast("double")
    zero = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("f"), F.lit(0.0).alias("s"))
    tail = F.aggregate(
        F.sequence(F.lit(0), F.least(d, F.lit(DIRECT_TIES)).cast("int") - 1), zero,
        lambda acc, k: F.struct(
            (acc["l"] + F.ln(a - (start + k) * b)).alias("l"), (acc["f"] + 1.0 / (a - (start + k) * b)).alias("f"),
            (acc["s"] + 1.0 / ((a - (start + k) * b) * (a - (start + k) * b))).alias("s"),
        ),
    )
    p0, p1 = a, a - start * b

    def smooth(integral, g, g1, g3):
        return integral - (g(p1) - g(p0)) / 2.0 + (g1(p1) - g1(p0)) / 12.0 - (g3(p1) - g3(p0)) / 720.0

    head_l = smooth(((p0 * F.ln(p0) - p0) - (p1 * F.ln(p1) - p1)) / b, F.ln, lambda p: -b / p, lambda p: -2.0 * b * b * b / (p * p * p))
    head_f = smooth((F.ln(p0) - F.ln(p1)) / b, lambda p: 1.0 / p, lambda p: b / (p * p), lambda p: 6.0 * b * b * b / (p * p * p * p))
    head_s = smooth((1.0 / p1 - 1.0 / p0) / b, lambda p: 1.0 / (p * p), lambda p: 2.0 * b / (p * p * p),
                    lambda p: 24.0 * b * b * b / (p * p * p * p * p))
    many = start > 0
    pick = lambda field, head: F.col("_tail")[field] + F.when(many, head).otherwise(0.0)
    return tail, (pick("l", head_l), pick("f", head_f), pick("s", head_s))


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _per_time(rows: DataFrame, keys: list[str], p: int, longest: int | None) -> DataFrame:
    """Risk-set and event sums per (key, time) at the current coefficients (column ``beta``)."""
    eta = sum((F.col("x")[i] * F.col("beta")[i] for i in range(p)), F.lit(0.0))
    w = rows.withColumn("_eta", eta).withColumn("_w", F.exp("_eta"))
    x = lambda i: F.col("x")[i]
    ev = F.col("status").cast("double")
    aggs = [F.sum("status").cast("bigint").alias("d"), F.sum("_w").alias("s0"), F.sum(ev * F.col("_w")).alias("e0"),
            F.sum(ev * F.col("_eta")).alias("xb")]
    for i in range(p):
        aggs += [F.sum(F.col("_w") * x(i)).alias(f"s1_{i}"), F.sum(ev * F.col("_w") * x(i)).alias(f"e1_{i}"), F.sum(ev * x(i)).alias(f"x_{i}")]
    for i, j in _pairs(p):
        aggs += [F.sum(F.col("_w") * x(i) * x(j)).alias(f"s2_{i}_{j}"), F.sum(ev * F.col("_w") * x(i) * x(j)).alias(f"e2_{i}_{j}")]
    per = w.groupBy(*keys, "time").agg(*aggs)
    totals = {"r0": "s0"} | {f"r1_{i}": f"s1_{i}" for i in range(p)} | {f"r2_{i}_{j}": f"s2_{i}_{j}" for i, j in _pairs(p)}
    run = running_totals(per, keys, "time", totals, descending=True, longest=longest)
    return _with_ties(run.filter("d > 0"))


def _with_ties(run: DataFrame) -> DataFrame:
    b = F.col("e0") / F.col("d")
    tail, (log_sum, inv, inv2) = _tie_sums(F.col("r0"), b, F.col("d"))
    return run.withColumn("_tail", tail).withColumns({"f0": log_sum, "f1": inv, "f2": inv2}).drop("_tail")


def _score(per_time: DataFrame, keys: list[str], p: int) -> DataFrame:
    """Log likelihood, gradient and information per key."""
    ratio = F.col("r0") / F.col("e0")
    u = lambda i: F.col(f"r1_{i}") - ratio * F.col(f"e1_{i}")
    v = lambda i: F.col(f"e1_{i}") / F.col("e0")
    f1, f2, d = F.col("f1"), F.col("f2"), F.col("d")
    grads = [F.sum(F.col(f"x_{i}") - (u(i) * f1 + d * v(i))) for i in range(p)]
    infos = []
    for i, j in _pairs(p):
        second = (F.col(f"r2_{i}_{j}") - ratio * F.col(f"e2_{i}_{j}")) * f1 + d * F.col(f"e2_{i}_{j}") / F.col("e0")
        cross = u(i) * u(j) * f2 + (u(i) * v(j) + v(i) * u(j)) * f1 + d * v(i) * v(j)
        infos.append(F.sum(second - cross))
    return per_time.groupBy(*keys).agg(
        F.sum(F.col("xb") - F.col("f0")).alias("loglik"), F.array(*grads).alias("gradient"), F.array(*infos).alias("info"),
        F.sum("d").alias("events"),
    )


def prepare_rows(rows: DataFrame, keys: list[str], x: Column, time: str = "time_event", status: str = "status") -> DataFrame:
    return rows.select(
        *keys, F.col(time).cast("double").alias("time"), F.col(status).cast("int").alias("status"), x.alias("x")
    ).filter("x IS NOT NULL AND time IS NOT NULL AND status IS NOT NULL")


def score_at(rows: DataFrame, keys: list[str], p: int, beta: Column, longest: int | None = None) -> DataFrame:
    return _score(_per_time(rows.withColumn("beta", beta), keys, p, longest), keys, p)


def _newton(info: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Newton direction and inverse information, flat directions left at zero."""
    from .linear import solve

    b, p = gradient.shape
    full = np.zeros((b, p + 1, p + 1))
    full[:, :p, :p] = info
    full[:, :p, p] = gradient
    full[:, p, :p] = gradient
    coef, inverse, _, _ = solve(full)
    return coef, inverse


def fit_cox(rows: DataFrame, keys: list[str], p: int, *, max_iter: int = 20, tol: float = 1e-9, stored: bool = False,
            longest: int | None = None) -> DataFrame:
    """Fit one Cox model per key, all keys in the same job per Newton step.

    ``rows``: keys, time, status, x (array of width p). Returns keys, beta, inverse (flat), loglik,
    gradient_norm, events, iterations, converged. A step that lowers the likelihood is halved.
    ``stored`` rows are cheap to read again and are not written; ``longest`` bounds the distinct
    times of a key when it is known.
    """
    if not stored:
        rows = materialize(rows, "cox")
    kinds = dict(rows.dtypes)
    key_schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    if longest is None:
        longest = longest_group(rows.select(*keys, "time").distinct(), keys)
    schema = (f"{key_schema}, beta array<double>, good array<double>, good_ll double, inverse array<double>, "
              "loglik double, gradient_norm double, events bigint, iterations int, active boolean, converged boolean")
    zero = F.array(*[F.lit(0.0)] * p)
    empty = F.lit(None).cast("array<double>")
    state = rows.select(*keys).distinct().select(
        *keys, zero.alias("beta"), zero.alias("good"), F.lit(None).cast("double").alias("good_ll"), empty.alias("inverse"),
        F.lit(None).cast("double").alias("loglik"), F.lit(None).cast("double").alias("gradient_norm"),
        F.lit(0).cast("bigint").alias("events"), F.lit(0).alias("iterations"), F.lit(True).alias("active"), F.lit(False).alias("converged"),
    )
    state = materialize(state, "cox-state")

    def step(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            beta, good = np.vstack(pdf["beta"].to_numpy()), np.vstack(pdf["good"].to_numpy())
            ll, last = pdf["new_ll"].to_numpy(dtype=float), pdf["good_ll"].to_numpy(dtype=float)
            gradient = np.vstack(pdf["gradient"].to_numpy())
            info = unpack(np.vstack(pdf["info"].to_numpy()), p)
            with np.errstate(invalid="ignore"):
                worse = ~np.isfinite(ll) | (ll < last - tol * np.abs(last))
                done = np.abs(ll - last) <= tol * np.maximum(np.abs(ll), 1.0)
            move, inverse = _newton(np.where(np.isfinite(info), info, 0.0), np.where(np.isfinite(gradient), gradient, 0.0))
            done &= ~worse
            out = pdf[keys].copy()
            out["beta"] = list(np.where(worse[:, None], (beta + good) / 2, np.where(done[:, None], beta, beta + move)))
            out["good"] = list(np.where(worse[:, None], good, beta))
            out["good_ll"] = np.where(worse, last, ll)
            out["inverse"] = list(inverse.reshape(len(pdf), -1))
            out["loglik"] = ll
            out["gradient_norm"] = np.sqrt((gradient**2).sum(axis=1))
            out["events"], out["iterations"] = pdf["events_now"], pdf["iterations"] + 1
            out["active"], out["converged"] = ~done, done
            yield out

    for _ in range(max_iter):
        active = state.filter("active")
        if active.isEmpty():
            break
        scored = score_at(
            rows.join(active.select(*keys, F.col("beta").alias("_beta")), keys), keys, p, F.col("_beta"), longest
        ).withColumnRenamed("loglik", "new_ll").withColumnRenamed("events", "events_now")
        # a key without any event has nothing to fit and stops at zero
        moved = active.join(scored, keys).select(
            *keys, "beta", "good", "good_ll", "iterations", "new_ll", "gradient", "info", "events_now"
        ).mapInPandas(step, schema)
        moved = materialize(moved, "cox-moved")
        rest = state.join(moved.select(*keys), keys, "left_anti").withColumn("active", F.lit(False))
        state = materialize(rest.unionByName(moved), "cox-state")
    return state.select(
        *keys, F.when(F.col("converged"), F.col("beta")).otherwise(F.col("good")).alias("beta"), "inverse", "loglik",
        "gradient_norm", "events", "iterations", "converged",
    )


def baseline_hazard(rows: DataFrame, fits: DataFrame, keys: list[str], p: int) -> DataFrame:
    """Cumulative baseline hazard after each event time, with the last observed time per key."""
    per = _per_time(rows.join(fits.select(*keys, "beta"), keys), keys, p, None)
    steps = running_totals(per.select(*keys, "time", "f1"), keys, "time", {"hazard": "f1"})
    last = rows.groupBy(*keys).agg(F.max("time").alias("last_time"))
    return steps.select(*keys, "time", "hazard").join(last, keys)


def linear_predictor(p: int) -> Column:
    return sum((F.col("x")[i] * F.col("beta")[i] for i in range(p)), F.lit(0.0))


def centred_risk(rows: DataFrame, fits: DataFrame, keys: list[str], p: int, train: DataFrame | None = None) -> DataFrame:
    """exp(xb - mean xb), the mean taken over the rows the model was fitted on."""
    both = rows.join(fits.select(*keys, "beta"), keys).withColumn("_eta", linear_predictor(p))
    base = both if train is None else train.join(fits.select(*keys, "beta"), keys).withColumn("_eta", linear_predictor(p))
    mean = base.groupBy(*keys).agg(F.avg("_eta").alias("_mean"))
    return both.join(mean, keys).withColumn("risk", F.exp(F.col("_eta") - F.col("_mean"))).drop("_eta", "_mean", "beta")


def horizon_hazards(hazard: DataFrame, fits: DataFrame, horizons, keys: list[str]) -> DataFrame:
    """Baseline hazard at each horizon; null past the last observed time of the stratum."""
    at = [
        F.when(F.max("last_time") >= F.lit(h), F.coalesce(F.max(F.when(F.col("time") <= F.lit(h), F.col("hazard"))), F.lit(0.0))).alias(f"h{i}")
        for i, h in enumerate(horizons)
    ]
    return hazard.groupBy(*keys).agg(*at).join(fits.select(*keys, "beta"), keys)


def survival_probability(rows: DataFrame, levels: DataFrame, keys: list[str], p: int, n: int, names=None) -> DataFrame:
    """Add one probability column per horizon to rows that carry ``x``."""
    names = names or [f"p{i}" for i in range(n)]
    both = rows.join(levels, keys, "left").withColumn("_risk", F.exp(linear_predictor(p)))
    return both.withColumns({c: F.exp(-F.col(f"h{i}") * F.col("_risk")) for i, c in enumerate(names)}).drop(
        "_risk", "beta", *[f"h{i}" for i in range(n)]
    )


def cox_terms(fits: DataFrame, names: DataFrame, p: int) -> DataFrame:
    """Long registry: (cluster, position, term, coef, std_error)."""
    cells = fits.select("cluster", "inverse", "events", "converged", F.posexplode("beta").alias("position", "coef"))
    return cells.join(names, ["cluster", "position"]).select(
        "cluster", "position", "term", "coef", F.sqrt(F.col("inverse")[F.col("position") * p + F.col("position")]).alias("std_error"),
        "events", F.col("converged").cast("int").alias("converged"),
    )
