"""Model metrics: RMSE, concordance, time-dependent AUC and its integral.

Nothing here pairs rows. Concordance counts earlier-event / later-subject pairs by splitting the
time rank into octal digits: two ranks first differ at exactly one digit, and inside that digit's
prefix a running count over the score gives the number of dominated subjects. AUC(t) needs one
running count of controls over the marker. Both cost N log N and work on hot groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import longest_group, running_totals
from ..session import materialize
from .survival import censoring_curve

BASE_BITS = 3
MONTH = 30.5


def rmse(scored: DataFrame, observed: str, fitted: str, keys: list[str]) -> DataFrame:
    error = F.col(observed) - F.col(fitted)
    return scored.groupBy(*keys).agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.count(error).alias("n"))


def concordance(rows: DataFrame, keys: list[str], score: str = "risk", time: str = "time_event", status: str = "status") -> DataFrame:
    """Share of comparable pairs in which the earlier event has the higher score; tied scores count half.

    A pair is comparable when one subject has an event and the other is followed longer; a subject
    censored on the day of an event counts as followed longer, two events on one day do not compare.
    """
    base = materialize(
        rows.filter(F.col(time).isNotNull() & F.col(status).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
        .select(*keys, F.col(time).alias("_t"), F.col(status).cast("int").alias("_e"), F.col(score).alias("_s")), "concordance",
    )
    times = base.select(*keys, "_t").distinct().withColumn("_one", F.lit(1))
    longest = longest_group(times, keys)
    ranks = running_totals(times, keys, "_t", {"_rank": "_one"}, longest=longest).drop("_one")
    digits = max(1, -(-(2 * longest + 2).bit_length() // BASE_BITS))
    size = 1 << BASE_BITS
    placed = base.join(ranks, [*keys, "_t"]).withColumn("_pos", 2 * F.col("_rank") + 1 - F.col("_e"))
    cells = placed.select(*keys, "_s", "_e", F.explode(F.array(*[
        F.struct(
            F.lit(level).alias("level"),
            F.shiftright("_pos", BASE_BITS * (level + 1)).alias("prefix"),
            F.shiftright("_pos", BASE_BITS * level).bitwiseAND(size - 1).alias("digit"),
        ) for level in range(digits)
    ])).alias("c")).select(*keys, "_s", "_e", "c.*")
    part = [*keys, "level", "prefix"]
    counts = cells.groupBy(*part, "_s").agg(
        *[F.sum((F.col("digit") == b).cast("bigint")).alias(f"n{b}") for b in range(size)],
        *[F.sum(F.when(F.col("digit") == b, F.col("_e")).otherwise(0)).alias(f"e{b}") for b in range(size - 1)],
    )
    run = running_totals(counts, part, "_s", {f"c{b}": f"n{b}" for b in range(1, size)}, exclusive=True)
    above = lambda p, a: sum((F.col(f"{p}{b}") for b in range(a + 1, size)), F.lit(0)).cast("double")
    better = sum((F.col(f"e{a}") * above("c", a) for a in range(size - 1)), F.lit(0.0))
    equal = sum((F.col(f"e{a}") * above("n", a) for a in range(size - 1)), F.lit(0.0))
    pairs = counts.groupBy(*part).agg(
        *[F.sum(f"n{b}").alias(f"n{b}") for b in range(1, size)], *[F.sum(f"e{b}").alias(f"e{b}") for b in range(size - 1)]
    ).groupBy(*keys).agg(F.sum(sum((F.col(f"e{a}") * above("n", a) for a in range(size - 1)), F.lit(0.0))).alias("comparable"))
    scored = run.groupBy(*keys).agg(F.sum(better).alias("concordant"), F.sum(equal).alias("tied"))
    return scored.join(pairs, keys).select(
        *keys, "comparable", "concordant", "tied",
        F.try_divide(F.col("concordant") + F.col("tied") / 2.0, F.col("comparable")).alias("c_index"),
    )


def auc_at(rows: DataFrame, keys: list[str], horizons, score: str = "risk", time: str = "time_event",
           status: str = "status") -> DataFrame:
    """Cumulative/dynamic AUC at each horizon with marginal censoring weights: (keys, auc array).

    Cases had the event by the horizon and weigh 1/G just before their time; controls are still
    followed after it. Null when a horizon has no case or no control.
    """
    horizons = [float(h) for h in horizons]
    base = materialize(
        rows.filter(F.col(time).isNotNull() & F.col(status).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
        .select(*keys, F.col(time).alias("time"), F.col(status).cast("int").alias("status"), F.col(score).alias("_s")), "auc",
    )
    weights = censoring_curve(base, keys, "time", "status").select(*keys, "time", "g_before")
    both = base.join(weights, [*keys, "time"]).withColumn("_w", F.try_divide(F.col("status").cast("double"), F.col("g_before")))
    aggs = []
    for i, h in enumerate(horizons):
        aggs.append(F.sum(F.when(F.col("time") <= h, F.col("_w")).otherwise(0.0)).alias(f"w{i}"))
        aggs.append(F.sum((F.col("time") > h).cast("bigint")).alias(f"n{i}"))
    counts = both.groupBy(*keys, "_s").agg(*aggs)
    n = len(horizons)
    run = running_totals(counts, keys, "_s", {f"c{i}": f"n{i}" for i in range(n)}, exclusive=True)
    value = [
        F.try_divide(F.sum(F.col(f"w{i}") * (F.col(f"c{i}") + F.col(f"n{i}") / 2.0)), F.sum(f"w{i}") * F.sum(f"n{i}"))
        for i in range(n)
    ]
    return run.groupBy(*keys).agg(F.array(*value).alias("auc"))


def auc_table(rows: DataFrame, keys: list[str], horizons, **columns) -> DataFrame:
    marks = F.array(*[F.lit(float(h)) for h in horizons])
    wide = auc_at(rows, keys, horizons, **columns)
    return wide.select(*keys, F.posexplode("auc").alias("_i", "auc")).withColumn("horizon", marks[F.col("_i")]).drop("_i")


def integrate(values: np.ndarray, points: np.ndarray, span: float, steps: int = 512) -> float | None:
    """Simpson's rule over a linear resampling of the defined points, divided by the full span."""
    ok = ~np.isnan(values)
    if ok.sum() < 2:
        return None
    grid = np.linspace(points[ok][0], points[ok][-1], steps + 1)
    y = np.interp(grid, points[ok], values[ok])
    h = (grid[-1] - grid[0]) / steps
    return float(h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) / span)


def scorecard(rows: DataFrame, keys: list[str], *, score: str = "risk", time: str = "time_event", status: str = "status",
              months: int = 30, marks: tuple[int, ...] = (12, 18, 24), horizon_scores: dict[int, str] | None = None) -> DataFrame:
    """c_index, AUC at the marked months and the integrated AUC per key, from one set of counts.

    ``horizon_scores`` gives a separate score column for a marked month; the others use ``score``.
    """
    points = [m * MONTH for m in range(months + 1)]
    kinds = dict(rows.dtypes)
    auc = auc_at(rows, keys, points, score, time, status)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + ", ".join(f"auc{m} double" for m in marks) + ", iauc double"
    grid = np.array(points)

    def finish(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            values = np.vstack(pdf["auc"].to_numpy()).astype(float)
            out = pdf[keys].copy()
            for m in marks:
                out[f"auc{m}"] = values[:, m]
            out["iauc"] = pd.Series([integrate(v, grid, grid[-1] - grid[0]) for v in values], index=out.index, dtype=float)
            yield out

    areas = auc.mapInPandas(finish, schema)
    for m, column in (horizon_scores or {}).items():
        own = auc_at(rows, keys, [m * MONTH], column, time, status).select(*keys, F.col("auc")[0].alias("_own"))
        areas = areas.join(own, keys, "left").withColumn(f"auc{m}", F.col("_own")).drop("_own")
    index = concordance(rows, keys, score, time, status).select(*keys, "c_index")
    return index.join(areas, keys)
