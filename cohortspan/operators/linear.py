"""Per-stratum least squares from one grouped aggregate of cross products.

Cross products are sums, so the data is read once for all strata, combined map-side, and a hot
stratum never travels as rows. Only the p x p solve happens in Python, one small row per model.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import from_rows, small_or_stored
from . import design as dz

PIVOT_TOLERANCE = 1e-11


def gram(rows: DataFrame, keys: list[str], x: Column, width: int, y: Column) -> DataFrame:
    """Upper triangle of [x y]'[x y] and the row count per key."""
    cells = rows.select(*keys, x.alias("_x"), y.alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL")
    at = lambda i: F.col("_x")[i] if i < width else F.col("_y")
    sums = [F.sum(at(i) * at(j)) for i in range(width + 1) for j in range(i, width + 1)]
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("g"))


def unpack(flat: np.ndarray, size: int) -> np.ndarray:
    """(batch, triangle) to full symmetric matrices."""
    out = np.zeros((flat.shape[0], size, size))
    i, j = np.triu_indices(size)
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


def solve(full: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gauss-Jordan over a batch of [x y] cross products, last column y.

    Columns are taken in order; one whose remaining sum of squares vanishes repeats earlier columns
    and is left out (coefficient 0, flagged). Returns coefficients, inverse, residual SS, used.
    """
    a = full.copy()
    b, size, _ = a.shape
    p = size - 1
    first = np.einsum("bii->bi", full).copy()
    inv = np.zeros((b, size, p))
    inv[:, np.arange(p), np.arange(p)] = 1.0
    used = np.zeros((b, p), dtype=bool)
    for k in range(p):
        piv = a[:, k, k]
        ok = piv > PIVOT_TOLERANCE * np.maximum(first[:, k], 1e-300)
        used[:, k] = ok
        safe = np.where(ok, piv, 1.0)[:, None]
        row, irow = a[:, k, :] / safe, inv[:, k, :] / safe
        factor = np.where(ok[:, None], a[:, :, k], 0.0)
        factor[:, k] = 0.0
        a -= factor[:, :, None] * row[:, None, :]
        inv -= factor[:, :, None] * irow[:, None, :]
        a[:, k, :] = np.where(ok[:, None], row, 0.0)
        inv[:, k, :] = np.where(ok[:, None], irow, 0.0)
        a[:, :, k] = np.where(ok[:, None], a[:, :, k], 0.0)
    coef = np.where(used, a[:, :p, p], 0.0)
    inverse = inv[:, :p, :] * used[:, :, None] * used[:, None, :]
    return coef, inverse, a[:, p, p], used


def t_quantile(prob: float, df: float) -> float:
    """Quantile of Student's t by bisection on the incomplete beta continued fraction."""
    def upper(t: float) -> float:
        x, a, b = df / (df + t * t), df / 2.0, 0.5
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
        flip = x > (a + 1) / (a + b + 2)
        if flip:
            x, a, b = 1 - x, b, a
        c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                        -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 / (1 + num * d)
                c = 1 + num / c
                h *= c * d
        part = front * h / a
        return 0.5 * (1 - part if flip else part)

    lo, hi = 1e-9, 1e9
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if upper(mid) > 1 - prob else (lo, mid)
    return math.sqrt(lo * hi)


FIT_SCHEMA = ("n bigint, width int, df_resid bigint, sigma2 double, t975 double, coef array<double>, "
              "used array<boolean>, inverse array<double>, rss double")


def fit_grams(grams: DataFrame, keys: list[str], width: int) -> DataFrame:
    """One model row per key: coefficients, (X'X)^-1, residual variance."""
    kinds = dict(grams.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + FIT_SCHEMA

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            coef, inverse, rss, used = solve(unpack(np.vstack(pdf["g"].to_numpy()), width + 1))
            rank = used.sum(axis=1)
            df_resid = pdf["n"].to_numpy() - rank
            sigma2 = np.where(df_resid > 0, rss / np.maximum(df_resid, 1), np.nan)
            out = pdf[keys].copy()
            out["n"], out["width"], out["df_resid"], out["sigma2"] = pdf["n"], width, df_resid, sigma2
            out["t975"] = [t_quantile(0.975, d) if d > 0 else None for d in df_resid]
            out["coef"], out["used"] = list(coef), list(used)
            out["inverse"] = list(inverse.reshape(len(pdf), -1))
            out["rss"] = rss
            yield out

    return grams.mapInPandas(run, schema)


def fit_ols(rows: DataFrame, models: dict[int, list[dz.Term]], level_map, y: str = "slope") -> tuple[DataFrame, dict]:
    """Fit every stratum's model in one job; returns the model table and its design columns."""
    designs = {c: dz.design(m, level_map) for c, m in models.items()}
    x, width = dz.vector(designs)
    wanted = rows.filter(F.col("cluster").isin(*models))
    return fit_grams(gram(wanted, ["cluster"], x, width, F.col(y)), ["cluster"], width), designs


def term_table(fits: DataFrame, designs: dict[int, list[dz.DesignColumn]]) -> DataFrame:
    """Long registry: one row per stratum and term with estimate and standard error."""
    spark = fits.sparkSession
    names = from_rows(
        spark, [(c, i, t) for c, d in designs.items() for i, t in enumerate(["(intercept)", *map(dz.label, d)])],
        "cluster int, position int, term string",
    )
    cells = fits.select("cluster", "n", "df_resid", "sigma2", "width", "inverse", "used", F.posexplode("coef").alias("position", "coef"))
    return cells.join(names, ["cluster", "position"]).select(
        "cluster", "position", "term",
        F.when(F.col("used")[F.col("position")], F.col("coef")).alias("coef"),
        F.when(F.col("used")[F.col("position")],
               F.sqrt(F.col("sigma2") * F.col("inverse")[F.col("position") * F.col("width") + F.col("position")])).alias("std_error"),
        "n", "df_resid", "sigma2",
    )


def predict_ols(rows: DataFrame, fits: DataFrame, designs: dict[int, list[dz.DesignColumn]]) -> DataFrame:
    """Add fit, standard error of the mean and the 95% prediction interval; null on missing terms."""
    x, width = dz.vector(designs)
    model = small_or_stored(fits.select("cluster", "coef", "inverse", "sigma2", "t975"), "models")
    both = rows.withColumn("_x", x).join(model, "cluster", "left")
    at = lambda i: F.col("_x")[i]
    fit = sum((at(i) * F.col("coef")[i] for i in range(width)), F.lit(0.0))
    form = sum(
        (at(i) * at(j) * F.col("inverse")[i * width + j] * F.lit(1.0 if i == j else 2.0)
         for i in range(width) for j in range(i, width)), F.lit(0.0),
    )
    out = both.withColumns({"fit": fit, "se": F.sqrt(F.greatest(F.col("sigma2") * form, F.lit(0.0)))})
    half = F.col("t975") * F.sqrt(F.col("sigma2") + F.col("se") * F.col("se"))
    return out.withColumns({"lower": F.col("fit") - half, "upper": F.col("fit") + half}).drop(
        "_x", "coef", "inverse", "sigma2", "t975"
    )


def stratum_means(predicted: DataFrame, columns) -> DataFrame:
    """Average prediction per stratum: the fallback for subjects the model cannot score."""
    return predicted.filter(F.col("cluster").isNotNull()).groupBy("cluster").agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns]
    )


def fill_with_fallback(predicted: DataFrame, fallback: DataFrame, columns, zero=()) -> DataFrame:
    """Replace missing predictions by the stratum mean and flag them: ``replaced``, or ``replaced_<column>`` each if there are several."""
    both = predicted.join(small_or_stored(fallback, "fallback"), "cluster", "left")
    flag = lambda c: "replaced" if len(columns) == 1 else f"replaced_{c}"
    out = {flag(c): F.col(c).isNull().cast("int") for c in columns}
    out |= {c: F.coalesce(F.col(c), F.col(f"mean_{c}")) for c in columns}
    out |= {c: F.when(F.col(columns[0]).isNull(), F.lit(0.0)).otherwise(F.col(c)) for c in zero}
    return both.withColumns(out).drop(*[f"mean_{c}" for c in columns])


def support_rows(rows: DataFrame, column: str, all_levels: list[str], *, cluster: str = "cluster", seed: int = 1,
                 donor_level: str | None = None) -> DataFrame:
    """For each level a stratum never saw, one donor row of that stratum with the level overridden.

    The donor is the row with the smallest draw key, found by a map-side combined minimum.
    """
    from ..functions.scalar import draw_key

    seen = rows.filter(F.col(column).isNotNull()).groupBy(cluster, column).agg(F.count(F.lit(1)).alias("_n"))
    groups = rows.filter(F.col(cluster).isNotNull()).select(cluster).distinct()
    # a small table: strata times levels of a closed set
    grid = groups.select(cluster, F.explode(F.array(*[F.lit(v) for v in all_levels])).alias("_level"))
    missing = grid.join(seen.withColumnRenamed(column, "_level"), [cluster, "_level"], "left_anti")
    pool = rows if donor_level is None else rows.filter(F.col(column) == donor_level)
    donors = pool.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(
        F.min(F.struct(
            draw_key(seed, F.col("subject_id")).alias("_d"), F.col("subject_id").alias("_i"),
            F.struct(*[F.col(c) for c in rows.columns if c != cluster]).alias("_row"),
        )).alias("_best")
    )
    return missing.join(donors, cluster).select(
        cluster, F.col("_level"), *[F.col(f"_best._row.{c}").alias(c) for c in rows.columns if c != cluster]
    ).withColumn(column, F.col("_level")).select(*rows.columns)
