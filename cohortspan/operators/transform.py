"""De-skewing, standardising, one-hot coding, and the joint preparation of new subjects.

Fitting is one or two aggregates that end in a few numbers per column; applying is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import impute

#: Text of all levels of a fit at most; their names are columns and parameters, so the driver holds them.
LEVEL_BYTES = 64 << 20


@dataclass(frozen=True)
class ScaleModel:
    """Per column: kind, offset of the log, and n / mean / sd of the transformed values."""

    kinds: dict[str, str]
    minimum: dict[str, float]
    count: dict[str, int]
    mean: dict[str, float]
    sd: dict[str, float]


def shaped(c: Column, kind: str, minimum: Column | float) -> Column:
    if kind == "right":
        low = minimum if isinstance(minimum, Column) else F.lit(minimum)
        return F.ln(c + F.abs(low) + F.lit(1.0))
    return c * c * c if kind == "left" else c


def kinds_of(columns, right_skewed=(), left_skewed=()) -> dict[str, str]:
    return {c: "right" if c in right_skewed else "left" if c in left_skewed else "plain" for c in columns}


def fit_scale(df: DataFrame, kinds: dict[str, str]) -> ScaleModel:
    """Two passes: minima for the log offsets, then moments of the transformed columns."""
    cols = list(kinds)
    low = df.agg(*[F.min(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    minimum = {c: low[f"m{i}"] for i, c in enumerate(cols)}
    aggs = []
    for i, c in enumerate(cols):
        t = shaped(F.col(c), kinds[c], minimum[c])
        aggs += [F.count(t).alias(f"n{i}"), F.avg(t).alias(f"a{i}"), F.stddev_samp(t).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    pick = lambda p: {c: row[f"{p}{i}"] for i, c in enumerate(cols)}
    return ScaleModel(kinds, minimum, pick("n"), pick("a"), pick("s"))


def column_stats(df: DataFrame, columns) -> DataFrame:
    """Minimum, mean and sample standard deviation of every column in one aggregate."""
    row = df.agg(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.min(c).alias("min_value"),
                 F.avg(c).alias("mean_value"), F.stddev_samp(c).alias("sd_value")) for c in columns
    ]).alias("s"))
    return row.select(F.inline("s"))


def apply_scale(df: DataFrame, model: ScaleModel) -> DataFrame:
    """Standardise with the fitted moments; a constant column becomes null."""
    out = {}
    for c, kind in model.kinds.items():
        sd = model.sd[c]
        if not sd:
            out[c] = F.lit(None).cast("double")
        else:
            out[c] = (shaped(F.col(c), kind, model.minimum[c]) - F.lit(model.mean[c])) / F.lit(sd)
    return df.withColumns(out)


SERIES = 24


#: Octaves of offsets whose power sums a stored preparation keeps.
OCTAVES = 64


def offset_sums(train: DataFrame, model: ScaleModel) -> DataFrame:
    """Power sums of every right-skewed column for all octaves below ``OCTAVES``: (feature, octave, n, l, ll, p, q)."""
    parts = [
        _offset_moments(train, c, model.minimum[c], list(range(OCTAVES))).select(
            F.lit(c).alias("feature"), F.col("_octave").alias("octave"), F.col("_n").alias("n"), F.col("_l").alias("l"), F.col("_ll").alias("ll"),
            F.col("_p").alias("p"), F.col("_q").alias("q"),
        ) for c, kind in model.kinds.items() if kind == "right"
    ]
    if not parts:
        return train.sparkSession.createDataFrame([], "feature string, octave int, n double, l double, ll double, p array<double>, q array<double>")
    return reduce(DataFrame.unionByName, parts)


def _offset_moments(train: DataFrame, column: str, minimum: float, octaves: list[int]) -> DataFrame:
    """Power sums that give mean and sd of ln(t + offset) for every offset, one row per octave.

    Let b be the smallest shifted value (never below 1) and c the middle of its octave. With
    w = t - minimum + c and d = b - c, ln(w + d) is a series in (d/c)*(c/w) whose ratio stays under
    1/3, so 24 power sums reach double precision. One pass over the training column serves any
    number of new minima.
    """
    def sums(batches):
        held = np.zeros((len(octaves), 3 + 2 * SERIES))
        for pdf in batches:
            x = pdf["_x"].to_numpy(dtype=float) - minimum
            for at, octave in enumerate(octaves):
                c = 1.5 * 2.0**octave
                log = np.log(x + c)
                powers = np.cumprod(np.broadcast_to(c / (x + c), (SERIES, len(x))), axis=0)
                held[at] += [len(x), log.sum(), (log * log).sum(), *powers.sum(axis=1), *(powers @ log)]
        if held[:, 0].any():
            yield pd.DataFrame(held, columns=names).assign(_octave=np.array(octaves, np.int32))

    names = ["_n", "_l", "_ll", *[f"_p{k}" for k in range(SERIES)], *[f"_q{k}" for k in range(SERIES)]]
    rows = train.select(F.col(column).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    return rows.mapInPandas(sums, ", ".join(f"{n} double" for n in names) + ", _octave int").groupBy("_octave").agg(
        *[F.sum(n).alias(n) for n in names[:3]], *[F.array(*[F.sum(f"{n}{k}") for k in range(SERIES)]).alias(n) for n in ("_p", "_q")]
    )


def _series_moments(shift: Column) -> tuple[Column, Column]:
    """Mean and sd from the power sums; ``shift`` is d/c."""
    c = [0.0] + [(-1.0) ** (k + 1) / k for k in range(1, SERIES + 1)]
    square = [sum(c[i] * c[m - i] for i in range(1, m)) for m in range(SERIES + 1)]
    total, total2 = F.col("_l"), F.col("_ll")
    power = F.lit(1.0)
    for k in range(1, SERIES + 1):
        power = F.pow(shift, F.lit(float(k)))
        total = total + F.lit(c[k]) * power * F.col("_p")[k - 1]
        total2 = total2 + F.lit(2 * c[k]) * power * F.col("_q")[k - 1] + F.lit(square[k]) * power * F.col("_p")[k - 1]
    mean = total / F.col("_n")
    return mean, F.sqrt((total2 - F.col("_n") * mean * mean) / (F.col("_n") - 1))


def apply_scale_joint(df: DataFrame, model: ScaleModel, train: DataFrame | None, offsets_of: DataFrame | None = None) -> DataFrame:
    """Standardise each new row against (training rows + that row) in closed form.

    Adding x to n values with mean m and squared deviations q gives mean m + d/(n+1) and
    q + d*d*n/(n+1) with d = x - m. A new minimum moves the log offset and with it every training
    value; those rows take their training moments from the power sums of their offset's octave: computed from ``train``, or stored ones
    (``offsets_of``, from ``offset_sums``).
    """
    rights = [c for c, k in model.kinds.items() if k == "right"]
    moments = {c: (F.lit(model.mean[c]), F.lit(model.sd[c])) for c in model.kinds}
    offsets: dict[str, Column | float] = dict(model.minimum)
    result = df
    if rights:
        lows = [
            F.when(F.col(c) < F.lit(model.minimum[c]), F.floor(F.log2(F.lit(model.minimum[c] + 1.0) + F.abs(F.col(c)))))
            for c in rights
        ]
        span = df.agg(*[F.min(o).alias(f"lo{i}") for i, o in enumerate(lows)], *[F.max(o).alias(f"hi{i}") for i, o in enumerate(lows)]).first()
    for i, c in enumerate(rights):
        if span[f"lo{i}"] is None:
            continue
        if offsets_of is None:
            sums = _offset_moments(train, c, model.minimum[c], list(range(int(span[f"lo{i}"]), int(span[f"hi{i}"]) + 1)))
        else:
            if span[f"hi{i}"] >= OCTAVES:
                raise ValueError(f"{c} holds a value below -2^{OCTAVES}; stored power sums do not reach that far")
            sums = offsets_of.filter(F.col("feature") == c).select(F.col("octave").alias("_octave"), *[F.col(x).alias(f"_{x}") for x in ("n", "l", "ll", "p", "q")])
        base = F.lit(model.minimum[c] + 1.0) + F.abs(F.col(c))
        centre = F.lit(1.5) * F.pow(F.lit(2.0), F.col(f"_octave_{c}"))
        mean, sd = _series_moments((base - centre) / centre)
        result = (
            result.withColumn(f"_octave_{c}", lows[i].cast("int"))
            .join(sums.withColumnRenamed("_octave", f"_octave_{c}"), f"_octave_{c}", "left")
            .withColumns({f"_mean_{c}": mean, f"_sd_{c}": sd})
            .drop("_n", "_l", "_ll", "_p", "_q")
        )
        moments[c] = (
            F.coalesce(F.col(f"_mean_{c}"), F.lit(model.mean[c])), F.coalesce(F.col(f"_sd_{c}"), F.lit(model.sd[c]))
        )
        offsets[c] = F.least(F.col(c), F.lit(model.minimum[c]))
    out = {}
    for c, kind in model.kinds.items():
        n = float(model.count[c])
        mean, sd = moments[c]
        d = shaped(F.col(c), kind, offsets[c]) - mean
        q = sd * sd * F.lit(n - 1.0) + d * d * F.lit(n / (n + 1.0))
        out[c] = F.try_divide(d * F.lit(n / (n + 1.0)), F.sqrt(q / F.lit(n)))
    return result.withColumns(out).select(*df.columns)


def level_counts(df: DataFrame, columns) -> dict[str, dict[str, int]]:
    """Rows per level of each categorical column; refuses columns that are not closed sets."""
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns
    ])).alias("s")).select("s.*").filter(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    cells = materialize(cells, "levels")
    size = cells.agg(F.sum(F.octet_length("v") + 16)).first()[0] or 0
    if size > LEVEL_BYTES:
        raise ValueError(f"the categorical columns' levels take {size} bytes; at most {LEVEL_BYTES} are held")
    out: dict[str, dict[str, int]] = {c: {} for c in columns}
    for r in cells.collect():
        out[r["c"]][r["v"]] = r["n"]
    return out


def levels(df: DataFrame, columns) -> dict[str, list[str]]:
    """Sorted level list per categorical column."""
    return {c: sorted(v) for c, v in level_counts(df, columns).items()}


def modes(counts: dict[str, dict[str, int]]) -> dict[str, str | None]:
    """Most frequent level per column, smallest on ties."""
    return {c: min(v, key=lambda x: (-v[x], x)) if v else None for c, v in counts.items()}


def dummy_code(df: DataFrame, columns, level_map: dict[str, list[str]]) -> DataFrame:
    """Treatment contrasts: one 0/1 column per level but the first, named feature_level."""
    made = {}
    for c in columns:
        if len(level_map[c]) < 2:
            raise ValueError(f"{c} needs at least two levels")
        for lvl in level_map[c][1:]:
            if dummy_name(c, lvl) in made:
                raise ValueError(f"levels of {c} collide after normalising")
            made[dummy_name(c, lvl)] = F.when(F.col(c).isNotNull(), (F.col(c) == F.lit(lvl)).cast("double"))
    return df.select(*[F.col(x) for x in df.columns if x not in columns], *[e.alias(n) for n, e in made.items()])


def dummy_name(column: str, level: str) -> str:
    from ..functions.scalar import normalise_name

    return f"{column}_{normalise_name(level)}"


def unseen_to_null(df: DataFrame, level_map: dict[str, list[str]]) -> DataFrame:
    """Categories that training never saw become null, for every categorical column."""
    return df.withColumns({c: F.when(F.col(c).isin(*lv), F.col(c)) for c, lv in level_map.items()})


@dataclass(frozen=True)
class Preparation:
    """Everything fitted on the training rows that a new subject needs."""

    numerics: tuple[str, ...]
    categoricals: tuple[str, ...]
    knn: impute.ImputeModel
    scale: ScaleModel
    modes: dict[str, str | None]
    level_map: dict[str, list[str]]


@dataclass(frozen=True)
class Prepared:
    filled: DataFrame
    table: DataFrame
    model: Preparation


def prepare_training(wide: DataFrame, numerics, categoricals, kinds: dict[str, str], **limits) -> Prepared:
    """Impute, de-skew, standardise and mode-fill the training table."""
    knn = impute.fit(wide, numerics, **limits)
    filled = materialize(impute.knn_impute(wide, numerics, model=knn), "imputed")
    scale = fit_scale(filled, kinds)
    counts = level_counts(filled, categoricals)
    prep = Preparation(
        tuple(numerics), tuple(categoricals), knn, scale, modes(counts), {c: sorted(v) for c, v in counts.items()}
    )
    return Prepared(filled, impute.mode_impute(apply_scale(filled, scale), categoricals, prep.modes), prep)


def prepare_scoring(new_wide: DataFrame, train_wide: DataFrame | None, train_filled: DataFrame | None, prep: Preparation, *,
                    index: impute.Tree | impute.Forest | None = None, offsets_of: DataFrame | None = None) -> DataFrame:
    """Joint preparation of many new subjects, each against the training rows and itself.

    ``index`` and ``offsets_of`` stand for the training rows where only what was stored of them is at hand.
    """
    known = unseen_to_null(new_wide, prep.level_map)
    filled = materialize(impute.knn_impute(known, prep.numerics, pool=train_wide, model=prep.knn, index=index), "new-filled")
    scaled = apply_scale_joint(filled, prep.scale, train_filled, offsets_of)
    return impute.mode_impute(scaled, prep.categoricals, prep.modes)
