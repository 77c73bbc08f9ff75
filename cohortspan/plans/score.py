"""Training and batch scoring jobs: classify, ship the stratum's features, predict, fill, format."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..operators import clean, collapse, design, impute, linear, strata, survival, transform
from ..session import from_rows, materialize, small_or_stored
from ..sources.bridge import Roles


def stratum_features(models: dict[int, tuple[str, ...]], derived: dict[str, tuple[str, ...]]) -> dict[int, list[str]]:
    """Raw features each stratum's model needs; derived columns are replaced by their sources."""
    out = {}
    for c, names in models.items():
        columns = list(dict.fromkeys(x for t in design.terms(names) for x in t))
        out[c] = list(dict.fromkeys(r for x in columns for r in derived.get(x, (x,))))
    return out


def select_rows(forms: DataFrame, labels: DataFrame, needed: dict[int, list[str]]) -> DataFrame:
    """Raw rows of each labelled subject restricted to its stratum's features; rows that no stratum needs do not move."""
    forms = forms.filter(F.col("feature_name").isin(sorted({f for fs in needed.values() for f in fs})))
    pairs = from_rows(forms.sparkSession, [(c, f) for c, fs in needed.items() for f in fs], "cluster int, feature_name string")
    return forms.join(labels.select("subject_id", "cluster"), "subject_id").join(pairs, ["cluster", "feature_name"])


@dataclass(frozen=True)
class Trained:
    """A training table with everything needed to score new subjects.

    Read back from a bundle, it has no training rows: ``index`` and ``offsets_of`` stand for them.
    """

    wide: DataFrame | None
    filled: DataFrame | None
    table: DataFrame | None
    model: transform.Preparation
    median_onset: float | None
    index: impute.Tree | impute.Forest | None = None
    offsets_of: DataFrame | None = None


@dataclass(frozen=True)
class SlopeModels:
    """Least-squares models of the strata with what replaces predictions that are missing."""

    fits: DataFrame
    designs: dict[int, list[design.DesignColumn]]
    means: DataFrame


@dataclass(frozen=True)
class SurvivalModels:
    """Cox models of the strata: fits, steps of the baseline hazard, and mean probabilities."""

    fits: DataFrame
    hazard: DataFrame
    designs: dict[int, list[design.DesignColumn]]
    width: int
    means: DataFrame


def train(forms: DataFrame, response: DataFrame, roles: Roles, median: float | None = None) -> Trained:
    """Prepare the subjects that have a response. Rows of others may be there: they are left out of the wide table, which is smaller."""
    if median is None:
        own = forms.join(response.select("subject_id"), "subject_id", "left_semi")
        median = collapse.onset_median_value(own, roles, fixed.INTERVAL_FORMS)
    wide = collapse.collapse(forms, roles, fixed.INTERVAL_FORMS, median_onset=median)
    known = materialize(wide.join(response, "subject_id"), "train-wide")
    kinds = transform.kinds_of(roles.numerics, roles.right_skewed, roles.left_skewed)
    ready = transform.prepare_training(known, roles.numerics, roles.categorical, kinds)
    return Trained(known, ready.filled, materialize(ready.table, "train-table"), ready.model, median)


def prepare_new(forms: DataFrame, trained: Trained, roles: Roles, known: DataFrame | None = None) -> DataFrame:
    """Wide, imputed and standardised rows of new subjects, each joined with the training set only.

    ``known`` are subjects that are not new; they are left out of the wide table, which is smaller than their forms.
    """
    wide = collapse.collapse(forms, roles, fixed.INTERVAL_FORMS, median_onset=trained.median_onset)
    if known is not None:
        wide = wide.join(known.select("subject_id"), "subject_id", "left_anti")
    return transform.prepare_scoring(
        materialize(wide, "new-wide"), trained.wide, trained.filled, trained.model, index=trained.index, offsets_of=trained.offsets_of
    )


def union_training(train_wide: DataFrame, new_wide: DataFrame) -> DataFrame:
    """Training and new subjects in one table by column name, new ones flagged."""
    return train_wide.withColumn("is_scoring", F.lit(False)).unionByName(
        new_wide.withColumn("is_scoring", F.lit(True)), allowMissingColumns=True
    )


def train_slope(trained: Trained, rule_set, models: dict[int, tuple[str, ...]], columns=None) -> SlopeModels:
    rows = strata.classify(trained.table, rule_set, columns)
    fits, designs = linear.fit_ols(rows, {c: design.terms(m) for c, m in models.items()}, trained.model.level_map)
    fits = materialize(fits, "models")
    return SlopeModels(fits, designs, linear.stratum_means(linear.predict_ols(rows, fits, designs), ["fit"]))


def predict_slope(forms: DataFrame, trained: Trained, roles: Roles, rule_set, fitted: SlopeModels, columns=None, *,
                  needed: dict[int, list[str]] | None = None, known: DataFrame | None = None) -> DataFrame:
    """(subject, cluster, fit, se, replaced) for every new subject (not ``known``); missing predictions take the stratum mean.

    With ``needed`` a stratum is scored from its own features only, the way a two-step request does.
    """
    ready = materialize(strata.classify(prepare_new(forms, trained, roles, known), rule_set, columns), "new-table")
    if needed is not None:
        labels = ready.select("subject_id", "cluster")
        again = prepare_new(select_rows(forms, labels, needed).drop("cluster"), trained, roles)
        ready = materialize(again.join(labels, "subject_id"), "new-table")
    scored = linear.predict_ols(ready, fitted.fits, fitted.designs)
    return linear.fill_with_fallback(scored, fitted.means, ["fit"], ["se"]).select("subject_id", "cluster", "fit", "se", "replaced")


def score_slope(forms: DataFrame, trained: Trained, roles: Roles, rule_set, models: dict[int, tuple[str, ...]], columns=None,
                *, restrict: bool = False, derived=None, known: DataFrame | None = None) -> DataFrame:
    """Fit the strata's models and score new subjects with them."""
    needed = stratum_features(models, derived or fixed.DERIVED_FROM) if restrict else None
    return predict_slope(forms, trained, roles, rule_set, train_slope(trained, rule_set, models, columns), columns, needed=needed, known=known)


def fit_survival(rows: DataFrame, models: dict[int, tuple[str, ...]], level_map) -> tuple[DataFrame, DataFrame, dict, int]:
    """Cox fits per stratum: (model rows with x, fits, designs, width)."""
    designs = {c: design.design(design.terms(m), level_map) for c, m in models.items()}
    x, width = design.vector(designs, intercept=False)
    data = materialize(survival.prepare_rows(rows.filter(F.col("cluster").isin(*models)), ["cluster"], x), "cox-rows")
    return data, materialize(survival.fit_cox(data, ["cluster"], width), "cox-fits"), designs, width


def survival_levels(data: DataFrame, fits: DataFrame, width: int, horizons=fixed.HORIZON_DAYS) -> DataFrame:
    return levels_of(survival.baseline_hazard(data, fits, ["cluster"], width), fits, horizons)


def levels_of(hazard: DataFrame, fits: DataFrame, horizons=fixed.HORIZON_DAYS) -> DataFrame:
    """Hazards at the horizons, one row a stratum."""
    return small_or_stored(survival.horizon_hazards(hazard, fits, horizons, ["cluster"]), "hazard")


PROBABILITIES = ("p12", "p18", "p24")


def predict_survival(rows: DataFrame, levels: DataFrame, designs, width: int) -> DataFrame:
    x, _ = design.vector(designs, intercept=False, width=width)
    return survival.survival_probability(rows.withColumn("x", x), levels, ["cluster"], width, 3, PROBABILITIES).drop("x")


def train_survival(trained: Trained, rule_set, models, columns=None) -> SurvivalModels:
    rows = strata.classify(trained.table, rule_set, columns)
    data, fits, designs, width = fit_survival(rows, models, trained.model.level_map)
    hazard = materialize(survival.baseline_hazard(data, fits, ["cluster"], width), "hazard-steps")
    scored = predict_survival(rows, levels_of(hazard, fits), designs, width)
    return SurvivalModels(fits, hazard, designs, width, linear.stratum_means(scored, PROBABILITIES))


def predict_probabilities(forms: DataFrame, trained: Trained, roles: Roles, rule_set, fitted: SurvivalModels, columns=None, *,
                          known: DataFrame | None = None) -> DataFrame:
    """(subject, cluster, p12, p18, p24 and a flag each); missing probabilities take the stratum mean one by one."""
    ready = materialize(strata.classify(prepare_new(forms, trained, roles, known), rule_set, columns), "new-table")
    scored = predict_survival(ready, levels_of(fitted.hazard, fitted.fits), fitted.designs, fitted.width)
    return linear.fill_with_fallback(scored, fitted.means, list(PROBABILITIES)).select(
        "subject_id", "cluster", *PROBABILITIES, *[f"replaced_{c}" for c in PROBABILITIES]
    )


def score_survival(forms: DataFrame, trained: Trained, roles: Roles, rule_set, models, columns=None, *, known: DataFrame | None = None) -> DataFrame:
    """Fit the strata's Cox models and score new subjects with them."""
    return predict_probabilities(forms, trained, roles, rule_set, train_survival(trained, rule_set, models, columns), columns, known=known)


def slope_registry(spark: SparkSession, fits: DataFrame, designs) -> DataFrame:
    return linear.term_table(fits, designs)


def survival_registry(spark: SparkSession, fits: DataFrame, designs, width: int) -> DataFrame:
    names = from_rows(
        spark, [(c, i, design.label(d)) for c, ds in designs.items() for i, d in enumerate(ds)], "cluster int, position int, term string"
    )
    return survival.cox_terms(fits, names, width)


def measured_subjects(forms: DataFrame, roles: Roles) -> DataFrame:
    return clean.subjects(forms, roles.features, fixed.INTERVAL_FORMS)
