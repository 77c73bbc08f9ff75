"""Query catalogue: one callable per operator, each over the whole tables of ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions.scalar import normalise_name_column, rounded
from ..operators import (
    clean, collapse, design, impute, linear, metrics, resample, select, strata, survival, transform, tree,
)
from ..session import materialize, scratch_path, small_or_stored
from ..sources import bridge, files
from ..sources.bridge import STUDY
from . import bundle, prepare, products, score

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
OUT = fixed.INTERVAL_FORMS


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


FORM_COLS = ["subject_id", "form_name", "feature_name", "feature_value", "feature_delta", "row_seq"]


# --- cleaning --------------------------------------------------------------------------------------
@query
def filter_forms(spark, sf):
    return clean.drop_forms(bridge.forms(spark, sf), OUT).select(*FORM_COLS)


@query
def filter_interval_forms(spark, sf):
    return clean.only_forms(bridge.forms(spark, sf), OUT).select(*FORM_COLS)


@query
def feature_whitelist(spark, sf):
    kept = clean.whitelist(bridge.forms(spark, sf), ("quantity", "price", "age", "segment"))
    return kept.groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("feature_delta").cast("bigint").alias("sum_delta")
    )


@query
def feature_missingness(spark, sf):
    return rounded(clean.missingness(bridge.forms(spark, sf), OUT))


@query
def drop_sentinel(spark, sf):
    kept = clean.drop_mark(bridge.forms(spark, sf))
    return kept.groupBy("feature_name", "form_name").agg(
        F.count(F.lit(1)).alias("n"), F.count("feature_value").alias("n_value"), F.sum("row_seq").alias("sum_seq")
    )


@query
def lenient_cast(spark, sf):
    rows = clean.with_number(bridge.forms(spark, sf))
    return rounded(rows.groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_number"), F.avg("value").alias("mean_value"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
    ))


@query
def window_cutoff(spark, sf):
    rows = clean.in_window(clean.with_delta(bridge.forms(spark, sf)), fixed.WINDOW_DAYS)
    return rows.select("subject_id", "feature_name", "feature_value", F.col("delta").cast("bigint").alias("delta"), "row_seq")


@query
def complete_case(spark, sf):
    rows = clean.with_number(clean.with_delta(clean.drop_mark(bridge.forms(spark, sf))))
    return clean.complete_cases(rows, ["value", "delta"]).groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")
    )


@query
def normalise_names(spark, sf):
    return bridge.table(spark, sf, "part").select(
        "p_name", normalise_name_column(F.col("p_name")).alias("column_name")
    ).distinct()


@query
def subject_universe(spark, sf):
    return clean.subjects(bridge.forms(spark, sf), STUDY.features, OUT)


# --- collapse --------------------------------------------------------------------------------------
@query
def collapse_wide(spark, sf):
    return rounded(prepare.wide_plan(spark, sf), 5, discount=8, tax=8)


@query
def collapse_mean(spark, sf):
    return rounded(collapse.collapse_numeric(bridge.forms(spark, sf), STUDY.numeric_mean, OUT, "mean"), 5)


@query
def collapse_min(spark, sf):
    return rounded(collapse.collapse_numeric(bridge.forms(spark, sf), STUDY.numeric_min, OUT, "min"))


@query
def collapse_mode(spark, sf):
    return collapse.collapse_mode(bridge.forms(spark, sf), STUDY.categorical, OUT)


@query
def collapse_registry(spark, sf):
    forms = bridge.registry_forms(spark, sf)
    return rounded(collapse.collapse_numeric(forms, bridge.REGISTRY_FEATURES, OUT, "mean", days=15))


@query
def first_value(spark, sf):
    return collapse.first_value(bridge.forms(spark, sf), ("onset", "age", "quantity", "tax"), OUT)


@query
def latest_in_window(spark, sf):
    return collapse.latest_in_window(bridge.forms(spark, sf), "quantity", OUT)


@query
def prior_slope(spark, sf):
    return rounded(collapse.prior_slope_table(bridge.forms(spark, sf), STUDY, OUT))


@query
def onset_median(spark, sf):
    return collapse.onset_median(bridge.forms(spark, sf, ("onset",)), STUDY, OUT)


@query
def onset_age(spark, sf):
    return rounded(prepare.wide_plan(spark, sf).select("subject_id", "onset_age"))


@query
def attach_slope(spark, sf):
    wide = prepare.wide_plan(spark, sf)
    return rounded(collapse.attach_response(wide.select("subject_id", "price", "segment"), bridge.slope_response(spark, sf)), 5)


@query
def attach_survival(spark, sf):
    wide = prepare.wide_plan(spark, sf)
    return rounded(collapse.attach_response(wide.select("subject_id", "price", "segment"), bridge.survival_response(spark, sf)), 5)


# --- imputation and transforms -----------------------------------------------------------------------
@query
def knn_neighbours(spark, sf):
    wide = prepare.wide_table(spark, sf)
    return rounded(impute.neighbours(wide, STUDY.numerics, max_block=100), 4)


@query
def knn_impute(spark, sf):
    wide = prepare.wide_table(spark, sf)
    filled = impute.knn_impute(wide, STUDY.numerics, max_block=100).select("subject_id", *STUDY.numerics)
    # prices are means of ten means of cents and often end in an exact 5; step off the rounding edge
    return rounded(filled.withColumn("price", F.col("price") + 1e-7), 5, discount=8, tax=8)


@query
def mode_impute(spark, sf):
    wide = prepare.wide_table(spark, sf)
    return impute.mode_impute(wide, STUDY.categorical).select("subject_id", *STUDY.categorical)


@query
def column_stats(spark, sf):
    return rounded(transform.column_stats(prepare.wide_table(spark, sf), STUDY.numerics), 5)


@query
def deskew_scale(spark, sf):
    return rounded(prepare.feature_table(spark, sf).table.select("subject_id", *STUDY.numerics))


@query
def dummy_code(spark, sf):
    study = prepare.feature_table(spark, sf)
    coded = transform.dummy_code(study.table, STUDY.categorical, study.model.level_map)
    return rounded(coded.drop(*STUDY.numerics, "slope", "time_event", "status"))


@query
def unseen_level_to_null(spark, sf):
    """New subjects (no slope response) against the category levels of the training subjects."""
    wide = collapse.attach_response(prepare.wide_table(spark, sf), bridge.slope_response(spark, sf))
    train = wide.filter(F.col("slope").isNotNull())
    level_map = transform.levels(train.filter(F.col("segment") != "BUILDING"), STUDY.categorical)
    return transform.unseen_to_null(wide.filter(F.col("slope").isNull()), level_map).select("subject_id", *STUDY.categorical)


# --- strata ------------------------------------------------------------------------------------------
ROLE_COLUMNS = {
    "onset_delta": "onset", "Q1_Speech": "quantity", "hands": "price", "trunk": "discount", "fvc_percent": "tax",
    "onsetAge": "onset_age", "ALSFRS_Total": "quantity", "priorSlope": "prior_slope",
}


STRATA = fixed.RULES_REGISTRY_SURVIVAL


def _classified(spark, sf, rules):
    study = prepare.feature_table(spark, sf)
    return strata.classify(study.table, rules, ROLE_COLUMNS), study


def _labels(spark, sf, rules):
    return _classified(spark, sf, rules)[0].select("subject_id", "cluster")


@query
def classify_c1(spark, sf):
    return _labels(spark, sf, fixed.RULES_TRIAL_SLOPE)


@query
def classify_c2(spark, sf):
    return _labels(spark, sf, fixed.RULES_TRIAL_SURVIVAL)


@query
def classify_c3(spark, sf):
    return _labels(spark, sf, fixed.RULES_REGISTRY_SLOPE)


@query
def classify_c4(spark, sf):
    return _labels(spark, sf, fixed.RULES_REGISTRY_SURVIVAL)


@query
def cluster_sizes(spark, sf):
    table, _ = _classified(spark, sf, fixed.RULES_TRIAL_SLOPE)
    return strata.cluster_sizes(table.filter(F.col("slope").isNotNull()), fixed.HOLDOUT_SHARE)


# --- linear models -----------------------------------------------------------------------------------
SLOPE_MODELS = {
    1: ("quantity", "price", "quantity*price"),
    2: ("discount", "segment"),
    3: ("tax", "onset_age", "returnflag", "quantity*linestatus"),
}
PAIR_MODELS = {1: ("quantity", "price"), 2: ("discount", "onset_age"), 3: ("tax", "age")}


def _slope_fits(spark, sf, models=None, rules=STRATA):
    table, study = _classified(spark, sf, rules)
    parsed = {c: design.terms(m) for c, m in (models or SLOPE_MODELS).items()}
    fits, designs = linear.fit_ols(table, parsed, study.model.level_map)
    return table, study, materialize(fits, "models"), designs


@query
def ols_fit(spark, sf):
    _, _, fits, designs = _slope_fits(spark, sf, PAIR_MODELS)
    return rounded(linear.term_table(fits, designs).select("cluster", "term", "coef", "n"), 4)


@query
def ols_fit_full(spark, sf):
    _, _, fits, designs = _slope_fits(spark, sf)
    return rounded(linear.term_table(fits, designs), 4, sigma2=2)


@query
def ols_predict(spark, sf):
    table, _, fits, designs = _slope_fits(spark, sf)
    return rounded(linear.predict_ols(table, fits, designs).select("subject_id", "cluster", "fit", "se"), 4)


@query
def cluster_fallbacks(spark, sf):
    table, _, fits, designs = _slope_fits(spark, sf)
    known = table.filter(F.col("slope").isNotNull())
    return rounded(linear.stratum_means(linear.predict_ols(known, fits, designs), ["fit"]), 4)


@query
def fallback_fill(spark, sf):
    """Subjects scored on raw (not imputed) discount: a missing value takes the stratum mean."""
    table, study, fits, designs = _slope_fits(spark, sf)
    known = linear.predict_ols(table.filter(F.col("slope").isNotNull()), fits, designs)
    means = linear.stratum_means(known, ["fit"])
    raw = study.wide.select("subject_id", F.col("discount").alias("_raw"))
    holes = table.join(raw, "subject_id").withColumn("discount", F.when(F.col("_raw").isNotNull(), F.col("discount")))
    scored = linear.predict_ols(holes, fits, designs)
    return rounded(linear.fill_with_fallback(scored, means, ["fit"], ["se"]).select("subject_id", "cluster", "fit", "se", "replaced"), 4)


@query
def support_augment(spark, sf):
    table, study = _classified(spark, sf, fixed.RULES_TRIAL_SLOPE)
    part = table.filter(F.col("slope").isNotNull()).withColumn(
        "group_name", F.concat_ws("-", "segment", "returnflag", "linestatus")
    ).select("subject_id", "cluster", "group_name", "slope")
    full = transform.levels(part, ["group_name"])["group_name"]
    return rounded(linear.support_rows(part, "group_name", full), 4)


# --- resampling and selection ------------------------------------------------------------------------
REPS, SEED = 20, 20
SLOPE_START = {1: ("quantity", "price"), 2: ("discount", "onset"), 3: ("tax", "onset_age", "tax*onset_age")}


def _train_rows(spark, sf, rules=STRATA):
    table, study = _classified(spark, sf, rules)
    return table.filter(F.col("slope").isNotNull() & F.col("cluster").isNotNull()), study


@query
def holdout_split(spark, sf):
    rows, _ = _train_rows(spark, sf)
    split = resample.holdout_split(rows.select("subject_id", "cluster"), reps=REPS, seed=SEED)
    return split.select("cluster", "rep", "subject_id", F.col("is_test").cast("int").alias("is_test"))


@query
def holdout_pool(spark, sf):
    """Test part per repetition plus 25 rows drawn from subjects without a survival response."""
    table, _ = _classified(spark, sf, STRATA)
    rows = table.filter(F.col("slope").isNotNull() & F.col("cluster").isNotNull())
    own = resample.holdout_split(rows.select("subject_id", "cluster"), reps=REPS, seed=SEED).filter("is_test")
    outside = table.filter(F.col("time_event").isNull()).select("subject_id", F.lit(0).alias("cluster"))
    drawn = resample.holdout_split(outside, reps=REPS, seed=SEED + 1, size=25).filter("is_test")
    return own.withColumn("source", F.lit("own")).unionByName(drawn.withColumn("source", F.lit("pool"))).select(
        "cluster", "rep", "subject_id", "source"
    )


def _void_rows(spark, sf):
    rows, study = _train_rows(spark, sf, fixed.RULES_TRIAL_SLOPE)
    part = rows.withColumn("combo", F.concat_ws("-", "segment", "returnflag", "linestatus")).select(
        "subject_id", "cluster", "combo", "linestatus", "slope"
    )
    part = materialize(part, "void-rows")
    cuts = small_or_stored(resample.holdout_cuts(part, reps=REPS, seed=SEED), "cuts")
    return part, cuts, transform.levels(part, ["linestatus", "combo"])


@query
def missing_levels(spark, sf):
    rows, cuts, level_map = _void_rows(spark, sf)
    return resample.missing_levels(rows, cuts, level_map, SEED)


@query
def void_levels(spark, sf):
    rows, cuts, level_map = _void_rows(spark, sf)
    donors = resample.override(resample.void_donors(rows, cuts, level_map, SEED), list(level_map))
    return rounded(donors.select("cluster", "rep", "feature", "level", "subject_id", "combo", "slope"), 4)


@query
def abundance_rate(spark, sf):
    rows, _ = _train_rows(spark, sf)
    return rounded(select.abundance(rows, STUDY.numerics + STUDY.categorical))


def _slope_search(spark, sf, build):
    rows, study = _train_rows(spark, sf)
    rows = materialize(rows, "train")
    models = build(rows)
    return select.cv_slope(
        rows, models, study.model.level_map, reps=REPS, seed=SEED, support=STUDY.categorical
    ), models


def _rates(rows, columns):
    return {(r["cluster"], r["feature"]): r["abundance"] for r in select.abundance(rows, columns).collect()}


def _additions(rows):
    candidates = STUDY.numerics + STUDY.categorical
    return select.addition_models(SLOPE_START, candidates, _rates(rows, candidates), fixed.ABUNDANCE_LIMIT)


@query
def interaction_candidates(spark, sf):
    rows, _ = _train_rows(spark, sf)
    return select.candidate_table(rows, _additions(rows))


@query
def forward_step_slope(spark, sf):
    return rounded(_slope_search(spark, sf, _additions)[0], 3)


@query
def backward_step_slope(spark, sf):
    return rounded(_slope_search(spark, sf, lambda rows: select.removal_models(SLOPE_START))[0], 3)


@query
def cv_summary(spark, sf):
    return rounded(select.summarise(_slope_search(spark, sf, _additions)[0], ["rmse"], skip_missing=False), 3)


@query
def best_model(spark, sf):
    summary = select.summarise(_slope_search(spark, sf, _additions)[0], ["rmse"], skip_missing=False)
    return rounded(select.best_model(summary, "mean_rmse"), 3)


@query
def top_models(spark, sf):
    summary = select.summarise(_slope_search(spark, sf, _additions)[0], ["rmse"], skip_missing=False)
    return rounded(select.top_models(summary, "mean_rmse", fixed.TOP_MODELS).select("cluster", "place", "model_id", "mean_rmse"), 3)


@query
def rmse(spark, sf):
    """Root mean squared residual of the fitted stratum models on their own rows."""
    table, _, fits, designs = _slope_fits(spark, sf)
    scored = linear.predict_ols(table.filter(F.col("slope").isNotNull()), fits, designs)
    return rounded(metrics.rmse(scored, "slope", "fit", ["cluster"]), 3)


# --- trees -------------------------------------------------------------------------------------------
TREE_OPTIONS = {"minsplit": fixed.TREE_MINSPLIT["trial_slope"], "cp": fixed.TREE_CP}


@query
def tree_best_split(spark, sf):
    """Best cut of every feature at the root, squared-error gain."""
    rows = prepare.feature_table(spark, sf).table
    data = materialize(tree.response_rows(rows, "anova").withColumn("node", F.lit(1).cast("bigint")), "root")
    best = tree.best_splits(data, STUDY.numerics, STUDY.categorical, kind="anova", minbucket=20, by=("node", "feature"))
    return rounded(best.select("feature", "gain", F.col("ln").alias("n_left"), "threshold"), 4, gain=0)


@query
def surv_tree_best_split(spark, sf):
    """Best cut of every feature at the root, exponential-survival gain."""
    rows = prepare.feature_table(spark, sf).table
    data = materialize(tree.response_rows(rows, "survival").withColumn("node", F.lit(1).cast("bigint")), "root")
    best = tree.best_splits(data, STUDY.numerics, STUDY.categorical, kind="survival", minbucket=20, by=("node", "feature"))
    return rounded(best.select("feature", "gain", F.col("ln").alias("n_left"), "threshold"), 4)


def _slope_tree(spark, sf):
    rows = prepare.feature_table(spark, sf).table
    return rows, tree.grow(rows, STUDY.numerics, STUDY.categorical, kind="anova", **TREE_OPTIONS)


@query
def tree_fit(spark, sf):
    _, nodes = _slope_tree(spark, sf)
    return rounded(tree.node_table(spark, nodes), 3, threshold=4, gain=0)


@query
def tree_fit_registry(spark, sf):
    """The same tree with the registry's smaller nodes, so a much deeper one."""
    rows = prepare.feature_table(spark, sf).table
    nodes = tree.grow(rows, STUDY.numerics, STUDY.categorical, kind="anova", minsplit=fixed.TREE_MINSPLIT["registry_slope"], cp=fixed.TREE_CP)
    return rounded(tree.node_table(spark, nodes), 3, threshold=4, gain=0)


@query
def tree_to_rules(spark, sf):
    """Grow, freeze to rules, classify by the rules: size and mean response of each leaf."""
    rows, nodes = _slope_tree(spark, sf)
    labelled = strata.classify(rows.filter(F.col("slope").isNotNull()), tree.rules(nodes), name="leaf")
    return rounded(labelled.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.avg("slope").alias("mean_slope")), 3)


@query
def surv_tree_fit(spark, sf):
    rows = prepare.feature_table(spark, sf).table
    nodes = tree.grow(rows, STUDY.numerics, STUDY.categorical, kind="survival", minsplit=fixed.TREE_MINSPLIT["registry_survival"], cp=fixed.TREE_CP)
    return rounded(tree.node_table(spark, nodes), 3)


# --- survival ----------------------------------------------------------------------------------------
COX_PAIRS = {1: ("price", "onset_age"), 2: ("discount", "prior_slope"), 3: ("tax", "quantity")}
COX_MODELS = {
    1: ("price", "onset_age", "quantity", "price*quantity"), 2: ("discount", "prior_slope", "segment"), 3: ("tax", "quantity"),
}


def _surv_rows(spark, sf):
    table, study = _classified(spark, sf, STRATA)
    return table.filter(F.col("time_event").isNotNull() & F.col("cluster").isNotNull()), study


@query
def km_curve(spark, sf):
    rows, _ = _surv_rows(spark, sf)
    return rounded(survival.km_curve(rows, ["cluster"]).select("cluster", "time", "events", "at_risk", "survival"))


@query
def cox_risk_sets(spark, sf):
    """Risk-set sums per event time at fixed coefficients (0.2, -0.1)."""
    rows, study = _surv_rows(spark, sf)
    designs = {c: design.design(design.terms(m), study.model.level_map) for c, m in COX_PAIRS.items()}
    x, p = design.vector(designs, intercept=False)
    data = materialize(survival.prepare_rows(rows, ["cluster"], x), "cox-rows")
    per = survival._per_time(data.withColumn("beta", F.array(F.lit(0.2), F.lit(-0.1))), ["cluster"], p, None)
    return rounded(per.select("cluster", "time", F.col("d").alias("events"), F.col("r0").alias("sum_risk"), F.col("r1_0").alias("sum_x1")))


@query
def cox_score_at_zero(spark, sf):
    rows, study = _surv_rows(spark, sf)
    designs = {c: design.design(design.terms(m), study.model.level_map) for c, m in COX_PAIRS.items()}
    x, p = design.vector(designs, intercept=False)
    data = materialize(survival.prepare_rows(rows, ["cluster"], x), "cox-rows")
    at_zero = survival.score_at(data, ["cluster"], p, F.array(F.lit(0.0), F.lit(0.0)))
    return rounded(at_zero.select(
        "cluster", "loglik", F.col("gradient")[0].alias("u1"), F.col("gradient")[1].alias("u2"), F.col("info")[0].alias("i11"),
        F.col("info")[1].alias("i12"), F.col("info")[2].alias("i22"),
    ), 5)


def _cox(spark, sf, models):
    rows, study = _surv_rows(spark, sf)
    return rows, *score.fit_survival(rows, models, study.model.level_map)


@query
def cox_fit(spark, sf):
    _, _, fits, designs, p = _cox(spark, sf, COX_PAIRS)
    return rounded(score.survival_registry(spark, fits, designs, p).drop("position"), 4)


@query
def cox_fit_full(spark, sf):
    _, _, fits, designs, p = _cox(spark, sf, COX_MODELS)
    return rounded(score.survival_registry(spark, fits, designs, p).drop("position"), 4)


@query
def cox_risk(spark, sf):
    rows, _, fits, designs, p = _cox(spark, sf, COX_PAIRS)
    x, _ = design.vector(designs, intercept=False)
    return rounded(survival.centred_risk(rows.withColumn("x", x), fits, ["cluster"], p).select("subject_id", "cluster", "risk"), 4)


@query
def surv_prob(spark, sf):
    rows, data, fits, designs, p = _cox(spark, sf, COX_PAIRS)
    levels = score.survival_levels(data, fits, p)
    return rounded(score.predict_survival(rows, levels, designs, p).select("subject_id", "cluster", *score.PROBABILITIES), 4)


# --- survival metrics: the marker is the standardised onset age --------------------------------------
MONTHS = tuple(m * 30.5 for m in range(31))


def _marked(spark, sf):
    rows, _ = _surv_rows(spark, sf)
    return rows.withColumn("risk", F.round(F.col("onset_age"), 6))


@query
def c_index(spark, sf):
    return rounded(metrics.concordance(_marked(spark, sf), ["cluster"]))


@query
def auc_t(spark, sf):
    return rounded(metrics.auc_table(_marked(spark, sf), ["cluster"], MONTHS))


@query
def iauc(spark, sf):
    return rounded(metrics.scorecard(_marked(spark, sf), ["cluster"]).select("cluster", "iauc"))


@query
def survival_scorecard(spark, sf):
    return rounded(metrics.scorecard(_marked(spark, sf), ["cluster"]))


@query
def horizon_scorecard(spark, sf):
    """A marker of its own for 12, 18 and 24 months; all else by the common one."""
    rows = _marked(spark, sf).withColumns({"m12": F.round("price", 6), "m18": F.round("tax", 6), "m24": F.round("onset_age", 6)})
    return rounded(metrics.scorecard(rows, ["cluster"], horizon_scores={12: "m12", 18: "m18", 24: "m24"}).select("cluster", "c_index", "auc12", "auc18", "auc24", "iauc"))


# --- survival selection ------------------------------------------------------------------------------
SURV_REPS = 5
SURV_BACK = {1: ("price", "onset_age", "segment"), 2: ("discount", "prior_slope", "linestatus"), 3: ("tax", "quantity", "age")}


def _surv_search(spark, sf, build):
    rows, study = _surv_rows(spark, sf)
    rows = materialize(rows, "train")
    return select.cv_survival(rows, build(rows), study.model.level_map, reps=SURV_REPS, seed=SEED)


def _surv_additions(rows):
    candidates = STUDY.numerics + STUDY.categorical
    return select.addition_models(COX_PAIRS, candidates, _rates(rows, candidates), fixed.ABUNDANCE_LIMIT)


@query
def forward_step_surv(spark, sf):
    return rounded(_surv_search(spark, sf, _surv_additions), 4)


@query
def backward_step_surv(spark, sf):
    return rounded(_surv_search(spark, sf, lambda rows: select.removal_models(SURV_BACK)), 4)


@query
def cross_validate_surv(spark, sf):
    models = {c: {" + ".join(m): design.terms(m)} for c, m in COX_MODELS.items()}
    return rounded(_surv_search(spark, sf, lambda rows: models), 4)


@query
def top_models_surv(spark, sf):
    scored = _surv_search(spark, sf, _surv_additions)
    summary = select.summarise(scored, select.SURVIVAL_METRICS, skip_missing=True)
    top = select.top_models(summary, "mean_c_index", fixed.TOP_MODELS, largest=True)
    return rounded(top.select("cluster", "place", "model_id", "mean_c_index", "mean_iauc"), 4)


# --- scoring -----------------------------------------------------------------------------------------
def _trained(spark, sf, response):
    """Training subjects have the response; the others are new and are scored. The forms of all, what was trained, and the subjects it knows."""
    forms, known = bridge.forms(spark, sf), response.select("subject_id")
    # onset rows only, so the visit tables are not read for their median
    onsets = bridge.forms(spark, sf, (STUDY.onset,)).join(known, "subject_id", "left_semi")
    median = collapse.onset_median_value(onsets, STUDY, OUT)
    return forms, score.train(forms, response, STUDY, median), known


@query
def union_train_score(spark, sf):
    wide = prepare.wide_table(spark, sf)
    response = bridge.slope_response(spark, sf)
    both = score.union_training(wide.join(response, "subject_id"), wide.join(response, "subject_id", "left_anti"))
    return rounded(both.select("subject_id", F.col("is_scoring").cast("int").alias("is_scoring"), "price", "segment", "slope"), 5)


@query
def score_prepare(spark, sf):
    forms, trained, known = _trained(spark, sf, bridge.slope_response(spark, sf))
    ready = score.prepare_new(forms, trained, STUDY, known)
    return rounded(ready.select("subject_id", *STUDY.numerics, *STUDY.categorical), 5)


@query
def score_batch_slope(spark, sf):
    forms, trained, known = _trained(spark, sf, bridge.slope_response(spark, sf))
    return rounded(score.score_slope(forms, trained, STUDY, STRATA, SLOPE_MODELS, ROLE_COLUMNS, known=known), 3)


@query
def score_batch_survival(spark, sf):
    forms, trained, known = _trained(spark, sf, bridge.survival_response(spark, sf))
    return rounded(score.score_survival(forms, trained, STUDY, STRATA, COX_PAIRS, ROLE_COLUMNS, known=known), 4)


def _saved(spark, sf, response, save, models) -> tuple[str, DataFrame, DataFrame]:
    """Train on the subjects with a response, save the bundle and forget the rest; the others are new."""
    forms, trained, known = _trained(spark, sf, response)
    root = scratch_path(spark, "bundle")
    save(spark, root, trained, STUDY, STRATA, models, ROLE_COLUMNS)
    return root, forms, known


@query
def score_bundle_slope(spark, sf):
    """The new subjects scored from a saved bundle."""
    root, forms, known = _saved(spark, sf, bridge.slope_response(spark, sf), bundle.save_slope, SLOPE_MODELS)
    return rounded(bundle.score_bundle_slope(spark, root, forms, known=known), 3)


@query
def score_bundle_survival(spark, sf):
    root, forms, known = _saved(spark, sf, bridge.survival_response(spark, sf), bundle.save_survival, COX_PAIRS)
    return rounded(bundle.score_bundle_survival(spark, root, forms, known=known), 4)


NEEDED_FROM = {"prior_slope": ("onset", "quantity"), "onset_age": ("onset", "age")}


def _selected(spark, sf):
    labels = _labels(spark, sf, STRATA).filter(F.col("cluster").isNotNull())
    needed = score.stratum_features(COX_PAIRS, NEEDED_FROM)
    return score.select_rows(bridge.forms(spark, sf), labels, needed)


@query
def select_rows(spark, sf):
    return _selected(spark, sf).select("subject_id", "cluster", "feature_name", "feature_value", "feature_delta", "row_seq")


def _requests(spark, sf) -> DataFrame:
    path = scratch_path(spark, "requests")
    files.write_requests(_selected(spark, sf), path)
    return files.read_request_lines(spark, path)


@query
def parse_cluster_tag(spark, sf):
    """Tagged requests of all subjects written as text and read back: the stratum and the lines of each."""
    return _requests(spark, sf).groupBy("subject_id", "cluster").agg(F.count(F.lit(1)).alias("n_lines"))


@query
def read_requests(spark, sf):
    """The form rows of tagged requests, read back."""
    return files.parse_request_rows(_requests(spark, sf)).groupBy("subject_id", "cluster", "feature_name").agg(F.count(F.lit(1)).alias("n"))


@query
def audit_copy(spark, sf):
    """Requests appended to an audit table by a job that runs twice, and counts once."""
    path, rows = scratch_path(spark, "audit"), _selected(spark, sf)
    for _ in range(2):
        files.append_audit(rows, path, "request", "run-1")
    return files.read_audit(spark, path, rows.schema).groupBy("stage", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query
def read_forms_quarantine(spark, sf):
    """Forms with damaged lines written as text and read back: what is kept, and what went to quarantine by reason."""
    path, quarantine = scratch_path(spark, "forms"), scratch_path(spark, "quarantine")
    columns = ["subject_id", "form_name", "feature_name", "feature_value", "feature_unit", "feature_delta"]
    seq = F.col("row_seq")
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns])
    damaged = (
        F.when(seq % 97 == 0, F.concat_ws("|", "subject_id", "form_name", "feature_name")).when(seq % 89 == 0, F.concat(line, F.lit("|more")))
        .when(seq % 83 == 0, F.concat(F.lit('"'), line)).when(seq % 79 == 0, F.concat(F.lit("NA|"), F.substring_index(line, "|", -5)))
        .otherwise(line)
    )
    bridge.forms(spark, sf).select(damaged.alias("line")).write.text(path)
    good = files.read_forms_checked(spark, path, quarantine, header=False)
    kept = good.groupBy("feature_name").agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("kind"), F.col("feature_name").alias("name"), "n")
    lost = files.load_table(spark, quarantine).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit("quarantine").alias("kind"), F.col("reason").alias("name"), "n")
    return kept.unionByName(lost)


@query
def save_feature_tables(spark, sf):
    """The one-hot coded feature table built as a stored product and loaded again."""
    products.feature_tables(spark, sf, STRATA, ROLE_COLUMNS)
    stored = products.feature_tables(spark, sf, STRATA, ROLE_COLUMNS)
    return rounded(stored.table("dummy").drop(*STUDY.numerics, "slope", "time_event", "status", "cluster"))


@query
def stratum_feature_table(spark, sf):
    """The rows of two strata from the stored product: only their folders are read."""
    product = products.feature_tables(spark, sf, STRATA, ROLE_COLUMNS)
    return rounded(products.stratum_rows(product, "default", (1, 3)).select("subject_id", "cluster", "price", "tax", "segment"))


@query
def read_responses(spark, sf):
    """Both response files, written with a header and read back."""
    slope, survival = scratch_path(spark, "slope"), scratch_path(spark, "survival")
    bridge.slope_response(spark, sf).write.options(sep="|", header=True, nullValue="NA").csv(slope)
    bridge.survival_response(spark, sf).write.options(sep="|", header=True, nullValue="NA").csv(survival)
    return rounded(files.read_slope(spark, slope).join(files.read_survival(spark, survival), "subject_id", "full"), 4)


@query
def read_forms_header(spark, sf):
    """Long forms written with a header line and read back."""
    path = scratch_path(spark, "forms")
    files.write_forms(bridge.forms(spark, sf), path)
    return files.read_forms(spark, path).groupBy("feature_name").agg(F.count(F.lit(1)).alias("n"), F.count("feature_value").alias("n_value"))


@query
def format_predictions(spark, sf):
    table, _, fits, designs = _slope_fits(spark, sf)
    scored = linear.predict_ols(table, fits, designs)
    scored = scored.withColumns({c: F.round(c, 2).cast("decimal(18,2)") for c in ("fit", "se")})
    return files.format_predictions(scored, ["fit", "se"])


@query
def format_probabilities(spark, sf):
    """Survival probabilities as prediction lines, written as text and read back."""
    rows, data, fits, designs, p = _cox(spark, sf, COX_PAIRS)
    scored = score.predict_survival(rows, score.survival_levels(data, fits, p), designs, p)
    scored = scored.withColumns({c: F.round(c, 3).cast("decimal(18,3)") for c in score.PROBABILITIES})
    path = scratch_path(spark, "predictions")
    files.write_predictions(files.format_predictions(scored, score.PROBABILITIES), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query
def model_registry(spark, sf):
    """Fitted models saved by stratum, loaded again and listed term by term."""
    _, _, fits, designs = _slope_fits(spark, sf)
    path = scratch_path(spark, "registry")
    files.save_table(linear.term_table(fits, designs), path, by="cluster")
    return rounded(files.load_table(spark, path).select("cluster", "term", "coef", "std_error", "n"), 4)


@query
def roundtrip_wide(spark, sf):
    path = scratch_path(spark, "wide")
    files.save_table(prepare.wide_plan(spark, sf), path)
    return rounded(files.load_table(spark, path), 5, discount=8, tax=8)


@query
def read_forms_text(spark, sf):
    """Long forms written as bar-separated text without header, read back with the schema."""
    path = scratch_path(spark, "forms")
    files.write_forms(bridge.forms(spark, sf), path, header=False)
    rows = clean.with_number(clean.with_delta(files.read_forms(spark, path, header=False)))
    return rounded(rows.groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("n"), F.count("feature_value").alias("n_value"), F.avg("value").alias("mean_value"),
        F.sum("delta").alias("sum_delta"),
    ))
