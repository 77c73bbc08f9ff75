"""A trained study as a stored bundle: one job trains and saves, later ones score new subjects from the bundle and their forms alone.

Parts: levels and modes, moments and log offsets with their power sums, the rows that may be neighbours in their blocks with the trees of boxes,
stratum rules, model terms, coefficients with the inverse cross products (or information), steps of the baseline hazard, stratum means.
"""

from __future__ import annotations

from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import design, impute, transform
from ..session import from_rows
from ..sources.bridge import Roles
from ..sources.bundles import Bundle, open_bundle, write_bundle
from . import score
from .score import SlopeModels, SurvivalModels, Trained

_LEVELS = "feature string, level string, place int, is_mode boolean"
_COLUMNS = "feature string, place int, kind string, minimum double, n bigint, mean double, sd double, imputed double"
_RULES = "label int, place int, step int, feature string, op string, threshold double, levels array<string>"
_TERMS = "cluster int, place int, term string"
_BY_TREE = {"reference": "tree", "boxes": "tree"}


def _rule_rows(rule_set) -> list[tuple]:
    return [
        (label, place, step, column, op, None if op in ("in", "not in") else float(value), list(value) if op in ("in", "not in") else None)
        for place, (label, tests) in enumerate(rule_set) for step, (column, op, value) in enumerate(tests)
    ]


def _preparation_parts(spark: SparkSession, trained: Trained, rule_set, models) -> tuple[dict[str, DataFrame], dict]:
    """The tables that prepare new subjects, and what is known of the trees among them."""
    prep = trained.model
    scale, knn = prep.scale, prep.knn
    planted = impute.forest(trained.wide, prep.numerics, knn)
    each = lambda part: reduce(DataFrame.unionByName, [part(t).withColumn("tree", F.lit(i)) for i, (_, t) in enumerate(planted.trees)])
    levels = [(c, v, i, v == prep.modes[c]) for c, found in prep.level_map.items() for i, v in enumerate(found)]
    trees = [
        {"leading": list(m), "top": t.top, "kinds": list(t.kinds), "order": None if t.order is None else [[i, list(cuts)] for i, cuts in t.order.items()]}
        for m, t in planted.trees
    ]
    return {
        "levels": spark.createDataFrame(levels, _LEVELS),
        "columns": from_rows(spark, [
            (c, i, scale.kinds[c], scale.minimum[c], scale.count[c], scale.mean[c], scale.sd[c], knn.means[c]) for i, c in enumerate(prep.numerics)
        ], _COLUMNS),
        "offsets": transform.offset_sums(trained.filled, scale),
        "reference": each(lambda t: t.rows),
        "boxes": each(lambda t: t.nodes),
        "rules": from_rows(spark, _rule_rows(rule_set), _RULES),
        "terms": from_rows(spark, [(c, i, t) for c, names in models.items() for i, t in enumerate(names)], _TERMS),
    }, {"spread": list(planted.spread), "trees": trees}


def _meta(trained: Trained, roles: Roles, columns, outcome: str) -> dict:
    knn = trained.model.knn
    return {
        "outcome": outcome, "median_onset": trained.median_onset, "roles": asdict(roles), "columns": columns or {},
        "categoricals": list(trained.model.categoricals),
        "knn": {"n_rows": knn.n_rows, "usable": knn.usable, "block_rows": knn.block_rows, "k": knn.k, "row_limit": knn.row_limit},
    }


def save_slope(spark: SparkSession, root: str, trained: Trained, roles: Roles, rule_set, models, columns=None) -> str:
    """Fit the strata's least-squares models and save all that scoring needs as a new version under ``root``."""
    fitted = score.train_slope(trained, rule_set, models, columns)
    parts, forest = _preparation_parts(spark, trained, rule_set, models)
    parts |= {"fits": fitted.fits, "fallbacks": fitted.means}
    return write_bundle(spark, root, parts, _meta(trained, roles, columns, "slope") | {"forest": forest}, by=_BY_TREE)


def save_survival(spark: SparkSession, root: str, trained: Trained, roles: Roles, rule_set, models, columns=None) -> str:
    """The same for Cox models, whose baseline hazard is kept step by step, so that any horizon can be asked for."""
    fitted = score.train_survival(trained, rule_set, models, columns)
    parts, forest = _preparation_parts(spark, trained, rule_set, models)
    parts |= {"fits": fitted.fits, "hazard": fitted.hazard, "fallbacks": fitted.means}
    return write_bundle(spark, root, parts, _meta(trained, roles, columns, "survival") | {"width": fitted.width, "forest": forest}, by=_BY_TREE)


def _trained(bundle: Bundle) -> Trained:
    columns = bundle.table("columns").orderBy("place").collect()
    names = tuple(r["feature"] for r in columns)
    pick = lambda field: {r["feature"]: r[field] for r in columns}
    categoricals = tuple(bundle.meta["categoricals"])
    level_map: dict[str, list[str]] = {c: [] for c in categoricals}
    modes: dict[str, str | None] = dict.fromkeys(categoricals)
    for r in bundle.table("levels").orderBy("feature", "place").collect():  # bounded by transform.LEVEL_BYTES
        level_map[r["feature"]].append(r["level"])
        if r["is_mode"]:
            modes[r["feature"]] = r["level"]
    knn = impute.ImputeModel(names, pick("imputed"), **bundle.meta["knn"])
    scale = transform.ScaleModel(pick("kind"), pick("minimum"), pick("n"), pick("mean"), pick("sd"))
    prep = transform.Preparation(names, categoricals, knn, scale, modes, level_map)
    return Trained(None, None, None, prep, bundle.meta["median_onset"], _forest(bundle), bundle.table("offsets"))


def _forest(bundle: Bundle) -> impute.Forest | impute.Tree:
    if "forest" not in bundle.meta:  # saved with one tree
        top = bundle.table("boxes").agg(F.max("level")).first()[0]
        return impute.Tree(bundle.table("reference"), bundle.table("boxes"), top)
    said = bundle.meta["forest"]
    of = lambda part, i: bundle.table(part).filter(F.col("tree") == i).drop("tree")
    trees = [
        (tuple(t["leading"]), impute.Tree(of("reference", i), of("boxes", i), t["top"], tuple(t["kinds"]), None if t["order"] is None else {k: c for k, c in t["order"]}))
        for i, t in enumerate(said["trees"])
    ]
    return impute.Forest(tuple(trees), tuple(said["spread"]))


def _roles(bundle: Bundle) -> Roles:
    return Roles(**{k: tuple(v) if isinstance(v, list) else v for k, v in bundle.meta["roles"].items()})


def _rules(bundle: Bundle) -> tuple:
    found: dict[int, tuple[int, list]] = {}
    for r in bundle.table("rules").orderBy("place", "step").collect():
        value = tuple(r["levels"]) if r["op"] in ("in", "not in") else r["threshold"]
        found.setdefault(r["place"], (r["label"], []))[1].append((r["feature"], r["op"], value))
    return tuple((label, tuple(tests)) for label, tests in found.values())


def _models(bundle: Bundle) -> dict[int, tuple[str, ...]]:
    models: dict[int, list[str]] = {}
    for r in bundle.table("terms").orderBy("cluster", "place").collect():
        models.setdefault(r["cluster"], []).append(r["term"])
    return {c: tuple(m) for c, m in models.items()}


def _designs(bundle: Bundle, trained: Trained) -> dict:
    return {c: design.design(design.terms(m), trained.model.level_map) for c, m in _models(bundle).items()}


def score_bundle_slope(spark: SparkSession, root: str, forms: DataFrame, version: str | None = None, *, known: DataFrame | None = None) -> DataFrame:
    """Score new subjects (not ``known``) from the newest complete bundle and their forms."""
    bundle = open_bundle(spark, root, version)
    if bundle.meta["outcome"] != "slope":
        raise ValueError(f"{bundle.path} holds {bundle.meta['outcome']} models")
    trained = _trained(bundle)
    fitted = SlopeModels(bundle.table("fits"), _designs(bundle, trained), bundle.table("fallbacks"))
    return score.predict_slope(forms, trained, _roles(bundle), _rules(bundle), fitted, bundle.meta["columns"] or None, known=known)


def score_bundle_survival(spark: SparkSession, root: str, forms: DataFrame, version: str | None = None, *, known: DataFrame | None = None) -> DataFrame:
    bundle = open_bundle(spark, root, version)
    if bundle.meta["outcome"] != "survival":
        raise ValueError(f"{bundle.path} holds {bundle.meta['outcome']} models")
    trained = _trained(bundle)
    fitted = SurvivalModels(
        bundle.table("fits"), bundle.table("hazard"), _designs(bundle, trained), bundle.meta["width"], bundle.table("fallbacks")
    )
    return score.predict_probabilities(forms, trained, _roles(bundle), _rules(bundle), fitted, bundle.meta["columns"] or None, known=known)
