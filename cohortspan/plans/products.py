"""Feature tables as stored products: built once for given input files and settings, loaded by every later job.

The key of a product is a digest of the input files (name, length, time) and of the settings, so a product whose input has changed is never met
again; it is rebuilt under another key. A product is a bundle, so a half-written one does not count.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import strata, transform
from ..session import checkpoint_root
from ..sources.bridge import STUDY, Roles
from ..sources.bundles import Bundle, IncompleteBundle, file_marks, open_bundle, write_bundle
from . import prepare

INPUTS = ("customer", "orders", "lineitem")
FORMAT = 1


def product_key(spark: SparkSession, sf: str, roles: Roles, rule_set, columns) -> str:
    marks = [file_marks(spark, f"{sf}/{t}.parquet") for t in INPUTS]
    return hashlib.sha256(json.dumps([FORMAT, marks, asdict(roles), rule_set, columns], sort_keys=True, default=list).encode()).hexdigest()


def feature_tables(spark: SparkSession, sf: str, rule_set, columns=None, roles: Roles = STUDY, root: str | None = None) -> Bundle:
    """The stored tables ``default`` and ``dummy`` (one-hot coded), both by stratum; built if there is no complete product of the key."""
    home = f"{root or checkpoint_root(spark) + '/products'}/{product_key(spark, sf, roles, rule_set, columns)}"
    try:
        return open_bundle(spark, home)
    except IncompleteBundle:
        study = prepare.feature_table(spark, sf, roles)
        labelled = strata.classify(study.table, rule_set, columns)
        coded = transform.dummy_code(labelled, roles.categorical, study.model.level_map)
        write_bundle(
            spark, home, {"default": labelled, "dummy": coded}, {"levels": study.model.level_map}, by={"default": "cluster", "dummy": "cluster"}
        )
        return open_bundle(spark, home)


def stratum_rows(product: Bundle, part: str, clusters) -> DataFrame:
    """Rows of some strata: only their folders are read."""
    return product.table(part).filter(F.col("cluster").isin(*clusters))
