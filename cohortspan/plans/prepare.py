"""Cleaning job: long forms to the prepared feature table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .. import fixed
from ..operators import collapse, transform
from ..session import materialize
from ..sources import bridge
from ..sources.bridge import STUDY, Roles


@dataclass(frozen=True)
class Study:
    wide: DataFrame
    table: DataFrame
    model: transform.Preparation


def onset_median(spark: SparkSession, sf: str, roles: Roles = STUDY) -> float | None:
    """Needs the onset rows only, so the visit tables are not read."""
    return collapse.onset_median_value(bridge.forms(spark, sf, (roles.onset,)), roles, fixed.INTERVAL_FORMS)


def wide_plan(spark: SparkSession, sf: str, roles: Roles = STUDY) -> DataFrame:
    median = onset_median(spark, sf, roles)
    return collapse.collapse(bridge.forms(spark, sf), roles, fixed.INTERVAL_FORMS, median_onset=median)


def wide_table(spark: SparkSession, sf: str, roles: Roles = STUDY) -> DataFrame:
    return materialize(wide_plan(spark, sf, roles), "wide")


def feature_table(spark: SparkSession, sf: str, roles: Roles = STUDY) -> Study:
    """Prepared numerics and categoricals with both responses; one row per subject."""
    kinds = transform.kinds_of(roles.numerics, roles.right_skewed, roles.left_skewed)
    base = materialize(collapse.attach_response(wide_plan(spark, sf, roles), bridge.slope_response(spark, sf)), "wide")
    ready = transform.prepare_training(base, roles.numerics, roles.categorical, kinds)
    table = materialize(collapse.attach_response(ready.table, bridge.survival_response(spark, sf)), "features")
    return Study(base.drop("slope"), table, ready.model)
