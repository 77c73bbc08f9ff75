"""Longitudinal collapse: many dated rows per subject and feature to one wide row.

One scan feeds one partial aggregate keyed by (subject, feature, category value). A subject that
owns a large share of all rows is reduced on the map side before any shuffle, and category counts
travel as one row per distinct value, never as a per-subject hash map. A second, much smaller
aggregate turns those rows into columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import exact_median
from ..functions.scalar import lenient_double, onset_age, prior_slope
from ..sources.bridge import Roles
from . import clean


def cells(rows: DataFrame, roles: Roles, days: int = 92, mark: str = "-") -> DataFrame:
    """Partial results per (subject, feature, text).

    ``text`` is the category of categorical rows and null for plain numbers, which reduce to sums.
    The few rows that must keep their order (total score inside the window, onset, age) also carry
    their place in the key. All results are plain numbers, so this is a hash aggregate in generated
    code. Rows that add nothing (the missing mark, days outside the window) fall together under no
    feature and only keep their subject in the result, so the universe of subjects needs no second scan.
    """
    real = clean.keep_measured(F.col("feature_value"), mark)
    is_cat = F.col("feature_name").isin(*roles.categorical)
    named = rows.select(
        "subject_id", "feature_name", "row_seq", "delta", is_cat.alias("_is_cat"), real.alias("_real"),
        ((F.col("delta") < days) & real).alias("_inside"), F.when(real, F.col("feature_value")).alias("_value"),
    )
    inside = F.col("_inside")
    latest = (F.col("feature_name") == roles.total_score) & inside
    placed = latest | (F.col("feature_name").isin(roles.onset, roles.age) & F.col("_real"))
    undated = F.col("_real") & (F.col("feature_name") == roles.total_score) & F.col("delta").isNull()
    # numbers are parsed inside the window only, nothing else is summed
    number = F.when(inside & ~F.col("_is_cat"), lenient_double("_value"))
    return (
        named.withColumn("_text", F.when((F.col("_is_cat") & inside) | placed, F.col("_value")))
        .withColumn("_seq", F.when(placed, F.col("row_seq")))
        .withColumn("_day", F.when(latest, F.col("delta")))
        .withColumn("_x", number)
        .withColumn("_undated", undated)
        .withColumn("feature_name", F.when(inside | placed | undated, F.col("feature_name")))
        .groupBy("subject_id", "feature_name", "_text", "_seq", "_day")
        .agg(
            F.sum("_x").alias("_sum"), F.count("_x").alias("_n"), F.min("_x").alias("_min"),
            F.count(F.when(inside & F.col("_is_cat") & (F.col("_value") != ""), F.lit(1))).alias("_seen"),
            F.max(F.when(F.col("_undated"), 1).otherwise(0)).alias("_nodate"),
        )
    )


def collapse(forms: DataFrame, roles: Roles, excluded, *, days: int = 92, mark: str = "-",
             median_onset: float | None = None, score_at_onset: float = 39.0) -> DataFrame:
    """Wide table: one row per subject, numerics by mean or min, categoricals by mode, derived columns."""
    rows = clean.with_delta(clean.whitelist(clean.drop_forms(forms, excluded), roles.features))
    if median_onset is None:
        median_onset = onset_median_value(forms, roles, excluded, mark)
    cut = cells(rows, roles, days, mark)
    mine = lambda f: F.col("feature_name") == f
    aggs = [F.min(F.when(mine(f), F.col("_min"))).alias(f) for f in roles.numeric_min]
    aggs += [
        F.try_divide(F.sum(F.when(mine(f), F.col("_sum"))), F.sum(F.when(mine(f), F.col("_n")))).alias(f)
        for f in roles.numeric_mean
    ]
    # most frequent value, smallest on ties
    aggs += [
        F.min(F.when(mine(f) & (F.col("_seen") > 0), F.struct((-F.col("_seen")).alias("n"), F.col("_text").alias("v"))))["v"].alias(f)
        for f in roles.categorical
    ]
    earliest = F.struct(F.col("_seq").alias("seq"), F.col("_text").alias("text"))
    aggs += [
        F.min(F.when(F.col("_day").isNotNull(), F.struct((-F.col("_day")).alias("back"), F.col("_seq").alias("seq"), F.col("_text").alias("text")))).alias("_latest"),
        F.max("_nodate").alias("_nodate"),
        F.min(F.when(mine(roles.onset) & F.col("_seq").isNotNull(), earliest))["text"].alias("_onset_text"),
        F.min(F.when(mine(roles.age) & F.col("_seq").isNotNull(), earliest))["text"].alias("_age_text"),
    ]
    wide = cut.groupBy("subject_id").agg(*aggs)
    onset, age = lenient_double("_onset_text"), lenient_double("_age_text")
    slope = F.when(
        F.col("_nodate") == 0,
        prior_slope(lenient_double(F.col("_latest.text")), -F.col("_latest.back"), onset, score_at_onset),
    )
    wide = wide.withColumn("prior_slope", slope).withColumn("onset_age", onset_age(age, onset, median_onset))
    return wide.select("subject_id", *roles.numerics, *roles.categorical)


def onset_median(forms: DataFrame, roles: Roles, excluded, mark: str = "-") -> DataFrame:
    rows = clean.measured(forms, (roles.onset,), excluded, mark)
    return exact_median(rows.select(lenient_double("feature_value").alias("value")), "value")


def onset_median_value(forms: DataFrame, roles: Roles, excluded, mark: str = "-") -> float | None:
    row = onset_median(forms, roles, excluded, mark).first()
    return None if row is None else row[0]


def collapse_numeric(forms: DataFrame, features, excluded, method: str, days: int = 92) -> DataFrame:
    """Long result of one numeric reducer: (subject, feature, value)."""
    reducers = {"mean": F.avg, "min": F.min, "max": F.max}
    rows = clean.with_number(clean.with_delta(clean.measured(forms, features, excluded)))
    return (
        clean.in_window(clean.complete_cases(rows, ["delta", "value"]), days)
        .groupBy("subject_id", "feature_name").agg(reducers[method]("value").alias("value"))
    )


def collapse_mode(forms: DataFrame, features, excluded, days: int = 92) -> DataFrame:
    """Most frequent value per (subject, feature); ties go to the smallest value."""
    rows = clean.with_delta(clean.measured(forms, features, excluded))
    counts = (
        clean.in_window(clean.complete_cases(rows, ["delta", "feature_value"]), days)
        .groupBy("subject_id", "feature_name", "feature_value").agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("feature_value").alias("v")))
    return counts.groupBy("subject_id", "feature_name").agg(best.alias("_b")).select(
        "subject_id", "feature_name", F.col("_b.v").alias("value"), (-F.col("_b.n")).alias("n")
    )


def first_value(forms: DataFrame, features, excluded) -> DataFrame:
    """First row in file order per (subject, feature); an unparsable first value gives null."""
    rows = clean.measured(forms, features, excluded)
    return rows.groupBy("subject_id", "feature_name").agg(
        F.min(F.struct("row_seq", "feature_value"))["feature_value"].alias("text")
    ).select("subject_id", "feature_name", lenient_double("text").alias("value"))


def latest_in_window(forms: DataFrame, feature: str, excluded, days: int = 92) -> DataFrame:
    """Latest dated row inside the window; the first in file order when several share the day."""
    rows = clean.in_window(clean.with_delta(clean.measured(forms, (feature,), excluded)), days)
    best = F.min(F.struct((-F.col("delta")).alias("back"), F.col("row_seq").alias("seq"), F.col("feature_value").alias("text")))
    return rows.groupBy("subject_id").agg(best.alias("_b")).select(
        "subject_id", (-F.col("_b.back")).alias("delta"), lenient_double(F.col("_b.text")).alias("value")
    )


def prior_slope_table(forms: DataFrame, roles: Roles, excluded, days: int = 92, score_at_onset: float = 39.0) -> DataFrame:
    wide = collapse(forms, roles, excluded, days=days, median_onset=0.0, score_at_onset=score_at_onset)
    return wide.select("subject_id", "prior_slope")


def onset_age_table(forms: DataFrame, roles: Roles, excluded) -> DataFrame:
    return collapse(forms, roles, excluded).select("subject_id", "onset_age")


def attach_response(wide: DataFrame, response: DataFrame) -> DataFrame:
    """Both sides hold one row per subject, so the full-outer join cannot fan out or skew."""
    return wide.join(response, "subject_id", "full_outer")
