"""Row-level cleaning of long forms: pure projections and filters, pushed to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import keep_measured, lenient_double


def drop_forms(forms: DataFrame, excluded) -> DataFrame:
    return forms.filter(~F.col("form_name").isin(*excluded))


def only_forms(forms: DataFrame, kept) -> DataFrame:
    return forms.filter(F.col("form_name").isin(*kept))


def whitelist(forms: DataFrame, features) -> DataFrame:
    return forms.filter(F.col("feature_name").isin(*features))


def drop_mark(forms: DataFrame, mark: str = "-") -> DataFrame:
    return forms.filter(keep_measured(F.col("feature_value"), mark))


def with_number(forms: DataFrame, source: str = "feature_value", name: str = "value") -> DataFrame:
    return forms.withColumn(name, lenient_double(source))


def with_delta(forms: DataFrame) -> DataFrame:
    """Numeric day offset; text that is not a number becomes null."""
    if dict(forms.dtypes)["feature_delta"] == "string":
        return forms.withColumn("delta", lenient_double("feature_delta"))
    return forms.withColumn("delta", F.col("feature_delta").cast("double"))


def in_window(forms: DataFrame, days: int = 92) -> DataFrame:
    return forms.filter(F.col("delta") < days)


def complete_cases(df: DataFrame, columns) -> DataFrame:
    return df.dropna(subset=list(columns))


def measured(forms: DataFrame, features, excluded, mark: str = "-") -> DataFrame:
    """The shared front of every job: kept forms, whitelisted features, missing mark removed."""
    return drop_mark(whitelist(drop_forms(forms, excluded), features), mark)


def subjects(forms: DataFrame, features, excluded) -> DataFrame:
    """Subjects with at least one whitelisted row; the mark counts as a row, as in the source study."""
    return whitelist(drop_forms(forms, excluded), features).select("subject_id").distinct()


def missingness(forms: DataFrame, excluded, limit: float = 0.25, mark: str = "-") -> DataFrame:
    """Share of subjects without any measured value, per feature."""
    kept = drop_forms(forms, excluded)
    cells = kept.groupBy("subject_id", "feature_name").agg(
        F.max(F.when(F.col("feature_value").isNotNull() & (F.col("feature_value") != mark), 1).otherwise(0)).alias("_has")
    )
    size = kept.select("subject_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("feature_name").agg(F.sum("_has").alias("n_with_value")).select(
        "feature_name", "n_with_value",
        (1.0 - F.col("n_with_value") / size.scalar()).alias("missing_share"),
    ).withColumn("kept", F.when(F.col("missing_share") < limit, 1).otherwise(0))
