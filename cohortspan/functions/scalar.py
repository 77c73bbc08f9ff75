"""Null-aware column expressions; all stay inside generated JVM code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# plain decimal or exponent numbers only: 'd'/'f' suffixes, NaN and Infinity are not measurements
NUMBER_PATTERN = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def lenient_double(value: Column | str) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def keep_measured(value: Column, mark: str = "-") -> Column:
    """Predicate that drops the missing mark and keeps nulls."""
    return value.isNull() | (value != F.lit(mark))


def prior_slope(score: Column, delta: Column, onset: Column, score_at_onset: float = 39.0) -> Column:
    """Monthly loss since onset; null when the visit falls on the onset day."""
    return F.try_divide(score - F.lit(score_at_onset), delta - onset) * F.lit(365.0) / F.lit(12.0)


def onset_age(age: Column, onset: Column, median_onset: Column | float) -> Column:
    fallback = median_onset if isinstance(median_onset, Column) else F.lit(median_onset).cast("double")
    return age + F.coalesce(onset, fallback) / F.lit(365.0)


def normalise_name(name: str) -> str:
    """Column name for a feature: runs of other characters become one underscore."""
    return re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_").lower()


def normalise_name_column(name: Column) -> Column:
    flat = F.regexp_replace(name, "[^A-Za-z0-9]+", "_")
    return F.lower(F.regexp_replace(flat, "^_+|_+$", ""))


def name_map(features) -> dict[str, str]:
    """Feature to column dictionary; refuses two features that fall on one column."""
    out = {f: normalise_name(f) for f in features}
    if len(set(out.values())) != len(out):
        raise ValueError("feature names collide after normalising")
    return out


def draw_key(seed: int, *parts: Column) -> Column:
    """Reproducible draw order: md5 of ``seed:part:part`` sorts the same way in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def rounded(df, digits: int = 6, **special: int):
    """Round every double column for output (sums differ in the last bits by partition order)."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.dataType.typeName() == "double":
            c = F.round(c, special.get(field.name, digits)).alias(field.name)
        out.append(c)
    return df.select(*out)
