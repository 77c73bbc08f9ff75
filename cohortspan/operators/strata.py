"""Stratification by rule tables: one generated CASE projection, no row loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def condition(column: str, op: str, value) -> Column:
    c = F.col(column)
    if op == "<":
        return c < F.lit(value)
    if op == ">=":
        return c >= F.lit(value)
    if op == "in":
        return c.isin(*value)
    if op == "not in":
        return ~c.isin(*value)
    raise ValueError(f"unknown rule operator {op}")


def rule_label(rules, columns: dict[str, str] | None = None) -> Column:
    """Label of the first rule whose conditions all hold; null when an operand is null."""
    columns = columns or {}
    label = None
    for name, tests in rules:
        hit = F.lit(True)
        for column, op, value in tests:
            hit = hit & condition(columns.get(column, column), op, value)
        label = F.when(hit, F.lit(name)) if label is None else label.when(hit, F.lit(name))
    return label


def rule_columns(rules) -> list[str]:
    return sorted({c for _, tests in rules for c, _, _ in tests})


def classify(df: DataFrame, rules, columns: dict[str, str] | None = None, name: str = "cluster") -> DataFrame:
    return df.withColumn(name, rule_label(rules, columns).cast("int"))


def cluster_sizes(df: DataFrame, share: float = 0.333334) -> DataFrame:
    return df.filter(F.col("cluster").isNotNull()).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) * F.lit(share)).cast("bigint").alias("test_size")
    )
