"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star; edges are (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``label``, the smallest identifier of its component, for every end of an edge (long ``a`` and ``b``).

    Minima are pre-aggregated and a hub's edges are a skewed join, which Spark splits; every round's edges are written
    to the shared folder. Null ends and edges from a node to itself count for nothing; no edges: an empty result.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, now = state, materialize(_stars(now), "edges")
    return now.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
