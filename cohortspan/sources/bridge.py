"""Cohort views over the star-schema tables: long forms, slope and survival responses.

Subject = customer. Missing answers, unparsable text and excluded forms follow from attributes in
the data (see ``README.md``), so every view reads its whole tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Roles:
    """Which features play which part in a study."""

    numeric_mean: tuple[str, ...]
    numeric_min: tuple[str, ...]
    categorical: tuple[str, ...]
    total_score: str
    onset: str
    age: str
    right_skewed: tuple[str, ...] = ()
    left_skewed: tuple[str, ...] = ()

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric_min + self.numeric_mean + self.categorical

    @property
    def numerics(self) -> tuple[str, ...]:
        return self.numeric_min + self.numeric_mean + ("prior_slope", "onset_age")


STUDY = Roles(
    numeric_mean=("price", "discount", "tax", "onset", "age"),
    numeric_min=("quantity",),
    categorical=("returnflag", "linestatus", "segment"),
    total_score="quantity",
    onset="onset",
    age="age",
    right_skewed=("price",),
    left_skewed=("onset", "quantity"),
)


REGISTRY_FEATURES = ("view", "click", "signup", "purchase", "error")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("d0"), F.max("o_orderdate").alias("d1")
    )


def orders_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the first and last order date of their customer."""
    return table(spark, sf_dir, "orders").join(first_order(spark, sf_dir), "o_custkey")


def forms(spark: SparkSession, sf_dir: str, features: tuple[str, ...] | None = None) -> DataFrame:
    """Long entity-attribute-value rows: one scan of line items, unpivoted in place.

    With ``features`` only their cells are built, and a table none of them needs is not read.
    """
    wanted = lambda name: features is None or name in features
    static = _static_forms(spark, sf_dir, wanted)
    measured = _visit_forms(spark, sf_dir, wanted)
    if measured is None or static is None:
        return static if measured is None else measured
    return measured.unionByName(static)


def _visit_forms(spark: SparkSession, sf_dir: str, wanted) -> DataFrame | None:
    orders = orders_since(spark, sf_dir).select(
        "o_orderkey",
        F.col("o_custkey").alias("subject_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Adverse Event")
        .when(F.col("o_orderpriority") == "5-LOW", "Concomitant Medication")
        .otherwise("Clinic").alias("form_name"),
        "d0",
    )
    items = table(spark, sf_dir, "lineitem").drop("l_partkey", "l_suppkey")
    visit = items.join(orders, items.l_orderkey == orders.o_orderkey)
    base = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 10
    marked = lambda c: F.when(F.col("l_linenumber") == 4, "-").otherwise(F.col(c).cast("string"))
    tax = F.when(F.col("l_linenumber") == 4, "-").when(F.col("l_linenumber") == 3, "n/a").otherwise(
        F.col("l_tax").cast("string")
    )
    cells = [
        ("quantity", marked("l_quantity")), ("price", marked("l_extendedprice")),
        ("discount", marked("l_discount")), ("tax", tax),
        ("returnflag", marked("l_returnflag")), ("linestatus", marked("l_linestatus")),
    ]
    if not any(wanted(n) for n, _ in cells):
        return None
    return visit.select(
        "subject_id", "form_name", F.date_diff("l_shipdate", "d0").alias("feature_delta"), base.alias("_base"),
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("feature_name"), v.alias("feature_value"), F.lit(i).alias("_pos"))
            for i, (n, v) in enumerate(cells) if wanted(n)
        ])).alias("_cell"),
    ).select(
        "subject_id", "form_name", "_cell.feature_name", "_cell.feature_value",
        F.lit("u").alias("feature_unit"), "feature_delta", (F.col("_base") + F.col("_cell._pos")).alias("row_seq"),
    )


def _static_forms(spark: SparkSession, sf_dir: str, wanted) -> DataFrame | None:
    onset = F.when(F.col("c_acctbal") >= 0, (-(30 + F.floor(F.col("c_acctbal") / 5))).cast("string"))
    age = F.when(F.col("c_acctbal") < 9000, (30 + 2 * F.col("c_nationkey")).cast("string"))
    cells = [("onset", onset, "days", 2), ("age", age, "years", 3), ("segment", F.col("c_mktsegment"), "", 4)]
    if not any(wanted(n) for n, *_ in cells):
        return None
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("subject_id"),
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("feature_name"), v.alias("feature_value"), F.lit(u).alias("feature_unit"), F.lit(p).alias("_pos"))
            for n, v, u, p in cells if wanted(n)
        ])).alias("_cell"),
    ).filter(F.col("_cell.feature_value").isNotNull()).select(
        "subject_id", F.lit("Clinic").alias("form_name"), "_cell.feature_name", "_cell.feature_value",
        "_cell.feature_unit", F.lit(0).alias("feature_delta"),
        (F.col("subject_id") * 1000 - F.col("_cell._pos")).alias("row_seq"),
    )


def slope_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly slope of order value for subjects with at least seven order days.

    A slope does not depend on where days are counted from, so one aggregate of the orders is enough.
    """
    days = F.unix_date(F.to_date("o_orderdate")).cast("double")
    return (
        table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("subject_id"))
        .agg(
            (F.regr_slope("o_totalprice", days) * 365 / 12).alias("slope"),
            F.count_distinct("o_orderdate").alias("_days"),
        ).filter("_days >= 7").drop("_days")
    )


def survival_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follow-up in days and event flag; subjects whose last order is pending have no response.

    The flag of the last day is the largest of day * 2 + flag: one aggregate, no join.
    """
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    last = lambda status: F.max(day * 2 + (F.col("o_orderstatus") == status).cast("long"))
    return (
        table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("subject_id"))
        .agg((F.max(day) - F.min(day)).cast("double").alias("time_event"), F.pmod(last("F"), F.lit(2)).cast("int").alias("status"), F.pmod(last("P"), F.lit(2)).alias("_pending"))
        .filter("_pending = 0").drop("_pending")
    )


def registry_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second study: one long row per event, feature = event type."""
    events = table(spark, sf_dir, "events")
    start = events.groupBy("user_id").agg(F.min("ts").alias("t0"))
    return events.join(start, "user_id").select(
        F.col("user_id").alias("subject_id"), F.lit("Clinic").alias("form_name"),
        F.col("event_type").alias("feature_name"), F.col("value").cast("string").alias("feature_value"),
        F.lit("u").alias("feature_unit"), F.date_diff("ts", "t0").alias("feature_delta"),
        F.col("event_id").alias("row_seq"),
    )
