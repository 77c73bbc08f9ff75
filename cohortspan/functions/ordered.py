"""Ordered building blocks that never put a whole hot group into one task.

A window partitioned by a stratum sorts that stratum in a single task. Each helper here first
looks at how long the longest group is. Short groups use a plain window; longer ones are cut into
ranges of the order column, each range gets its own window, and the range totals (a few rows per
group) supply the offsets. Both ways give the same numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

WINDOW_LIMIT = 200_000


def _same(left: str, right: str, keys: list[str]):
    tests = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def longest_group(df: DataFrame, keys: list[str]) -> int:
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()
    return int(row[0] or 0)


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, str],
    *,
    descending: bool = False,
    exclusive: bool = False,
    longest: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Add ``sums[out] = column`` as running totals of ``column`` over ``order`` inside ``keys``.

    Rows must be unique on ``keys + [order]`` (aggregate first). ``exclusive`` leaves the current
    row out. ``longest`` is the known length of the longest group; when it is not given the input
    is written once and measured.
    """
    limit = limit or WINDOW_LIMIT
    if longest is None:
        df = materialize(df, "ordered")
        longest = longest_group(df, keys)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    last = -1 if exclusive else Window.currentRow

    def run(base: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, last)
        return base.withColumns({o: F.coalesce(F.sum(c).over(w), F.lit(0)) for o, c in sums.items()})

    if longest <= limit:
        return run(df, keys)

    pieces = -(-longest // limit) * 4
    points = [i / pieces for i in range(1, pieces)]
    marks = df.groupBy(*keys).agg(
        F.percentile_approx(order, points, max(10_000, 20 * pieces)).alias("_marks")
    )
    ranged = (
        df.alias("l").join(marks.alias("r"), _same("l", "r", keys), "inner").select("l.*", "r._marks")
        .withColumn("_piece", F.size(F.filter("_marks", lambda m: m < F.col(order))))
        .drop("_marks")
    )
    ranged = materialize(ranged, "ranged")
    totals = ranged.groupBy(*keys, "_piece").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    wp = Window.partitionBy(*keys).orderBy(direction("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_piece", *[F.coalesce(F.sum(f"_t_{o}").over(wp), F.lit(0)).alias(f"_o_{o}") for o in sums]
    )
    local = run(ranged, keys + ["_piece"])
    joined = (
        local.alias("l").join(offsets.alias("r"), _same("l", "r", keys + ["_piece"]), "inner")
        .select("l.*", *[f"r._o_{o}" for o in sums])
    )
    return joined.withColumns({o: F.col(o) + F.col(f"_o_{o}") for o in sums}).drop(
        "_piece", *[f"_o_{o}" for o in sums]
    )


def rank_cut(df: DataFrame, keys: list[str], draw: str, tie: str, quota: str, *, digits: int = 3) -> DataFrame:
    """Per key, the ``(draw, tie)`` of the row whose place is ``quota``: (keys, cut_draw, cut_tie).

    ``draw`` is a hexadecimal digest, so its leading digits cut a group into even shares. Shares are
    only counted; the one share that holds the quota boundary is the only one that is sorted.
    """
    tagged = df.withColumn("_share", F.substring(draw, 1, digits))
    counts = tagged.groupBy(*keys, "_share").agg(F.count(F.lit(1)).alias("_n"), F.max(quota).alias("_quota"))
    w = Window.partitionBy(*keys).orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        counts.withColumn("_left", F.col("_quota") - F.coalesce(F.sum("_n").over(w), F.lit(0)))
        .filter((F.col("_left") > 0) & (F.col("_left") <= F.col("_n")))
        .select(*keys, "_share", "_left")
    )
    inside = (
        tagged.alias("l").join(edge.alias("r"), _same("l", "r", keys + ["_share"]), "inner").select("l.*", "r._left")
    )
    place = Window.partitionBy(*keys, "_share").orderBy(draw, tie)
    return (
        inside.withColumn("_place", F.row_number().over(place)).filter("_place = _left")
        .select(*keys, F.col(draw).alias("cut_draw"), F.col(tie).alias("cut_tie"))
    )


def exact_median(df: DataFrame, value: str, keys: list[str] | None = None, *, limit: int | None = None) -> DataFrame:
    """Exact interpolated median per group from counts per distinct value (nulls skipped)."""
    keys = list(keys or [])
    marked = df.filter(F.col(value).isNotNull())
    part = keys or ["_all"]
    if not keys:
        marked = marked.withColumn("_all", F.lit(1))
    counts = materialize(marked.groupBy(*part, value).agg(F.count(F.lit(1)).alias("_n")), "median")
    size = counts.groupBy(*part).agg(F.sum("_n").alias("_size"), F.count(F.lit(1)).alias("_values"))
    longest = int(size.agg(F.max("_values")).first()[0] or 0)
    run = running_totals(counts, part, value, {"_upto": "_n"}, longest=longest, limit=limit)
    both = run.alias("l").join(size.alias("r"), _same("l", "r", part), "inner").select("l.*", "r._size")
    low = F.floor((F.col("_size") + 1) / 2)
    high = F.floor(F.col("_size") / 2) + 1
    holds = lambda p: (F.col("_upto") >= p) & (F.col("_upto") - F.col("_n") < p)
    return both.groupBy(*part).agg(
        ((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2.0).alias("median")
    ).drop("_all")
