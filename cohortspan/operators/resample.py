"""Seeded repeated hold-out: exact draws without replacement, decided by digest order.

The k-th smallest digest of a (stratum, repetition) is found by counting digest prefixes; whether a
row is in the test part is then a comparison with that cut. No stratum is ever sorted as a whole,
and no row is repeated for each repetition: a row carries the prefixes of a block of repetitions as one array, tasks add
them up as counts per prefix, and only rows in the one prefix that holds a cut are looked at again.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import draw_key
from ..session import materialize, small_or_stored


#: Leading hexadecimal digits that are counted, and repetitions counted together (a stratum's counts take 8 MB).
DIGITS, REPS_TOGETHER = 3, 256
#: Counts that a task holds before it hands them on.
FLUSH_BYTES = 64 << 20


def _prefix(seed: int, rep: Column, id_column: str) -> Column:
    return F.conv(F.substring(draw_key(seed, rep, F.col(id_column)), 1, DIGITS), 16, 10).cast("int")


def _edges(base: DataFrame, keys: list[str], first: int, last: int, seed: int, id_column: str) -> DataFrame:
    """Per (key, repetition): the prefix that holds the quota's last row, and how many rows of it belong to the test part."""
    kinds, size = dict(base.dtypes), 16**DIGITS
    key_schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    shares = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda r: _prefix(seed, r, id_column))
    reps = np.arange(first, last + 1, dtype=np.int32)

    def count(batches):
        held: dict[tuple, np.ndarray] = {}

        def given():
            for key, counts in held.items():
                out = pd.DataFrame({k: [v] * len(reps) for k, v in zip([*keys, "quota"], key)})
                yield out.assign(rep=reps, counts=list(counts))
            held.clear()

        for pdf in batches:
            for key, part in pdf.groupby([*keys, "quota"], sort=False):
                cells = np.vstack(part["shares"].to_numpy()) + np.arange(len(reps)) * size
                found = np.bincount(cells.ravel(), minlength=len(reps) * size).reshape(len(reps), size).astype(float)
                held[key] = held[key] + found if key in held else found
                if len(held) * found.nbytes > FLUSH_BYTES:
                    yield from given()
        yield from given()

    counted = base.select(*keys, "quota", shares.alias("shares")).mapInPandas(count, f"{key_schema}, quota bigint, rep int, counts array<double>")
    total = counted.withColumn("v", array_to_vector("counts")).groupBy(*keys, "quota", "rep").agg(Summarizer.sum(F.col("v")).alias("v"))

    def edge(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            counts = np.vstack(pdf["counts"].to_numpy())
            upto, quota = counts.cumsum(axis=1), pdf["quota"].to_numpy(dtype=float)
            at = (upto < quota[:, None]).sum(axis=1)
            some = (quota > 0) & (at < size)
            at = np.minimum(at, size - 1)
            left = quota - (upto[np.arange(len(at)), at] - counts[np.arange(len(at)), at])
            yield pdf.loc[some, [*keys, "rep"]].assign(share=at[some].astype(np.int32), left=left[some].astype(np.int64))

    return total.select(*keys, "quota", "rep", vector_to_array("v").alias("counts")).mapInPandas(edge, f"{key_schema}, rep int, share int, left bigint")


def _cuts(base: DataFrame, keys: list[str], first: int, last: int, seed: int, id_column: str) -> DataFrame:
    edges = materialize(_edges(base, keys, first, last, seed, id_column), "edges")
    listed = edges.groupBy(*keys).agg(F.collect_list(F.struct("rep", "share", "left")).alias("_edges"))  # at most REPS_TOGETHER a key
    near = F.filter("_edges", lambda e: _prefix(seed, e["rep"], id_column) == e["share"])
    inside = base.select(*keys, id_column).join(listed, keys).select(*keys, id_column, F.explode(near).alias("e")).select(
        *keys, F.col("e.rep").alias("rep"), F.col("e.left").alias("_left"), id_column, draw_key(seed, F.col("e.rep"), F.col(id_column)).alias("draw")
    )
    place = Window.partitionBy(*keys, "rep").orderBy("draw", id_column)
    return inside.withColumn("_place", F.row_number().over(place)).filter("_place = _left").select(
        *keys, "rep", F.col("draw").alias("cut_draw"), F.col(id_column).alias("cut_tie")
    )


def holdout_cuts(rows: DataFrame, *, reps: int, seed: int, share: float | None = 0.333334, size: int | None = None,
                 keys: tuple[str, ...] = ("cluster",), id_column: str = "subject_id") -> DataFrame:
    """One row per (stratum, repetition): the last draw that still belongs to the test part."""
    keys = list(keys)
    base = rows.dropna(subset=keys)
    if size is None:
        n = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
        quota = n.withColumn("quota", F.round(F.col("_size") * F.lit(share)).cast("bigint")).drop("_size")
        base = base.join(small_or_stored(quota, "quota"), keys)
    else:
        base = base.withColumn("quota", F.lit(size).cast("bigint"))
    blocks = [(at, min(at + REPS_TOGETHER - 1, reps)) for at in range(1, reps + 1, REPS_TOGETHER)]
    return reduce(DataFrame.unionByName, [_cuts(base, keys, first, last, seed, id_column) for first, last in blocks])


def is_test(seed: int, rep: Column, id_column: str, cut_draw: Column, cut_tie: Column) -> Column:
    draw = draw_key(seed, rep, F.col(id_column))
    return (draw < cut_draw) | ((draw == cut_draw) & (F.col(id_column) <= cut_tie))


def holdout_split(rows: DataFrame, *, reps: int, seed: int, share: float | None = 0.333334, size: int | None = None,
                  keys: tuple[str, ...] = ("cluster",), id_column: str = "subject_id") -> DataFrame:
    """All (stratum, repetition, subject) with the ``is_test`` flag."""
    cuts = holdout_cuts(rows, reps=reps, seed=seed, share=share, size=size, keys=keys, id_column=id_column)
    return rows.join(small_or_stored(cuts, "cuts"), list(keys)).withColumn("is_test", is_test(seed, F.col("rep"), id_column, F.col("cut_draw"), F.col("cut_tie"))).drop(
        "cut_draw", "cut_tie"
    )


def cut_blocks(cuts: DataFrame, block: int = 64) -> DataFrame:
    """Cuts of up to ``block`` repetitions as one array per (stratum, block)."""
    return cuts.withColumn("rep_block", F.floor((F.col("rep") - 1) / block).cast("int")).groupBy("cluster", "rep_block").agg(
        F.sort_array(F.collect_list(F.struct("rep", "cut_draw", "cut_tie"))).alias("cuts")
    )


def test_flags(rows: DataFrame, cuts: DataFrame, seed: int, id_column: str = "subject_id", block: int = 64) -> DataFrame:
    """One row per (subject, block of repetitions): ``reps`` and a 0/1 array telling test membership."""
    blocks = cut_blocks(cuts, block)
    flags = F.transform("cuts", lambda c: is_test(seed, c["rep"], id_column, c["cut_draw"], c["cut_tie"]).cast("double"))
    return rows.join(blocks, "cluster").withColumn("in_test", flags).withColumn("reps", F.col("cuts.rep")).drop("cuts")


def level_counts(rows: DataFrame, cuts: DataFrame, columns, seed: int, id_column: str = "subject_id") -> DataFrame:
    """Train-part rows per (stratum, repetition, feature, level), where there are any.

    Each row carries its test membership in a block of repetitions as one 0/1 vector; vectors are summed per level, and
    train = all - test. Only sums are shuffled, and repetitions become rows after that.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("level")) for c in columns])
    flagged = test_flags(rows.select("cluster", id_column, *columns), cuts, seed, id_column)
    sums = flagged.select("cluster", "rep_block", "reps", array_to_vector("in_test").alias("v"), F.explode(cells).alias("s")).groupBy(
        "cluster", "rep_block", "reps", "s.feature", "s.level"
    ).agg(Summarizer.sum(F.col("v")).alias("v"), F.count(F.lit(1)).alias("whole"))
    each = sums.select("cluster", "feature", "level", "whole", F.explode(F.arrays_zip("reps", vector_to_array("v").alias("test"))).alias("s"))
    return each.select("cluster", F.col("s.reps").alias("rep"), "feature", "level", (F.col("whole") - F.col("s.test")).cast("bigint").alias("n")).filter("n > 0")


def missing_levels(rows: DataFrame, cuts: DataFrame, level_map: dict[str, list[str]], seed: int, id_column: str = "subject_id") -> DataFrame:
    """Levels of the closed sets that a train part does not contain."""
    counts = level_counts(rows, cuts, list(level_map), seed, id_column)
    full = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(v).alias("level")) for c, lv in level_map.items() for v in lv
    ])
    grid = cuts.select("cluster", "rep", F.explode(full).alias("s")).select("cluster", "rep", "s.*")
    return grid.join(counts, ["cluster", "rep", "feature", "level"], "left_anti")


def void_donors(rows: DataFrame, cuts: DataFrame, level_map: dict[str, list[str]], seed: int, id_column: str = "subject_id") -> DataFrame:
    """One train-part donor row per missing level: all columns, with ``feature``/``level`` to override.

    Rows meet only the repetitions that miss a level in their stratum.
    """
    missing = materialize(missing_levels(rows, cuts, level_map, seed, id_column).join(cuts, ["cluster", "rep"]), "missing")
    keep = [c for c in rows.columns if c != "cluster"]
    train = rows.select("cluster", F.col(id_column), F.struct(*keep).alias("row")).join(missing, "cluster").filter(
        ~is_test(seed, F.col("rep"), id_column, F.col("cut_draw"), F.col("cut_tie")))
    picked = train.groupBy("cluster", "rep", "feature", "level").agg(
        F.min(F.struct(
            draw_key(seed, F.col("rep"), F.col("feature"), F.col("level"), F.col(id_column)).alias("d"),
            F.col(id_column).alias("i"), F.col("row"),
        )).alias("b")
    )
    return picked.select("cluster", "rep", "feature", "level", *[F.col(f"b.row.{c}").alias(c) for c in keep])


def override(donors: DataFrame, columns) -> DataFrame:
    return donors.withColumns({
        c: F.when(F.col("feature") == c, F.col("level")).otherwise(F.col(c)) for c in columns
    })
