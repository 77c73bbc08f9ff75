import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspan.functions.ordered import exact_median, rank_cut, running_totals


def _hot(spark, n=400):
    # one group holds most rows
    rows = [("hot" if i % 10 else "cold", float((i * 37) % 1009), i % 7) for i in range(n)]
    return spark.createDataFrame(rows, "g string, t double, v int").groupBy("g", "t").agg(F.sum("v").alias("v"))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_ranges_give_the_plain_window_result(spark, descending, exclusive):
    df = _hot(spark)
    plain = running_totals(df, ["g"], "t", {"c": "v"}, descending=descending, exclusive=exclusive)
    cut = running_totals(df, ["g"], "t", {"c": "v"}, descending=descending, exclusive=exclusive, limit=20)
    pick = lambda d: sorted((r["g"], r["t"], r["c"]) for r in d.collect())
    assert pick(plain) == pick(cut)


@pytest.mark.parametrize("limit", [None, 15])
def test_exact_median(spark, limit):
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.integers(0, 200, 301)] + [("b", float(x)) for x in rng.integers(0, 90, 100)] + [("b", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["median"] for r in exact_median(df, "x", ["g"], limit=limit).collect()}
    for g in "ab":
        assert got[g] == np.median([x for k, x in rows if k == g and x is not None])


def test_rank_cut_is_the_quota_th_draw(spark):
    rows = [(k, i, hashlib.md5(f"{k}:{i}".encode()).hexdigest()) for k, n in (("a", 500), ("b", 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, id int, d string").withColumn(
        "q", F.when(F.col("k") == "a", 167).otherwise(3)
    )
    got = {r["k"]: (r["cut_draw"], r["cut_tie"]) for r in rank_cut(df, ["k"], "d", "id", "q", digits=1).collect()}
    for k, q in (("a", 167), ("b", 3)):
        assert got[k] == sorted((d, i) for kk, i, d in rows if kk == k)[q - 1]
