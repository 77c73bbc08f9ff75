import pytest

import __spark_entry__ as entry_points
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = ["collapse_wide", "feature_missingness", "lenient_cast", "collapse_mode", "knn_impute", "classify_c1", "ols_fit_full"]
ROWS_ONLY = set()


def test_every_query_has_sql_but_the_iterative_ones():
    own = {q for q in entry_points.queries() if q != "pipeline" and not q.startswith("op")}
    assert own - set(entry_points.oracle_sql()) == ROWS_ONLY
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    line, ok = compare(spark, connect(SF), SF, name)
    assert ok, line


def test_result_does_not_depend_on_partitions(spark):
    seen = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = entry_points.queries()["collapse_wide"](spark, SF).collect()
        seen.append(sorted(map(repr, rows)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_entry(spark):
    assert not entry_points.entry(spark).isEmpty()
