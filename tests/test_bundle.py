"""Stored bundles: only whole versions are read, and scoring from one equals scoring with what was trained."""

import pytest

import __spark_entry__ as entry_points
from cohortspan.operators import impute
from cohortspan.plans import bundle
from cohortspan.sources import bundles
from tests.test_files import _path

SF = "/root/testdata/sf0.001"


def _parts(spark, n):
    return {"a": spark.range(n), "b": spark.createDataFrame([(1, None, [0.5])], "k int, s string, v array<double>")}


def test_newest_complete_version_is_read(spark):
    root = _path()
    with pytest.raises(bundles.IncompleteBundle):
        bundles.open_bundle(spark, root)
    first = bundles.write_bundle(spark, root, _parts(spark, 3), {"x": 0.1, "none": None})
    got = bundles.open_bundle(spark, root)
    assert got.path == first and got.meta == {"x": 0.1, "none": None}
    assert got.table("a").count() == 3 and got.table("b").collect() == [(1, None, [0.5])]
    second = bundles.write_bundle(spark, root, _parts(spark, 4), {})
    assert bundles.open_bundle(spark, root).path == second > first
    assert bundles.open_bundle(spark, root, first.rsplit("/", 1)[1]).path == first


def test_half_written_version_is_refused(spark):
    root = _path()
    good = bundles.write_bundle(spark, root, _parts(spark, 3), {})
    # a writer that died before the manifest
    spark.range(9).write.parquet(f"{root}/v000002-dead/a")
    assert bundles.open_bundle(spark, root).path == good
    with pytest.raises(bundles.IncompleteBundle):
        bundles.open_bundle(spark, root, "v000002-dead")
    # a version whose part was written over, or lacks a part
    third = bundles.write_bundle(spark, root, _parts(spark, 5), {})
    spark.range(1, 6).write.mode("overwrite").parquet(f"{third}/a")
    assert bundles.open_bundle(spark, root).path == good
    text = bundles.read_text(spark, f"{good}/{bundles.MANIFEST}")
    bundles.write_text(spark, f"{root}/v000009-x/{bundles.MANIFEST}", text)
    assert bundles.open_bundle(spark, root).path == good


@pytest.mark.parametrize("outcome", ["slope", "survival"])
def test_scores_equal_those_of_the_training_job(spark, outcome):
    queries = entry_points.queries()
    key = lambda r: r["subject_id"]
    want = sorted(queries[f"score_batch_{outcome}"](spark, SF).collect(), key=key)
    got = sorted(queries[f"score_bundle_{outcome}"](spark, SF).collect(), key=key)
    assert got == want and want


def test_scores_of_several_trees_equal_those_of_one(spark, monkeypatch):
    """A bundle holds a tree for each set of widest columns that many pairs share; the scores do not depend on it."""
    queries, key, put, metas = entry_points.queries(), lambda r: r["subject_id"], bundle.write_bundle, []
    one = sorted(queries["score_bundle_slope"](spark, SF).collect(), key=key)
    monkeypatch.setattr(impute, "PAIRS", 1)
    monkeypatch.setattr(bundle, "write_bundle", lambda *a, **k: metas.append(a[3]) or put(*a, **k))
    assert sorted(queries["score_bundle_slope"](spark, SF).collect(), key=key) == one and one
    assert len(metas[0]["forest"]["trees"]) > 1
