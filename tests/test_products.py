"""Stored products, audit runs and damaged lines; hold-out cuts against a plain sort; the neighbour tree's levels."""

import hashlib
import random

from pyspark.sql import functions as F

from cohortspan.operators import impute, resample
from cohortspan.plans import products
from cohortspan.sources import bundles, files
from tests.test_files import _path

SF = "/root/testdata/sf0.001"
RULES = ((1, (("price", "<", 0.0),)), (2, (("price", ">=", 0.0),)))


def test_product_is_built_once_and_rebuilt_for_other_settings(spark):
    root = _path()
    first = products.feature_tables(spark, SF, RULES, root=root)
    assert products.feature_tables(spark, SF, RULES, root=root).path == first.path
    other = products.feature_tables(spark, SF, RULES[:1], root=root)
    assert other.path != first.path and len(bundles.folders(spark, root)) == 2
    some = products.stratum_rows(first, "default", (2,))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cluster" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.cluster for r in some.select("cluster").distinct().collect()} == {2}
    # the key follows the input files
    files.save_table(spark.range(3), f"{root}-in/customer.parquet")
    before = products.product_key(spark, f"{root}-in", products.STUDY, RULES, None)
    spark.range(4).write.mode("append").parquet(f"{root}-in/customer.parquet")
    assert products.product_key(spark, f"{root}-in", products.STUDY, RULES, None) != before


def test_audit_counts_a_run_once(spark):
    path, rows = _path(), spark.range(5).withColumn("cluster", F.lit(1))
    assert files.read_audit(spark, path, rows.schema).count() == 0
    assert files.append_audit(rows, path, "request", "a") and not files.append_audit(rows, path, "request", "a")
    assert files.append_audit(rows.limit(2), path, "response", "a")
    # an attempt that died before its record counts for nothing and is written over
    rows.write.parquet(f"{path}/stage=request/run=b")
    count = lambda: {(r.stage, r.run): r.n for r in files.read_audit(spark, path, rows.schema).groupBy("stage", "run").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert count() == {("request", "a"): 5, ("response", "a"): 2}
    assert files.append_audit(rows.limit(3), path, "request", "b") and count()["request", "b"] == 3


def test_damaged_lines_go_to_quarantine(spark):
    head = "subject_id|form_name|feature_name|feature_value|feature_unit|feature_delta"
    lines = [head, "1|Clinic|age|40|y|0", '2|Clinic|note|"a|b"|u|1', "3|Clinic|age", "4|Clinic|age|4|y|0|more", '5|Clinic|age|"4|y|0', "|Clinic|age|4|y|0", "NA|Clinic|age|4|y|0", "  ", "6|Clinic|age|NA|y|"]
    path, bad = _path(), _path()
    spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.text(path)
    good = files.read_forms_checked(spark, path, bad)
    assert sorted((r.subject_id, r.feature_value, r.feature_delta) for r in good.collect()) == [("1", "40", "0"), ("2", "a|b", "1"), ("6", None, None)]
    found = files.load_table(spark, bad).collect()
    assert sorted((r.reason, r.line[:1]) for r in found) == [("long", "4"), ("quote", "5"), ("short", "3"), ("subject", "N"), ("subject", "|")]
    assert all(r.file.startswith("file:") for r in found)


def test_cuts_match_a_sort(spark, monkeypatch):
    ids = list(range(300))
    rows = spark.createDataFrame([(i, 1 + i % 3 if i % 10 else None) for i in ids], "subject_id long, cluster int").repartition(4)
    monkeypatch.setattr(resample, "REPS_TOGETHER", 3)
    got = {(r.cluster, r.rep): (r.cut_draw, r.cut_tie) for r in resample.holdout_cuts(rows, reps=7, seed=4).collect()}
    assert len(got) == 21
    for (cluster, rep), cut in got.items():
        own = [i for i in ids if i % 10 and 1 + i % 3 == cluster]
        draws = sorted((hashlib.md5(f"4:{rep}:{i}".encode()).hexdigest(), i) for i in own)
        assert cut == draws[round(len(own) * 0.333334) - 1]
    assert resample.holdout_cuts(rows, reps=2, seed=4, size=0).count() == 0
    plan = resample._edges(rows.dropna().withColumn("quota", F.lit(5).cast("bigint")), ["cluster"], 1, 3, 4, "subject_id")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_tree_levels_and_pruning(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1) if i % 5 else None, rnd.gauss(0, 1)) for i in range(1500)]
    df = spark.createDataFrame(rows, "subject_id long, a double, b double, c double")
    model = impute.fit(df, ["a", "b", "c"], k=3, max_block=5)
    tree = impute.reference(df, ["a", "b", "c"], model)
    sizes = {r.level: (r.n, r.boxes) for r in tree.nodes.groupBy("level").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("boxes")).collect()}
    assert tree.top >= 2 and sizes[tree.top][1] == 1 and all(n == 1500 for n, _ in sizes.values())
    assert [sizes[k][1] for k in range(tree.top + 1)] == sorted((b for _, b in sizes.values()), reverse=True)
    targets = df.filter("b IS NULL").withColumn("_reach", F.lit(0.01))
    routed = impute._routed(targets, ["a", "b", "c"], tree, 3, "_reach")
    # no block within reach is missed
    blocks = {}
    for r in tree.rows.collect():
        blocks.setdefault(r._block, []).append(r)
    met = {(r.subject_id, r._block) for r in routed.collect()}
    for i, a, b, c in [r for r in rows if r[2] is None][:40]:
        for block, members in blocks.items():
            near = min(sum((x - y) ** 2 for x, y in zip((a, b, c), (m.a, m.b, m.c)) if x is not None and y is not None)
                       / sum(x is not None and y is not None for x, y in zip((a, b, c), (m.a, m.b, m.c))) for m in members)
            assert near > 0.01 or (i, block) in met
    assert len(met) < 300 * len(blocks) / 2
