import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspan.operators import impute, transform

COLS = ["a", "b", "c"]


def _table(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(3)
    x[rng.random((n, 3)) < 0.2] = np.nan
    x[5] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "subject_id bigint, a double, b double, c double"), x


def _brute(x, k=10, pool=None):
    pool = x if pool is None else pool
    means = np.nanmean(pool, axis=0)
    out = x.copy()
    ok = np.isnan(pool).sum(1) <= 0.8 * 3
    for i, r in enumerate(x):
        if not np.isnan(r).any():
            continue
        if np.isnan(r).sum() > 0.8 * 3:
            out[i] = np.where(np.isnan(r), means, r)
            continue
        d = []
        for j, q in enumerate(pool):
            both = ~np.isnan(r) & ~np.isnan(q)
            if (pool is x and j == i) or not ok[j] or not both.any():
                continue
            d.append((((r - q)[both] ** 2).sum() / both.sum(), j))
        near = [j for _, j in sorted(d)[:k]]
        for c in np.flatnonzero(np.isnan(r)):
            v = pool[near, c]
            v = v[~np.isnan(v)]
            out[i, c] = v.mean() if len(v) else means[c]
    return out


def test_knn_impute_matches_brute_force(spark):
    df, x = _table(spark)
    got = impute.knn_impute(df, COLS).orderBy("subject_id").select(*COLS).toPandas().to_numpy()
    assert np.allclose(got, _brute(x))


def test_knn_against_a_pool_with_split_targets(spark, monkeypatch):
    monkeypatch.setattr(impute, "TARGETS_PER_TASK", 7)
    df, x = _table(spark, seed=2)
    pool_df, pool = _table(spark, n=80, seed=3)
    got = impute.knn_impute(df, COLS, pool=pool_df).orderBy("subject_id").select(*COLS).toPandas().to_numpy()
    assert np.allclose(got, _brute(x, pool=pool))


def test_knn_is_the_same_for_any_blocks(spark):
    df, x = _table(spark, n=300, seed=4)
    for size in (20, 90):
        got = impute.knn_impute(df, COLS, max_block=size).orderBy("subject_id").select(*COLS).toPandas().to_numpy()
        assert np.allclose(got, _brute(x))


def test_neighbours_of_many_blocks_are_the_true_ones(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(15_000, 3))
    x[:, 2] = x[:, 0] + x[:, 1] + rng.normal(scale=0.05, size=len(x))
    x[rng.random(x.shape) < 0.1] = np.nan
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(subject_id=np.arange(len(x)))
    df = spark.createDataFrame(pdf.astype({"subject_id": "int64"})).replace(float("nan"), None)
    got = impute.neighbours(df, ["a", "b", "c"], max_block=500).toPandas().groupby("subject_id").neighbour_id.apply(list)
    asked = np.flatnonzero(np.isnan(x).any(axis=1) & ~np.isnan(x).all(axis=1))[::40]
    usable = np.isnan(x).sum(axis=1) <= 0.8 * 3
    for i in asked:
        both = ~np.isnan(x) & ~np.isnan(x[i])
        with np.errstate(invalid="ignore", divide="ignore"):
            dist = np.where(both, (x - x[i]) ** 2, 0).sum(axis=1) / both.sum(axis=1)
        dist[~usable | (both.sum(axis=1) == 0)] = np.inf
        dist[i] = np.inf
        assert got[i] == np.argsort(dist, kind="stable")[:10].tolist()


def test_column_limit(spark):
    df = spark.createDataFrame([(i, 1.0, None if i else 2.0) for i in range(10)], "subject_id bigint, a double, b double")
    with pytest.raises(ValueError):
        impute.fit(df, ["a", "b"])


def test_rows_without_shared_columns_have_no_neighbours(spark):
    rows = [(i, float(i), None) for i in range(6)] + [(10 + i, None, float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "subject_id bigint, a double, b double")
    got = {r["subject_id"]: (r["a"], r["b"]) for r in impute.knn_impute(df, ["a", "b"], max_block=4).collect()}
    assert got[0] == (0.0, 1.0) and got[10] == (2.5, 0.0)  # column means


def test_knn_of_many_copies(spark):
    rows = [(i, 1.0, 1.0 if i % 3 else None) for i in range(120)] + [(200 + i, float(i), None if i % 2 else 2.0) for i in range(60)]
    df = spark.createDataFrame(rows, "subject_id bigint, a double, b double")
    got = impute.knn_impute(df, ["a", "b"], max_block=15)
    assert got.filter("b IS NULL").count() == 0 and got.filter("subject_id < 120 AND b <> 1").count() == 0


def test_joint_scaling_matches_direct_union(spark):
    rng = np.random.default_rng(7)
    train = np.exp(rng.normal(size=200)) + 3.0
    new = np.array([0.5, 4.0, 2.9, -40.0, 7.5, -3.0])
    left = rng.normal(size=200)
    new_left = rng.normal(size=len(new))
    kinds = {"r": "right", "l": "left"}
    tr = spark.createDataFrame([(float(a), float(b)) for a, b in zip(train, left)], "r double, l double")
    nw = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(new, new_left))], "i int, r double, l double")
    model = transform.fit_scale(tr, kinds)
    got = transform.apply_scale_joint(nw, model, tr).orderBy("i").toPandas()
    for i, x in enumerate(new):
        v = np.append(train, x)
        t = np.log(v + abs(v.min()) + 1)
        assert got["r"][i] == pytest.approx((t[-1] - t.mean()) / t.std(ddof=1), abs=1e-9)
        t = np.append(left, new_left[i]) ** 3
        assert got["l"][i] == pytest.approx((t[-1] - t.mean()) / t.std(ddof=1), abs=1e-9)


def test_dummy_and_unseen(spark):
    df = spark.createDataFrame([("x",), ("y",), ("z",)], "c string")
    levels = transform.levels(df, ["c"])
    coded = transform.dummy_code(df, ["c"], levels)
    assert coded.columns == ["c_y", "c_z"]
    other = spark.createDataFrame([("q",), ("y",)], "c string")
    assert [r["c"] for r in transform.unseen_to_null(other, levels).collect()] == [None, "y"]


def test_constant_column_scales_to_null(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "a double")
    out = transform.apply_scale(df, transform.fit_scale(df, {"a": "plain"}))
    assert out.filter(F.col("a").isNotNull()).isEmpty()


def test_trees_for_sets_of_gaps_find_the_true_neighbours(spark, monkeypatch):
    """Rows that lack the widest column are ordered by the widest that they have; each pair is compared in one tree."""
    monkeypatch.setattr(impute, "PAIRS", 1)
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(scale=1000, size=400), rng.integers(0, 40, 400), rng.integers(0, 3, 400)]).astype(float)
    x[rng.random(x.shape) < 0.25] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "subject_id bigint, a double, b double, c double")
    model = impute.fit(df, COLS, max_block=20)
    pool = df.filter(impute.missing_cells(COLS) <= 0.8 * 3)
    trees = impute._trees(df, pool, COLS, "subject_id", model, True)
    met = [pair for _, pairs in trees for pair in pairs]
    assert len(trees) >= 3 and len(met) == len(set(met))
    # a target without the widest column meets few blocks
    tree, pairs = next((t, p) for t, p in trees if ("010", "010") in p)
    asked = pool.filter("a IS NULL AND c IS NULL").select("subject_id", *COLS).withColumn("_reach", F.lit(1.0))
    assert impute._routed(asked, COLS, tree, 10, "_reach", pairs).count() < asked.count() * tree.rows.select("_block").distinct().count() / 3
    got = impute.knn_impute(df, COLS, max_block=20).orderBy("subject_id").select(*COLS).toPandas().to_numpy()
    assert np.allclose(got, _brute(x))


def test_a_stored_forest_serves_rows_with_any_gaps(spark, monkeypatch):
    """New rows, also with gaps that no reference row has, meet every pair in one tree and get the mean of their true neighbours."""
    rng = np.random.default_rng(23)
    x = np.column_stack([rng.normal(scale=1000, size=300), rng.normal(scale=30, size=300), rng.normal(size=300)])
    x[rng.random(300) < 0.3, 0] = np.nan
    y = np.column_stack([rng.normal(scale=1000, size=90), rng.normal(scale=30, size=90), rng.normal(size=90)])
    for i in range(90):
        y[i, [(0,), (1,), (0, 2), (1, 2), (2,), (0, 1)][i % 6]] = np.nan
    frame = lambda m, at: spark.createDataFrame([(at + i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(m)], "subject_id bigint, a double, b double, c double")
    pool, new = frame(x, 0), frame(y, 1000)
    model = impute.fit(pool, COLS, max_block=20)
    want = y.copy()
    for i, r in enumerate(y):
        d = np.nanmean(np.where(np.isnan(r) | np.isnan(x), np.nan, (x - r) ** 2), axis=1)
        near = x[np.argsort(np.where(np.isnan(d), np.inf, d), kind="stable")[:10]]
        want[i] = np.where(np.isnan(r), np.where(np.isnan(near).all(axis=0), [model.means[c] for c in COLS], np.nanmean(near, axis=0)), r)
    for pairs, trees, kinds in ((1, 2, 64), (1, 2, 4)):
        monkeypatch.setattr(impute, "PAIRS", pairs)
        monkeypatch.setattr(impute, "KINDS", 64)
        forest = impute.forest(pool, COLS, model)
        assert len(forest.trees) >= trees and (trees > 1) == (len(forest.trees) > 1)
        monkeypatch.setattr(impute, "KINDS", kinds)
        met = [p for _, some in impute._planted(forest, new, COLS) for p in some or ()]
        assert len(met) == len(set(met))
        got = impute.knn_impute(new, COLS, model=model, index=forest).orderBy("subject_id").select(*COLS).toPandas().to_numpy()
        assert np.allclose(got, want)


def test_new_rows_are_filled_once(spark, monkeypatch):
    """The search for neighbours of new rows is not run again by what reads its result."""
    pool, _ = _table(spark, n=200, seed=29)
    ready = transform.prepare_training(pool.withColumn("g", F.lit("x")), COLS, ["g"], transform.kinds_of(COLS, ("a",)))
    seen, fill = spark.sparkContext.accumulator(0), impute.knn_impute

    def counted(*a, **k):
        df = fill(*a, **k)

        def count(batches):
            for pdf in batches:
                seen.add(len(pdf))
                yield pdf

        return df.mapInPandas(count, df.schema)

    monkeypatch.setattr(impute, "knn_impute", counted)
    new = pool.limit(30).withColumn("g", F.lit("x"))
    assert transform.prepare_scoring(new, pool, ready.filled, ready.model).count() == 30 == seen.value


@pytest.mark.parametrize("octave", [0, 3, 40])
def test_power_sums_match_direct_ones(spark, octave):
    x = np.random.default_rng(octave).gamma(2.0, 50.0, 300) - 7
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "a double").repartition(5)
    row = transform._offset_moments(df, "a", float(x.min()), [octave]).first()
    c = 1.5 * 2.0**octave
    w = x - x.min() + c
    assert row["_octave"] == octave and row["_n"] == 300
    assert [row["_l"], row["_ll"]] == pytest.approx([np.log(w).sum(), (np.log(w) ** 2).sum()], rel=1e-12)
    for k in range(1, transform.SERIES + 1):
        assert [row["_p"][k - 1], row["_q"][k - 1]] == pytest.approx([((c / w) ** k).sum(), (np.log(w) * (c / w) ** k).sum()], rel=1e-11)
    assert transform._offset_moments(df.filter("a IS NULL"), "a", 0.0, [octave]).isEmpty()


def test_equal_distances_leave_a_block_k_at_a_time(spark, monkeypatch):
    rows = [(i, 1.0, 1.0 if i % 3 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "subject_id bigint, a double, b double")
    sent = []
    searched = impute._searched
    monkeypatch.setattr(impute, "_searched", lambda *a: sent.append(searched(*a)) or sent[-1])
    got = impute.neighbours(df, ["a", "b"], max_block=300).toPandas().groupby("subject_id").neighbour_id.apply(list)
    for i in range(0, 300, 3):
        assert got[i] == [j for j in range(12) if j != i][:10]
    blocks = 2  # one for each set of gaps
    assert sent[-1].count() <= 100 * 10 * blocks


def test_rows_go_down_the_tree_in_cells(spark, monkeypatch):
    """Cells, not rows, meet the boxes; every row still gets the blocks within its own reach, and no others."""
    monkeypatch.setattr(impute, "CELL", 20)
    rng = np.random.default_rng(13)
    x = rng.normal(scale=(100, 5, 1), size=(500, 3))
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "subject_id bigint, a double, b double, c double")
    model = impute.fit(df, COLS, max_block=15)
    tree = impute.reference(df, COLS, model)
    asked = df.filter((impute.missing_cells(COLS) > 0) & (impute.missing_cells(COLS) < 3)).withColumn("_reach", F.lit(2.0) + F.col("subject_id") % 7)
    cells = impute._celled(asked, COLS, "subject_id", tree, model, None).cache()
    sizes = [r["n"] for r in cells.groupBy("_cell", "_gaps").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == asked.count() and max(sizes) == 20 and len(sizes) <= asked.count() / 20 + 6
    met = {(r.subject_id, r._block) for r in impute._routed(cells, COLS, tree, 10, "_reach").collect()}
    assert met == {(r.subject_id, r._block) for r in impute._routed(asked, COLS, tree, 10, "_reach").collect()}
    near = {r.subject_id for r in impute._routed(cells, COLS, tree, 10, None).collect()}
    assert near == {r.subject_id for r in asked.collect()}


def test_distances_by_matrix_product_are_off_by_no_more_than_they_say():
    rng = np.random.default_rng(17)
    pool = rng.normal(size=(300, 4)) * (1e5, 1, 1e-3, 1) + (1e6, 0, 0, -5)
    pool[rng.random(pool.shape) < 0.3] = np.nan
    values = np.vstack([pool[~np.isnan(pool[:, 0])][:40], pool[:40]])
    values[:, 3] = np.nan
    for rows in impute._alike(values):
        if np.isnan(values[rows]).all():
            continue
        guess, slack = impute.estimates(values[rows], pool)
        exact = impute.distances(values[rows], pool, np.zeros(guess.shape, bool))
        both = ~np.isnan(values[rows][:, None, :]) & ~np.isnan(pool[None, :, :])
        with np.errstate(invalid="ignore", divide="ignore"):
            direct = np.where(both, (values[rows][:, None, :] - pool[None, :, :]) ** 2, 0).sum(axis=2) / both.sum(axis=2)
        assert np.allclose(exact[both.any(axis=2)], direct[both.any(axis=2)], rtol=1e-12, atol=0)
        assert np.isinf(exact[~both.any(axis=2)]).all() and np.isinf(guess[~both.any(axis=2)]).all()
        there = np.isfinite(exact)
        assert (np.abs(guess[there] - exact[there]) <= np.broadcast_to(slack[:, None], exact.shape)[there]).all()


def test_cells_take_the_cuts_of_their_tree_and_tasks_follow_rows(spark, monkeypatch):
    df, _ = _table(spark, n=400, seed=19)
    model = impute.fit(df, COLS, max_block=20)
    tree = impute.reference(df, COLS, model)
    assert tree.order and all(len(cuts) == impute.CUTS for cuts in tree.order.values())
    asked = df.filter((impute.missing_cells(COLS) > 0) & (impute.missing_cells(COLS) < 3))
    monkeypatch.setattr(impute.F, "percentile_approx", None)
    cells = impute._celled(asked, COLS, "subject_id", tree, model, None)
    assert cells.count() == asked.count()
    assert impute._tasks(df, 1) == 1 and impute._tasks(df, 10**9) == 4
    assert impute._routed(cells, COLS, tree, 10, None, rows=asked.count()).rdd.getNumPartitions() == 1


def test_driver_steps_run_side_by_side(spark):
    import threading

    from cohortspan.session import at_once

    meet = threading.Barrier(3, timeout=60)
    assert at_once(spark, [lambda i=i: (meet.wait(), spark.range(i + 1).count())[1] for i in range(3)]) == [1, 2, 3]


def test_order_of_many_wide_columns_stays_compiled(spark, monkeypatch):
    """The JVM does not compile methods of more than 8,000 bytes; the order of the rows is as if every cut were counted."""
    names, plans, store = [f"x{i}" for i in range(4)], [], impute.materialize
    monkeypatch.setattr(impute, "materialize", lambda df, name: plans.append(df) or store(df, name))
    rng = np.random.default_rng(23)
    x = np.round(rng.normal(size=(200, 4)), 1)
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "subject_id bigint, " + ", ".join(f"{n} double" for n in names))
    cut, cuts = impute._cut(df, names, "subject_id", impute.fit(df, names), 1, "_block", None)
    assert sorted(cuts) == [0, 1, 2, 3] and all(len(c) == 15 for c in cuts.values())

    def place(r):
        above = [sum(r[i] > m for m in cuts[i]) for i in reversed(cuts)]
        key = sum((n >> bit & 1) << (bit * 4 + at) for at, n in enumerate(above) for bit in range(4))
        first = next(iter(cuts))
        return "".join("0" if np.isnan(v) else "1" for v in r), key, (not np.isnan(r[first]), r[first] if r[first] == r[first] else 0.0)

    expected = sorted(range(200), key=lambda i: (*place(x[i]), i))
    assert [r.subject_id for r in cut.orderBy("_block").collect()] == expected
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = plans[0].select("*")._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    code = [code.apply(i) for i in range(code.size())]
    assert code and max(c._3().maxMethodCodeSize() for c in code) < 8000


def test_pairs_of_a_row_and_itself():
    ids, pool = np.array([5, 7, 5, 9, 11]), np.array([9, 5, 5, 8])
    assert (impute.itself(ids, pool) == (ids[:, None] == pool[None, :])).all()
    ids, pool = np.array([5, None, "a"], dtype=object), np.array(["a", None, 6], dtype=object)
    assert (impute.itself(ids, pool) == (ids[:, None] == pool[None, :])).all()


def test_estimates_without_gaps_and_rows_that_tie(spark):
    rng = np.random.default_rng(29)
    pool = rng.normal(size=(200, 3)) * (1e4, 1, 1e-2) + (1e6, 0, 3)
    guess, slack = impute.estimates(pool[:30], pool)
    exact = impute.distances(pool[:30], pool, np.zeros((30, 200), bool))
    assert (np.abs(guess - exact) <= slack[:, None]).all()
    # more rows at one distance than are compared exactly at first
    rows = [(i, float(i % 2), None if i % 5 == 0 else float(i)) for i in range(500)]
    got = impute.neighbours(spark.createDataFrame(rows, "subject_id bigint, a double, b double"), ["a", "b"], max_block=250)
    by_id = got.orderBy("place").toPandas().groupby("subject_id").neighbour_id.apply(list)
    for i in range(0, 500, 5):
        assert by_id[i] == [j for j in range(i % 2, 500, 2) if j != i][:10]
