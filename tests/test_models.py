import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspan.functions import ordered
from cohortspan.operators import design, linear, metrics, resample, select, strata, survival, tree


def _rows(spark, n=240, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)).round(4)
    g = rng.choice(["p", "q", "r"], n, p=[0.7, 0.25, 0.05])
    y = 2 + x[:, 0] - 0.5 * x[:, 1] + (g == "q") * 1.5 + rng.normal(size=n)
    c = np.where(np.arange(n) % 4 == 0, 2, 1)
    time = np.ceil(rng.exponential(400, n) * np.exp(-0.4 * x[:, 0]))
    status = (rng.random(n) < 0.6).astype(int)
    data = [(i, int(c[i]), float(x[i, 0]), float(x[i, 1]), str(g[i]), float(y[i]), float(time[i]), int(status[i])) for i in range(n)]
    df = spark.createDataFrame(
        data, "subject_id bigint, cluster int, a double, b double, g string, slope double, time_event double, status int"
    )
    return df.cache(), data


LEVELS = {"g": ["p", "q", "r"]}


def _x(data, c, names):
    cols = {"1": [1.0] * len(data), "a": [d[2] for d in data], "b": [d[3] for d in data],
            "q": [float(d[4] == "q") for d in data], "r": [float(d[4] == "r") for d in data]}
    cols["ab"] = list(np.array(cols["a"]) * np.array(cols["b"]))
    m = np.array([cols[k] for k in names]).T
    keep = np.array([d[1] == c for d in data])
    return m[keep], np.array([d[5] for d in data])[keep]


def test_terms():
    assert design.terms(["a", "a*b"]) == [("a",), ("b",), ("a", "b")]
    assert design.parse("a:b*f") == [("a", "b"), ("f",), ("a", "b", "f")]
    assert len(design.design(design.terms(["a*g"]), LEVELS)) == 5


def test_ols_matches_lstsq_and_predicts(spark):
    df, data = _rows(spark)
    models = {1: design.terms(["a", "g", "a*b"]), 2: design.terms(["a", "b"])}
    fits, designs = linear.fit_ols(df, models, LEVELS)
    rows = {r["cluster"]: r for r in fits.collect()}
    for c, names in ((1, ["1", "a", "q", "r", "b", "ab"]), (2, ["1", "a", "b"])):
        x, y = _x(data, c, names)
        beta, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
        assert np.allclose(rows[c]["coef"][: len(beta)], beta)
        assert rows[c]["sigma2"] == pytest.approx(rss[0] / (len(y) - len(beta)))
    scored = linear.predict_ols(df, fits, designs).filter("cluster = 2").orderBy("subject_id").toPandas()
    x, y = _x(data, 2, ["1", "a", "b"])
    beta, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
    s2 = rss[0] / (len(y) - 3)
    se = np.sqrt(s2 * np.einsum("ij,jk,ik->i", x, np.linalg.inv(x.T @ x), x))
    assert np.allclose(scored["fit"], x @ beta) and np.allclose(scored["se"], se)
    assert ((scored["upper"] - scored["fit"]) > scored["se"]).all()


def test_repeated_column_is_left_out(spark):
    df, data = _rows(spark)
    df = df.withColumn("a2", F.col("a") * 2)
    fits, _ = linear.fit_ols(df, {2: design.terms(["a", "a2", "b"])}, LEVELS)
    row = fits.first()
    x, y = _x(data, 2, ["1", "a", "b"])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    assert list(row["used"]) == [True, True, False, True]
    assert np.allclose([row["coef"][i] for i in (0, 1, 3)], beta)


def test_t_quantile():
    assert linear.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert linear.t_quantile(0.975, 1) == pytest.approx(12.7062, abs=1e-3)


def test_support_rows_and_missing_levels(spark):
    df, data = _rows(spark)
    part = df.filter(~((F.col("cluster") == 2) & (F.col("g") == "r"))).select("subject_id", "cluster", "g", "slope")
    extra = linear.support_rows(part, "g", LEVELS["g"]).collect()
    assert [(r["cluster"], r["g"]) for r in extra] == [(2, "r")]


def test_train_level_counts_by_sums_equal_direct_counts(spark):
    df, data = _rows(spark)
    cuts = resample.holdout_cuts(df, reps=70, seed=4)  # more than one block of repetitions
    split = resample.holdout_split(df, reps=70, seed=4).filter("NOT is_test").groupBy("cluster", "rep", "g").count()
    want = {(r["cluster"], r["rep"], r["g"]): r["count"] for r in split.collect()}
    got = {(r["cluster"], r["rep"], r["level"]): r["n"] for r in resample.level_counts(df, cuts, ["g"], 4).collect()}
    assert got == want


@pytest.mark.parametrize("ties", [3, 64, 65, 1000, 1_000_000])
def test_tie_sums_are_exact_for_any_number_of_ties(spark, ties):
    """Sums over very many ties by the Euler-Maclaurin formula agree with adding them one by one."""
    a, b = 3.0 * ties, 2.5
    row = spark.createDataFrame([(a, b, ties)], "a double, b double, d long")
    tail, sums = survival._tie_sums(F.col("a"), F.col("b"), F.col("d"))
    got = row.withColumn("_tail", tail).select(*sums).first()
    terms = a - np.arange(ties) * b
    assert np.allclose(list(got), [np.log(terms).sum(), (1 / terms).sum(), (1 / terms**2).sum()], rtol=1e-12)


def test_cross_product_search_equals_direct_fits(spark):
    df, data = _rows(spark)
    models = {1: {"a": design.terms(["a"]), "a*b + g": design.terms(["a*b", "g"])}, 2: {"b": design.terms(["b"])}}
    got = select.cv_slope(df, models, LEVELS, reps=3, seed=9, support=("g",), block=2)
    got = {(r["cluster"], r["model_id"], r["rep"]): r["rmse"] for r in got.collect()}
    split = resample.holdout_split(df, reps=3, seed=9)
    test = {(r["cluster"], r["rep"], r["subject_id"]) for r in split.filter("is_test").collect()}
    donors = resample.override(resample.void_donors(df, resample.holdout_cuts(df, reps=3, seed=9), LEVELS, 9), ["g"]).collect()
    for (c, m, rep), value in got.items():
        names = {"a": ["1", "a"], "a*b + g": ["1", "a", "b", "ab", "q", "r"], "b": ["1", "b"]}[m]
        mine = [d for d in data if d[1] == c]
        hold = np.array([(c, rep, d[0]) in test for d in mine])
        assert hold.sum() == round(len(mine) * 0.333334)
        extra = [(r["subject_id"], c, r["a"], r["b"], r["g"], r["slope"]) for r in donors if r["cluster"] == c and r["rep"] == rep]
        x, y = _x([d for d, h in zip(mine, hold) if not h] + extra, c, names)
        tx, ty = _x([d for d, h in zip(mine, hold) if h], c, names)
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        assert value == pytest.approx(np.sqrt(((ty - tx @ beta) ** 2).mean()), rel=1e-9)


def test_pool_rows_join_the_test_part_only(spark):
    df, data = _rows(spark)
    pool, pool_data = _rows(spark, n=40, seed=11)
    got = select.cv_slope(df, {2: {"a": design.terms(["a"])}}, LEVELS, reps=2, seed=4, pool=pool, pool_size=15)
    split = resample.holdout_split(df.filter("cluster = 2"), reps=2, seed=4)
    test = {(r["rep"], r["subject_id"]) for r in split.filter("is_test").collect()}
    drawn = resample.holdout_split(pool.withColumn("cluster", F.lit(2)), reps=2, seed=5, size=15).filter("is_test")
    extra = {(r["rep"], r["subject_id"]) for r in drawn.collect()}
    for r in got.collect():
        mine = [d for d in data if d[1] == 2]
        hold = [(r["rep"], d[0]) in test for d in mine]
        x, y = _x([d for d, h in zip(mine, hold) if not h], 2, ["1", "a"])
        out = [d for d, h in zip(mine, hold) if h] + [(*d[:1], 2, *d[2:]) for d in pool_data if (r["rep"], d[0]) in extra]
        tx, ty = _x(out, 2, ["1", "a"])
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        assert len(out) == sum(hold) + 15
        assert r["rmse"] == pytest.approx(np.sqrt(((ty - tx @ beta) ** 2).mean()), rel=1e-9)


def _efron(x, t, s, beta):
    w = np.exp(x @ beta)
    g, h, ll = np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2), 0.0
    for u in np.unique(t[s == 1]):
        risk, ev = t >= u, (t == u) & (s == 1)
        d = ev.sum()
        g += x[ev].sum(0)
        ll += (x[ev] @ beta).sum()
        for k in range(d):
            wt = w * risk - k / d * w * ev
            m = (wt[:, None] * x).sum(0) / wt.sum()
            g -= m
            h += (wt[:, None, None] * x[:, :, None] * x[:, None, :]).sum(0) / wt.sum() - np.outer(m, m)
            ll -= np.log(wt.sum())
    return ll, g, h


def _newton(x, t, s):
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        _, g, h = _efron(x, t, s, beta)
        beta = beta + np.linalg.solve(h, g)
    return beta, np.linalg.inv(_efron(x, t, s, beta)[2])


@pytest.mark.parametrize("limit", [200_000, 12])
def test_cox_matches_direct_newton(spark, monkeypatch, limit):
    monkeypatch.setattr(ordered, "WINDOW_LIMIT", limit)
    df, data = _rows(spark)
    # many ties on one day, enough to use the closed form for the smooth part
    rows = survival.prepare_rows(
        df.withColumn("t", F.when(F.col("time_event") < 300, F.lit(100.0)).otherwise(F.col("time_event"))), ["cluster"],
        F.array("a", "b"), "t",
    )
    fits = {r["cluster"]: r for r in survival.fit_cox(rows, ["cluster"], 2).collect()}
    for c in (1, 2):
        mine = [d for d in data if d[1] == c]
        x = np.array([[d[2], d[3]] for d in mine])
        t = np.array([100.0 if d[6] < 300 else d[6] for d in mine])
        s = np.array([d[7] for d in mine])
        if c == 1:
            assert ((t == 100) & (s == 1)).sum() > survival.DIRECT_TIES - 20
        beta, inverse = _newton(x, t, s)
        assert fits[c]["converged"]
        assert np.allclose(fits[c]["beta"], beta, atol=1e-6)
        assert np.allclose(np.array(fits[c]["inverse"]).reshape(2, 2), inverse, rtol=1e-4)


def test_many_ties_use_the_closed_form(spark):
    a, d = 5000.0, 3000
    df = spark.createDataFrame([(a, 4000.0, d)], "r0 double, e0 double, d bigint")
    row = survival._with_ties(df).first()
    phi = a - np.arange(d) / d * 4000.0
    assert row["f0"] == pytest.approx(np.log(phi).sum(), rel=1e-12)
    assert row["f1"] == pytest.approx((1 / phi).sum(), rel=1e-12)
    assert row["f2"] == pytest.approx((1 / phi**2).sum(), rel=1e-12)


def test_all_censored_stratum_does_not_fail(spark):
    rows = spark.createDataFrame([(1, 5.0, 0, 0.3), (1, 7.0, 0, 0.1), (2, 4.0, 1, 0.2), (2, 6.0, 1, 0.9), (2, 7.0, 0, 0.5), (2, 8.0, 1, 0.1)],
                                 "cluster int, time_event double, status int, a double")
    fits = {r["cluster"]: r for r in survival.fit_cox(survival.prepare_rows(rows, ["cluster"], F.array("a")), ["cluster"], 1).collect()}
    assert not fits[1]["converged"] and fits[1]["beta"] == [0.0] and fits[2]["converged"]


def test_km_without_censoring_is_the_empirical_curve(spark):
    times = [3.0, 5.0, 5.0, 8.0]
    df = spark.createDataFrame([(1, t, 1) for t in times], "cluster int, time_event double, status int")
    got = {r["time"]: r["survival"] for r in survival.km_curve(df, ["cluster"]).collect()}
    assert got[3.0] == pytest.approx(0.75) and got[5.0] == pytest.approx(0.25) and got[8.0] == 0.0


def test_probability_is_null_past_follow_up(spark):
    df, data = _rows(spark)
    x = survival.prepare_rows(df, ["cluster"], F.array("a"))
    fits = survival.fit_cox(x, ["cluster"], 1)
    levels = survival.horizon_hazards(survival.baseline_hazard(x, fits, ["cluster"], 1), fits, [100.0, 1e6], ["cluster"])
    out = survival.survival_probability(df.withColumn("x", F.array("a")), levels, ["cluster"], 1, 2)
    assert out.filter("p1 IS NOT NULL").isEmpty() and out.filter("p0 IS NULL OR p0 <= 0 OR p0 > 1").isEmpty()


@pytest.mark.parametrize("limit", [200_000, 9])
def test_concordance_and_auc_match_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(ordered, "WINDOW_LIMIT", limit)
    df, data = _rows(spark)
    marked = df.withColumn("risk", F.round("a", 1)).withColumn("time_event", F.ceil(F.col("time_event") / 50).cast("double"))
    got = {r["cluster"]: r for r in metrics.concordance(marked, ["cluster"]).collect()}
    for c in (1, 2):
        mine = [(np.ceil(d[6] / 50), d[7], float(np.round(d[2], 1))) for d in data if d[1] == c]
        pairs = [(i, j) for i in mine for j in mine if i[1] == 1 and (i[0] < j[0] or (i[0] == j[0] and j[1] == 0))]
        value = sum(1.0 if i[2] > j[2] else 0.5 if i[2] == j[2] else 0.0 for i, j in pairs) / len(pairs)
        assert got[c]["comparable"] == len(pairs)
        assert got[c]["c_index"] == pytest.approx(value, abs=5e-3)
    whole = df.withColumn("status", F.lit(1)).withColumn("risk", F.col("a"))
    auc = {r["cluster"]: r["auc"][0] for r in metrics.auc_at(whole, ["cluster"], [200.0]).collect()}
    for c in (1, 2):
        cases = [d[2] for d in data if d[1] == c and d[6] <= 200]
        controls = [d[2] for d in data if d[1] == c and d[6] > 200]
        plain = np.mean([[1.0 if i > j else 0.5 if i == j else 0.0 for j in controls] for i in cases])
        assert auc[c] == pytest.approx(plain)


def test_integral_of_a_constant():
    points = np.arange(31) * 30.5
    values = np.full(31, 0.7)
    assert metrics.integrate(values, points, 915.0) == pytest.approx(0.7)
    values[0] = np.nan
    assert metrics.integrate(values, points, 915.0) == pytest.approx(0.7 * 30 / 31 * 31 / 30 * (915 - 30.5) / 915)


def test_tree_root_matches_brute_force_and_rules_agree(spark):
    df, data = _rows(spark)
    nodes = tree.grow(df, ["a", "b"], ["g"], minsplit=30, cp=0.01)
    y = np.array([d[5] for d in data])
    best = (-1.0, None, None)
    for name, col in (("a", 2), ("b", 3)):
        v = np.array([d[col] for d in data])
        for cut in np.unique(v)[:-1]:
            l, r = y[v <= cut], y[v > cut]
            if min(len(l), len(r)) >= 10:
                gain = ((y - y.mean()) ** 2).sum() - ((l - l.mean()) ** 2).sum() - ((r - r.mean()) ** 2).sum()
                best = max(best, (gain, name, cut))
    assert nodes[1].gain == pytest.approx(best[0]) and nodes[1].feature == best[1]
    leaves = {n.id: n.n for n in nodes.values() if n.feature is None}
    labelled = strata.classify(df, tree.rules(nodes), name="leaf")
    assert {r["leaf"]: r["count"] for r in labelled.groupBy("leaf").count().collect()} == leaves


def test_null_operand_gives_null_label(spark):
    df = spark.createDataFrame([(None, 1.0), (0.5, 1.0)], "a double, b double")
    rules = ((1, (("a", "<", 0.0),)), (2, (("a", ">=", 0.0), ("b", "<", 2.0))))
    assert [r["cluster"] for r in strata.classify(df, rules).collect()] == [None, 2]


@pytest.mark.parametrize("kind", ["anova", "survival"])
def test_a_task_grows_the_tree_that_levels_grow(spark, monkeypatch, kind):
    """Nodes below a size are grown where their rows lie; where that begins changes nothing, and it takes one job, not one a level."""
    df, _ = _rows(spark, n=260)
    df = df.withColumn("a", F.when(F.col("subject_id") % 23 != 0, F.round("a", 1))).withColumn("g", F.when(F.col("subject_id") % 19 != 0, F.col("g")))
    found = {}
    # of a survival tree's own root loss only rounding is left
    monkeypatch.setattr(tree, "node_loss", lambda *a: 50.0)
    for limit in (0, 150, 10**6):
        monkeypatch.setattr(tree, "LOCAL_ROWS", limit)
        levels = []
        nodes = tree.grow(df, ["a", "b"], ["g"], kind=kind, minsplit=30, cp=0.002, counted=levels)
        found[limit] = {k: (n.n, n.s1, n.s2, n.feature, n.threshold, n.left_levels, n.gain) for k, n in nodes.items()}
        assert bool(levels) == (limit < 260)
    assert len(found[0]) > 10
    for limit in (150, 10**6):
        assert set(found[limit]) == set(found[0])
        for k, (*numbers, feature, threshold, levels, gain) in found[0].items():
            got = found[limit][k]
            assert got[3] == feature and got[5] == levels
            assert got[:3] == pytest.approx(numbers) and (got[4], got[6]) == (pytest.approx(threshold), pytest.approx(gain))
