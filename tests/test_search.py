"""Hold-out search over compact rows: bins of any size give one result, which is that of direct sums and pairs."""

import pickle
import random
import subprocess
import sys
from types import SimpleNamespace

import numpy as np
import pytest

from cohortspan.operators import design, risksets, select


def cohort(spark, n=160, seed=5, hot=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rnd.gauss(0, 1), rnd.gauss(0, 1)
        t = 30.0 if i < hot else float(rnd.randint(1, 40) * 25)
        rows.append((i, 1 + i % 2, t, int(rnd.random() < 0.7 if i >= hot else i % 2), a + (t < 300), b, rnd.choice("uvw"), None if i % 17 == 0 else a * b))
    return spark.createDataFrame(rows, "subject_id long, cluster int, time_event double, status int, a double, b double, g string, c double")


MODELS = {1: {"a + b": ("a", "b"), "a": ("a",), "1": (), "a + g + a*g": ("a", "g", "a*g")}, 2: {"b + c": ("b", "c"), "c": ("c",)}}
LEVELS = {"g": ["u", "v", "w"]}


def search(rows, **options):
    models = {c: {m: design.terms(t) for m, t in ms.items()} for c, ms in MODELS.items()}
    found = select.cv_survival(rows, models, LEVELS, reps=3, seed=9, **options).collect()
    return {(r.cluster, r.model_id, r.rep): [r.c_index, r.auc12, r.auc18, r.auc24, r.iauc] for r in found}


def same(a, b):
    assert set(a) == set(b)
    for k in a:
        assert [x is None for x in a[k]] == [x is None for x in b[k]], (k, a[k], b[k])
        assert [x or 0 for x in a[k]] == pytest.approx([x or 0 for x in b[k]], abs=1e-6), k


@pytest.mark.parametrize("hot", [0, 60])
def test_bins_of_any_size(spark, hot):
    rows = cohort(spark, hot=hot)
    whole = search(rows)
    assert len(whole) == 3 * 6
    same(whole, search(rows, bin_rows=11))


def test_turns_bound_the_sums(spark, monkeypatch):
    rows = cohort(spark)
    whole = search(rows)
    monkeypatch.setattr(risksets, "SUM_BYTES", 4000)
    monkeypatch.setattr(risksets, "CELL_BYTES", 800)
    same(whole, search(rows))
    units = list(risksets.turns({1: [[0], [0, 1]]}, 130, {1: [0, 2, 4]}, 10**6))
    assert [len(u.reps) for g in units for u in g] == [64, 64, 64, 64, 2, 2]
    assert sum(len(u.reps) for g in units for u in g if u.model == 1) == 130


def direct_score(x, time, status, beta):
    """Efron's log likelihood and gradient, term by term."""
    w, ll, grad = np.exp(x @ beta), 0.0, np.zeros(len(beta))
    for t in set(time[status == 1]):
        at, ev = time >= t, (time == t) & (status == 1)
        for k in range(ev.sum()):
            share = k / ev.sum()
            s0 = w[at].sum() - share * w[ev].sum()
            s1 = (w[at, None] * x[at]).sum(axis=0) - share * (w[ev, None] * x[ev]).sum(axis=0)
            ll -= np.log(s0)
            grad -= s1 / s0
        ll += (x[ev] @ beta).sum()
        grad += x[ev].sum(axis=0)
    return ll, grad


@pytest.mark.parametrize("ties", [40, 2])
def test_sums_match_direct_ones(ties):
    rng = np.random.default_rng(ties)
    n = 400
    x, time, status = rng.normal(size=(n, 2)), rng.integers(0, ties, n).astype(float), (rng.random(n) < 0.8).astype(np.int8)
    order = np.argsort(-time, kind="stable")
    rows = risksets.Rows(time[order], status[order], x[order], rng.integers(0, 4, (n, 1))[order])
    unit = risksets.Unit(1, 0, [0, 1], np.array([1, 2]), np.array([[0.3, -0.2], [0.0, 0.5]]))
    _, sums = risksets.bin_sums(rows, unit, False, None)
    for k, rep in enumerate((1, 2)):
        train = ~rows.tested(rep)
        ll, grad = direct_score(rows.x[train], rows.time[train], rows.status[train], unit.beta[k])
        assert sums[0, k] == pytest.approx(ll, rel=1e-8) and sums[1:3, k] == pytest.approx(grad, rel=1e-6, abs=1e-7)
        assert sums[-1, k] == rows.status[train].sum()
        h = 1e-5  # the information is minus the derivative of the gradient
        for i in range(2):
            step = np.eye(2)[i] * h
            slope = (direct_score(rows.x[train], rows.time[train], rows.status[train], unit.beta[k] + step)[1]
                     - direct_score(rows.x[train], rows.time[train], rows.status[train], unit.beta[k] - step)[1]) / (2 * h)
            info = {0: [sums[3, k], sums[4, k]], 1: [sums[4, k], sums[5, k]]}[i]
            assert info == pytest.approx(-slope, rel=1e-4)


def test_held_out_metrics_match_pairs():
    rng = np.random.default_rng(8)
    for n in (1, 5, 700):
        time, status, risk = rng.integers(1, 30, n) * 30.0, (rng.random(n) < 0.6).astype(np.int64), np.round(rng.normal(size=n), 1)
        grid = np.array([0.0, 300.0, 500.0])
        part = risksets.HeldOut(time, status, grid)
        longer = (status[:, None] == 1) & ((time[:, None] < time[None]) | ((time[:, None] == time[None]) & (status[None] == 0)))
        wins = (longer * (risk[:, None] > risk[None])).sum() + (longer * (risk[:, None] == risk[None])).sum() / 2
        got = part.c_index(risk[part.order])
        assert np.isnan(got) if not longer.sum() else got == pytest.approx(wins / longer.sum())
        g, before = 1.0, {}
        for t in sorted(set(time)):
            before[t] = g
            base = (time >= t).sum() - ((time == t) & (status == 1)).sum()
            g *= 1 - ((time == t) & (status == 0)).sum() / base if base else 1
        weight = np.array([s / before[t] if before[t] > 0 else 0.0 for t, s in zip(time, status)])
        for h, auc in zip(grid, part.aucs(risk[part.order])):
            case, control = time <= h, time > h
            pairs = weight[case, None] * ((risk[case, None] > risk[None, control]) + (risk[case, None] == risk[None, control]) / 2)
            total = weight[case].sum() * control.sum()
            assert np.isnan(auc) if not total else auc == pytest.approx(pairs.sum() / total)


def test_units_reach_executors_that_lack_the_package(tmp_path):
    """Passes over strata of several bins send their fits along by value."""
    class Sent(Exception):
        pass

    def broadcast(value):
        (tmp_path / "sent").write_bytes(pickle.dumps(value))
        raise Sent

    spark = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=broadcast))
    with pytest.raises(Sent):
        risksets._pass(SimpleNamespace(sparkSession=spark), [risksets.Unit(1, 0, [0], np.array([4]), np.array([[0.5]]))], {1: 1}, True)
    load = "import pickle; from pyspark import cloudpickle; x = pickle.load(open('sent', 'rb')); x = cloudpickle.loads(x) if isinstance(x, bytes) else x; print(x[0].sums)"
    done = subprocess.run([sys.executable, "-I", "-c", load], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.strip() == "3", done.stderr


@pytest.mark.parametrize("cuts", [1, 3, 64])
def test_large_strata_are_scored_without_a_row_per_subject_and_fit(spark, monkeypatch, cuts):
    """Test parts of several bins give the metrics of one bin, also where few scores are shared by many; no row-wise metrics are used."""
    models = {c: {m: design.terms(t) for m, t in {"g": ("g",), "1": (), "a + c": ("a", "c")}.items()} for c in (1, 2)}
    run = lambda **o: {(r.cluster, r.model_id, r.rep): list(r)[3:] for r in select.cv_survival(cohort(spark, hot=40), models, LEVELS, reps=2, seed=4, **o).collect()}
    whole = run()
    monkeypatch.setattr(risksets, "SCORE_CUTS", cuts)
    monkeypatch.setattr(risksets.metrics, "scorecard", None)
    monkeypatch.setattr(risksets, "SUM_BYTES", 30_000)
    same(whole, run(bin_rows=9))


def test_areas_and_pairs_match_direct_ones():
    rng = np.random.default_rng(31)
    risk, mark, n = rng.integers(0, 12, 200) / 4.0, rng.integers(0, 6, 200).astype(np.uint8), rng.integers(1, 4, 200)
    weight = rng.random(200) * (rng.random(200) < 0.5)
    wins = (risk[:, None] > risk[None]) + (risk[:, None] == risk[None]) / 2
    for h, got in enumerate(risksets.areas(risk, weight, mark, n, 5).T):
        case, control = np.where(mark <= h, weight, 0), np.where(mark > h, n, 0)
        assert got == pytest.approx([case @ wins @ control, case.sum(), control.sum()])
    events, longer = np.array([0, 5, 150]), np.array([3, 200, 160])
    want = [(wins[e, k:].sum(), 200 - k) for e, k in zip(events, longer)]
    assert risksets.pairs(risk, events, longer) == (sum(w for w, _ in want), sum(c for _, c in want))
