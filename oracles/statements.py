"""One SQL statement per query."""

from .base import *  # noqa: F403
from .base import FORMS, FORMS2, KEPT, MEASURED, NUM, NUMERICS, CATEGORICALS, SLOPE, SURV, WIDE, number, r, with_

S: dict[str, str] = {}
DIGITS = {"discount": 8, "tax": 8}
COLS = "subject_id, form_name, feature_name, feature_value, feature_delta, row_seq"
S["filter_forms"] = with_(FORMS) + f"SELECT {COLS} FROM forms WHERE {KEPT}"
S["filter_interval_forms"] = with_(FORMS) + f"SELECT {COLS} FROM forms WHERE NOT ({KEPT})"
S["feature_whitelist"] = with_(FORMS) + """SELECT feature_name, count(*) AS n, CAST(sum(feature_delta) AS BIGINT) AS sum_delta
FROM forms WHERE feature_name IN ('quantity','price','age','segment') GROUP BY feature_name"""
S["feature_missingness"] = with_(FORMS) + f""", u AS (SELECT count(DISTINCT subject_id) AS n FROM forms WHERE {KEPT}),
m AS (SELECT feature_name, count(DISTINCT subject_id) FILTER (feature_value <> '-') AS n_with_value FROM forms WHERE {KEPT} GROUP BY 1)
SELECT feature_name, n_with_value, round(1.0 - n_with_value/CAST(n AS DOUBLE), 6) AS missing_share,
CASE WHEN 1.0 - n_with_value/CAST(n AS DOUBLE) < 0.25 THEN 1 ELSE 0 END AS kept FROM m, u"""
S["drop_sentinel"] = with_(FORMS) + """SELECT feature_name, form_name, count(*) AS n, count(feature_value) AS n_value, CAST(sum(row_seq) AS BIGINT) AS sum_seq
FROM forms WHERE feature_value IS NULL OR feature_value <> '-' GROUP BY 1, 2"""
S["lenient_cast"] = with_(FORMS) + f"""SELECT feature_name, count(*) AS n, count(x) AS n_number, round(avg(x),6) AS mean_value, round(min(x),6) AS min_value, round(max(x),6) AS max_value
FROM (SELECT feature_name, {number('feature_value')} AS x FROM forms) GROUP BY feature_name"""
S["window_cutoff"] = with_(FORMS) + "SELECT subject_id, feature_name, feature_value, CAST(feature_delta AS BIGINT) AS delta, row_seq FROM forms WHERE feature_delta < 92"
S["complete_case"] = with_(FORMS) + f"""SELECT subject_id, count(*) AS n, round(sum(x),3) AS total FROM (SELECT subject_id, {number('feature_value')} AS x FROM forms
WHERE feature_value IS NULL OR feature_value <> '-') WHERE x IS NOT NULL GROUP BY subject_id"""
S["normalise_names"] = r"""SELECT DISTINCT p_name, lower(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS column_name FROM part"""
S["subject_universe"] = with_(FORMS) + f"SELECT DISTINCT subject_id FROM forms WHERE {KEPT}"
S["collapse_wide"] = with_(WIDE) + "SELECT subject_id, " + ", ".join(r(c, DIGITS.get(c, 5)) for c in NUMERICS) + ", returnflag, linestatus, segment FROM wide"
S["collapse_mean"] = with_(MEASURED) + f"""SELECT subject_id, feature_name, round(avg(x),5) AS value FROM (SELECT subject_id, feature_name, {number('feature_value')} AS x
FROM measured WHERE feature_delta < 92 AND feature_name IN ('price','discount','tax','onset','age')) WHERE x IS NOT NULL GROUP BY 1,2"""
S["collapse_min"] = with_(MEASURED) + f"""SELECT subject_id, feature_name, round(min(x),6) AS value FROM (SELECT subject_id, feature_name, {number('feature_value')} AS x
FROM measured WHERE feature_delta < 92 AND feature_name = 'quantity') WHERE x IS NOT NULL GROUP BY 1,2"""
S["collapse_mode"] = with_(MEASURED) + """SELECT subject_id, feature_name, feature_value AS value, n FROM (SELECT subject_id, feature_name, feature_value, count(*) AS n,
row_number() OVER (PARTITION BY subject_id, feature_name ORDER BY count(*) DESC, feature_value) AS rn FROM measured
WHERE feature_delta < 92 AND feature_value IS NOT NULL AND feature_name IN ('returnflag','linestatus','segment') GROUP BY 1,2,3) WHERE rn = 1"""
S["collapse_registry"] = with_(FORMS2) + f"""SELECT subject_id, feature_name, round(avg(x),6) AS value FROM (SELECT subject_id, feature_name, {number('feature_value')} AS x
FROM forms2 WHERE feature_delta < 15) WHERE x IS NOT NULL GROUP BY 1,2"""
S["first_value"] = with_(MEASURED) + f"""SELECT subject_id, feature_name, {number('feature_value')} AS value FROM (SELECT *, row_number() OVER
(PARTITION BY subject_id, feature_name ORDER BY row_seq, feature_value) AS rn FROM measured WHERE feature_name IN ('onset','age','quantity','tax')) WHERE rn = 1"""
S["latest_in_window"] = with_(WIDE) + "SELECT subject_id, delta, score AS value FROM latest"
S["prior_slope"] = with_(WIDE) + "SELECT subject_id, round(prior_slope,6) AS prior_slope FROM wide"
S["onset_median"] = with_(WIDE) + "SELECT m AS median FROM med"
S["onset_age"] = with_(WIDE) + "SELECT subject_id, round(onset_age,6) AS onset_age FROM wide"
S["attach_slope"] = with_(WIDE, SLOPE) + "SELECT subject_id, round(price,5) AS price, segment, round(slope,5) AS slope FROM wide FULL JOIN slope_resp USING (subject_id)"
S["attach_survival"] = with_(WIDE, SURV) + "SELECT subject_id, round(price,5) AS price, segment, round(time_event,5) AS time_event, status FROM wide FULL JOIN surv_resp USING (subject_id)"

from .prepared import BASE, C1, C2, C3, C4, IMPUTED, PREPARED, SCALED, classify, gauss, knn  # noqa: E402

NEIGH = WIDE + knn("wide", "near", NUMERICS)
S["knn_neighbours"] = with_(NEIGH) + "SELECT subject_id, neighbour_id, CAST(place AS INT) AS place, round(distance,4) AS distance FROM near_near"
S["knn_impute"] = with_(NEIGH) + "SELECT subject_id, " + ", ".join(r(c if c != "price" else "price + 1e-7", DIGITS.get(c, 5), c) for c in NUMERICS) + " FROM near"
S["mode_impute"] = with_(WIDE) + "SELECT subject_id, " + ", ".join(
    f"coalesce({c}, (SELECT {c} FROM wide WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}" for c in CATEGORICALS) + " FROM wide"
S["column_stats"] = with_(WIDE) + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, round(min({c}),5) AS min_value, round(avg({c}),5) AS mean_value, round(stddev_samp({c}),5) AS sd_value FROM wide" for c in NUMERICS)
S["deskew_scale"] = with_(PREPARED) + "SELECT subject_id, " + ", ".join(r(c) for c in NUMERICS) + " FROM prepared"
LEVELS = {"returnflag": ["A", "N", "R"], "linestatus": ["F", "O"],
          "segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]}
S["dummy_code"] = with_(PREPARED) + "SELECT subject_id, " + ", ".join(
    f"CASE WHEN {c}='{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS {c}_{v.lower()}" for c, lv in LEVELS.items() for v in lv[1:]) + " FROM prepared"
S["unseen_level_to_null"] = with_(BASE) + ", tr AS (SELECT * FROM base WHERE slope IS NOT NULL AND segment <> 'BUILDING') SELECT subject_id, " + ", ".join(
    f"CASE WHEN {c} IN (SELECT {c} FROM tr) THEN {c} END AS {c}" for c in CATEGORICALS) + " FROM base WHERE slope IS NULL"
for _n, _c in (("classify_c1", C1), ("classify_c2", C2), ("classify_c3", C3), ("classify_c4", C4)):
    S[_n] = with_(PREPARED, classify("prepared", "lab", _c)) + "SELECT subject_id, cluster FROM lab"
S["cluster_sizes"] = with_(PREPARED, classify("prepared", "lab", C1)) + """SELECT cluster, count(*) AS n, CAST(round(count(*)*0.333334) AS BIGINT) AS test_size
FROM lab WHERE slope IS NOT NULL AND cluster IS NOT NULL GROUP BY cluster"""


def dummies(c):
    return [(f"{c}={v}", f"CAST({c}='{v}' AS INT)") for v in LEVELS[c][1:]]


def lm(models, src="lab", y="slope", name="fit"):
    """CTEs that fit one least-squares model per cluster: ``name`` holds the solved system."""
    p = max(len(m) for m in models.values()) + 1
    arr = " ".join(
        f"WHEN {c} THEN [1.0::DOUBLE, " + ", ".join([f"({e})::DOUBLE" for _, e in m] + ["0.0"] * (p - 1 - len(m))) + f", {y}]" for c, m in models.items())
    return p, [
        (f"{name}_x", f"SELECT *, CASE cluster {arr} END AS x FROM {src}"),
        (f"{name}_g", f"SELECT cluster, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, sum(x[i+1]*x[j+1]) AS v FROM {name}_x, range({p + 1}) a(i), range({p + 1}) b(j) WHERE x IS NOT NULL AND {y} IS NOT NULL GROUP BY 1,2,3"),
        (f"{name}_n", f"SELECT cluster, count(*) AS n FROM {name}_x WHERE x IS NOT NULL AND {y} IS NOT NULL GROUP BY 1"),
    ] + gauss(f"{name}_g", name, p, ["cluster"]) + [
        (f"{name}_s", f"SELECT n.cluster, n.n, {p} AS p, u.rank, n.n - u.rank AS df_resid, f.v/(n.n-u.rank) AS sigma2 FROM {name}_n n JOIN {name} f ON f.cluster=n.cluster AND f.i={p} AND f.j={p} "
         f"JOIN (SELECT cluster, count(*) AS rank FROM {name} WHERE i<{p} AND j=i AND v<>0 GROUP BY 1) u ON u.cluster=n.cluster"),
    ]


def names_cte(models, name="nm"):
    vals = ", ".join(f"({c}, {i}, '{t}')" for c, m in models.items() for i, (t, _) in enumerate([("(intercept)", "")] + m))
    return [(name, f"SELECT * FROM (VALUES {vals}) t(cluster, position, term)")]


LAB3 = [PREPARED, classify("prepared", "lab", C4)]
PAIR = {1: [("quantity", "quantity"), ("price", "price")], 2: [("discount", "discount"), ("onset_age", "onset_age")], 3: [("tax", "tax"), ("age", "age")]}
FULL = {1: [("quantity", "quantity"), ("price", "price"), ("quantity:price", "quantity*price")],
        2: [("discount", "discount")] + dummies("segment"),
        3: [("tax", "tax"), ("onset_age", "onset_age")] + dummies("returnflag") + [("quantity", "quantity")] + dummies("linestatus")
           + [("quantity:linestatus=O", "quantity*CAST(linestatus='O' AS INT)")]}
P2, FIT2 = lm(PAIR)
PF, FITF = lm(FULL)
S["ols_fit"] = with_(*LAB3, FIT2, names_cte(PAIR)) + f"""SELECT nm.cluster, term, round(f.v,4) AS coef, s.n FROM nm JOIN fit f ON f.cluster=nm.cluster AND f.i=nm.position AND f.j={P2} JOIN fit_s s ON s.cluster=nm.cluster"""
S["ols_fit_full"] = with_(*LAB3, FITF, names_cte(FULL)) + f"""SELECT nm.cluster, nm.position, term, round(f.v,4) AS coef, round(sqrt(s.sigma2*q.v),4) AS std_error, s.n, s.df_resid, round(s.sigma2,2) AS sigma2
FROM nm JOIN fit f ON f.cluster=nm.cluster AND f.i=nm.position AND f.j={PF} JOIN fit q ON q.cluster=nm.cluster AND q.i=nm.position AND q.j={PF}+1+nm.position JOIN fit_s s ON s.cluster=nm.cluster"""
PRED = [
    ("pred", f"""SELECT x.subject_id, x.cluster, x.slope, a.fit, sqrt(greatest(s.sigma2*b.form, 0)) AS se FROM fit_x x
     LEFT JOIN (SELECT subject_id, sum(x.x[f.i+1]*f.v) AS fit FROM fit_x x JOIN fit f ON f.cluster=x.cluster AND f.j={PF} AND f.i<{PF} WHERE x.x IS NOT NULL GROUP BY 1) a USING (subject_id)
     LEFT JOIN (SELECT subject_id, sum(x.x[f.i+1]*f.v*x.x[f.j-{PF}]) AS form FROM fit_x x JOIN fit f ON f.cluster=x.cluster AND f.j>{PF} AND f.i<{PF} WHERE x.x IS NOT NULL GROUP BY 1) b USING (subject_id)
     LEFT JOIN fit_s s ON s.cluster=x.cluster"""),
    ("means", "SELECT cluster, avg(fit) AS mean_fit FROM pred WHERE slope IS NOT NULL AND cluster IS NOT NULL GROUP BY 1"),
]
S["ols_predict"] = with_(*LAB3, FITF, PRED) + "SELECT subject_id, cluster, round(fit,4) AS fit, round(se,4) AS se FROM pred"
S["cluster_fallbacks"] = with_(*LAB3, FITF, PRED) + "SELECT cluster, round(mean_fit,4) AS mean_fit FROM means"
S["fallback_fill"] = with_(*LAB3, FITF, PRED) + """SELECT p.subject_id, p.cluster, round(CASE WHEN bad THEN mean_fit ELSE fit END,4) AS fit, round(CASE WHEN bad THEN 0 ELSE se END,4) AS se,
CAST(bad AS INT) AS replaced FROM (SELECT p.*, coalesce(p.cluster=2 AND w.discount IS NULL, false) OR p.fit IS NULL AS bad FROM pred p JOIN wide w USING (subject_id)) p LEFT JOIN means USING (cluster)"""
S["support_augment"] = with_(PREPARED, classify("prepared", "lab", C1), [
    ("part", "SELECT subject_id, cluster, segment||'-'||returnflag||'-'||linestatus AS group_name, slope FROM lab WHERE slope IS NOT NULL"),
    ("donor", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5('1:'||subject_id), subject_id) AS rn FROM part WHERE cluster IS NOT NULL) WHERE rn=1"),
]) + """SELECT d.subject_id, d.cluster, l.group_name, round(d.slope,4) AS slope FROM donor d, (SELECT DISTINCT group_name FROM part) l
WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.cluster=d.cluster AND p.group_name=l.group_name)"""

# --- resampling ---------------------------------------------------------------------------------------
REPS, SEED = 20, 20


def split_cte(src="tr", reps=REPS, seed=SEED, name="split", quota="q"):
    return [
        (f"{name}_q", f"SELECT cluster, CAST(round(count(*)*0.333334) AS BIGINT) AS q FROM {src} GROUP BY 1"),
        (name, f"""SELECT s.*, CAST(r AS INT) AS rep, row_number() OVER (PARTITION BY s.cluster, r ORDER BY md5(concat_ws(':','{seed}',r,s.subject_id)), s.subject_id) <= q.q AS is_test
          FROM {src} s JOIN {name}_q q ON q.cluster=s.cluster, range(1,{reps + 1}) t(r)"""),
    ]


def key15(c):
    return c if c in CATEGORICALS else f"round({c}, 9)"


TRAIN3 = LAB3 + [[("tr", "SELECT * FROM lab WHERE slope IS NOT NULL AND cluster IS NOT NULL")]]
S["holdout_split"] = with_(*TRAIN3, split_cte()) + "SELECT cluster, rep, subject_id, CAST(is_test AS INT) AS is_test FROM split"
S["holdout_pool"] = with_(*TRAIN3, split_cte()) + f"""SELECT cluster, rep, subject_id, 'own' AS source FROM split WHERE is_test UNION ALL
SELECT 0, CAST(r AS INT), subject_id, 'pool' FROM (SELECT subject_id, r, row_number() OVER (PARTITION BY r ORDER BY md5(concat_ws(':','{SEED + 1}',r,subject_id)), subject_id) AS rn
FROM lab, range(1,{REPS + 1}) t(r) WHERE time_event IS NULL) WHERE rn <= 25"""


def void_cte(features, split="split", seed=SEED, name="void", levels_from="tr"):
    lv = " UNION ALL ".join(f"SELECT DISTINCT '{f}' AS feature, {f} AS level FROM {levels_from}" for f in features)
    have = " UNION ALL ".join(f"SELECT DISTINCT cluster, rep, '{f}' AS feature, {f} AS level FROM {split} WHERE NOT is_test" for f in features)
    return [
        (f"{name}_lv", lv), (f"{name}_have", have),
        (f"{name}_miss", f"SELECT g.cluster, g.rep, l.feature, l.level FROM (SELECT DISTINCT cluster, rep FROM {split}) g, {name}_lv l WHERE NOT EXISTS (SELECT 1 FROM {name}_have h WHERE h.cluster=g.cluster AND h.rep=g.rep AND h.feature=l.feature AND h.level=l.level)"),
        (name, f"""SELECT * FROM (SELECT m.feature, m.level, s.*, row_number() OVER (PARTITION BY m.cluster, m.rep, m.feature, m.level ORDER BY md5(concat_ws(':','{seed}',s.rep,m.feature,m.level,s.subject_id)), s.subject_id) AS rn
          FROM {name}_miss m JOIN {split} s ON s.cluster=m.cluster AND s.rep=m.rep AND NOT s.is_test) WHERE rn = 1"""),
    ]


COMBO = [PREPARED, classify("prepared", "lab", C1), [("tr", "SELECT subject_id, cluster, segment||'-'||returnflag||'-'||linestatus AS combo, linestatus, slope FROM lab WHERE slope IS NOT NULL AND cluster IS NOT NULL")]]
S["missing_levels"] = with_(*COMBO, split_cte(), void_cte(["linestatus", "combo"])) + "SELECT cluster, rep, feature, level FROM void_miss"
S["void_levels"] = with_(*COMBO, split_cte(), void_cte(["linestatus", "combo"])) + "SELECT cluster, rep, feature, level, subject_id, CASE WHEN feature='combo' THEN level ELSE combo END AS combo, round(slope,4) AS slope FROM void"
S["abundance_rate"] = with_(*TRAIN3) + "SELECT cluster, feature, round(max(n)/CAST(sum(n) AS DOUBLE),6) AS abundance FROM (" + " UNION ALL ".join(
    f"SELECT cluster, '{c}' AS feature, CAST({key15(c)} AS VARCHAR) AS v, count(*) AS n FROM tr WHERE {c} IS NOT NULL GROUP BY ALL" for c in NUMERICS + CATEGORICALS) + ") GROUP BY 1, 2"
S["rmse"] = with_(*LAB3, FITF, PRED) + "SELECT cluster, round(sqrt(avg((slope-fit)*(slope-fit))),3) AS rmse, count(slope-fit) AS n FROM pred WHERE slope IS NOT NULL GROUP BY 1"

START = {1: ["quantity", "price"], 2: ["discount", "onset"], 3: ["tax", "onset_age", "tax*onset_age"]}


def columns_of(term):
    """Design columns of one candidate term as (name, SQL)."""
    out = [("", "1")]
    for f in term:
        opts = [(f"{f}={v}", f"CAST({f}='{v}' AS INT)") for v in LEVELS[f][1:]] if f in LEVELS else [(f, f)]
        out = [(a + ":" + n, f"{e}*{x}") for a, e in out for n, x in opts]
    return [e for _, e in out]


def expand(names):
    """Design expressions of a model written with a*b terms (two or three factors)."""
    seen, out = set(), []
    for n in names:
        parts = n.split("*")
        for mask in sorted(range(1, 2 ** len(parts)), key=lambda m: bin(m).count("1")):
            t = frozenset(p for i, p in enumerate(parts) if mask >> i & 1)
            if t not in seen:
                seen.add(t)
                out.append(sorted(t, key=[q for m in names for q in m.split("*")].index))
    out.sort(key=len)
    return [e for t in out for e in columns_of(t)]


def additions(base):
    inside = {p for b in base for p in b.split("*")}
    for f in NUMERICS + CATEGORICALS:
        if f in inside:
            continue
        yield f, " + ".join(base + [f]), base + [f], False
        for b in base:
            yield f, " + ".join(base + [f, f"{b}*{f}"]), base + [f, f"{b}*{f}"], True


def cv_sql(candidates, tail):
    """Fit every (model, rep) on its train part and score its test part."""
    width = max(len(expand(n)) for _, _, _, n, _ in candidates) + 1
    rows = []
    for c, f, mid, names, gated in candidates:
        e = ["1.0::DOUBLE"] + [f"({x})::DOUBLE" for x in expand(names)]
        e += ["0.0"] * (width - len(e))
        gate = f" AND (SELECT abundance FROM ab WHERE cluster={c} AND feature='{f}') < 0.77" if gated else ""
        rows.append(f"SELECT {c} AS cluster, '{mid}' AS model_id, rep, is_test, [{', '.join(e)}, slope] AS x FROM allrows WHERE cluster={c}{gate}")
    gated_src = [("ab", "SELECT cluster, feature, max(n)/CAST(sum(n) AS DOUBLE) AS abundance FROM (" + " UNION ALL ".join(
        f"SELECT cluster, '{c}' AS feature, CAST({key15(c)} AS VARCHAR) AS v, count(*) AS n FROM tr WHERE {c} IS NOT NULL GROUP BY ALL" for c in NUMERICS + CATEGORICALS) + ") GROUP BY 1, 2")]
    cols = "subject_id, cluster, rep, is_test, slope, " + ", ".join(NUMERICS)
    allrows = [("allrows", f"SELECT {cols}, returnflag, linestatus, segment FROM split UNION ALL SELECT {cols}, "
                + ", ".join(f"CASE WHEN feature='{c}' THEN level ELSE {c} END" for c in CATEGORICALS) + " FROM void")]
    return with_(*TRAIN3, split_cte(), void_cte(CATEGORICALS), gated_src, allrows, [
        ("mr", " UNION ALL ".join(rows)),
        ("mm", f"SELECT cluster, model_id, list(CASE WHEN i=0 THEN 0 ELSE m END ORDER BY i) AS m, list(CASE WHEN i=0 OR i={width} OR s<1e-12 THEN 1 ELSE s END ORDER BY i) AS s FROM (SELECT cluster, model_id, CAST(i AS BIGINT) AS i, avg(x[i+1]) AS m, stddev_pop(x[i+1]) AS s FROM mr, range({width + 1}) a(i) GROUP BY ALL) GROUP BY ALL"),
        ("mx", "SELECT r.cluster, r.model_id, r.rep, r.is_test, list_transform(list_zip(r.x, mm.m, mm.s), lambda z: (z[1]-z[2])/z[3]) AS x FROM mr r JOIN mm USING (cluster, model_id)"),
        ("mg", f"SELECT cluster, model_id, rep, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, sum(x[i+1]*x[j+1]) AS v FROM mx, range({width + 1}) a(i), range({width + 1}) b(j) WHERE NOT is_test GROUP BY ALL"),
    ], gauss("mg", "ms", width, ["cluster", "model_id", "rep"]), [
        ("beta", f"SELECT cluster, model_id, rep, list(v ORDER BY i) AS b FROM ms WHERE j={width} AND i<{width} GROUP BY ALL"),
        ("cv", f"SELECT cluster, model_id, rep, sqrt(avg(e*e)) AS rmse FROM (SELECT m.cluster, m.model_id, m.rep, m.x[{width + 1}] - list_dot_product(m.x[1:{width}], b.b) AS e FROM mx m JOIN beta b USING (cluster, model_id, rep) WHERE m.is_test) GROUP BY ALL"),
        ("summ", "SELECT cluster, model_id, count(*) AS n_reps, avg(rmse) AS mean_rmse, CAST(0 AS BIGINT) AS failed_rmse FROM cv GROUP BY ALL"),
    ]) + tail


ADD = [(c, f, mid, names, gated) for c in START for f, mid, names, gated in additions(START[c])]
DROP = [(c, "", " + ".join(k), k, False) for c, base in START.items() for d in base for k in [[b for b in base if b != d]]]
S["interaction_candidates"] = with_(*TRAIN3, [("ab", "SELECT cluster, feature, max(n)/CAST(sum(n) AS DOUBLE) AS abundance FROM (" + " UNION ALL ".join(
    f"SELECT cluster, '{c}' AS feature, CAST({key15(c)} AS VARCHAR) AS v, count(*) AS n FROM tr WHERE {c} IS NOT NULL GROUP BY ALL" for c in NUMERICS + CATEGORICALS) + ") GROUP BY 1, 2")]) + (
    "SELECT c.cluster, c.model_id, c.n_terms FROM (VALUES " + ", ".join(
        f"({c}, '{f}', '{mid}', {len({frozenset(p for i, p in enumerate(n.split('*')) if m >> i & 1) for n in names for m in range(1, 2 ** len(n.split('*')))})}, {str(g).lower()})" for c, f, mid, names, g in ADD)
    + ") c(cluster, feature, model_id, n_terms, gated) JOIN ab USING (cluster, feature) WHERE NOT c.gated OR ab.abundance < 0.77")
S["forward_step_slope"] = cv_sql(ADD, "SELECT cluster, model_id, rep, round(rmse,3) AS rmse FROM cv")
S["backward_step_slope"] = cv_sql(DROP, "SELECT cluster, model_id, rep, round(rmse,3) AS rmse FROM cv")
S["cv_summary"] = cv_sql(ADD, "SELECT cluster, model_id, n_reps, round(mean_rmse,3) AS mean_rmse, failed_rmse FROM summ")
S["best_model"] = cv_sql(ADD, "SELECT cluster, model_id, round(mean_rmse,3) AS mean_rmse FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY mean_rmse, model_id) AS place FROM summ) WHERE place=1")
S["top_models"] = cv_sql(ADD, "SELECT cluster, place, model_id, round(mean_rmse,3) AS mean_rmse FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY mean_rmse, model_id) AS INT) AS place FROM summ) WHERE place<=20")

# --- trees -----------------------------------------------------------------------------------------------
from .survival import card, grown, hazard, km, linear, newton, newton_halving, node_rows, score, splits  # noqa: E402

ROOT = [("rt", "SELECT *, CAST(1 AS BIGINT) AS node, slope AS a, slope*slope AS b FROM prepared WHERE slope IS NOT NULL")]
SROOT = [
    ("na_t", "SELECT time_event, sum(status) AS d, count(*) AS n FROM prepared WHERE time_event IS NOT NULL GROUP BY 1"),
    ("na_r", "SELECT *, sum(n) OVER (ORDER BY time_event DESC) AS r FROM na_t"),
    ("na", "SELECT time_event, sum(d/r) OVER (ORDER BY time_event) AS h FROM na_r"),
    ("rt", "SELECT p.*, CAST(1 AS BIGINT) AS node, CAST(status AS DOUBLE) AS a, h AS b FROM prepared p JOIN na USING (time_event)"),
]
S["tree_best_split"] = with_(PREPARED, ROOT, splits("rt", "bs", 20, "anova", "node, feature")) + "SELECT feature, round(gain,0) AS gain, CAST(ln_ AS BIGINT) AS n_left, round(threshold,4) AS threshold FROM bs"
S["surv_tree_best_split"] = with_(PREPARED, SROOT, splits("rt", "bs", 20, "exp", "node, feature")) + "SELECT feature, round(gain,4) AS gain, CAST(ln_ AS BIGINT) AS n_left, round(threshold,4) AS threshold FROM bs"
S["tree_fit"] = with_(PREPARED, ROOT, grown("anova", 250, 0.005)) + node_rows(4, 0)
S["tree_fit_registry"] = with_(PREPARED, ROOT, grown("anova", 25, 0.005)) + node_rows(4, 0)
S["surv_tree_fit"] = with_(PREPARED, SROOT, grown("exp", 400, 0.005)) + node_rows(3, 3)
S["tree_to_rules"] = with_(PREPARED, ROOT, grown("anova", 250, 0.005)) + "SELECT CAST(node AS INT) AS leaf, count(*) AS n, round(avg(a),3) AS mean_slope FROM leaves GROUP BY 1"

# --- survival ----------------------------------------------------------------------------------------------
XS = {1: ("price", "onset_age"), 2: ("discount", "prior_slope"), 3: ("tax", "quantity")}


def xcase(i, models, extra="cluster"):
    return "CASE cluster " + " ".join(f"WHEN {c} THEN ({m[i] if i < len(m) else '0.0'})::DOUBLE" for c, m in models.items()) + " END"


def cox_rows(models, src="lab", name="cx"):
    return [(name, f"SELECT subject_id, cluster, time_event AS time, status, {xcase(0, models)} AS x1, {xcase(1, models)} AS x2, {xcase(2, models)} AS x3 FROM {src} WHERE time_event IS NOT NULL AND cluster IS NOT NULL")]


CX = [*LAB3, cox_rows(XS)]
COX = [*CX, newton("cx", "nb", ["cluster"])]
S["km_curve"] = with_(*CX, km("cx", "k", ["cluster"])) + "SELECT cluster, time, events, at_risk, round(survival,6) AS survival FROM k"
S["cox_risk_sets"] = with_(*CX, [("b0", "SELECT DISTINCT cluster, 0.2 AS b1, -0.1 AS b2, 0.0 AS b3 FROM cx")], score("cx", "b0", "z", ["cluster"])) + \
    "SELECT cluster, time, CAST(d AS BIGINT) AS events, round(r0,6) AS sum_risk, round(r1,6) AS sum_x1 FROM z_r WHERE d>0"
S["cox_score_at_zero"] = with_(*CX, [("b0", "SELECT DISTINCT cluster, 0.0 AS b1, 0.0 AS b2, 0.0 AS b3 FROM cx")], score("cx", "b0", "z", ["cluster"])) + \
    "SELECT cluster, round(loglik,5) AS loglik, round(u1,5) AS u1, round(u2,5) AS u2, round(i1_1,5) AS i11, round(i1_2,5) AS i12, round(i2_2,5) AS i22 FROM z"
_terms = " UNION ALL ".join(
    f"SELECT {c} AS cluster, '{m[i]}' AS term, b{i + 1} AS coef, sqrt({'i2_2' if i == 0 else 'i1_1'}/(i1_1*i2_2-i1_2*i1_2)) AS se FROM nb JOIN nb_s9 USING (cluster) WHERE cluster={c}" for c, m in XS.items() for i in (0, 1))
S["cox_fit"] = with_(*COX) + f"SELECT t.cluster, t.term, round(t.coef,4) AS coef, round(t.se,4) AS std_error, CAST(e.n AS BIGINT) AS events, 1 AS converged FROM ({_terms}) t JOIN (SELECT cluster, sum(status) AS n FROM cx GROUP BY 1) e USING (cluster)"
COX_FULL = {1: ["price", "onset_age", "quantity", "price*quantity"], 2: ["discount", "prior_slope", "segment"], 3: ["tax", "quantity"]}
_wide = {c: expand(m) for c, m in COX_FULL.items()}
_labels = {c: [t if t not in LEVELS else f"{t}={v}" for n in m for t in [n.replace("*", ":")] for v in (LEVELS[t][1:] if t in LEVELS else [""])] for c, m in COX_FULL.items()}
_tri = [(i, j) for i in range(1, 7) for j in range(1, 7)]
S["cox_fit_full"] = with_(*LAB3, [
    ("cx", "SELECT cluster, time_event AS time, status, " + ", ".join(f"{xcase(i, _wide)} AS x{i + 1}" for i in range(6)) + " FROM lab WHERE time_event IS NOT NULL AND cluster IS NOT NULL"),
], newton("cx", "nb", ["cluster"], p=6), [
    ("info", " UNION ALL ".join(f"SELECT cluster, {i - 1} AS i, {j - 1} AS j, i{min(i, j)}_{max(i, j)} AS v FROM nb_s9" for i, j in _tri) + " UNION ALL " + " UNION ALL ".join(f"SELECT cluster, {i - 1}, 6, u{i} FROM nb_s9" for i in range(1, 7))),
], gauss("info", "iv", 6, ["cluster"])) + "SELECT t.cluster, term, round(coef, 4) AS coef, round(sqrt(iv.v), 4) AS std_error, CAST(e.n AS BIGINT) AS events, 1 AS converged FROM (" + " UNION ALL ".join(
    f"SELECT {c} AS cluster, {i} AS place, '{t}' AS term, b{i + 1} AS coef FROM nb WHERE cluster={c}" for c, ts in _labels.items() for i, t in enumerate(ts)
) + ") t JOIN iv ON iv.cluster=t.cluster AND iv.i=place AND iv.j=7+place JOIN (SELECT cluster, sum(status) AS n FROM cx GROUP BY 1) e ON e.cluster=t.cluster"
S["cox_risk"] = with_(*COX) + "SELECT subject_id, cluster, round(exp(eta - avg(eta) OVER (PARTITION BY cluster)),4) AS risk FROM (SELECT cx.*, b1*x1+b2*x2+b3*x3 AS eta FROM cx JOIN nb USING (cluster))"


def probs(rows, name="pr"):
    """Survival probabilities at the three horizons of ``rows(subject_id, cluster, x1..x3)``."""
    return hazard("hz", "nb_s9", ["cluster"]) + [
        ("lt", "SELECT cluster, max(time) AS last FROM cx GROUP BY 1"),
        ("hh", "SELECT l.cluster, " + ", ".join(f"CASE WHEN any_value(l.last) >= {m}*30.5 THEN coalesce(max(h.h) FILTER (h.time <= {m}*30.5), 0) END AS h{m}" for m in (12, 18, 24)) + " FROM lt l LEFT JOIN hz h USING (cluster) GROUP BY 1"),
        (name, "SELECT x.subject_id, x.cluster, " + ", ".join(f"exp(-h{m}*exp(b1*x1+b2*x2+b3*x3)) AS p{m}" for m in (12, 18, 24)) + f" FROM {rows} x LEFT JOIN nb USING (cluster) LEFT JOIN hh USING (cluster)"),
    ]


S["surv_prob"] = with_(*COX, probs("cx")) + "SELECT subject_id, cluster, round(p12,4) AS p12, round(p18,4) AS p18, round(p24,4) AS p24 FROM pr"
MARK = [*LAB3, [("mk", "SELECT cluster, time_event AS time, status, round(onset_age,6) AS risk FROM lab WHERE time_event IS NOT NULL AND cluster IS NOT NULL")], card("mk", "cd", ["cluster"])]
S["c_index"] = with_(*MARK) + "SELECT cluster, comparable, concordant, tied, round(c_index,6) AS c_index FROM cd_ci"
S["auc_t"] = with_(*MARK) + "SELECT c.cluster, m*30.5::DOUBLE AS horizon, round(auc,6) AS auc FROM (SELECT DISTINCT cluster FROM mk) c CROSS JOIN range(31) t(m) LEFT JOIN cd_a USING (cluster, m)"
S["iauc"] = with_(*MARK) + "SELECT cluster, round(iauc,6) AS iauc FROM cd"
S["survival_scorecard"] = with_(*MARK) + "SELECT cluster, round(c_index,6) AS c_index, round(auc12,6) AS auc12, round(auc18,6) AS auc18, round(auc24,6) AS auc24, round(iauc,6) AS iauc FROM cd"

FK = ["cluster", "model_id", "rep"]
BACK = {1: ["price", "onset_age", "segment"], 2: ["discount", "prior_slope", "linestatus"], 3: ["tax", "quantity", "age"]}


SURV_REPS = 5


def cv_surv(candidates, tail, reps=SURV_REPS):
    """``candidates``: (cluster, feature, model_id, design expressions, gated); all are padded to one width."""
    p = max(len(x[3]) for x in candidates)
    padded = [(*x[:3], [*x[3], *["0.0"] * (p - len(x[3]))], x[4]) for x in candidates]

    def sel(c, f, mid, xs, gated):
        gate = f" AND (SELECT abundance FROM ab WHERE cluster={c} AND feature='{f}') < 0.77" if gated else ""
        return f"SELECT cluster, '{mid}' AS model_id, rep, is_test, time_event AS time, status, " + ", ".join(f"({x})::DOUBLE AS x{i + 1}" for i, x in enumerate(xs)) + f" FROM split WHERE cluster={c}{gate}"
    ab = [("ab", "SELECT cluster, feature, max(n)/CAST(sum(n) AS DOUBLE) AS abundance FROM (" + " UNION ALL ".join(
        f"SELECT cluster, '{c}' AS feature, CAST({key15(c)} AS VARCHAR) AS v, count(*) AS n FROM tr WHERE {c} IS NOT NULL GROUP BY ALL" for c in NUMERICS + CATEGORICALS) + ") GROUP BY 1, 2")]
    return with_(*LAB3, [("tr", "SELECT * FROM lab WHERE time_event IS NOT NULL AND cluster IS NOT NULL")], split_cte(reps=reps), ab, [
        ("lg", " UNION ALL ".join(sel(*x) for x in padded)), ("cxt", "SELECT * FROM lg WHERE NOT is_test"),
    ], newton_halving("cxt", "nb", FK, p), [
        ("mk", f"SELECT l.cluster, l.model_id, l.rep, l.time, l.status, round({linear(p)}, 9) AS risk FROM lg l JOIN nb USING (cluster, model_id, rep) WHERE l.is_test"),
    ], card("mk", "cd", FK)) + tail


CARD = "SELECT cluster, model_id, rep, round(c_index,4) AS c_index, round(auc12,4) AS auc12, round(auc18,4) AS auc18, round(auc24,4) AS auc24, round(iauc,4) AS iauc FROM cd"
SADD = [(c, f, mid, expand(names), gated) for c, m in XS.items() for f, mid, names, gated in additions(list(m))]
S["forward_step_surv"] = cv_surv(SADD, CARD)
S["backward_step_surv"] = cv_surv([(c, "", " + ".join(k), expand(k), False) for c, m in BACK.items() for d in m for k in [[b for b in m if b != d]]], CARD)
S["cross_validate_surv"] = cv_surv([(c, "", " + ".join(m), expand(m), False) for c, m in COX_FULL.items()], CARD)
S["top_models_surv"] = cv_surv(SADD, """SELECT * FROM (SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY ci DESC, model_id) AS INT) AS place, model_id, round(ci,4) AS mean_c_index, round(ia,4) AS mean_iauc
FROM (SELECT cluster, model_id, avg(c_index) AS ci, avg(iauc) AS ia FROM cd GROUP BY 1,2)) WHERE place <= 20""")

# --- scoring -------------------------------------------------------------------------------------------------
S["union_train_score"] = with_(WIDE, SLOPE) + "SELECT w.subject_id, CAST(s.subject_id IS NULL AS INT) AS is_scoring, round(price,5) AS price, segment, round(slope,5) AS slope FROM wide w LEFT JOIN slope_resp s USING (subject_id)"


def joint(resp, table):
    """Train on subjects in ``table``; prepare each other subject against the training rows and itself."""
    wide2 = [(n, b.replace("WHERE feature_name='onset'", f"WHERE feature_name='onset' AND subject_id IN (SELECT subject_id FROM {table})") if n == "med" else b) for n, b in WIDE]
    first = [x for x in wide2 if x[0] in {n for n, _ in MEASURED}]
    cols = ", ".join(NUMERICS)
    out = first + [x for x in resp if x not in first] + [x for x in wide2 if x not in first] + [
        ("known", f"SELECT wide.*, r.* EXCLUDE (subject_id) FROM wide JOIN {table} r USING (subject_id)"),
        ("newc", f"SELECT * FROM wide WHERE subject_id NOT IN (SELECT subject_id FROM {table})"),
    ] + knn("known", "kimp", NUMERICS) + [
        ("newk", "SELECT subject_id, " + cols + ", " + ", ".join(f"CASE WHEN {c} IN (SELECT {c} FROM known) THEN {c} END AS {c}" for c in CATEGORICALS) + " FROM newc"),
    ] + knn("newk", "nimp", NUMERICS, pool="known") + [("low", "SELECT min(price) AS low FROM kimp")]
    from .prepared import mode, shaped
    low = "(SELECT low FROM low)"
    out += [
        ("kshape", "SELECT * REPLACE (" + ", ".join(f"{shaped(c, low)} AS {c}" for c in ("price", "onset", "quantity")) + ") FROM kimp"),
        ("kmom", "SELECT " + ", ".join(f"avg({c}) AS a_{c}, stddev_samp({c}) AS s_{c}" for c in NUMERICS) + " FROM kshape"),
        ("prepared", "SELECT k.subject_id, k.* EXCLUDE (subject_id, " + cols + ", " + ", ".join(CATEGORICALS) + "), " + ", ".join(f"(k.{c}-m.a_{c})/nullif(m.s_{c},0) AS {c}" for c in NUMERICS) + ", "
         + ", ".join(f"coalesce(k.{c}, {mode('kimp', c)}) AS {c}" for c in CATEGORICALS) + " FROM kshape k, kmom m"),
        # brute force: the new subject's value next to every training value
        ("cand", "SELECT subject_id AS sid, TRUE AS own, least(price, (SELECT low FROM low)) AS lo, " + cols + " FROM nimp UNION ALL SELECT n.subject_id, FALSE, least(n.price, (SELECT low FROM low)), "
         + ", ".join(f"k.{c}" for c in NUMERICS) + " FROM nimp n, kimp k"),
        ("cshape", "SELECT sid, own, " + ", ".join(f"{shaped(c, 'lo')} AS {c}" for c in NUMERICS) + " FROM cand"),
        ("cmom", "SELECT sid, " + ", ".join(f"avg({c}) AS a_{c}, stddev_samp({c}) AS s_{c}" for c in NUMERICS) + " FROM cshape GROUP BY 1"),
        ("ready", "SELECT c.sid AS subject_id, " + ", ".join(f"(c.{c}-m.a_{c})/nullif(m.s_{c},0) AS {c}" for c in NUMERICS) + ", " + ", ".join(f"coalesce(n.{c}, {mode('kimp', c)}) AS {c}" for c in CATEGORICALS)
         + " FROM cshape c JOIN cmom m USING (sid) JOIN nimp n ON n.subject_id=c.sid WHERE c.own"),
    ]
    return out


S["score_prepare"] = with_(joint(SLOPE, "slope_resp")) + "SELECT subject_id, " + ", ".join(r(c, 5) for c in NUMERICS) + ", returnflag, linestatus, segment FROM ready"
SCORE_LAB = [joint(SLOPE, "slope_resp"), [("lab0", "SELECT subject_id, slope, " + ", ".join(NUMERICS + CATEGORICALS) + " FROM prepared UNION ALL SELECT subject_id, NULL, " + ", ".join(NUMERICS + CATEGORICALS) + " FROM ready")],
             classify("lab0", "lab", C4)]
S["score_batch_slope"] = with_(*SCORE_LAB, FITF, PRED) + """SELECT p.subject_id, p.cluster, round(coalesce(fit, mean_fit),3) AS fit, round(CASE WHEN fit IS NULL THEN 0 ELSE se END,3) AS se, CAST(fit IS NULL AS INT) AS replaced
FROM pred p LEFT JOIN means USING (cluster) WHERE p.subject_id IN (SELECT subject_id FROM ready)"""
_cols = ", ".join(NUMERICS + CATEGORICALS)
SURV_LAB = [joint(SURV, "surv_resp"), [("lab0", f"SELECT subject_id, time_event, status, {_cols} FROM prepared UNION ALL SELECT subject_id, NULL, NULL, {_cols} FROM ready")], classify("lab0", "lab", C4),
            cox_rows(XS), newton("cx", "nb", ["cluster"]),
            [("allx", f"SELECT subject_id, cluster, time_event, {xcase(0, XS)} AS x1, {xcase(1, XS)} AS x2, {xcase(2, XS)} AS x3 FROM lab")], probs("allx"),
            [("pm", "SELECT p.cluster, avg(p12) AS m12, avg(p18) AS m18, avg(p24) AS m24 FROM pr p JOIN allx a USING (subject_id) WHERE a.time_event IS NOT NULL GROUP BY 1")]]
S["score_batch_survival"] = with_(*SURV_LAB) + "SELECT subject_id, cluster, " + ", ".join(f"round(coalesce(p{m}, m{m}),4) AS p{m}" for m in (12, 18, 24)) + ", " + ", ".join(f"CAST(p{m} IS NULL AS INT) AS replaced_p{m}" for m in (12, 18, 24)) + " FROM pr LEFT JOIN pm USING (cluster) WHERE subject_id IN (SELECT subject_id FROM ready)"
S["score_bundle_slope"], S["score_bundle_survival"] = S["score_batch_slope"], S["score_batch_survival"]
SEL = [*LAB3, FORMS, [("need", "SELECT * FROM (VALUES (1,'price'),(1,'onset'),(1,'age'),(2,'discount'),(2,'onset'),(2,'quantity'),(3,'tax'),(3,'quantity')) t(cluster, feature_name)"),
       ("picked", "SELECT f.*, l.cluster FROM forms f JOIN lab l USING (subject_id) JOIN need n ON n.cluster=l.cluster AND n.feature_name=f.feature_name")]]
S["select_rows"] = with_(*SEL) + "SELECT subject_id, cluster, feature_name, feature_value, feature_delta, row_seq FROM picked"
S["parse_cluster_tag"] = with_(*SEL) + "SELECT CAST(subject_id AS VARCHAR) AS subject_id, cluster, count(*) AS n_lines FROM picked GROUP BY 1, 2"
S["format_predictions"] = with_(*LAB3, FITF, PRED) + "SELECT subject_id, concat_ws('|', coalesce(CAST(CAST(round(fit,2) AS DECIMAL(18,2)) AS VARCHAR),'NA'), coalesce(CAST(CAST(round(se,2) AS DECIMAL(18,2)) AS VARCHAR),'NA')) AS line FROM pred"
S["model_registry"] = with_(*LAB3, FITF, names_cte(FULL)) + f"""SELECT nm.cluster, term, round(f.v,4) AS coef, round(sqrt(s.sigma2*q.v),4) AS std_error, s.n
FROM nm JOIN fit f ON f.cluster=nm.cluster AND f.i=nm.position AND f.j={PF} JOIN fit q ON q.cluster=nm.cluster AND q.i=nm.position AND q.j={PF}+1+nm.position JOIN fit_s s ON s.cluster=nm.cluster"""
S["roundtrip_wide"] = S["collapse_wide"]
S["read_requests"] = with_(*SEL) + "SELECT CAST(subject_id AS VARCHAR) AS subject_id, cluster, feature_name, count(*) AS n FROM picked GROUP BY ALL"
S["read_forms_header"] = with_(FORMS) + "SELECT feature_name, count(*) AS n, count(feature_value) AS n_value FROM forms GROUP BY 1"
S["read_responses"] = with_(SLOPE, SURV) + "SELECT CAST(subject_id AS VARCHAR) AS subject_id, round(slope, 4) AS slope, time_event, status FROM slope_resp FULL JOIN surv_resp USING (subject_id)"
S["audit_copy"] = with_(*SEL) + "SELECT 'request' AS stage, cluster, count(*) AS n FROM picked GROUP BY 2"
S["read_forms_text"] = with_(FORMS) + f"SELECT feature_name, count(*) AS n, count(feature_value) AS n_value, round(avg({number('feature_value')}),6) AS mean_value, round(CAST(sum(feature_delta) AS DOUBLE),6) AS sum_delta FROM forms GROUP BY 1"
S["save_feature_tables"] = S["dummy_code"]
S["stratum_feature_table"] = with_(*LAB3) + "SELECT subject_id, cluster, round(price,6) AS price, round(tax,6) AS tax, segment FROM lab WHERE cluster IN (1, 3)"
S["read_forms_quarantine"] = with_(FORMS) + """, w AS (SELECT feature_name, CASE WHEN row_seq % 97 = 0 THEN 'short' WHEN row_seq % 89 = 0 THEN 'long' WHEN row_seq % 83 = 0 THEN 'quote' WHEN row_seq % 79 = 0 THEN 'subject' END AS reason FROM forms)
SELECT CASE WHEN reason IS NULL THEN 'kept' ELSE 'quarantine' END AS kind, coalesce(reason, feature_name) AS name, count(*) AS n FROM w GROUP BY 1, 2"""
_mark = lambda m: f"SELECT cluster, time_event AS time, status, round({m},6) AS risk FROM lab WHERE time_event IS NOT NULL AND cluster IS NOT NULL"
S["horizon_scorecard"] = with_(*MARK, [("mk12", _mark("price"))], card("mk12", "cd12", ["cluster"]), [("mk18", _mark("tax"))], card("mk18", "cd18", ["cluster"])) + (
    "SELECT cd.cluster, round(cd.c_index,6) AS c_index, round(cd12.auc12,6) AS auc12, round(cd18.auc18,6) AS auc18, round(cd.auc24,6) AS auc24, round(cd.iauc,6) AS iauc "
    "FROM cd JOIN cd12 USING (cluster) JOIN cd18 USING (cluster)")
S["format_probabilities"] = with_(*COX, probs("cx")) + "SELECT concat_ws('|', " + ", ".join(f"coalesce(CAST(CAST(round(p{m},3) AS DECIMAL(18,3)) AS VARCHAR),'NA')" for m in (12, 18, 24)) + ") AS line, count(*) AS n FROM pr GROUP BY 1"
