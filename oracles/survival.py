"""Cox, Kaplan-Meier, AUC and tree statements; pairs are joined literally here."""

from .base import CATEGORICALS, NUMERICS


def eqk(a, b, keys):
    return " AND ".join(f"{a}.{k}={b}.{k}" for k in keys)


def eliminated(src, name, keys, p, tol=1e-11):
    """Solve I d = u of ``src(keys, iXY, uX)`` by Gauss-Jordan, one row per fit: columns d1..dp; a vanishing pivot leaves its column out."""
    k, ids = ", ".join(keys), range(1, p + 1)
    at = lambda i, j: f"i{min(i, j)}_{max(i, j)}"
    ctes = [(f"{name}_0", f"SELECT {k}, " + ", ".join(f"{at(i, i)} AS g{i}" for i in ids) + ", " + ", ".join(f"{at(i, j)} AS a{i}_{j}" for i in ids for j in ids)
             + ", " + ", ".join(f"u{i} AS a{i}_{p + 1}" for i in ids) + f" FROM {src}")]
    for s in ids:
        ok = f"a{s}_{s} > {tol}*greatest(g{s}, 1e-300)"
        cells = [
            f"CASE WHEN {ok} THEN a{s}_{j}/a{s}_{s} ELSE 0 END AS a{i}_{j}" if i == s else f"a{i}_{j} - CASE WHEN {ok} THEN a{i}_{s}*a{s}_{j}/a{s}_{s} ELSE 0 END AS a{i}_{j}"
            for i in ids for j in range(s + 1, p + 2)
        ]
        ctes.append((f"{name}_{s}", f"SELECT {k}, " + ", ".join(f"g{i}" for i in ids) + ", " + ", ".join(cells) + f" FROM {name}_{s - 1}"))
    ctes.append((name, f"SELECT {k}, " + ", ".join(f"a{i}_{p + 1} AS d{i}" for i in ids) + f" FROM {name}_{p}"))
    return ctes


def newton(src, name, keys, steps=9, p=3):
    """Newton-Raphson for covariates x1..xp (unused ones are 0), Efron ties, no halving."""
    k, ids = ", ".join(keys), range(1, p + 1)
    pk = lambda t: ", ".join(f"{t}.{c}" for c in keys)
    ctes = [(f"{name}_b0", f"SELECT DISTINCT {k}, " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in ids) + f" FROM {src}")]
    for s in range(steps + 1):
        b = f"{name}_b{s}"
        ctes += score(src, b, f"{name}_s{s}", keys, p)
        if s < steps:
            ctes += eliminated(f"{name}_s{s}", f"{name}_e{s}", keys, p)
            ctes.append((f"{name}_b{s + 1}", f"SELECT {pk('b')}, " + ", ".join(f"b{i}+d{i} AS b{i}" for i in ids) + f" FROM {b} b JOIN {name}_e{s} s ON {eqk('b', 's', keys)}"))
    ctes.append((name, f"SELECT * FROM {name}_b{steps}"))
    return ctes


def newton_halving(src, name, keys, p, steps=20, tol="1e-9"):
    """The same with convergence and halving: a step that lowers the likelihood goes half way back, a fit that moves no more is left alone."""
    k, ids = ", ".join(keys), range(1, p + 1)
    every = lambda f: ", ".join(f(i) for i in ids)
    ctes = [(f"{name}_b0", f"SELECT DISTINCT {k}, {every(lambda i: f'0.0::DOUBLE AS b{i}, 0.0::DOUBLE AS g{i}')}, NULL::DOUBLE AS gl, FALSE AS done FROM {src}")]
    for s in range(steps):
        b = f"{name}_b{s}"
        ctes.append((f"{name}_o{s}", f"SELECT * FROM {b} WHERE NOT done"))
        ctes += score(src, f"{name}_o{s}", f"{name}_s{s}", keys, p)
        ctes += eliminated(f"{name}_s{s}", f"{name}_e{s}", keys, p)
        worse = "(NOT coalesce(isfinite(s.loglik), FALSE) OR coalesce(s.loglik < o.gl - {t}*abs(o.gl), FALSE))".replace("{t}", tol)
        ctes.append((f"{name}_m{s}", f"SELECT o.*, e.* EXCLUDE ({k}), s.loglik AS ll, {worse} AS worse, NOT {worse} AND coalesce(abs(s.loglik-o.gl) <= {tol}*greatest(abs(s.loglik), 1), FALSE) AS settled "
                     f"FROM {name}_o{s} o JOIN {name}_s{s} s ON {eqk('o', 's', keys)} JOIN {name}_e{s} e ON {eqk('o', 'e', keys)}"))
        ctes.append((f"{name}_b{s + 1}", f"SELECT * FROM {b} WHERE done UNION ALL SELECT {k}, "
                     + every(lambda i: f"CASE WHEN worse THEN (b{i}+g{i})/2 WHEN settled THEN b{i} ELSE b{i}+d{i} END AS b{i}, CASE WHEN worse THEN g{i} ELSE b{i} END AS g{i}")
                     + f", CASE WHEN worse THEN gl ELSE ll END AS gl, settled AS done FROM {name}_m{s}"))
    ctes.append((name, f"SELECT {k}, {every(lambda i: f'CASE WHEN done THEN b{i} ELSE g{i} END AS b{i}')} FROM {name}_b{steps}"))
    return ctes


def linear(p):
    return "+".join(f"b{i}*x{i}" for i in range(1, p + 1))


def score(src, beta, name, keys, p=3):
    k, ids = ", ".join(keys), range(1, p + 1)
    pairs = [(i, j) for i in ids for j in range(i, p + 1)]
    sums = ["sum(w) AS s0", "sum(w*status) AS e0", "sum(status) AS d", "sum(status*eta) AS xb"]
    sums += [f"sum(w*x{i}) AS s{i}, sum(w*status*x{i}) AS e{i}, sum(status*x{i}) AS x{i}" for i in ids]
    sums += [f"sum(w*x{i}*x{j}) AS s{i}_{j}, sum(w*status*x{i}*x{j}) AS e{i}_{j}" for i, j in pairs]
    names = ["0"] + [str(i) for i in ids] + [f"{i}_{j}" for i, j in pairs]
    runs = ", ".join(f"sum(s{n}) OVER (PARTITION BY {k} ORDER BY time DESC) AS r{n}" for n in names)
    return [
        (f"{name}_p", f"SELECT {k}, time, {', '.join(sums)} FROM (SELECT x.*, {linear(p)} AS eta, exp({linear(p)}) AS w FROM {src} x JOIN {beta} b ON {eqk('x', 'b', keys)}) GROUP BY {k}, time"),
        (f"{name}_r", f"SELECT *, {runs} FROM {name}_p"),
        (f"{name}_l", "SELECT *, " + ", ".join(f"(r{i} - f*e{i})*q AS z{i}" for i in ids)
         + f" FROM (SELECT *, l/d AS f, 1.0/(r0 - l/d*e0) AS q FROM (SELECT r.*, unnest(range(CAST(d AS BIGINT)))::DOUBLE AS l FROM {name}_r r WHERE d > 0))"),
        (name, f"SELECT {k}, sum(CASE WHEN l=0 THEN xb ELSE 0 END + ln(q)) AS loglik, " + ", ".join(f"sum(x{i}/d - z{i}) AS u{i}" for i in ids) + ", "
         + ", ".join(f"sum((r{i}_{j} - f*e{i}_{j})*q - z{i}*z{j}) AS i{i}_{j}" for i, j in pairs) + f" FROM {name}_l GROUP BY {k}"),
    ]


def hazard(name, final, keys):
    k = ", ".join(keys)
    return [(name, f"SELECT {k}, time, sum(sum(1/(r0 - l/d*e0))) OVER (PARTITION BY {k} ORDER BY time) AS h FROM {final}_l GROUP BY {k}, time")]


def km(src, name, keys):
    k = ", ".join(keys)
    return [
        (f"{name}_t", f"SELECT {k}, time, sum(status) AS d, count(*) AS n FROM {src} GROUP BY {k}, time"),
        (f"{name}_r", f"SELECT *, sum(n) OVER (PARTITION BY {k} ORDER BY time DESC) AS r FROM {name}_t"),
        (name, f"""SELECT {k}, time, CAST(d AS BIGINT) AS events, CAST(r AS BIGINT) AS at_risk,
          CASE WHEN max(CAST(d>=r AS INT)) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d>=r THEN 0 ELSE ln(1-d/r) END) OVER w) END AS survival
          FROM {name}_r WINDOW w AS (PARTITION BY {k} ORDER BY time)"""),
    ]


def card(src, name, keys):
    """c-index, AUC at 0..30 months and the integrated AUC of ``src(keys, time, status, risk)``."""
    k = ", ".join(keys)
    pk = lambda t: ", ".join(f"{t}.{c}" for c in keys)
    return [
        (f"{name}_ci", f"""SELECT {pk('a')}, CAST(count(*) AS DOUBLE) AS comparable, CAST(sum(CAST(a.risk>b.risk AS INT)) AS DOUBLE) AS concordant, CAST(sum(CAST(a.risk=b.risk AS INT)) AS DOUBLE) AS tied,
          sum(CASE WHEN a.risk>b.risk THEN 1.0 WHEN a.risk=b.risk THEN 0.5 ELSE 0 END)/count(*) AS c_index FROM {src} a JOIN {src} b ON {eqk('a', 'b', keys)}
          AND a.status=1 AND (a.time<b.time OR (a.time=b.time AND b.status=0)) GROUP BY {pk('a')}"""),
        (f"{name}_gt", f"SELECT {k}, time, sum(status) AS d, sum(1-status) AS c, count(*) AS n FROM {src} GROUP BY {k}, time"),
        (f"{name}_gr", f"SELECT *, sum(n) OVER (PARTITION BY {k} ORDER BY time DESC) - d AS r FROM {name}_gt"),
        (f"{name}_g", f"""SELECT {k}, time, CASE WHEN coalesce(max(CAST(r>0 AND c>=r AS INT)) OVER w, 0) = 1 THEN 0 ELSE exp(coalesce(sum(CASE WHEN r<=0 OR c>=r THEN 0 ELSE ln(1-c/r) END) OVER w, 0)) END AS gb
          FROM {name}_gr WINDOW w AS (PARTITION BY {k} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
        (f"{name}_w", f"SELECT s.*, CASE WHEN s.status=1 THEN 1/nullif(g.gb,0) END AS w FROM {src} s JOIN {name}_g g ON {eqk('s', 'g', keys)} AND s.time=g.time"),
        (f"{name}_a", f"""SELECT {pk('a')}, m, sum(a.w*CASE WHEN a.risk>b.risk THEN 1.0 WHEN a.risk=b.risk THEN 0.5 ELSE 0 END)/sum(a.w) AS auc
          FROM range(31) t(m), {name}_w a JOIN {name}_w b ON {eqk('a', 'b', keys)} WHERE a.status=1 AND a.time<=m*30.5 AND b.time>m*30.5 GROUP BY {pk('a')}, m"""),
        (f"{name}_sg", f"SELECT {k}, m*30.5::DOUBLE AS h, auc, lead(m*30.5::DOUBLE) OVER (PARTITION BY {k} ORDER BY m) AS h2, lead(auc) OVER (PARTITION BY {k} ORDER BY m) AS auc2 FROM {name}_a WHERE auc IS NOT NULL"),
        (f"{name}_sp", f"SELECT {k}, min(h) AS x0, max(h) AS x1, arg_max(auc, h) AS last FROM {name}_sg GROUP BY {k} HAVING count(*) >= 2"),
        (f"{name}_gd", f"SELECT {k}, x0, x1, last, CAST(q AS INT) AS q, x0+(x1-x0)*q/512.0 AS x FROM {name}_sp, range(513) t(q)"),
        (f"{name}_y", f"SELECT {pk('g')}, g.x0, g.x1, q, CASE WHEN q=512 THEN last ELSE s.auc+(s.auc2-s.auc)*(g.x-s.h)/(s.h2-s.h) END AS y FROM {name}_gd g LEFT JOIN {name}_sg s ON {eqk('g', 's', keys)} AND g.q<512 AND g.x>=s.h AND g.x<s.h2"),
        (f"{name}_i", f"SELECT {k}, sum(y*CASE WHEN q IN (0,512) THEN 1 WHEN q%2=1 THEN 4 ELSE 2 END)*(any_value(x1)-any_value(x0))/512/3/915.0 AS iauc FROM {name}_y GROUP BY {k}"),
        (name, f"""SELECT {pk('c')}, c.c_index, i.iauc, a.auc12, a.auc18, a.auc24 FROM {name}_ci c LEFT JOIN (SELECT {k}, max(auc) FILTER (m=12) AS auc12, max(auc) FILTER (m=18) AS auc18,
          max(auc) FILTER (m=24) AS auc24 FROM {name}_a GROUP BY {k}) a ON {eqk('c', 'a', keys)} LEFT JOIN {name}_i i ON {eqk('c', 'i', keys)}"""),
    ]


def splits(src, name, minbucket, kind, by, loss=None):
    """Best cut per node (or node and feature) of ``src(node, a, b, features)``; gains compare by their share of ``loss``."""
    place = f"round(gain/({loss}), 9)" if loss else "round(gain,6)"
    base = "count(*)" if kind == "anova" else "sum(b)"
    num = [f"SELECT node, '{c}' AS feature, round({c}, 9) AS key, count(*) AS n, sum(a) AS s1, sum(b) AS s2 FROM {src} GROUP BY 1,2,3" for c in NUMERICS]
    lev = " UNION ALL ".join(f"SELECT node, '{c}' AS feature, {c} AS level, sum(a)/{base} AS key, count(*) AS n, sum(a) AS s1, sum(b) AS s2 FROM {src} GROUP BY node, {c}" for c in CATEGORICALS)
    if kind == "anova":
        part = lambda n, s, t: f"({s}*{s}/{n})"
        scale = "1.0"
    else:
        part = lambda n, s, t: f"(CASE WHEN {s}>0 THEN {s}*ln({s}/{t}) ELSE 0 END)"
        scale = "2.0"
    gain = f"{scale}*({part('ln_', 'l1', 'l2')} + {part('(tn-ln_)', '(t1-l1)', '(t2-l2)')} - {part('tn', 't1', 't2')})"
    return [
        (f"{name}_lev", lev),
        (f"{name}_cells", " UNION ALL ".join(num) + f" UNION ALL SELECT node, feature, key, sum(n), sum(s1), sum(s2) FROM {name}_lev GROUP BY 1,2,3"),
        (f"{name}_run", f"""SELECT *, sum(n) OVER w AS ln_, sum(s1) OVER w AS l1, sum(s2) OVER w AS l2, sum(n) OVER v AS tn, sum(s1) OVER v AS t1, sum(s2) OVER v AS t2,
          lead(key) OVER w AS next FROM {name}_cells WINDOW w AS (PARTITION BY node, feature ORDER BY key), v AS (PARTITION BY node, feature)"""),
        (f"{name}_gain", f"SELECT *, {gain} AS gain FROM {name}_run WHERE ln_>={minbucket} AND tn-ln_>={minbucket}"),
        (name, f"""SELECT *, CASE WHEN feature IN ('returnflag','linestatus','segment') THEN NULL ELSE (key+next)/2 END AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {place} DESC, feature, key) AS rn
          FROM {name}_gain) WHERE rn=1"""),
    ]


def assign(src, best, name):
    """Send rows of split nodes to the children."""
    key = "CASE s.feature " + " ".join(f"WHEN '{c}' THEN round(r.{c}, 9)" for c in NUMERICS) + " ELSE v.key END"
    level = "CASE s.feature " + " ".join(f"WHEN '{c}' THEN r.{c}" for c in CATEGORICALS) + " END"
    return [(name, f"""SELECT r.* REPLACE (CASE WHEN s.node IS NULL THEN r.node WHEN {key} <= s.key + 1e-12*abs(s.key) THEN 2*r.node ELSE 2*r.node+1 END AS node) FROM {src} r LEFT JOIN {best}_ok s ON s.node=r.node
       LEFT JOIN {best}_lev v ON v.node=r.node AND v.feature=s.feature AND v.level={level}""")]


LOSS = {"anova": "SELECT sum(b) - sum(a)*sum(a)/count(*) AS v FROM rt", "exp": "SELECT -2.0*sum(a)*ln(sum(a)/sum(b)) AS v FROM rt"}


def grown(kind, minsplit, cp, depth=12):
    """A whole tree over ``rt(node, a, b, features)``: all rows are counted again at each of ``depth`` levels."""
    ctes, bucket = [("loss", LOSS[kind])], max(1, round(minsplit / 3))
    for k in range(1, depth + 1):
        src, best = f"r{k - 1}" if k > 1 else "rt", f"b{k}"
        ctes += splits(src, best, bucket, kind, "node", "SELECT v FROM loss")
        ctes.append((f"{best}_ok", f"SELECT * FROM {best} WHERE gain >= {cp}*(SELECT v FROM loss) AND node IN (SELECT node FROM {src} GROUP BY node HAVING count(*)>={minsplit})"))
        ctes += assign(src, best, f"r{k}")
    levels = range(1, depth + 1)
    ctes += [
        ("cuts", " UNION ALL ".join(f"SELECT * FROM b{k}_ok" for k in levels)),
        ("levs", " UNION ALL ".join(f"SELECT * FROM b{k}_lev WHERE node >= {2 ** (k - 1)}" for k in levels)),
        ("members", "SELECT DISTINCT subject_id, node, a FROM (SELECT subject_id, node, a FROM rt" + "".join(f" UNION ALL SELECT subject_id, node, a FROM r{k}" for k in levels) + ")"),
        ("leaves", f"SELECT * FROM r{depth}"),
    ]
    return ctes


def node_rows(threshold, gain):
    return f"""SELECT m.node, m.n, round(m.mean,3) AS mean, c.feature, round(c.threshold,{threshold}) AS threshold, l.left_levels, round(c.gain,{gain}) AS gain
FROM (SELECT node, count(*) AS n, avg(a) AS mean FROM members GROUP BY 1) m LEFT JOIN (SELECT DISTINCT node, feature, threshold, gain, key FROM cuts) c USING (node)
LEFT JOIN (SELECT l.node, string_agg(DISTINCT l.level, ',' ORDER BY l.level) AS left_levels FROM levs l JOIN cuts c ON c.node=l.node AND c.feature=l.feature AND l.key<=c.key+1e-12*abs(c.key) GROUP BY 1) l USING (node)"""
