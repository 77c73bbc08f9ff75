"""Imputed and standardised tables in plain SQL."""

from .base import CATEGORICALS, NUMERICS, SLOPE, SURV, WIDE


def knn(source, name, cols, pool=None, key="subject_id"):
    """CTEs that impute ``source`` from ``pool`` (default: itself)."""
    pool_t = pool or source
    miss = " + ".join(f"CAST({c} IS NULL AS INT)" for c in cols)
    both = lambda c: f"(a.{c} IS NOT NULL AND b.{c} IS NOT NULL)"
    total = " + ".join(f"CASE WHEN {both(c)} THEN (a.{c}-b.{c})*(a.{c}-b.{c}) ELSE 0 END" for c in cols)
    shared = " + ".join(f"CAST({both(c)} AS INT)" for c in cols)
    n = len(cols)
    return [
        (f"{name}_pool", f"SELECT * FROM {pool_t} WHERE ({miss}) <= 0.8*{n}"),
        (f"{name}_need", f"SELECT * FROM {source} WHERE ({miss}) <= 0.8*{n} AND ({miss}) > 0"),
        (f"{name}_pairs", f"SELECT a.{key}, b.{key} AS neighbour_id, (0.0 + {total}) / ({shared}) AS distance FROM {name}_need a JOIN {name}_pool b ON a.{key}<>b.{key} WHERE ({shared}) > 0"),
        (f"{name}_near", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY distance, neighbour_id) AS place FROM {name}_pairs) WHERE place <= 10"),
        (f"{name}_fill", f"SELECT n.{key}, " + ", ".join(f"avg(p.{c}) AS {c}" for c in cols) + f" FROM {name}_near n JOIN {name}_pool p ON p.{key}=n.neighbour_id GROUP BY n.{key}"),
        (f"{name}_mean", "SELECT " + ", ".join(f"avg({c}) AS {c}" for c in cols) + f" FROM {pool_t}"),
        (name, "SELECT s.* EXCLUDE (" + ", ".join(cols) + "), " + ", ".join(f"coalesce(s.{c}, f.{c}, m.{c}) AS {c}" for c in cols)
         + f" FROM {source} s LEFT JOIN {name}_fill f USING ({key}) , {name}_mean m"),
    ]


def shaped(c, low):
    if c == "price":
        return f"ln({c} + abs({low}) + 1.0)"
    return f"{c}*{c}*{c}" if c in ("onset", "quantity") else c


def mode(src, c):
    return f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


BASE = WIDE + SLOPE + [("base", "SELECT subject_id, " + ", ".join(NUMERICS + CATEGORICALS) + ", slope FROM wide FULL JOIN slope_resp USING (subject_id)")]
IMPUTED = BASE + knn("base", "imputed", NUMERICS)
SCALED = IMPUTED + [
    ("shaped", "SELECT subject_id, slope, returnflag, linestatus, segment, " + ", ".join(f"{shaped(c, '(SELECT min(price) FROM imputed)')} AS {c}" for c in NUMERICS) + " FROM imputed"),
    ("moments", "SELECT " + ", ".join(f"avg({c}) AS a_{c}, stddev_samp({c}) AS s_{c}, count({c}) AS n_{c}" for c in NUMERICS) + " FROM shaped"),
]
PREPARED = SCALED + SURV + [
    ("prepared", "SELECT s.subject_id, s.slope, v.time_event, v.status, "
     + ", ".join(f"(s.{c} - m.a_{c})/nullif(m.s_{c}, 0) AS {c}" for c in NUMERICS) + ", "
     + ", ".join(f"coalesce(s.{c}, {mode('shaped', c)}) AS {c}" for c in CATEGORICALS)
     + " FROM shaped s FULL JOIN surv_resp v USING (subject_id), moments m"),
]


def classify(src, name, case):
    return [(name, f"SELECT *, {case} AS cluster FROM {src}")]


C1 = """CASE WHEN onset >= 0.053412932 AND quantity < 0.66757882 AND price < 2.01044607 THEN 111
WHEN onset >= 0.053412932 AND quantity < 0.66757882 THEN 112 WHEN onset >= 0.04964584 AND quantity < 0.66757882 THEN 12
WHEN onset >= 0.04964584 AND discount < 0.58163565 THEN 21 WHEN onset >= 0.04964584 THEN 22 WHEN onset >= -0.03113981 THEN 3 WHEN onset < -0.03113981 THEN 4 END"""
C2 = """CASE WHEN tax < -0.464656830 THEN 4 WHEN onset_age < -0.007705498 THEN 1 WHEN quantity >= 0.077406712 THEN 2 WHEN quantity < 0.077406712 THEN 3 END"""
C3 = "CASE WHEN onset < 0.1464 THEN 3 WHEN prior_slope < 0.4279 THEN 1 WHEN prior_slope >= 0.4279 THEN 2 END"
C4 = "CASE WHEN prior_slope < -0.001987586 THEN 3 WHEN onset < 0.132676146 THEN 1 WHEN onset >= 0.132676146 THEN 2 END"


def gauss(src, name, p, keys, tol=1e-11):
    """Gauss-Jordan in SQL on ``src(keys, i, j, v)``; i, j = 0..p with p the response; adds the inverse at j > p."""
    k = ", ".join(keys)
    eq = lambda x, y: " AND ".join(f"{x}.{c} IS NOT DISTINCT FROM {y}.{c}" for c in keys)
    ctes = [
        (f"{name}_d", f"SELECT {k}, i, v AS d FROM {src} WHERE i = j"),
        (f"{name}_0", f"SELECT {k}, i, j, v FROM {src} UNION ALL SELECT g.{k.replace(', ', ', g.')}, g.i, {p}+1+CAST(m AS BIGINT) AS j, CASE WHEN g.i=m THEN 1.0 ELSE 0.0 END FROM {src} g, range({p}) t(m) WHERE g.j = 0"),
    ]
    for s in range(p):
        prev = f"{name}_{s}"
        ctes.append((f"{name}_{s + 1}", f"""SELECT {', '.join('a.' + c for c in keys)}, a.i, a.j,
          CASE WHEN pv.v > {tol}*greatest(d.d, 1e-300) THEN CASE WHEN a.i={s} THEN a.v/pv.v WHEN a.j={s} THEN 0 ELSE a.v - c.v*w.v/pv.v END
               WHEN a.i={s} OR a.j={s} THEN 0 ELSE a.v END AS v
          FROM {prev} a JOIN {prev} pv ON {eq('a', 'pv')} AND pv.i={s} AND pv.j={s} JOIN {prev} c ON {eq('a', 'c')} AND c.i=a.i AND c.j={s}
          JOIN {prev} w ON {eq('a', 'w')} AND w.i={s} AND w.j=a.j JOIN {name}_d d ON {eq('a', 'd')} AND d.i={s}"""))
    # a skipped column also loses its row in the inverse part
    ctes.append((name, f"SELECT * FROM {name}_{p}"))
    return ctes
