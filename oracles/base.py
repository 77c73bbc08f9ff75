"""Shared WITH-clauses: forms, wide, prepared tables in plain SQL."""

NUM = r"'^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$'"


def number(c):
    return f"(CASE WHEN regexp_matches({c}, {NUM}) THEN TRY_CAST({c} AS DOUBLE) END)"


def days(a, b):
    return f"datediff('day', CAST({b} AS DATE), CAST({a} AS DATE))"


def with_(*ctes):
    seen, out = set(), []
    for group in ctes:
        for name, body in group:
            if name not in seen:
                seen.add(name)
                out.append(f"{name} AS MATERIALIZED ({body})")
    return "WITH RECURSIVE " + ",\n".join(out) + "\n"


FIRST = [("first_order", "SELECT o_custkey, min(o_orderdate) AS d0, max(o_orderdate) AS d1 FROM orders GROUP BY o_custkey")]


def _cell(name, expr, pos):
    return (
        f"SELECT subject_id, form_name, '{name}' AS feature_name, {expr} AS feature_value, 'u' AS feature_unit, "
        f"feature_delta, l_orderkey*1000 + l_linenumber*10 + {pos} AS row_seq FROM visit"
    )


def _mark(c):
    return f"CASE WHEN l_linenumber = 4 THEN '-' ELSE CAST({c} AS VARCHAR) END"


FORMS = FIRST + [
    ("visit", f"""SELECT o.o_custkey AS subject_id,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Adverse Event' WHEN '5-LOW' THEN 'Concomitant Medication' ELSE 'Clinic' END AS form_name,
       {days('l.l_shipdate', 'f.d0')} AS feature_delta, l.*
       FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN first_order f ON o.o_custkey = f.o_custkey"""),
    ("forms", " UNION ALL ".join([
        _cell("quantity", _mark("l_quantity"), 0), _cell("price", _mark("l_extendedprice"), 1),
        _cell("discount", _mark("l_discount"), 2),
        _cell("tax", "CASE WHEN l_linenumber = 4 THEN '-' WHEN l_linenumber = 3 THEN 'n/a' ELSE CAST(l_tax AS VARCHAR) END", 3),
        _cell("returnflag", _mark("l_returnflag"), 4), _cell("linestatus", _mark("l_linestatus"), 5),
        """SELECT c_custkey, 'Clinic', 'onset', CAST(-(30 + CAST(floor(c_acctbal/5) AS BIGINT)) AS VARCHAR), 'days', 0, c_custkey*1000-2
           FROM customer WHERE c_acctbal >= 0""",
        """SELECT c_custkey, 'Clinic', 'age', CAST(30 + 2*c_nationkey AS VARCHAR), 'years', 0, c_custkey*1000-3
           FROM customer WHERE c_acctbal < 9000""",
        "SELECT c_custkey, 'Clinic', 'segment', c_mktsegment, '', 0, c_custkey*1000-4 FROM customer WHERE c_mktsegment IS NOT NULL",
    ])),
]
KEPT = "form_name NOT IN ('Adverse Event','Concomitant Medication')"
MEASURED = FORMS + [("measured", f"SELECT * FROM forms WHERE {KEPT} AND (feature_value <> '-' OR feature_value IS NULL)")]
SLOPE = FIRST + [("slope_resp", f"""SELECT o.o_custkey AS subject_id,
   regr_slope(o.o_totalprice, CAST({days('o.o_orderdate', 'f.d0')} AS DOUBLE))*365/12 AS slope
   FROM orders o JOIN first_order f ON o.o_custkey = f.o_custkey GROUP BY o.o_custkey HAVING count(DISTINCT o.o_orderdate) >= 7""")]
SURV = FIRST + [("surv_resp", f"""SELECT f.o_custkey AS subject_id, CAST({days('f.d1', 'f.d0')} AS DOUBLE) AS time_event,
   max(CASE WHEN o.o_orderstatus='F' THEN 1 ELSE 0 END) AS status
   FROM first_order f JOIN orders o ON o.o_custkey=f.o_custkey AND o.o_orderdate=f.d1
   GROUP BY f.o_custkey, f.d1, f.d0 HAVING max(CASE WHEN o.o_orderstatus='P' THEN 1 ELSE 0 END) = 0""")]
FORMS2 = [("forms2", f"""SELECT e.user_id AS subject_id, 'Clinic' AS form_name, e.event_type AS feature_name,
   CAST(e.value AS VARCHAR) AS feature_value, 'u' AS feature_unit, {days('e.ts', 'g.t0')} AS feature_delta, e.event_id AS row_seq
   FROM events e JOIN (SELECT user_id, min(ts) AS t0 FROM events GROUP BY user_id) g ON e.user_id = g.user_id""")]

NUMERICS = ["quantity", "price", "discount", "tax", "onset", "age", "prior_slope", "onset_age"]
CATEGORICALS = ["returnflag", "linestatus", "segment"]

_x = number("feature_value")
WIDE = MEASURED + [
    ("med", f"SELECT median({_x}) AS m FROM measured WHERE feature_name='onset'"),
    ("universe", f"SELECT DISTINCT subject_id FROM forms WHERE {KEPT}"),
    ("num", f"""SELECT subject_id, min(x) FILTER (feature_name='quantity') AS quantity, avg(x) FILTER (feature_name='price') AS price,
        avg(x) FILTER (feature_name='discount') AS discount, avg(x) FILTER (feature_name='tax') AS tax,
        avg(x) FILTER (feature_name='onset') AS onset, avg(x) FILTER (feature_name='age') AS age
        FROM (SELECT subject_id, feature_name, {_x} AS x FROM measured WHERE feature_delta < 92) GROUP BY subject_id"""),
    ("modes", """SELECT subject_id, feature_name, feature_value FROM (
        SELECT subject_id, feature_name, feature_value, row_number() OVER (PARTITION BY subject_id, feature_name ORDER BY count(*) DESC, feature_value) AS rn
        FROM measured WHERE feature_delta < 92 AND feature_value IS NOT NULL AND feature_value <> ''
          AND feature_name IN ('returnflag','linestatus','segment')
        GROUP BY subject_id, feature_name, feature_value) WHERE rn = 1"""),
    ("firsts", f"""SELECT subject_id, feature_name, {_x} AS x FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, feature_name ORDER BY row_seq, feature_value) AS rn
        FROM measured WHERE feature_name IN ('onset','age')) WHERE rn = 1"""),
    ("latest", f"""SELECT subject_id, {_x} AS score, CAST(feature_delta AS DOUBLE) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY subject_id
        ORDER BY feature_delta DESC, row_seq, feature_value) AS rn FROM measured WHERE feature_name='quantity' AND feature_delta < 92) WHERE rn = 1"""),
    ("wide", """SELECT u.subject_id, n.quantity, n.price, n.discount, n.tax, n.onset, n.age,
        (l.score - 39) / nullif(l.delta - fo.x, 0) * 365.0 / 12.0 AS prior_slope,
        fa.x + coalesce(fo.x, (SELECT m FROM med)) / 365.0 AS onset_age,
        mr.feature_value AS returnflag, ml.feature_value AS linestatus, ms.feature_value AS segment
        FROM universe u LEFT JOIN num n USING (subject_id) LEFT JOIN latest l USING (subject_id)
        LEFT JOIN firsts fo ON fo.subject_id=u.subject_id AND fo.feature_name='onset'
        LEFT JOIN firsts fa ON fa.subject_id=u.subject_id AND fa.feature_name='age'
        LEFT JOIN modes mr ON mr.subject_id=u.subject_id AND mr.feature_name='returnflag'
        LEFT JOIN modes ml ON ml.subject_id=u.subject_id AND ml.feature_name='linestatus'
        LEFT JOIN modes ms ON ms.subject_id=u.subject_id AND ms.feature_name='segment'"""),
]


def r(c, d=6, alias=None):
    return f"round({c}, {d}) AS {alias or c}"
