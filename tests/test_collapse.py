import pytest

from cohortspan.functions.scalar import lenient_double, name_map, normalise_name
from cohortspan.operators import clean, collapse
from cohortspan.sources.bridge import Roles

ROLES = Roles(("lab", "onset", "age"), ("score",), ("sex",), "score", "onset", "age")
OUT = ("Adverse Event",)


def _forms(spark, rows):
    data = [(s, form, f, v, "u", d, i) for i, (s, form, f, v, d) in enumerate(rows)]
    return spark.createDataFrame(
        data, "subject_id bigint, form_name string, feature_name string, feature_value string, feature_unit string, "
        "feature_delta string, row_seq bigint"
    )


@pytest.fixture(scope="module")
def wide(spark):
    c = "Clinic"
    rows = [
        (1, c, "onset", "-400", "0"), (1, c, "age", "50", "0"), (1, c, "score", "30", "10"), (1, c, "score", "28", "80"),
        (1, c, "score", "27", "80"), (1, c, "score", "5", "92"), (1, c, "lab", "abc", "5"), (1, c, "lab", "2", "6"),
        (1, c, "lab", "4", "7"), (1, c, "sex", "F", "1"), (1, c, "sex", "M", "2"), (1, "Adverse Event", "lab", "900", "5"),
        # null day inside the score series: no slope
        (2, c, "onset", "-100", "0"), (2, c, "age", "60", "0"), (2, c, "score", "33", "20"), (2, c, "score", "31", None),
        # only rows outside the window, only the mark
        (3, c, "lab", "7", "200"), (4, c, "lab", "-", "3"),
        # visit on the onset day; first onset value unreadable, so the median is used for the age
        (5, c, "onset", "20", "0"), (5, c, "score", "30", "20"), (6, c, "onset", "x", "0"), (6, c, "onset", "-5", "0"),
        (6, c, "age", "40", "0"), (6, c, "lab", "1e1", "1"), (6, c, "lab", "1d", "1"),
        (7, "Adverse Event", "lab", "1", "1"),
    ]
    df = collapse.collapse(_forms(spark, rows), ROLES, OUT)
    return {r["subject_id"]: r.asDict() for r in df.collect()}


def test_universe_keeps_marked_and_late_subjects(wide):
    assert sorted(wide) == [1, 2, 3, 4, 5, 6]
    assert wide[3]["lab"] is None and wide[4]["lab"] is None


def test_reducers(wide):
    assert wide[1]["lab"] == 3.0 and wide[1]["score"] == 27.0
    assert wide[1]["sex"] == "F"  # tie goes to the smaller value
    assert wide[6]["lab"] == 10.0  # '1d' is not a number


def test_prior_slope(wide):
    assert wide[1]["prior_slope"] == pytest.approx((28 - 39) / (80 + 400) * 365 / 12)
    assert wide[2]["prior_slope"] is None
    assert wide[5]["prior_slope"] is None
    assert wide[3]["prior_slope"] is None


def test_onset_age(wide):
    assert wide[1]["onset_age"] == pytest.approx(50 - 400 / 365)
    median = sorted([-400, -100, 20, -5])
    assert wide[6]["onset_age"] == pytest.approx(40 + (median[1] + median[2]) / 2 / 365)
    assert wide[3]["onset_age"] is None


def test_lenient_numbers(spark):
    texts = ["1", " 2.5 ", "-.5e2", "1d", "NaN", "Infinity", "", None, "n/a", "5."]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(lenient_double("t").alias("v"))
    assert [r["v"] for r in df.collect()] == [1.0, 2.5, -50.0, None, None, None, None, None, None, 5.0]


def test_mark_keeps_nulls(spark):
    df = spark.createDataFrame([("-",), (None,), ("3",)], "feature_value string")
    assert clean.drop_mark(df).count() == 2


def test_names():
    assert normalise_name("AST(SGOT)") == "ast_sgot"
    with pytest.raises(ValueError):
        name_map(["a b", "a-b"])


def test_rows_outside_the_window_fall_together(spark):
    """They keep their subject, as one row, whatever their features and texts."""
    rows = [(1, "Clinic", f, v, "200") for f, v in (("lab", "7"), ("sex", "F"), ("sex", "M"), ("score", "3"), ("lab", "-"))] + [(1, "Clinic", "sex", "F", "3")]
    cut = collapse.cells(clean.with_delta(_forms(spark, rows)), ROLES).collect()
    assert sorted((str(r["feature_name"]), str(r["_text"]), r["_seen"]) for r in cut) == [("None", "None", 0), ("sex", "F", 1)]
