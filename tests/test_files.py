import os
import subprocess
import sys
import tempfile

from pyspark.sql import functions as F

from cohortspan.plans import score
from cohortspan.sources import files


def _path():
    return tempfile.mkdtemp(prefix="run-") + "/out"


def test_forms_text_round_trip(spark):
    df = spark.createDataFrame(
        [("1", "Clinic", "AST(SGOT)", "4", "u", "1.5"), ("2", "Clinic", "x", None, "u", None)],
        "subject_id string, form_name string, feature_name string, feature_value string, feature_unit string, feature_delta string",
    )
    for header in (True, False):
        path = _path()
        files.write_forms(df, path, header=header)
        back = files.read_forms(spark, path, header=header).drop("row_seq")
        assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


REQUEST = "subject_id string, cluster int, form_name string, feature_name string, feature_value string, feature_unit string, feature_delta int, row_seq long"


def test_request_files(spark):
    rows = spark.createDataFrame(
        [("7", 3, "Clinic", "trunk", "5", "u", 4, 10), ("7", 3, "Clinic", "fvc", None, "u", 9, 11), ("8", 1, "Clinic", "fvc", "1", "u", 2, 1), ("9", 2, "Clinic", "leg", "1", "u", 2, 1)],
        REQUEST,
    )
    path = _path()
    files.write_requests(rows, path)
    back = {(r["subject_id"], r["cluster"], r["line"]) for r in files.read_request_lines(spark, path).collect()}
    assert back == {("7", 3, "7|Clinic|trunk|5|u|4"), ("7", 3, "7|Clinic|fvc|NA|u|9"), ("8", 1, "8|Clinic|fvc|1|u|2"), ("9", 2, "9|Clinic|leg|1|u|2")}
    lines = [r["value"] for r in spark.read.text(f"{path}/cluster=3").collect()]
    assert lines == ["cluster: 3|||||", "7|Clinic|trunk|5|u|4", "7|Clinic|fvc|NA|u|9"]
    got = files.parse_request_rows(files.read_request_lines(spark, path)).filter("feature_name = 'fvc'").collect()
    assert {(r["subject_id"], r["feature_value"]) for r in got} == {("7", None), ("8", "1")}


def test_requests_are_written_from_one_pass(spark):
    """The rows of a request are built once, whatever that takes, and a first row of several with one place follows its tag."""
    rows = spark.createDataFrame(
        [("7", 3, "Clinic", "trunk", "5", "u", 4, 10), ("7", 3, "Clinic", "trunk", "5", "u", 4, 10), ("7", 3, "Clinic", "fvc", None, "u", 9, 11), ("8", 3, "Clinic", "fvc", "1", "u", 2, None)],
        REQUEST,
    )
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    path = _path()
    files.write_requests(rows.mapInPandas(count, rows.schema), path)
    assert seen.value == 4
    lines = [r["value"] for r in spark.read.text(f"{path}/cluster=3").collect()]
    assert len(lines) == 6 and lines.count("cluster: 3|||||") == 2
    at = lines.index("7|Clinic|trunk|5|u|4")
    assert lines[at - 1 : at + 3] == ["cluster: 3|||||", "7|Clinic|trunk|5|u|4", "7|Clinic|trunk|5|u|4", "7|Clinic|fvc|NA|u|9"]
    assert files.read_request_lines(spark, path).count() == 4


def test_legacy_request_file(spark):
    rows = spark.createDataFrame([("7", 3, "Clinic", "trunk", "5", "u", 4, 10)], REQUEST)
    path = _path()
    files.tag_lines(rows).orderBy("line_no").coalesce(1).select("line").write.text(path)
    assert [(r["subject_id"], r["cluster"]) for r in files.read_request_lines(spark, path).collect()] == [("7", 3)]


def test_functions_reach_executors_without_the_package(tmp_path):
    """Task functions travel by value: a worker that cannot import the package runs them."""
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark import cloudpickle\nimport cohortspan\nfrom cohortspan.operators import impute\n"
        "sys.stdout.buffer.write(cloudpickle.dumps(impute.distances))"
    )
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = subprocess.run([sys.executable, "-c", code, repo], cwd=tmp_path, capture_output=True, check=True).stdout
    run = "import sys, pickle, numpy as np; f = pickle.loads(sys.stdin.buffer.read()); print(f(np.zeros((1, 1)), np.ones((2, 1)), np.zeros((1, 2), bool))[0, 0])"
    out = subprocess.run([sys.executable, "-c", run], cwd=tmp_path, input=data, capture_output=True, check=True, env={**os.environ, "PYTHONPATH": ""})
    assert out.stdout.split()[-1] == b"1.0"


def test_prediction_lines(spark):
    df = spark.createDataFrame([(1, 0.5, None)], "subject_id int, fit double, se double")
    assert files.format_predictions(df, ["fit", "se"]).first()["line"] == "0.5|NA"


def test_derived_features_expand_to_their_sources():
    needed = score.stratum_features({1: ("priorSlope", "hands", "onsetAge")}, {"priorSlope": ("onset", "total"), "onsetAge": ("onset", "age")})
    assert needed == {1: ["onset", "total", "hands", "age"]}


def test_new_rows_are_flagged(spark):
    a = spark.createDataFrame([(1, 2.0, 3.0)], "subject_id int, a double, slope double")
    b = spark.createDataFrame([(2, 4.0)], "subject_id int, a double")
    out = score.union_training(a, b)
    assert out.filter(F.col("is_scoring")).first()["slope"] is None
