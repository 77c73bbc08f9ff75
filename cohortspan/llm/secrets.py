"""Secret scan: candidate strings, and a random forest that tells secrets from false positives. DataFrame operations only.

Candidates are runs of ``[A-Za-z0-9+/_=-]`` of at least ``LEAST`` characters. What the forest sees of one: its length, how often
neighbouring characters change class and how many are digits, the share of its letter triples that frequent words of the
corpus have (dictionary coverage), the path's depth and words like "test" in it, and the words beside it. It is trained on labelled
findings; without any, ``weak_labels`` labels those that a credential's name is assigned to or that plainly are something else.

The dictionary comes from counts over all documents and has a fixed size; the labelled findings that the forest is fitted on are bounded by
``TRAIN_ROWS``, by a hash, half of them secrets if there are that many.

Defined results: a null or empty text has no candidates; a null path counts as empty; a null identifier stays null; rows that repeat an
identifier and text are one document; without labelled findings of both kinds the result has the weak labels' verdict and a null
probability; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.llm.common import NO_ID, given_id, materialize

LEAST = 16
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % LEAST
#: Words in the dictionary, labelled findings for the fit at most, characters of context on either side.
DICTIONARY_WORDS, TRAIN_ROWS, CONTEXT = 5000, 20_000, 40
TREES, DEPTH = 24, 6
#: Names of credentials, and words that speak against one.
CREDENTIAL = r"(?i)(token|secret|passw|api|auth|credential|bearer|key)"
ASSIGNED = CREDENTIAL + r"\w*[\"']?\s*(=|:|=>)\s*[\"']?$"
PLACEHOLDER = r"(?i)(example|sample|test|dummy|fake|placeholder|xxxx|your)"
FEATURES = ("length", "changes", "digits", "uppers", "distinct", "coverage", "depth", "path_test", "named", "assigned", "quoted", "placeholder", "prose")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``_id``, ``_h`` (hash of the text), ``start`` (code point), ``candidate``, ``before``, ``after``, ``path``; each once."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    path = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_h"), path.alias("path"), text.alias("_text"))
    found = F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0))
    rows = rows.select("_id", "_h", "path", found.alias("c"), F.split("_text", CANDIDATE, -1).alias("p")).filter(F.size("c") > 0)
    parts = F.transform("c", lambda c, k: F.struct(
        c.alias("candidate"), F.right(F.get("p", k), F.lit(CONTEXT)).alias("before"), F.left(F.get("p", k + 1), F.lit(CONTEXT)).alias("after"),
        F.length(F.get("p", k)).alias("gap")))
    each = rows.select("_id", "_h", "path", F.posexplode(parts).alias("k", "x")).select("_id", "_h", "path", "k", "x.*")
    each = each.repartition("_id", "_h").dropDuplicates(["_id", "_h", "k"])
    so_far = Window.partitionBy("_id", "_h").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.col("gap") + F.length("candidate")).over(so_far) - F.length("candidate")
    return each.select("_id", "_h", "path", start.alias("start"), "candidate", "before", "after")


def _triples(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - 2), lambda i: F.substring(word, i, F.lit(3)))


def dictionary(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> DataFrame:
    """Letter triples of the ``words`` most frequent words of 3 to 15 letters; ties go to the smaller word."""
    word = F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), F.lit(r"\b[a-z]{3,15}\b"), F.lit(0)))
    counts = docs.select(word.alias("word")).groupBy("word").count()
    top = counts.orderBy(F.desc("count"), "word").limit(words)
    return top.select(F.explode(_triples(F.col("word"))).alias("triple")).distinct()


def features(found: DataFrame, triples: DataFrame) -> DataFrame:
    """The findings with ``FEATURES``. Coverage is worked out once per different candidate."""
    triples = F.broadcast(materialize(triples, "triples"))  # at most 13 * DICTIONARY_WORDS rows of three letters
    lower = F.lower(F.regexp_replace("candidate", "[^A-Za-z]", ""))
    different = found.select("candidate").distinct().withColumn("t", F.explode(F.when(F.length(lower) >= 3, _triples(lower)).otherwise(F.array(F.lit("")))))
    known = different.join(triples, F.col("t") == F.col("triple"), "left").groupBy("candidate").agg(F.avg(F.col("triple").isNotNull().cast("double")).alias("share"))
    c = F.col("candidate")
    n = F.length(c)
    count = lambda pattern: F.regexp_count(c, F.lit(pattern))
    says = lambda column, pattern: F.col(column).rlike(pattern).cast("double")
    letters = F.length(F.regexp_replace("candidate", "[^A-Za-z]", "")) / n
    return found.join(known, "candidate").select(
        "*", n.cast("double").alias("length"),
        (count(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n).alias("changes"),
        (count("[0-9]") / n).alias("digits"), (count("[A-Z]") / n).alias("uppers"),
        (F.size(F.array_distinct(F.split("candidate", ""))) / n).alias("distinct"),
        (F.col("share") * letters).alias("coverage"),
        F.regexp_count("path", F.lit("/")).cast("double").alias("depth"), says("path", r"(?i)(test|mock|fixture|example|doc)").alias("path_test"),
        says("before", CREDENTIAL).alias("named"), says("before", ASSIGNED).alias("assigned"), says("before", r"[\"'`]$").alias("quoted"),
        says("before", PLACEHOLDER).alias("placeholder"), (says("before", r"[A-Za-z,.] $") * says("after", r"^[ ,.]")).alias("prose"),
    ).drop("share")


def weak_labels(found: DataFrame) -> DataFrame:
    """The findings with ``label``: 1 if assigned to a credential's name and not plain words, 0 if in prose or all digits, null if unsure."""
    wordlike = F.col("digits") == 0
    yes = (F.col("assigned") == 1) & (F.col("placeholder") == 0) & ~wordlike
    no = (F.col("assigned") == 0) & (wordlike | (F.col("digits") == 1) | (F.col("prose") == 1))
    return found.withColumn("label", F.when(yes, 1.0).when(no | ((F.col("assigned") == 1) & wordlike), 0.0))


def train(labelled: DataFrame, most: int = TRAIN_ROWS):
    """A forest from findings with ``FEATURES`` and ``label``; None unless both labels occur."""
    known = labelled.filter(F.col("label").isNotNull()).select(*FEATURES, "label", F.xxhash64("candidate", "before", "after").alias("_r"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    half = most // 2
    want = {1.0: max(half, most - counts[0.0]), 0.0: max(half, most - counts[1.0])}
    share = F.when(F.col("label") == 1.0, min(1.0, want[1.0] / counts[1.0])).otherwise(min(1.0, want[0.0] / counts[0.0]))
    sample = materialize(known.filter(F.pmod("_r", F.lit(1 << 20)) < share * (1 << 20)).drop("_r"), "findings")
    if sample.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(sample)
    return RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=5, featureSubsetStrategy="sqrt").fit(rows)


def judge(found: DataFrame, model) -> DataFrame:
    """The findings with ``probability`` and ``is_secret``."""
    if model is None:
        return weak_labels(found).withColumn("probability", F.lit(None).cast("double")).withColumn("is_secret", F.coalesce(F.col("label") == 1, F.lit(False))).drop("label")
    rows = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(found))
    rows = rows.withColumn("probability", vector_to_array("probability")[1])
    return rows.withColumn("is_secret", F.col("probability") >= 0.5).drop("_x", "rawPrediction", "prediction")


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """Per candidate: identifier, ``start``, ``length``, ``candidate``, ``probability``, ``is_secret``.

    ``labelled``: ``id_col``, ``start`` and ``label`` (1 or 0) of known findings; weak labels if there is no such table.
    """
    found = materialize(features(candidates(docs, id_col, text_col, path_col), dictionary(docs, text_col)), "candidates")
    if labelled is None:
        known = weak_labels(found)
    else:
        told = labelled.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("_id"), "start", F.col("label").cast("double").alias("label"))
        known = found.join(told.dropDuplicates(["_id", "start"]), ["_id", "start"])
    rows = judge(found, train(known))
    return rows.select(
        given_id("_id").alias(id_col), F.col("start").cast("long").alias("start"), F.length("candidate").cast("long").alias("length"), "candidate",
        "probability", "is_secret")
