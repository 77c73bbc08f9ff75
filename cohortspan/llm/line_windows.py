"""Line deduplication by overlapping three-line windows, with DataFrame operations only.

A document's lines are hashed, and every three consecutive lines form a window with a 128-bit hash of its lines'
128-bit hashes. A window is repeated if it also occurs earlier: in a document with a smaller identifier, or earlier in
the same document. All three lines of a repeated window are covered; covered positions merge into spans, and what lies
between the spans is the cleaned text. Windows of three lines without a word never count as repeated.

Only hashes and positions are shuffled, never lines. First occurrences are found by a sum over pre-aggregated rows, and
join back on the hash, where Spark splits a frequent window over several tasks.

Defined results: a null text counts as empty and stays as it is, as does any text of under three lines; a null
identifier sorts before every other one and stays null; rows that repeat an identifier and text are one document and
get the same result (rows with one identifier and several texts count as one document for "earlier"); an empty table
gives an empty result; other columns of the input are not read by ``repeated_spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import NO_ID, given_id

LINES = 3
#: Second seed for the other half of the hashes.
OTHER = 0x5BD1E995


def _key(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_row"), text.alias("_text")]


def line_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per window: ``_id``, ``_row`` (hash of the text), ``pos`` (0 first), ``a`` and ``b`` (its hash)."""
    lines = docs.select(*_key(id_col, text_col)).withColumn("_lines", F.split("_text", "\n")).filter(F.size("_lines") >= LINES)
    line = F.transform("_lines", lambda x: F.struct(
        F.xxhash64(x).alias("a"), F.xxhash64(F.lit(OTHER), x).alias("b"), F.length(F.regexp_replace(x, r"[\x09-\x0D ]", "")).alias("n")))
    hashed = lines.select("_id", "_row", line.alias("_h"))
    windows = F.transform(F.sequence(F.lit(0), F.size("_h") - LINES), lambda i: F.struct(
        i.alias("pos"),
        F.xxhash64(*[F.get("_h", i + k)["a"] for k in range(LINES)], *[F.get("_h", i + k)["b"] for k in range(LINES)]).alias("a"),
        F.xxhash64(*[F.get("_h", i + k)["b"] for k in range(LINES)], *[F.get("_h", i + k)["a"] for k in range(LINES)]).alias("b"),
        sum((F.get("_h", i + k)["n"] for k in range(LINES)), F.lit(0)).alias("n"),
    ))
    return hashed.select("_id", "_row", F.explode(windows).alias("w")).select("_id", "_row", "w.pos", "w.a", "w.b", "w.n").filter("n > 0").drop("n")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with repeated windows: ``_id``, ``_row`` and the sorted arrays ``starts`` and ``ends`` of line spans."""
    windows = line_windows(docs, id_col, text_col)
    per_doc = windows.groupBy("a", "b", "_id", "_row").agg(F.sort_array(F.collect_list("pos")).alias("ps"))
    first = per_doc.groupBy("a", "b").agg(F.min("_id").alias("id0"), F.max("_id").alias("id1"), F.max(F.size("ps")).alias("most"))
    repeated = first.filter("id1 > id0 OR most > 1").select("a", "b", "id0")
    later = F.when(F.col("_id") > F.col("id0"), F.col("ps")).otherwise(F.slice("ps", 2, F.size("ps")))
    hits = per_doc.join(repeated, ["a", "b"]).select("_id", "_row", later.alias("ps")).filter(F.size("ps") > 0)
    covered = hits.groupBy("_id", "_row").agg(F.array_sort(F.flatten(F.collect_list("ps"))).alias("p"))
    return covered.select(
        "_id", "_row",
        F.filter("p", lambda x, i: (i == 0) | (x > F.get("p", i - 1) + LINES)).alias("starts"),
        F.transform(
            F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) > x + LINES)), lambda x: x + LINES,
        ).alias("ends"),
    )


def _kept_lines(lines: Column, starts: Column, ends: Column) -> Column:
    """The lines between the spans, in order."""
    gaps = F.transform(F.sequence(F.lit(0), F.size(starts)), lambda i: F.slice(
        lines,
        F.coalesce(F.get(ends, i - 1), F.lit(0)) + 1,
        F.coalesce(F.get(starts, i), F.size(lines)) - F.coalesce(F.get(ends, i - 1), F.lit(0)),
    ))
    return F.flatten(gaps)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", details: bool = False) -> DataFrame:
    """The input's rows and columns with repeated lines taken out of the text.

    ``details``: instead ``id_col``, ``n_lines``, ``n_removed_lines``, ``n_spans`` and the cleaned ``text_col``.
    """
    row = {name: f"_c{i}" for i, name in enumerate(docs.columns)}  # no input name can clash with the joined ones
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in row.items()])
    spans = repeated_spans(docs, id_col, text_col)
    id_, row_, text = _key(row[id_col], row[text_col])
    lines = F.split("_text", "\n")
    joined = inner.select("*", id_, row_, text).join(spans, ["_id", "_row"], "left")
    cleaned = F.when(F.col("starts").isNull(), F.col(row[text_col])).otherwise(F.array_join(_kept_lines(lines, F.col("starts"), F.col("ends")), "\n"))
    if not details:
        return joined.select(*[(cleaned if c == text_col else F.col(n)).alias(c) for c, n in row.items()])
    removed = F.aggregate(F.zip_with("starts", "ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda t, x: t + x)
    return joined.select(
        given_id("_id").alias(id_col), F.size(lines).cast("long").alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed_lines"),
        F.coalesce(F.size("starts"), F.lit(0)).cast("long").alias("n_spans"), F.coalesce(cleaned, F.lit("")).alias(text_col),
    )
