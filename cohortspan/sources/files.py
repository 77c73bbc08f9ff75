"""Text and parquet readers and writers of the pipeline's tables. Schemas are always explicit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import small_or_stored
from .bundles import file_names, read_text, write_text

FORM_SCHEMA = (
    "subject_id string, form_name string, feature_name string, feature_value string, feature_unit string, feature_delta string"
)
SLOPE_SCHEMA = "subject_id string, slope double"
SURVIVAL_SCHEMA = "subject_id string, time_event double, status int"
CLUSTER_TAG = r"^cluster: (\d+)"


def _delimited(spark: SparkSession, path: str, schema: str, header: bool) -> DataFrame:
    return spark.read.schema(schema).options(sep="|", header=header, nullValue="NA").csv(path)


def read_forms(spark: SparkSession, path: str, *, header: bool = True) -> DataFrame:
    """Long forms, with or without a header line.

    ``row_seq`` keeps the order of files by name and of the rows in a file, set before any shuffle. Spark packs files by size, so
    its own row numbers order rows inside a file only.
    """
    rows = _delimited(spark, path, FORM_SCHEMA, header)
    return rows.withColumn("row_seq", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row")))


def split_lines(spark: SparkSession, path: str, *, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Long forms, and the lines that do not fit: (file, line, reason).

    A line fits if its quotes are paired, it has as many fields as the schema and names a subject; lines of blanks and headers are no rows. A bar inside
    quotes separates nothing.
    """
    fields = [c.split()[0] for c in FORM_SCHEMA.split(", ")]
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("_row"))
    lines = lines.filter(F.trim("line") != "")
    if header:
        lines = lines.filter(F.col("line") != "|".join(fields))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    count = F.size(F.split(F.regexp_replace("line", '"[^"]*"', ""), r"\|"))
    reason = (
        F.when(quotes % 2 == 1, "quote").when(count < len(fields), "short").when(count > len(fields), "long")
        .when(F.trim(F.split("line", r"\|")[0]).isin("", "NA"), "subject")
    )
    judged = lines.withColumn("reason", reason)
    row = F.from_csv("line", FORM_SCHEMA, {"sep": "|", "nullValue": "NA"})
    good = judged.filter(F.col("reason").isNull()).select(row.alias("r"), F.struct("file", F.col("_row").alias("row")).alias("row_seq")).select("r.*", "row_seq")
    return good, judged.filter(F.col("reason").isNotNull()).select("file", "line", "reason")


def read_forms_checked(spark: SparkSession, path: str, quarantine: str, *, header: bool = True) -> DataFrame:
    """Long forms; lines that do not fit go to the table ``quarantine`` with file and reason."""
    good, bad = split_lines(spark, path, header=header)
    save_table(bad, quarantine)
    return good


def read_slope(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, SLOPE_SCHEMA, True)


def read_survival(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, SURVIVAL_SCHEMA, True)


def write_forms(forms: DataFrame, path: str, *, header: bool = True) -> None:
    columns = [c.split()[0] for c in FORM_SCHEMA.split(", ")]
    forms.select(*[F.col(c).cast("string") for c in columns]).write.options(sep="|", header=header, nullValue="NA").csv(path)


def save_table(df: DataFrame, path: str, *, by: str | None = None) -> None:
    writer = df.write.mode("error")
    (writer.partitionBy(by) if by else writer).parquet(path)


def load_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def append_audit(df: DataFrame, path: str, stage: str, run: str) -> bool:
    """Copy of requests or responses for later inspection, once per ``run``.

    A run's rows count from the moment its commit record is there, which is written last. A run that is already recorded is left as it is
    (False); what an attempt that died has left is written over.
    """
    spark = df.sparkSession
    record = f"{path}/_commits/{stage}={run}"
    if read_text(spark, record) is not None:
        return False
    df.write.mode("overwrite").parquet(f"{path}/stage={stage}/run={run}")
    write_text(spark, record, f"{stage} {run}")
    return True


def read_audit(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all recorded runs with ``stage`` and ``run``."""
    runs = [f for f in file_names(spark, f"{path}/_commits") if "=" in f]
    tables = [
        load_table(spark, f"{path}/stage={stage}/run={run}", schema).withColumns({"stage": F.lit(stage), "run": F.lit(run)})
        for stage, run in (f.split("=", 1) for f in runs)
    ]
    if not tables:
        return spark.createDataFrame([], schema).withColumns({"stage": F.lit(""), "run": F.lit("")})
    return reduce(DataFrame.unionByName, tables)


def _request_line() -> Column:
    """A form row as request text."""
    fields = ["subject_id", "form_name", "feature_name", "feature_value", "feature_unit", "feature_delta"]
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in fields])


def _tag_line() -> Column:
    return F.concat(F.lit("cluster: "), F.col("cluster").cast("string"), F.lit("|||||"))


def tag_lines(selected: DataFrame) -> DataFrame:
    """Legacy request text per subject: the stratum line, then that subject's rows in file order."""
    head = selected.select("subject_id", "cluster").distinct().select(
        "subject_id", F.lit(-1).cast("bigint").alias("line_no"), _tag_line().alias("line"),
    )
    place = F.row_number().over(Window.partitionBy("subject_id").orderBy("row_seq")).cast("bigint")
    return head.unionByName(selected.select("subject_id", place.alias("line_no"), _request_line().alias("line")))


def parse_cluster_tag(lines: DataFrame, column: str = "line") -> DataFrame:
    """Stratum number of legacy request text; null on ordinary lines."""
    tag = F.regexp_extract(F.col(column), CLUSTER_TAG, 1)
    return lines.withColumn("cluster", F.when(tag != "", tag.cast("int")))


def write_requests(selected: DataFrame, path: str) -> None:
    """One folder per stratum; in its files each subject's tag line, then its rows in order.

    The rows move once at most: where they lie by subject already, they are sorted and written there. The tag line goes out with the first row.
    """
    order = ["cluster", "subject_id", "row_seq"]
    rows = selected.select(*order, _request_line().alias("line"))
    first = F.row_number().over(Window.partitionBy("cluster", "subject_id").orderBy("row_seq")) == 1
    lines = rows.withColumn("_first", first).sortWithinPartitions("cluster", "subject_id", "row_seq", F.col("_first").desc())
    line = F.when(F.col("_first"), F.concat_ws("\n", _tag_line(), "line")).otherwise(F.col("line"))
    lines.select("cluster", line.alias("line")).write.partitionBy("cluster").text(path)


def read_request_lines(spark: SparkSession, path: str) -> DataFrame:
    """Request lines with their subject (the first field) and the stratum that their file's tag lines name.

    A file holds subjects of one stratum: those that ``write_requests`` writes many, a legacy file one. Few files are a parameter table, so
    their lines do not move.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))
    tagged = parse_cluster_tag(lines)
    strata = small_or_stored(tagged.filter(F.col("cluster").isNotNull()).groupBy("file").agg(F.max("cluster").alias("cluster")), "files")
    rows = tagged.drop("cluster").filter(~F.col("line").rlike(CLUSTER_TAG)).join(strata, "file")
    return rows.select(F.split("line", r"\|")[0].alias("subject_id"), "cluster", "line")


def parse_request_rows(lines: DataFrame) -> DataFrame:
    """The form rows of request lines."""
    fields = [c.split()[0] for c in FORM_SCHEMA.split(", ")]
    parts = F.split("line", r"\|")
    return lines.select("cluster", *[F.nullif(F.get(parts, F.lit(i)), F.lit("NA")).alias(c) for i, c in enumerate(fields)])


def format_predictions(scored: DataFrame, columns) -> DataFrame:
    """One output line per subject: the prediction fields joined with a bar."""
    return scored.select("subject_id", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns]).alias("line"))


def write_predictions(lines: DataFrame, path: str) -> None:
    lines.select("line").write.text(path)
