"""Exact deduplication by a content sort, with DataFrame operations only.

Texts are range-partitioned by sampled splitters and sorted inside the partitions, so that equal texts end up side by
side; a window over the full text compares neighbours. A text that fills a large share of a sample would be one task's
work: its rows get a salt beside the text, so that sampled splitters cut the group too, and the parts of these few
texts meet again as one pre-aggregated row per text and salt.

Defined results: a null text counts as empty; empty texts are equal to each other; a null identifier sorts before every
other one and stays null; rows that repeat an identifier and text are members of one group, and all rows that carry the
keeper's identifier are kept; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.llm.common import given_id, materialize, numbered

#: Sampled rows per partition; a text with this many sampled copies gets salted.
SAMPLE_PER_PARTITION, HOT_COPIES = 64, 16
#: Characters of a text that splitters compare.
PREFIX_CHARS = 32


def partitions_for(docs: DataFrame) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def hot_texts(texts: DataFrame, parts: int) -> list[str]:
    """SHA-256 of the texts that hold a noticeable share of a sample; at most sampled rows / ``HOT_COPIES`` of them."""
    rows = texts.count()
    want = SAMPLE_PER_PARTITION * parts
    sample = texts if rows <= want else texts.sample(want / rows, seed=11)
    found = sample.groupBy(F.sha2("_text", 256).alias("sha")).count().filter(F.col("count") >= HOT_COPIES)
    return [r.sha for r in found.select("sha").collect()]


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", parts: int | None = None) -> DataFrame:
    """Per row: identifier, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. ``keep``: "smallest" or "largest"."""
    parts = parts or partitions_for(docs)
    rows = numbered(docs, id_col, text_col)
    hot = hot_texts(rows, parts)
    pick = F.max if keep == "largest" else F.min
    sha = F.sha2("_text", 256)
    salt = F.when(sha.isin(hot), F.pmod(F.xxhash64("_id"), F.lit(8 * parts))) if hot else F.lit(None)
    # Ranges are cut by a prefix, and by a hash among texts with one prefix, so that the splitters that Spark samples stay
    # short. Equal texts (and salts) lie in one range; the window needs no further exchange, only the sort in the ranges.
    place = ["_prefix", "_hash", "_salt"]
    sorted_ = rows.select(
        "_id", "_text", F.substring("_text", 1, PREFIX_CHARS).alias("_prefix"), F.xxhash64("_text").alias("_hash"),
        F.coalesce(salt, F.lit(-1)).cast("long").alias("_salt"),
    ).repartitionByRange(parts, *place)
    equal = Window.partitionBy("_text", *place)
    runs = sorted_.select("_id", "_salt", sha.alias("sha"), pick("_id").over(equal).alias("keep"), F.count("*").over(equal).alias("size"))
    if hot:
        runs = materialize(runs, "content-runs")  # identifiers and digests, no text
        whole = (
            runs.filter("_salt >= 0").groupBy("sha", "_salt").agg(F.first("keep").alias("keep"), F.first("size").alias("size"))
            .groupBy("sha").agg(pick("keep").alias("all_keep"), F.sum("size").alias("all_size"))
        )
        runs = (  # one row per hot text, at most sampled rows / HOT_COPIES: 4 rows per partition
            runs.join(F.broadcast(whole), "sha", "left")
            .withColumn("keep", F.coalesce("all_keep", "keep")).withColumn("size", F.coalesce("all_size", "size"))
        )
    return runs.select(
        given_id("_id").alias(id_col), given_id("keep").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("_id") == F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The identifiers that stay, with the size of their groups."""
    return mark_copies(docs, id_col, text_col, keep).filter("kept").select(id_col, "group_size")
