"""A training-data pipeline over ``documents``: each stage's rows are written as Parquet and read again for the next.

Stages 1 to 4 return the columns of their input, whatever they are. A null text counts as empty, and the quality rules reject it;
nulls elsewhere pass through; repeated rows are one document to line dedup and leave together or stay together elsewhere; an empty table
passes through empty. The stages keep clean documents: line dedup takes lines, not documents, and the mixing stage drops by chance only
documents that the classifier holds for toxic or poor.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm import bpe, jaccard, line_windows, mixing, quality
from cohortspan.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines in three-line windows that occur earlier; ``n_chars`` follows the text."""
    cleaned = line_windows.clean(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix asks for."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.resample(docs, mixing.label_domains(labels), mixing.TARGETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded again to check the round trip."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.decode(bpe.encode(docs, ranks, pattern), ranks, pattern)
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mixing), ("byte-level BPE", encode),
]
#: Near duplicates, posteriors and merges are beyond SQL; the tests hold each stage against a direct version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k + 1}")
    return docs
