"""From raw documents to packed batches: quality rules, near copies, personal data, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.llm import jaccard_join, mixing, packing, pii, quality_rules
from echotrace.llm.common import discard, documents, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned one rejects go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8) the document with the least id stays."""
    return jaccard_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in angle brackets."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sources below their target weight come repeatedly; none is lost."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its bucket, batch and place."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("near copies", near_copies), ("personal data", personal_data), ("mixing", mix), ("packing", pack)]

#: The rules are learned and the mix is drawn by hashes that SQL engines don't share.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; a stage's table is deleted once the next one is written.

    Null ids stay, each as a document of its own; rows of one id are one document to the near copies and are packed one
    by one. An empty table gives an empty result. Further columns are carried along up to packing.
    """
    docs, last = documents(spark, sf_dir), None
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        discard(last)
        last = docs
    return docs
