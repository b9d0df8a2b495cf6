"""The model's tables, derived from the driver's: posts, links, image hashes, a log of reposts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr

#: What the queries take for now.
NOW = "2024-01-31 00:00:00"
START = "2024-01-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text posts, one a minute; the content hash is the md5 of the text."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), expr.base36(F.col("doc_id")).alias("post_id"), F.col("source").alias("author"), F.col("lang").alias("community"),
        F.col("doc_id").alias("minute"), F.md5(F.col("text").cast("binary")).alias("url_hash"), F.col("n_chars"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", "html", expr.host(F.col("url")).alias("host"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", expr.bit_hash(F.col("embedding")).alias("hash"), "embedding")


def signatures(spark: SparkSession, sf_dir: str, digits: int = 1) -> DataFrame:
    """Documents as pictures: their hash is the signature of their words, of 16 times ``digits`` digits."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("minute"), F.col("source").alias("author"), F.col("lang").alias("community"), expr.signature(F.col("text"), digits).alias("hash"))


def text_vectors(spark: SparkSession, sf_dir: str, size: int = 64) -> DataFrame:
    """Each distinct text by its least id, as a vector: every distinct word adds or takes one at a place by its md5 sum.

    Vectors are made where the texts are read, so neither texts nor words are shuffled. A text without words has none.
    """

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        known, out = {}, []
        for t in texts.cast(pa.large_binary()).to_pylist():
            words = set(t.split())
            for w in words:
                if w not in known:
                    m = hashlib.md5(w).digest()
                    known[w] = 2 * (m[0] * size // 256) + (m[1] >= 128)
            counts = np.bincount([known[w] for w in words], minlength=2 * size).astype(np.int32)
            out.append(counts[1::2] - counts[::2] if words else None)
        return pa.array(out, type=pa.list_(pa.int32()))

    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    each = d.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), of(F.col("text")).alias("v"))
    least = each.groupBy("h").agg(F.min_by(F.struct("doc_id", "v"), "doc_id").alias("t")).where(F.col("t.v").isNotNull())
    return least.select(F.col("t.doc_id").alias("id"), F.col("t.v").cast("array<double>").alias("embedding"))


def reposts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log: who (author), what kind (post_type), of what (repost_of_id), when."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("author"), F.col("event_type").alias("post_type"), F.get_json_object("props", "$.k").cast("bigint").alias("repost_of_id"), F.col("ts").alias("detected_at"), "value")
