"""Continuous ingest as Structured Streaming: de-duplication, stream against history, rate limits, periodic counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, key: str, at: str, horizon: str) -> DataFrame:
    """Each key once within the horizon; state older than the watermark is let go."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark([key])


def first_ever(stream: DataFrame, key: str) -> DataFrame:
    """Each key once for all time.

    The keys that came are state: with state stores of RocksDB (``echotrace.streaming.limits.PROVIDER``) a batch looks up
    its own keys alone, whatever came before, and a restarted or replayed batch goes on from the state of the one before.
    """
    return stream.dropDuplicates([key])


def new_only(batch: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key ``existing`` doesn't hold, each key once. ``existing`` is what it was when it was read: ``append_new`` reads the table anew."""
    return batch.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def append_new(batch: DataFrame, batch_id: int, target: str, key: str) -> None:
    """For foreachBatch: append rows whose key no other batch has stored, each key once, for all time.

    A batch writes its own part of the table, ``batch=<id>``, and overwrites it when it is replayed, so a replay leaves
    one copy; its own rows don't count as stored.
    """
    spark = batch.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fresh = batch.dropDuplicates([key])
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        stored = spark.read.schema(f"`{key}` {batch.schema[key].dataType.simpleString()}, batch bigint").parquet(target)
        fresh = fresh.join(stored.where(F.col("batch") != batch_id).select(key), key, "left_anti")
    fresh.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")


def against_history(stream: DataFrame, history: DataFrame, key: str, at: str) -> DataFrame:
    """New posts with the oldest stored post of the same content, which is summed up beforehand."""
    oldest = history.groupBy(key).agg(F.min_by("id", F.struct(at, "id")).alias("repost_of_id"), F.min(at).alias("first_at"))
    return stream.join(oldest, key).where(F.col("first_at") < F.col(at))


def watched(matches: DataFrame, watches: DataFrame, at: str | None = None) -> DataFrame:
    """Notifications: matches whose original has an enabled watch that has not expired (``expires_at``, null: never) at the match's time, or now where no time is named."""
    expires = F.col("expires_at") if "expires_at" in watches.columns else F.lit(None).cast("timestamp")
    active = watches.where(F.col("enabled")).select(F.col("post_id").alias("repost_of_id"), "user", expires.alias("_expires"))
    both = matches.join(active, "repost_of_id")
    when = F.current_timestamp() if at is None else F.col(at)
    return both.where(F.col("_expires").isNull() | (when < F.col("_expires"))).drop("_expires")


def with_last_detection(watches: DataFrame, notified: DataFrame, at: str) -> DataFrame:
    """The watches after a batch of notifications: each one's latest match, if that is later than what it holds."""
    latest = notified.groupBy(F.col("repost_of_id").alias("post_id"), "user").agg(F.max(at).alias("_at"))
    both = watches.join(latest, ["post_id", "user"], "left")
    return both.withColumn("last_detection", F.greatest("last_detection", "_at")).drop("_at").select(*watches.columns)


def hourly_requests(stream: DataFrame, user: str, at: str, limit: int) -> DataFrame:
    """Users above the limit in any hour that slides by ten minutes."""
    counts = stream.withWatermark(at, "1 hour").groupBy(F.window(at, "1 hour", "10 minutes"), user).agg(F.count("*").alias("requests"))
    return counts.where(F.col("requests") > limit)


def periodic_counts(stream: DataFrame, at: str, every: str, *keys: str) -> DataFrame:
    return stream.withWatermark(at, every).groupBy(F.window(at, every), *keys).agg(F.count("*").alias("n"))


def fan_out(batch: DataFrame, kind: str, sinks: dict[str, str], batch_id: int | None = None) -> None:
    """For foreachBatch: each kind of post added to its own table, from one cached pass.

    With ``batch_id`` a batch overwrites its own part of each table (``batch=<id>``), so a replay adds nothing twice.
    """
    batch.persist()
    try:
        for name, target in sinks.items():
            rows = batch.where(F.col(kind) == name).write
            rows.mode("append").parquet(target) if batch_id is None else rows.mode("overwrite").parquet(f"{target}/batch={batch_id}")
    finally:
        batch.unpersist()
