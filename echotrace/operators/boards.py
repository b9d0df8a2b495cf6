"""Leaderboards that are kept up to date: a refresh reads new days of the log, not its history.

A folder holds partial counts by day and totals up to a settled day. A refresh counts the days that aren't settled, writes
them over what stood there, and moves the totals on by the days that settle now, into a new folder of their own, so a
refresh that breaks off or is repeated leaves the same. A sliding range is the sum of its whole days and of two pieces of
the log: what lies in the range of the day that it begins in, and the present day.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import delete
from . import stats


class Board:
    """Counts of ``key`` by ``post_type`` over ranges of days.

    ``at`` is the log's column of time; ``left_out`` are keys that are never counted. A day is settled ``late`` days after
    it ended: rows that come later than that are not seen.
    """

    def __init__(self, folder: str, at: str, key: str, *, left_out: list[str] | None = None, late: int = 1) -> None:
        self.folder, self.at, self.key, self.left_out, self.late = folder.rstrip("/"), at, key, left_out or [], late

    def _settled(self, spark: SparkSession) -> date | None:
        """The day up to which the newest whole totals reach."""
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/totals")
        files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(place):
            return None
        whole = [f.getPath() for f in files.listStatus(place) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return max((date.fromisoformat(p.getName().split("=")[1]) for p in whole), default=None)

    def _counts(self, log: DataFrame, *more: str) -> DataFrame:
        rows = log.where(F.col(self.key).isNotNull())
        rows = rows.where(~F.col(self.key).cast("string").isin(self.left_out)) if self.left_out else rows
        return rows.groupBy(*more, self.key, "post_type").agg(F.count("*").alias("n"))

    def _days(self, spark: SparkSession, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.folder}/days")

    def update(self, log: DataFrame, now: datetime) -> None:
        """Count what isn't settled of the days before ``now``, and settle what can be."""
        spark, today = log.sparkSession, now.date()
        settled, settles = self._settled(spark), today - timedelta(days=1 + self.late)
        at = F.col(self.at)
        rows = log.where(at < F.lit(today)) if settled is None else log.where((at >= F.lit(settled + timedelta(days=1))) & (at < F.lit(today)))
        days = self._counts(rows.withColumn("day", F.to_date(at)), "day")
        days.repartition("day").write.mode("overwrite").partitionBy("day").option("partitionOverwriteMode", "dynamic").parquet(f"{self.folder}/days")
        if settled is not None and settles <= settled:
            return
        mine = self._days(spark, days.schema).where(F.col("day") <= F.lit(settles))
        if settled is not None:
            mine = mine.where(F.col("day") > F.lit(settled))
        mine = mine.select(self.key, "post_type", "n")
        if settled is not None:
            mine = mine.unionByName(spark.read.schema(mine.schema).parquet(f"{self.folder}/totals/upto={settled}"))
        mine.groupBy(self.key, "post_type").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{self.folder}/totals/upto={settles}")
        if settled is not None:
            delete(spark, f"{self.folder}/totals/upto={settled}")

    def refresh(self, log: DataFrame, now: datetime, least: int, limit: int = 100_000, excluded: list | None = None, ranges: list[int | None] = stats.RANGES) -> DataFrame:
        """The board at ``now``, after an update: as ``stats.leaderboard`` over the whole log."""
        self.update(log, now)
        spark, at, today = log.sparkSession, F.col(self.at), F.lit(now.date())
        present = self._counts(log.where(at >= today))
        schema = self._counts(log.withColumn("day", F.to_date(at)), "day").schema
        days = self._days(spark, schema)
        parts = []
        for length in ranges:
            if length is None:
                settled = self._settled(spark)
                past = days.where((F.col("day") > F.lit(settled)) & (F.col("day") < today)).select(self.key, "post_type", "n")
                past = past.unionByName(spark.read.schema(past.schema).parquet(f"{self.folder}/totals/upto={settled}"))
            else:
                since = now - timedelta(days=length)
                first = F.lit(since.date())
                past = days.where((F.col("day") > first) & (F.col("day") < today)).select(self.key, "post_type", "n")
                past = past.unionByName(self._counts(log.where((at > F.lit(since)) & (at < F.lit(min(since.date() + timedelta(days=1), now.date()))))))
            parts.append(past.unionByName(present).groupBy(self.key, "post_type").agg(F.sum("n").alias("repost_count")).withColumn("day_range", F.lit(length).cast("int")))
        counts = parts[0]
        for more in parts[1:]:
            counts = counts.unionByName(more)
        return stats.highest(counts.select(self.key, "post_type", "day_range", "repost_count"), self.key, least, limit, excluded)
