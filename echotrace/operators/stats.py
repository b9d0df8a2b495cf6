"""Leaderboards, windowed counts, time buckets and set algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a leaderboard in days; null is all time.
RANGES = [1, 7, 14, 30, None]
#: What stands for authors whose account is gone; they are never counted.
DELETED = ["[deleted]"]
#: Authors that leaderboards leave out.
EXCLUDED = ["AutoModerator", "AutoNewspaperAdmin"]


def by_range(log: DataFrame, now: Column, at: str, ranges: list[int | None] = RANGES) -> DataFrame:
    """Each row once for every range that it lies in, as ``day_range``; one pass serves all ranges."""
    inside = F.array(*(F.struct(F.lit(d).cast("int").alias("day_range"), (F.lit(True) if d is None else F.col(at) > now - F.expr(f"INTERVAL {d} DAY")).alias("ok")) for d in ranges))
    return log.withColumn("_r", F.explode(F.filter(inside, lambda x: x["ok"]))).withColumn("day_range", F.col("_r.day_range")).drop("_r")


def leaderboard(log: DataFrame, now: Column, at: str, key: str, least: int, limit: int = 100_000, excluded: list | None = None, ranges: list[int | None] = RANGES, left_out: list | None = None) -> DataFrame:
    """Counts by key, kind and range above ``least``, the highest ``limit`` of each; ``left_out`` keys aren't counted, exclusions come after the limit."""
    log = log.where(F.col(key).isNotNull())
    log = log.where(~F.col(key).cast("string").isin(left_out)) if left_out else log
    counts = by_range(log, now, at, ranges).groupBy(key, "post_type", "day_range").agg(F.count("*").alias("repost_count"))
    return highest(counts, key, least, limit, excluded)


def highest(counts: DataFrame, key: str, least: int, limit: int, excluded: list | None) -> DataFrame:
    """Of the counts by key, kind and range those above ``least``, the highest ``limit`` of each kind and range."""
    counts = counts.where(F.col("repost_count") > least)
    # First within lots of keys, so that the last ranking sees ``limit`` rows of each lot at most.
    order = [F.col("repost_count").desc(), F.col(key)]
    top = counts.withColumn("_lot", F.pmod(F.xxhash64(key), F.lit(64)))
    for of in (["post_type", "day_range", "_lot"], ["post_type", "day_range"]):
        top = top.withColumn("_rank", F.row_number().over(Window.partitionBy(*of).orderBy(*order))).where(F.col("_rank") <= limit)
    top = top.drop("_rank", "_lot")
    return top.where(~F.col(key).cast("string").isin(excluded)) if excluded else top


def bucket_means(log: DataFrame, at: str, value: str, seconds: int) -> DataFrame:
    """Means by time bucket, with a row of null for each empty bucket between the first and the last."""
    bucket = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / seconds).cast("bigint")
    means = log.groupBy(bucket.alias("bucket")).agg(F.round(F.avg(value), 6).alias("mean_value"))
    spine = means.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where(F.col("a").isNotNull()).select(F.explode(F.sequence("a", "b")).alias("bucket"))
    return spine.join(means, "bucket", "left").select((F.col("bucket") * seconds).alias("bucket_start"), "mean_value")


def trailing_count(log: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """For each row how many of its key's rows lie in the ``seconds`` before it, itself included, the far end excluded."""
    # A key's time is cut into slices of that length; a row also stands, as a guest, in the slice after its own.
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    slice_ = F.floor(micros / (seconds * 1_000_000))
    rows = log.select("*", micros.alias("_micros"), F.posexplode(F.array(slice_, slice_ + 1)).alias("_guest", "_slice"))
    w = Window.partitionBy(key, "_slice").orderBy("_micros").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return rows.withColumn("trailing", F.count("*").over(w)).where(F.col("_guest") == 0).drop("_micros", "_guest", "_slice")


def gaps(df: DataFrame, ident: str, run: int = 1 << 20) -> DataFrame:
    """Ids after which some are missing, and how many; works in runs of ids, whose edges are compared in a second step."""
    cut = df.select(F.col(ident).alias("i")).distinct().withColumn("run", F.floor(F.col("i") / run))
    inner = cut.withColumn("next", F.lead("i").over(Window.partitionBy("run").orderBy("i")))
    edges = cut.groupBy("run").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    edges = edges.select(F.col("last").alias("i"), F.lead("first").over(Window.partitionBy(F.lit(0)).orderBy("run")).alias("next"))
    both = inner.where(F.col("next").isNotNull()).select("i", "next").unionByName(edges.where(F.col("next").isNotNull()))
    return both.where(F.col("next") - F.col("i") > 1).select(F.col("i").alias("after_id"), (F.col("next") - F.col("i") - 1).alias("missing"))


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and which."""
    left = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("a"))
    return left.unionByName(b.select(key).distinct().join(a.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("b")))


def changed_keys(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each column of each key whose value differs, as strings; null equals null."""
    pairs = lambda side: F.array(*(F.struct(F.lit(c).alias("config_key"), F.col(c).cast("string").alias("v")) for c in columns))
    a = old.select(key, F.explode(pairs(old)).alias("p")).select(key, "p.config_key", F.col("p.v").alias("old_value"))
    b = new.select(key, F.explode(pairs(new)).alias("p")).select(key, "p.config_key", F.col("p.v").alias("new_value"))
    return a.join(b, [key, "config_key"]).where(~F.col("old_value").eqNullSafe(F.col("new_value")))
