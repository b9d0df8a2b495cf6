"""Rows that searches and accounts leave behind: logs, points, refreshed partitions, retries, second passes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import Settings

#: A limit of a history that stands for all that is shown at once.
ALL_SHOWN = 1000


def with_knobs(searches: DataFrame, settings: Settings) -> DataFrame:
    """Each search with every knob that it ran with, by name."""
    kinds = {"target_title_match": "int", "max_days_old": "int"}
    return searches.select("*", *(F.lit(getattr(settings, f.name)).cast(kinds[f.name]).alias(f.name) if f.name in kinds else F.lit(getattr(settings, f.name)).alias(f.name) for f in fields(settings)))


def search_scope(same_sub: Column) -> Column:
    return F.when(same_sub, "This Sub").otherwise("Reddit")


def checks_titles(target: Column) -> Column:
    """Any target counts, 0 too."""
    return target.isNotNull()


def updated(table: DataFrame, changes: DataFrame, key: str, at: list[str]) -> DataFrame:
    """The table with the last change of each key written over it, nulls too; changes of unknown keys are ignored."""
    named = [c for c in changes.columns if c in table.columns and c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*named), F.struct(*at)).alias("_new"))
    both = table.join(last, key, "left")
    return both.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in named else c for c in table.columns))


def upserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with ``rows`` in place of what it holds for their keys; keys of ``rows`` are unique."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def refreshed(table: DataFrame, fresh: DataFrame, parts: DataFrame) -> DataFrame:
    """The table after the partitions named by ``parts`` were deleted and ``fresh`` came in; a null key is a partition of its own."""
    gone = parts.select(*(F.col(c).alias(f"_{c}") for c in parts.columns)).distinct()
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in parts.columns))
    return table.join(gone, same, "left_anti").unionByName(fresh)


def overwrite_partitions(fresh: DataFrame, path: str, keys: list[str]) -> None:
    """Write only the partitions that ``fresh`` has rows of; the folder's others stay."""
    fresh.write.partitionBy(*keys).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table, with the column that names a post, after those posts were deleted everywhere; a row without a post stays."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    return {name: df.join(ids, F.col(column) == F.col("_gone"), "left_anti") for name, (df, column) in tables.items()}


def reply_routes(replies: DataFrame, bans: DataFrame, key: str) -> DataFrame:
    """``route``: where a community has banned the account its users get a message, elsewhere a reply."""
    banned = bans.select(key).distinct().withColumn("_banned", F.lit(True))
    return replies.join(banned, key, "left").withColumn("route", F.when(F.col("_banned"), "message").otherwise("reply")).drop("_banned")


def point(measurement: str, values: dict[str, Column], tags: dict[str, Column]) -> Column:
    """A point of a time series as JSON: its measurement, fields and tags, null ones too."""
    named = lambda d: F.struct(*(c.alias(n) for n, c in d.items()))
    return F.to_json(F.struct(F.lit(measurement).alias("measurement"), named(values).alias("fields"), named(tags).alias("tags")), {"ignoreNullFields": "false"})


def history(searches: DataFrame, community: str, order: str, *, only_reposts: bool = False, limit: int = -1) -> DataFrame:
    """A community's newest searches, on request only those with matches; -1 shows as many as are shown at once."""
    mine = searches.where(F.col("subreddit") == community)
    mine = mine.where(F.col("matches_found") > 0) if only_reposts else mine
    return mine.orderBy(F.col(order).desc()).limit(ALL_SHOWN if limit == -1 else limit)


def retries_due(failures: DataFrame, key: str, at: str, now: Column, *, most: int = 10, seconds: int = 300) -> DataFrame:
    """Keys that are to be tried again: fewer than ``most`` failures, the last one ``seconds`` ago or more; with the number of failures."""
    tried = failures.groupBy(key).agg(F.count("*").alias("attempts"), F.max(at).alias("_last"))
    return tried.where((F.col("attempts") < most) & (F.col("_last") + F.expr(f"INTERVAL {seconds} SECONDS") <= now)).drop("_last")


def sweep_due(created: Column, checked: Column, now: Column, *, days: int = 90, every: int = 1) -> Column:
    """Whether a post is looked up again: young enough, and last checked long enough ago; one never checked is not."""
    return F.coalesce((created > now - F.expr(f"INTERVAL {days} DAYS")) & (checked < now - F.expr(f"INTERVAL {every} DAYS")), F.lit(False))


def merged(parts: dict[str, DataFrame]) -> DataFrame:
    """Partial results as one, each row with the list that it comes from."""
    return reduce(DataFrame.unionByName, (df.withColumn("list", F.lit(name)) for name, df in parts.items()))


def in_order(requests: DataFrame, ids: str, posts: DataFrame, key: str) -> DataFrame:
    """One row for each requested id that a post has, with its place in the request; unknown ids are left out."""
    return requests.select("*", F.posexplode(ids).alias("place", key)).drop(ids).join(posts, key)


def first_live(matches: DataFrame, status: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """Each group's first match, in order, that answered with 200; a group without one has no row."""
    live = matches.join(status.where(F.col("status") == 200).select(key).distinct(), key, "left_semi")
    return live.groupBy(group).agg(F.min_by(key, F.struct(order, key)).alias(key))


def cached(posts: DataFrame, cache: DataFrame, key: str, value: str, compute: Column) -> DataFrame:
    """Each post's value from the cache, or worked out and marked as ``inserted``; the cache holds a key once."""
    both = posts.join(cache.select(key, F.col(value).alias("_held")), key, "left")
    return both.withColumn(value, F.coalesce("_held", compute)).withColumn("inserted", F.col("_held").isNull()).drop("_held")


def fingerprints_of_channels(rows: DataFrame, ident: str, channels: list[Column]) -> DataFrame:
    """The distinct fingerprints of all channels (arrays) of each recording; a channel that is null adds none.

    A row's fingerprints are one set before anything is shuffled, and recordings of several rows join their sets, so what
    is shuffled is an id and a set for each row.
    """
    own = reduce(F.array_union, [F.coalesce(c, F.array().cast("array<string>")) for c in channels])
    sets = rows.select(ident, own.alias("_own")).groupBy(ident).agg(F.array_distinct(F.flatten(F.collect_list("_own"))).alias("_own"))
    return sets.select(ident, F.explode("_own").alias("fingerprint"))


def right_wins(left: Column, right: Column) -> Column:
    """Two maps as one, in which the right one's values stand for keys of both."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def second_pass(searches: DataFrame, due: Column, key: str, again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Searches after those that are ``due`` made a template of their post and ran ``again`` with it; a post has one template."""
    made = searches.where(due).select(key, F.col(key).alias("_made")).distinct()
    seen = searches.join(made, key, "left").withColumn("template_id", F.coalesce("template_id", "_made")).drop("_made")
    return again(seen)
