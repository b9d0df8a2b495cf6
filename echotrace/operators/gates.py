"""Gates of ingest, mentions and reviews, and what checks of bans, watches and settings leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr

#: Reasons of removal that ingest skips, bots whose mentions are ignored, names that stand for no account.
REMOVALS_TO_SKIP = ["deleted", "author", "reddit", "copyright_takedown"]
BOTS = ["sneakpeekbot", "automoderator"]
NO_ACCOUNTS = ["[deleted]", "AutoModerator"]
#: The short link that a watch offer holds.
OFFERED = r"https://redd.it/([A-Za-z0-9]{6})"


def ingested(removal: Column, url: Column) -> Column:
    """Neither removed for a reason to skip nor a moving picture of the one host that serves them as pages; nulls stay."""
    moving = F.contains(url, F.lit("imgur")) & F.contains(url, F.lit("gifv"))
    return ~F.coalesce(removal.isin(REMOVALS_TO_SKIP), F.lit(False)) & ~F.coalesce(moving, F.lit(False))


def answerable(author: Column, created: Column, now: Column) -> Column:
    """A mention with an author that is no known bot, at most a day old."""
    return author.isNotNull() & (created >= now - F.expr("INTERVAL 1 DAY")) & ~F.lower(author).isin(BOTS)


def review_due(name: Column, last_checked: Column, now: Column, days: int = 7) -> Column:
    """Accounts never reviewed, or not for so many whole days."""
    return ~name.isin(NO_ACCOUNTS) & (last_checked.isNull() | (expr.age_days(now, last_checked) >= days))


def recheck_bans(bans: DataFrame, still: DataFrame, key: str, now: Column) -> DataFrame:
    """The ban list after a check: fresh entries stay, older ones get a new time or go if the ban was lifted."""
    marked = bans.join(still.select(key).distinct().withColumn("_still", F.lit(True)), key, "left")
    fresh = expr.age_days(now, F.col("last_checked")) < 1
    kept = marked.where(fresh | F.col("_still").isNotNull())
    return kept.withColumn("last_checked", F.when(fresh, F.col("last_checked")).otherwise(now)).drop("_still")


def promoter_flags(*, whitelisted: Column, links_found: Column, remove: Column, ban: Column, notify: Column) -> dict[str, Column]:
    """Actions on a post of a flagged promoter; a community that only wants a note gets none."""
    off = lambda c: F.coalesce(c, F.lit(False))
    acts = ~off(whitelisted) & off(links_found) & (off(remove) | off(ban))
    return {"remove_post": acts & off(remove), "ban_user": acts & off(ban), "modmail": acts & off(notify)}


def template_due(template: Column, matches: Column, community: Column, most: int = 5) -> Column:
    """Many matches of a picture without a template, in a community for memes."""
    return template.isNull() & (matches > most) & F.contains(F.lower(community), F.lit("meme"))


def offered_post(body: Column, reply: Column) -> Column:
    """The post of a watch offer whose reply says yes, else null."""
    found = F.regexp_extract(body, OFFERED, 1)
    return F.when(F.contains(F.lower(reply), F.lit("yes")) & (found != ""), found)


def new_watches(offers: DataFrame, posts: DataFrame, watches: DataFrame) -> DataFrame:
    """Accepted offers (user, post_id) of posts that exist and that the user doesn't watch, once each."""
    return offers.where(F.col("post_id").isNotNull()).distinct().join(posts.select("post_id").distinct(), "post_id", "left_semi").join(watches, ["user", "post_id"], "left_anti")


def member(names: Column, name: Column) -> Column:
    return F.exists(names, lambda x: F.lower(x) == F.lower(name))


def permitted(permissions: Column, wanted: str) -> Column:
    return F.array_contains(permissions, "all") | F.array_contains(permissions, wanted)


def first_revisions(log: DataFrame, revision: str, at: str, body: str) -> DataFrame:
    """Each revision once, as first logged, with its settings (null if the body is no JSON object) and whether it is valid."""
    first = log.groupBy(revision).agg(F.min_by(F.struct(at, body), at).alias("_first")).select(revision, "_first.*")
    return first.withColumn("settings", F.from_json(body, "map<string,string>")).withColumn("is_valid", F.col("settings").isNotNull())


def changed_settings(new: Column, current: Column, exposed: list[str]) -> Column:
    """The exposed settings whose new value differs from the current one."""
    return F.map_filter(new, lambda k, v: k.isin(exposed) & ~v.eqNullSafe(current[k]))


def with_defaults(table: DataFrame, names: DataFrame, key: str, defaults: dict) -> DataFrame:
    """The table and, for each name that it lacks, a row of the defaults."""
    absent = names.select(key).distinct().join(table.select(key), key, "left_anti")
    return table.unionByName(absent.select(key, *(F.lit(v).alias(k) for k, v in defaults.items())))
