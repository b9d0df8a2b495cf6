"""What follows from a check, by the flags of the community: rows of actions with what each of them needs.

Nothing is carried out here; a row says what is to be done to which post or user, with its reason or text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import templates

#: Below this a community's threshold is taken for a mistake, and nothing is done.
LEAST_THRESHOLD = 10
NOTE = "High volume of reposts detected"
# The wording of messages to moderators.
HIGH_VOLUME_MAIL = "User [u/{username}](https://reddit.com/u/{username}) has been flagged as a high volume reposter.\n\nThey just created [this submission](https://redd.it/{post_id}) on [r/{subreddit}](https://reddit.com/r/{subreddit}) \n\nIn the last 7 days I have detected {repost_count} reposts created by them"
REPOST_MAIL = "I found a repost in [r/{subreddit}](https://reddit.com/r/{subreddit})\n\n**Matches:** {match_count}\n\n**Author:** [u/{author}](https://reddit.com/u/{author})\n\n**Title:** {title}\n\n**Permalink:** https://reddit.com{perma_link}\n\n**Oldest Match:** https://reddit.com{oldest_match}\n\n"
ACTION = "action string, reason string, text string, sticky boolean, locked boolean"


def removal_reasons(wanted: DataFrame, reasons: DataFrame) -> DataFrame:
    """``wanted`` (community, reason) with ``reason_id``: the community's first reason (reason_id, title, place) of that title in any case; null if it has none."""
    title = F.lower("title")
    first = reasons.groupBy("community", title.alias("_title")).agg(F.min_by("reason_id", "place").alias("reason_id"))
    both = wanted.join(first.withColumnRenamed("community", "_community"), (F.col("community") == F.col("_community")) & (F.lower("reason") == F.col("_title")) & (F.col("reason") != ""), "left")
    return both.drop("_community", "_title")


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _rows(df: DataFrame, keys: list[str], wanted: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """One row of ACTION for each condition that holds."""
    none = {"reason": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "sticky": F.lit(None).cast("boolean"), "locked": F.lit(None).cast("boolean")}
    each = [F.when(c, F.struct(*(x.alias(n) for n, x in ({"action": with_["action"]} | none | with_).items()))) for c, with_ in wanted]
    return df.select(*keys, F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("_a")).select(*keys, "_a.*")


def high_volume(posts: DataFrame, communities: DataFrame, counts: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Actions on new posts (post_id, author, community) whose authors have many reposts (``counts``: author, repost_count).

    ``communities`` has community, high_volume_reposter_threshold, _remove_post, _ban_user and _notify_mod_mail flags and
    the reasons for both; ``whitelist`` has author, community and ignore_high_volume_repost_detection. A community without
    any flag, or with a threshold below LEAST_THRESHOLD or none, does nothing.
    """
    spared = whitelist.where(_flag("ignore_high_volume_repost_detection")).select("author", "community").distinct()
    rows = posts.join(communities, "community").join(counts, "author").join(spared, ["author", "community"], "left_anti")
    name = "high_volume_reposter"
    rows = rows.where((F.col(f"{name}_threshold") >= LEAST_THRESHOLD) & (F.col("repost_count") > 0) & (F.col("repost_count") >= F.col(f"{name}_threshold")))
    mail = templates.filled(F.lit(HIGH_VOLUME_MAIL), templates.values(username=F.col("author"), subreddit=F.col("community"), post_id=F.col("post_id"), repost_count=F.col("repost_count")))
    ban_reason = F.col(f"{name}_ban_reason")
    return _rows(rows, ["post_id", "author", "community"], [
        (_flag(f"{name}_remove_post"), {"action": F.lit("remove_post"), "reason": F.col(f"{name}_removal_reason"), "text": F.lit(NOTE)}),
        (_flag(f"{name}_ban_user"), {"action": F.lit("ban_user"), "reason": F.when(ban_reason != "", ban_reason).otherwise(NOTE)}),
        (_flag(f"{name}_notify_mod_mail"), {"action": F.lit("mod_mail"), "text": mail}),
    ])


def on_results(results: DataFrame, communities: DataFrame) -> DataFrame:
    """Actions on checked posts: post_id, author, community, title, perma_link, match_count, oldest_match, ``message`` and ``report`` (as ``replies`` makes them).

    ``communities`` has community, removal_reason and the flags comment_on_repost, comment_on_oc, remove_repost, lock_post,
    mark_as_oc, report_reposts, send_repost_modmail, sticky_comment and lock_response_comment. Without matches nothing is
    done unless comment_on_oc is set.
    """
    rows = results.join(communities, "community")
    repost = F.col("match_count") > 0
    mail = templates.filled(F.lit(REPOST_MAIL), templates.values(subreddit=F.col("community"), match_count=F.col("match_count"), author=F.col("author"), title=F.col("title"), perma_link=F.col("perma_link"), oldest_match=F.col("oldest_match")))
    original = ~repost & _flag("comment_on_oc")
    return _rows(rows, ["post_id", "author", "community"], [
        (repost & _flag("report_reposts"), {"action": F.lit("report_post"), "text": F.col("report")}), (repost & _flag("lock_post"), {"action": F.lit("lock_post")}),
        (repost & _flag("remove_repost"), {"action": F.lit("remove_post"), "reason": F.col("removal_reason")}), (original & _flag("mark_as_oc"), {"action": F.lit("mark_as_oc")}),
        (repost & _flag("send_repost_modmail"), {"action": F.lit("mod_mail"), "text": mail}),
        ((repost | original) & _flag("comment_on_repost"), {"action": F.lit("comment"), "text": F.col("message"), "sticky": _flag("sticky_comment"), "locked": _flag("lock_response_comment")}),
    ])


def recent(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """What stays after rows older than ``days`` were deleted; a row without a time stays."""
    return rows.where(F.col(at).isNull() | (F.col(at) >= now - F.expr(f"INTERVAL {days} DAYS")))
