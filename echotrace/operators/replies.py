"""What is said about a search: by the community's own template or the default one of its kind and number of matches.

Templates are data. A community's template with a name that no value has (or a brace alone) falls back to the default one.
Where replies link to, and what the site is called, are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages, templates

# The wording of replies.
IMAGE_NONE = "I didn't find any posts that meet the matching requirements for r/{this_subreddit}.\n\nIt might be OC, it might not. Things such as JPEG artifacts and cropping may impact the results."
IMAGE_ONE = "Looks like a repost. I've seen this {post_type} {match_count} {times_word}.\n\n{first_seen} {oldest_percent_match} match."
IMAGE_MANY = "Looks like a repost. I've seen this {post_type} {match_count} {times_word}.\n\n{first_seen} {oldest_percent_match} match. {last_seen} {newest_percent_match} match"
LINK_NONE = "Looks like this is the first time this link has been shared on Reddit"
LINK_SOME = "This link has been shared {match_count} {times_word}.\n\n{first_seen}. {last_seen}"
CLOSEST = "I did find [this post]({closest_shortlink}) that is {closest_percent_match} similar.  It might be a match but I cannot be certain."
SEARCH_LINK = "[View Search On {site_name}]({search_url})"
IMAGE_SETTINGS = "**Scope:** {search_scope} | **Target Percent:** {effective_target_match_percent}% | **Max Age:** {max_age}"
OTHER_SETTINGS = "**Scope:** {search_scope} | **Check Title:** {check_title} | **Max Age:** {max_days_old}"
STATS = "{stats_searched_post_str} | **Search Time:** {search_time}s"
REPORT = "*I'm not perfect, but you can help. Report [ [False {pos_neg_text}](https://www.reddit.com/message/compose/?to={bot_name}&subject=False%20{pos_neg_text}&message={report_data}) ]*"
SHORT_LINK = "https://redd.it/"


@dataclass(frozen=True)
class Site:
    """Whom replies speak for."""

    name: str
    search: str
    bot: str


@dataclass(frozen=True)
class Parts:
    """What a reply holds besides its message."""

    stats: bool = True
    search_link: bool = True
    search_settings: bool = True


#: A match as ``oldest``, ``newest`` and ``closest`` hold it.
MATCH = "struct<post_id:string,url:string,community:string,created_at:timestamp_ntz,percent:double>"


def _link(post_id: Column) -> Column:
    return F.concat(F.lit(SHORT_LINK), post_id)


def _percent(value: Column) -> Column:
    return F.concat(value.cast("string"), F.lit("%"))


def _seen(word: str, match: Column) -> Column:
    return F.concat(F.lit(f"{word} Seen [Here]("), _link(match["post_id"]), F.lit(") on "), F.date_format(match["created_at"], "yyyy-MM-dd"))


def values_of(site: Site) -> Column:
    """All values by name, of a row of ``replies``."""
    c, s = F.col, lambda name: F.col(f"settings.{name}")
    n, oldest, newest = c("match_count"), c("oldest"), c("newest")
    image = c("post_type") == "image"
    report = F.concat(F.lit('{"post_id": '), F.coalesce(F.concat(F.lit('"'), c("post_id"), F.lit('"')), F.lit("null")), F.lit(', "meme_template": '), F.coalesce(c("template_id").cast("string"), F.lit("null")), F.lit("}"))
    search = messages.search_link(site.search, c("post_id"), same_sub=s("same_sub"), only_older=s("only_older_matches"), meme_filter=s("meme_filter"), dead=s("filter_dead_matches"), percent=s("target_match_percent"), meme_percent=s("target_meme_match_percent"))
    every = {
        "total_searched": messages.thousands(c("total_searched")), "total_posts": F.lit(0), "match_count": n, "post_type": c("post_type"), "this_subreddit": c("community"), "times_word": messages.times_word(n),
        "stats_searched_post_str": messages.searched_line(c("post_type"), c("total_searched")), "post_shortlink": _link(c("post_id")), "post_author": c("author"), "search_time": c("search_time"),
        "site_name": F.lit(site.name), "bot_name": F.lit(site.bot), "search_scope": F.when(s("same_sub"), "This Sub").otherwise("Reddit"),
        "check_title": templates.truth(F.coalesce(s("target_title_match"), F.lit(0)) != 0), **{x: templates.truth(s(x)) for x in ("filter_crossposts", "filter_same_author", "only_older_matches", "filter_removed_matches", "filter_dead_matches", "same_sub")},
        **{x: s(x) for x in ("max_days_old", "max_matches", "target_title_match")},
    }
    matched = {f"{word}_{name}": match[field] for word, match in (("oldest", oldest), ("newest", newest)) for name, field in (("created_at", "created_at"), ("url", "url"), ("sub", "community"))}
    matched |= {"oldest_shortlink": _link(oldest["post_id"]), "newest_shortlink": _link(newest["post_id"]), "first_seen": _seen("First", oldest), "last_seen": F.when(n > 1, _seen("Last", newest)).otherwise("")}
    pictured = {
        "closest_sub": c("closest.community"), "closest_url": c("closest.url"), "closest_shortlink": _link(c("closest.post_id")), "closest_percent_match": _percent(c("closest.percent")), "closest_created_at": c("closest.created_at"),
        "meme_filter_used": templates.truth(c("template_id").isNotNull()), "search_url": search, "pos_neg_text": F.when(n > 0, "Positive").otherwise("Negative"), "report_data": report,
        "effective_target_match_percent": F.when(c("template_id").isNotNull(), s("target_meme_match_percent")).otherwise(s("target_match_percent")), "max_age": messages.max_age(s("max_days_old")),
        **{x: s(x) for x in ("target_match_percent", "target_meme_match_percent", "target_annoy_distance", "max_depth")}, "meme_filter": templates.truth(s("meme_filter")),
    }
    percents = {"newest_percent_match": _percent(newest["percent"]), "oldest_percent_match": _percent(oldest["percent"]), "meme_template_id": c("template_id")}
    nothing = F.create_map().cast("map<string,string>")
    base = F.map_concat(
        templates.values(**every), F.when(n > 0, templates.values(**matched)).otherwise(nothing), F.when(image, templates.values(**pictured)).otherwise(nothing),
        F.when(image & (n > 0), templates.values(**percents)).otherwise(nothing),
    )
    link = F.when(image, templates.filled(F.lit(REPORT), base)).otherwise("")
    return F.map_concat(base, F.create_map(F.lit("report_post_link"), F.coalesce(link, F.lit(""))))


def _around(message: Column, parts: Parts) -> Column:
    """The message with what stands below it."""
    image, n = F.col("post_type") == "image", F.col("match_count")
    out = F.concat(message, F.when(image & (n == 0) & F.col("closest").isNotNull(), f"\n\n{CLOSEST}").otherwise(""))
    if parts.search_link:
        out = F.concat(out, F.when(image, f"\n\n{SEARCH_LINK}").otherwise(""))
    if parts.search_settings or parts.stats:
        out = F.concat(out, F.lit("\n\n---\n\n"))
    if parts.search_settings:
        out = F.concat(out, F.when(image, IMAGE_SETTINGS).otherwise(OTHER_SETTINGS))
    if parts.stats:
        out = F.concat(out, F.lit(f" | {STATS}" if parts.search_settings else STATS))
    return out


def replies(results: DataFrame, site: Site, communities: DataFrame | None = None, parts: Parts = Parts()) -> DataFrame:
    """``results`` with ``message``, and ``report`` for those who moderate.

    ``results`` has post_id, author, community, post_type, total_searched, search_time, template_id, match_count,
    ``oldest`` and ``newest`` of the matches and ``closest`` (MATCH or null), and ``settings``. ``communities`` has community,
    repost_response_template, oc_response_template and report_msg, one row each; they are joined by Spark's choice.
    """
    n, image = F.col("match_count"), F.col("post_type") == "image"
    default = F.when(image, F.when(n == 0, IMAGE_NONE).when(n == 1, IMAGE_ONE).otherwise(IMAGE_MANY)).when(F.col("post_type") == "link", F.when(n == 0, LINK_NONE).otherwise(LINK_SOME)).otherwise("")
    names = results.columns
    if communities is None:
        results = results.withColumns({x: F.lit(None).cast("string") for x in ("_repost", "_oc", "_report")})
    else:
        own = communities.select("community", *(F.col(x).alias(y) for x, y in (("repost_response_template", "_repost"), ("oc_response_template", "_oc"), ("report_msg", "_report"))))
        results = results.join(own, "community", "left")
    own = F.when(n > 0, F.col("_repost")).otherwise(F.col("_oc"))
    rows = results.withColumn("_values", values_of(site))
    message = templates.filled_or(F.col("_values"), _around(F.when(own != "", own), parts), _around(default, parts))
    report = F.coalesce(templates.filled_or(F.col("_values"), F.col("_report")), F.lit(f"{site.bot}-Repost"))
    return rows.select(*names, message.alias("message"), report.alias("report"))
