"""Moderation policy, audits and rendered results, as tables of actions and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import moderation, policy, replies, stats
from ..sources import views
from .registry import registry

QUERIES, ORACLES, query = registry()


@query("""WITH c AS (SELECT user_id, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY GROUP BY 1)
SELECT user_id, n, 'remove_post' AS action FROM c WHERE n >= 10 UNION ALL SELECT user_id, n, 'ban_user' FROM c WHERE n >= 10 AND n >= 20""")
def high_volume_actions(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").where(F.col("ts") > views.now() - F.expr("INTERVAL 7 DAY"))
    c = e.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= 10)
    return policy.actions(c, ["user_id", "n"], {"remove_post": F.lit(True), "ban_user": F.col("n") >= 20})


@query("SELECT event_id, CASE WHEN value <= 2 THEN 'remove' WHEN value <= 5 THEN 'review' ELSE 'keep' END AS verdict FROM events")
def karma_verdicts(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", policy.karma_verdict(F.col("value"), 2, 5).alias("verdict"))


@query("""WITH v AS (SELECT user_id, CAST(sum(CASE event_type WHEN 'error' THEN -1 WHEN 'view' THEN 0 ELSE 1 END) AS BIGINT) AS total FROM events GROUP BY 1)
SELECT user_id, total, CASE WHEN total >= 10 THEN 'promote' WHEN total <= -10 THEN 'remove' ELSE 'open' END AS verdict FROM v""")
def template_votes(spark, sf_dir):
    vote = F.when(F.col("event_type") == "error", -1).when(F.col("event_type") == "view", 0).otherwise(1)
    v = views.table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(vote).alias("total"))
    return v.withColumn("verdict", policy.vote_verdict(F.col("total")))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN toxic = 1 THEN 'banned' WHEN quality = 0 THEN 'over_limit' WHEN d.n_chars < 100 THEN 'answered' ELSE 'run' END AS outcome
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def summons_ladder(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(views.table(spark, sf_dir, "labels"), "doc_id", "left")
    known = F.coalesce(F.col("toxic"), F.col("quality"))
    return d.select("doc_id", policy.first_of((known.isNull(), "unknown"), (F.col("toxic") == 1, "banned"), (F.col("quality") == 0, "over_limit"), (F.col("n_chars") < 100, "answered"), otherwise="run").alias("outcome"))


@query("""SELECT page_id, list_filter(list_distinct_ordered, lambda x: contains(x, 'example') OR contains(x, '/tag'))[1] AS flagged FROM (SELECT page_id, regexp_extract_all(html, 'href=[''"]?([^''" >]+)', 1) AS list_distinct_ordered FROM pages)""")
def flagged_links(spark, sf_dir):
    return views.links(spark, sf_dir).select("page_id", policy.first_link_with(expr.hrefs(F.col("html")), ["example", "/tag"]).alias("flagged"))


@query("""SELECT n.n_nationkey, k.config_key, k.old_value, k.new_value FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey, LATERAL (VALUES ('name', n.n_name, r.r_name), ('number', CAST(n.n_nationkey AS VARCHAR), CAST(r.r_regionkey AS VARCHAR))) k(config_key, old_value, new_value) WHERE k.old_value IS DISTINCT FROM k.new_value""")
def config_changes(spark, sf_dir):
    n, r = views.table(spark, sf_dir, "nation"), views.table(spark, sf_dir, "region")
    old = n.select("n_nationkey", F.col("n_name").alias("name"), F.col("n_nationkey").alias("number"))
    new = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("name"), F.col("r_regionkey").alias("number"))
    return stats.changed_keys(old, new, "n_nationkey", ["name", "number"])


SITE = replies.Site("search.example", "https://search.example/search", "a_bot")


@query(r"""WITH c AS (SELECT min(doc_id) AS id, max(doc_id) AS last_id, count(*) - 1 AS n FROM documents GROUP BY md5(text)), d AS (SELECT c.id, c.last_id, c.n, d.lang, d.n_chars FROM c JOIN documents d ON d.doc_id = c.id),
own(lang, repost, oc, report) AS (VALUES ('fr', 'Seen {match_count} {times_word} in r/{this_subreddit}.', NULL, '{match_count} copies'), ('de', 'Seen {how_often}', 'New in r/{this_subreddit}', '{how_often}')),
s AS (SELECT d.*, CASE WHEN d.n_chars % 2 = 0 THEN 'image' ELSE 'link' END AS kind, strftime(TIMESTAMP '2024-01-01' + to_minutes(id + 1), '%Y-%m-%d') AS first_day, strftime(TIMESTAMP '2024-01-01' + to_minutes(last_id), '%Y-%m-%d') AS last_day, repost, oc, report FROM d LEFT JOIN own USING (lang)),
body AS (SELECT *, 'First Seen [Here](https://redd.it/' || (id + 1) || ') on ' || first_day AS first_seen, 'Last Seen [Here](https://redd.it/' || last_id || ') on ' || last_day AS last_seen FROM s)
SELECT id, CASE WHEN n > 0 AND lang = 'fr' THEN 'Seen ' || n || CASE WHEN n > 1 THEN ' times' ELSE ' time' END || ' in r/fr.' WHEN n = 0 AND lang = 'de' THEN 'New in r/de'
WHEN kind = 'link' THEN CASE WHEN n = 0 THEN 'Looks like this is the first time this link has been shared on Reddit' ELSE 'This link has been shared ' || n || CASE WHEN n > 1 THEN ' times' ELSE ' time' END || '.' || chr(10) || chr(10) || first_seen || '. ' || CASE WHEN n > 1 THEN last_seen ELSE '' END END
WHEN n = 0 THEN 'I didn''t find any posts that meet the matching requirements for r/' || coalesce(lang, 'None') || '.' || chr(10) || chr(10) || 'It might be OC, it might not. Things such as JPEG artifacts and cropping may impact the results.'
ELSE 'Looks like a repost. I''ve seen this image ' || n || CASE WHEN n > 1 THEN ' times' ELSE ' time' END || '.' || chr(10) || chr(10) || first_seen || ' 100.0% match.' || CASE WHEN n > 1 THEN ' ' || last_seen || ' 100.0% match' ELSE '' END END
|| CASE WHEN kind = 'image' THEN chr(10) || chr(10) || '[View Search On search.example](https://search.example/search?postId=' || id || '&sameSub=false&filterOnlyOlder=true&memeFilter=false&filterDeadMatches=false&targetImageMatch=90&targetImageMemeMatch=97)' ELSE '' END
|| chr(10) || chr(10) || '---' || chr(10) || chr(10) || CASE WHEN kind = 'image' THEN '**Scope:** Reddit | **Target Percent:** 90% | **Max Age:** 190 | **Searched Images:** ' ELSE '**Scope:** Reddit | **Check Title:** False | **Max Age:** 190 | **Searched Links:** ' END || format('{:,}', n_chars * 1000) || ' | **Search Time:** 1s' AS message,
CASE WHEN lang = 'fr' THEN n || ' copies' ELSE 'a_bot-Repost' END AS report FROM body""")
def replies_to_searches(spark, sf_dir):
    """What is said about each content's first post: later copies are its matches; two communities have templates, one of them with a bad name."""
    p = views.posts(spark, sf_dir)
    groups = p.groupBy("url_hash").agg(F.min("id").alias("id"), F.max("id").alias("last_id"), (F.count("*") - 1).cast("int").alias("match_count"))
    at = lambda m: F.timestamp_add("MINUTE", m.cast("int"), F.lit(views.START).cast("timestamp_ntz"))
    match = lambda i: F.struct(i.cast("string").alias("post_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("community"), at(i).alias("created_at"), F.lit(100.0).alias("percent"))
    some = lambda m: F.when(F.col("match_count") > 0, m)
    settings = F.struct(
        F.lit(90).alias("target_match_percent"), F.lit(0.077).alias("target_annoy_distance"), F.lit(97).alias("target_meme_match_percent"), F.lit(False).alias("meme_filter"), F.lit(4000).alias("max_depth"), F.lit(None).cast("int").alias("target_title_match"), F.lit(75).alias("max_matches"),
        F.lit(False).alias("same_sub"), F.lit(190).alias("max_days_old"), *(F.lit(x not in ("filter_dead_matches", "filter_removed_matches")).alias(x) for x in ("filter_dead_matches", "filter_removed_matches", "only_older_matches", "filter_same_author", "filter_crossposts")),
    )
    results = p.join(groups, "id").select(
        F.col("id").cast("string").alias("post_id"), "author", "community", F.when(F.col("n_chars") % 2 == 0, "image").otherwise("link").alias("post_type"), (F.col("n_chars") * 1000).alias("total_searched"), F.lit(1).alias("search_time"), F.lit(None).cast("bigint").alias("template_id"),
        "match_count", some(match(F.col("id") + 1)).alias("oldest"), some(match(F.col("last_id"))).alias("newest"), F.lit(None).cast(replies.MATCH).alias("closest"), settings.alias("settings"),
    )
    own = spark.createDataFrame([("fr", "Seen {match_count} {times_word} in r/{this_subreddit}.", None, "{match_count} copies"), ("de", "Seen {how_often}", "New in r/{this_subreddit}", "{how_often}")], "community string, repost_response_template string, oc_response_template string, report_msg string")
    return replies.replies(results, SITE, own).select(F.col("post_id").cast("bigint").alias("id"), "message", "report")


@query("""SELECT c.c_custkey, CASE WHEN c_acctbal IS NULL OR c_acctbal = 0 THEN true ELSE c_acctbal > 1000 END AS keep, c_mktsegment IN ('AUTOMOBILE', 'BUILDING') AS monitored FROM customer c""")
def knobs(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    return c.select("c_custkey", (expr.knob_off(F.col("c_acctbal")) | (F.col("c_acctbal") > 1000)).alias("keep"), F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING").alias("monitored"))


@query("""SELECT s.s_suppkey, n.n_name, r.r_name, count(DISTINCT l.l_orderkey) AS orders FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey GROUP BY ALL""")
def profile_joins(spark, sf_dir):
    t = lambda name: views.table(spark, sf_dir, name)
    seen = t("lineitem").select("l_suppkey", "l_orderkey").distinct().groupBy("l_suppkey").agg(F.count("*").alias("orders"))
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.join(seen, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", "n_name", "r_name", F.coalesce("orders", F.lit(0).cast("bigint")).alias("orders"))


COMMUNITIES = "c(community, least, remove, ban, mail, removal_reason, ban_reason) AS (VALUES ('en', 10, true, true, false, 'Spam', NULL), ('de', 12, false, true, true, NULL, 'Too many'), ('fr', 5, true, true, true, 'Spam', NULL), ('es', 10, false, false, false, NULL, NULL))"


@query(f"""WITH {COMMUNITIES}, copies AS (SELECT 'src' || user_id AS author, count(*) AS repost_count FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY GROUP BY user_id),
rows_ AS (SELECT d.doc_id AS post_id, d.source AS author, c.*, repost_count FROM documents d JOIN c ON c.community = d.lang JOIN copies ON copies.author = d.source WHERE least >= 10 AND repost_count >= least AND NOT (d.source = 'src1' AND d.lang = 'en'))
SELECT post_id, 'remove_post' AS action, removal_reason AS reason, 'High volume of reposts detected' AS text FROM rows_ WHERE remove UNION ALL SELECT post_id, 'ban_user', coalesce(ban_reason, 'High volume of reposts detected'), NULL FROM rows_ WHERE ban
UNION ALL SELECT post_id, 'mod_mail', NULL, 'User [u/' || author || '](https://reddit.com/u/' || author || ') has been flagged as a high volume reposter.' || chr(10) || chr(10) || 'They just created [this submission](https://redd.it/' || post_id || ') on [r/' || community || '](https://reddit.com/r/' || community || ') ' || chr(10) || chr(10) || 'In the last 7 days I have detected ' || repost_count || ' reposts created by them' FROM rows_ WHERE mail""")
def actions_on_high_volume(spark, sf_dir):
    """By each community's flags and threshold; one is too low to be meant, one user is spared in one community."""
    p = views.posts(spark, sf_dir)
    week = views.table(spark, sf_dir, "events").where(F.col("ts") > views.now() - F.expr("INTERVAL 7 DAY"))
    counts = week.groupBy(F.concat(F.lit("src"), F.col("user_id").cast("string")).alias("author")).agg(F.count("*").alias("repost_count"))
    names = "community string, high_volume_reposter_threshold int, high_volume_reposter_remove_post boolean, high_volume_reposter_ban_user boolean, high_volume_reposter_notify_mod_mail boolean, high_volume_reposter_removal_reason string, high_volume_reposter_ban_reason string"
    communities = spark.createDataFrame([("en", 10, True, True, False, "Spam", None), ("de", 12, False, True, True, None, "Too many"), ("fr", 5, True, True, True, "Spam", None), ("es", 10, False, False, False, None, None)], names)
    whitelist = spark.createDataFrame([("src1", "en", True), ("src2", "en", False)], "author string, community string, ignore_high_volume_repost_detection boolean")
    posts = p.select(F.col("id").alias("post_id"), "author", "community")
    return moderation.high_volume(posts, communities, counts, whitelist).select("post_id", "action", "reason", "text")
