"""Gates of ingest, mentions and reviews, bans, watch offers and settings, over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import configs, gates, policy, writes
from ..sources import views
from .registry import registry

QUERIES, ORACLES, query = registry()

NOW = f"TIMESTAMP '{views.NOW}'"


def t(spark, sf_dir, name):
    return views.table(spark, sf_dir, name)


@query("""SELECT doc_id FROM documents WHERE coalesce(lang, '') <> 'de' AND NOT coalesce(n_chars > 800 AND lang = 'en', false)""")
def ingest_gate(spark, sf_dir):
    """German documents are deleted ones, French ones went by a moderator; long English ones are moving pictures."""
    removal = F.when(F.col("lang") == "de", "deleted").when(F.col("lang") == "fr", "moderator")
    url = F.concat(F.lit("https://i.imgur.com/"), F.col("doc_id").cast("string"), F.when((F.col("n_chars") > 800) & (F.col("lang") == "en"), ".gifv").otherwise(".jpg"))
    return t(spark, sf_dir, "documents").where(gates.ingested(removal, url)).select("doc_id")


@query(f"""SELECT event_id FROM events WHERE ts >= {NOW} - INTERVAL 1 DAY AND event_type <> 'error' AND NOT (event_type = 'view' AND value < 5)""")
def mentions_to_answer(spark, sf_dir):
    author = F.when(F.col("event_type") == "error", "AutoModerator").when((F.col("event_type") == "view") & (F.col("value") < 5), None).otherwise("someone")
    return t(spark, sf_dir, "events").where(gates.answerable(author, F.col("ts"), views.now())).select("event_id")


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 8 THEN 12 ELSE 0 END AS hours_since FROM supplier WHERE s_nationkey < 8 OR s_acctbal > 3000")
def bans_after_check(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    bans = s.select("s_suppkey", F.when(F.col("s_nationkey") < 8, views.now() - F.expr("INTERVAL 12 HOURS")).otherwise(views.now() - F.expr("INTERVAL 3 DAYS")).alias("last_checked"))
    out = gates.recheck_bans(bans, s.where(F.col("s_acctbal") > 3000), "s_suppkey", views.now())
    return out.select("s_suppkey", F.timestamp_diff("HOUR", F.col("last_checked"), views.now()).cast("int").alias("hours_since"))


@query(f"""SELECT c_custkey FROM customer LEFT JOIN (SELECT user_id, max(ts) AS t FROM events GROUP BY user_id) ON user_id = c_custkey WHERE c_mktsegment <> 'BUILDING' AND (t IS NULL OR t <= {NOW} - INTERVAL 7 DAY)""")
def accounts_to_review(spark, sf_dir):
    seen = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("last_checked"))
    name = F.when(F.col("c_mktsegment") == "BUILDING", "AutoModerator").otherwise(F.col("c_name"))
    return t(spark, sf_dir, "customer").join(seen, "c_custkey", "left").where(gates.review_due(name, F.col("last_checked"), views.now())).select("c_custkey")


@query("""WITH p AS (SELECT o_orderkey, o_orderstatus, o_orderpriority[1] AS priority FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'FURNITURE' AND c_acctbal > 2000 AND o_orderpriority[1] IN ('1', '2'))
SELECT o_orderkey, 'remove_post' AS action FROM p UNION ALL SELECT o_orderkey, 'ban_user' FROM p WHERE priority = '1' UNION ALL SELECT o_orderkey, 'modmail' FROM p WHERE o_orderstatus = 'F'""")
def promoter_actions(spark, sf_dir):
    """Orders as posts, customers as reviewed authors; an author without a review gets no action."""
    p = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    priority = F.substring("o_orderpriority", 1, 1)
    flags = gates.promoter_flags(whitelisted=F.col("c_mktsegment") == "FURNITURE", links_found=F.col("c_acctbal") > 2000, remove=priority.isin("1", "2"), ban=priority == "1", notify=F.col("o_orderstatus") == "F")
    return policy.actions(p, ["o_orderkey"], flags)


@query("""SELECT c_custkey FROM customer JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON user_id = c_custkey WHERE n > 5 AND c_mktsegment IN ('BUILDING', 'FURNITURE') AND c_acctbal <= 5000""")
def templates_due(spark, sf_dir):
    n = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"))
    community = F.when(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"), "DankMemes").otherwise("pics")
    template = F.when(F.col("c_acctbal") > 5000, F.col("c_custkey"))
    return t(spark, sf_dir, "customer").join(n, "c_custkey").where(gates.template_due(template, F.col("n"), community)).select("c_custkey")


@query("""SELECT DISTINCT l_suppkey AS "user", lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS post_id FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_partkey IN (SELECT doc_id FROM documents)
AND (l_suppkey, l_partkey) NOT IN (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) FROM events WHERE props IS NOT NULL)""")
def accepted_watch_offers(spark, sf_dir):
    """Lines as offers by mail: only R lines are accepted, only F lines hold a link.

    A link shows six digits of the post's id, which several posts share from a million on; posts are told apart by the whole id.
    """
    link = F.concat(F.lit("Watch https://redd.it/"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"), F.lit("?"))
    shown = gates.offered_post(F.when(F.col("l_linestatus") == "F", link).otherwise("nothing"), F.when(F.col("l_returnflag") == "R", "Yes, please").otherwise("no"))
    offers = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("user"), F.when(shown.isNotNull(), F.col("l_partkey")).alias("post_id"), shown.alias("shown"))
    posts = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"))
    watches = views.reposts(spark, sf_dir).select(F.col("author").alias("user"), F.col("repost_of_id").alias("post_id"))
    return gates.new_watches(offers, posts, watches).select("user", F.col("shown").alias("post_id")).distinct()


@query("SELECT c_custkey, c_mktsegment IN ('BUILDING', 'FURNITURE') AS moderator, c_acctbal < 0 OR c_nationkey > 12 AS may_post FROM customer")
def memberships(spark, sf_dir):
    names = F.array(F.lit("building"), F.lit("Furniture"))
    permissions = F.array(F.when(F.col("c_acctbal") < 0, "all").otherwise("wiki"), F.when(F.col("c_nationkey") > 12, "posts").otherwise("mail"))
    return t(spark, sf_dir, "customer").select("c_custkey", gates.member(names, F.col("c_mktsegment")).alias("moderator"), gates.permitted(permissions, "posts").alias("may_post"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'image' WHEN 'O' THEN 'link' ELSE 'text' END AS search, CASE WHEN o_orderstatus = 'F' THEN coalesce(s_acctbal, 90.0) END AS percent, CASE WHEN o_orderstatus = 'F' THEN coalesce(s_nationkey, 190) END AS days
FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey""")
def request_thresholds(spark, sf_dir):
    """Requests by the post's type; a picture's thresholds are its community's, or the defaults if that isn't monitored."""
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("o_custkey"), "left")
    image = F.col("o_orderstatus") == "F"
    search = policy.first_of((image, "image"), (F.col("o_orderstatus") == "O", "link"), otherwise="text")
    return o.select("o_orderkey", search.alias("search"), F.when(image, F.coalesce("s_acctbal", F.lit(90.0))).alias("percent"), F.when(image, F.coalesce("s_nationkey", F.lit(190))).alias("days"))


@query("""WITH f AS (SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS kind, arg_min(props, event_id) AS props FROM events GROUP BY user_id)
SELECT user_id, event_id, kind <> 'error' AS is_valid, CASE WHEN kind <> 'error' AND json_extract_string(props, '$.k') <> '5' THEN json_extract_string(props, '$.k') END AS changed_k FROM f""")
def config_revisions(spark, sf_dir):
    """A user's first event as a revision of settings; those of errors are broken. The setting k is 5 so far."""
    e = t(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "{k: broken").otherwise(F.col("props")).alias("body"))
    r = gates.first_revisions(e, "user_id", "event_id", "body")
    changed = gates.changed_settings(F.col("settings"), F.create_map(F.lit("k"), F.lit("5")), ["k"])
    return r.select("user_id", "event_id", "is_valid", changed["k"].alias("changed_k"))


@query("""SELECT s_suppkey, s_acctbal AS percent FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT s_suppkey, 90.0 FROM supplier WHERE NOT coalesce(s_acctbal > 0, false)""")
def communities_with_defaults(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    return gates.with_defaults(s.where(F.col("s_acctbal") > 0).select("s_suppkey", F.col("s_acctbal").alias("percent")), s, "s_suppkey", {"percent": 90.0})


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1 ORDER BY day DESC LIMIT 1")
def home_stats(spark, sf_dir):
    """The newest row of the daily statistics."""
    daily = t(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return daily.agg(F.max_by(F.struct("day", "n", "users"), "day").alias("last")).select("last.*")


@query("""SELECT doc_id, lang AS sub, 'log' AS search FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, lang, 'text' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def checked_posts(spark, sf_dir):
    """The log of checks after a run over all posts: those it holds are not checked again."""
    d, labels = t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("sub")), t(spark, sf_dir, "labels").select("doc_id")
    log = d.join(labels, "doc_id", "left_semi").withColumn("search", F.lit("log"))
    return writes.insert_absent(log, d.withColumn("search", F.lit("text")), "doc_id")


@query("""SELECT event_id, CAST(json_object('event_id', event_id, 'post', json_object('id', user_id, 'type', event_type)) AS VARCHAR) AS result FROM events""")
def results_as_json(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.select("event_id", F.to_json(F.struct("event_id", F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("type")).alias("post"))).alias("result"))


@query("""SELECT e.event_id, e.user_id, d.doc_id AS post_id, d.source FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'click') e JOIN documents d ON d.doc_id = e.k""")
def watches_with_posts(spark, sf_dir):
    w = views.reposts(spark, sf_dir).where(F.col("post_type") == "click").select("event_id", F.col("author").alias("user_id"), F.col("repost_of_id").alias("doc_id"))
    return w.join(t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("event_id", "user_id", F.col("doc_id").alias("post_id"), "source")


@query("""WITH c AS (SELECT *, s_suppkey % 5 AS k, s_acctbal > 0 AS old_flag, s_acctbal > 5000 AS new_flag FROM supplier WHERE s_nationkey <> 3 AND s_suppkey % 5 > 0)
SELECT CAST(s_suppkey AS VARCHAR) AS name, 'r' || s_suppkey AS revision_id, 'remove_repost' AS config_key, CASE WHEN old_flag THEN 'true' ELSE 'false' END AS old_value, CASE WHEN new_flag THEN 'true' ELSE 'false' END AS new_value FROM c WHERE old_flag <> new_flag
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'r' || s_suppkey, 'max_days_old', '190', CAST(s_nationkey AS VARCHAR) FROM c WHERE k <> 1 AND s_nationkey <> 190
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'r' || s_suppkey, 'title_ignore_keywords', 'old', CASE WHEN k <> 2 THEN s_name END FROM c""")
def settings_changed_by_pages(spark, sf_dir):
    """Each supplier as a community whose page says what it should do; a fifth of the pages can't be read, another has a number as text."""
    s, k = t(spark, sf_dir, "supplier"), F.col("s_suppkey") % 5
    name, revision = F.col("s_suppkey").cast("string").alias("name"), F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("revision_id")
    yes = F.lit(True)
    communities = s.select(name, yes.alias("active"), yes.alias("is_mod"), (F.col("s_nationkey") != 3).alias("wiki_permission"), (F.col("s_acctbal") > 0).alias("remove_repost"), F.lit(190).alias("max_days_old"), F.lit("old").alias("title_ignore_keywords"))
    page = F.to_json(F.struct((F.col("s_acctbal") > 5000).alias("remove_repost"), F.when(k != 1, F.col("s_nationkey")).alias("max_days_old"), F.when(k == 1, F.col("s_nationkey").cast("string")).alias("_text"), F.when(k == 2, "").otherwise(F.col("s_name")).alias("title_ignore_keywords")))
    content = F.when(k == 0, "{").otherwise(F.replace(page, F.lit("_text"), F.lit("max_days_old")))
    done = configs.sync(communities, s.select(name, revision, content.alias("content")), s.select(revision).limit(0), {"remove_repost": "boolean", "max_days_old": "int", "title_ignore_keywords": "string"})
    return done.audit
