"""Logs, points, refreshed tables, retries and second passes, over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import filters, gates, records, search, stats, writes
from ..sources import views
from . import duplicates
from .registry import registry
from .stats import IN_RANGE, LOG, NOW, RANGES

QUERIES, ORACLES, query = registry()

COPIES = "copies AS (SELECT md5(text) AS h, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1)"
SEARCHES = "searches AS (SELECT doc_id AS post_id, lang AS subreddit, 'ingest' AS source, coalesce(n - 1, 0) AS matches_found FROM documents LEFT JOIN copies ON md5(text) = h)"
KNOBS = "CAST(NULL AS INT) AS target_title_match, 75 AS max_matches, false AS same_sub, 190 AS max_days_old, true AS only_older_matches, true AS filter_same_author, true AS filter_crossposts, CAST(90 AS DOUBLE) AS target_match_percent, CAST(0.077 AS DOUBLE) AS target_distance"


def t(spark, sf_dir, name):
    return views.table(spark, sf_dir, name)


def searches(spark, sf_dir):
    """Each document as a searched post, with the number of its copies."""
    p = views.posts(spark, sf_dir)
    copies = p.where(F.col("url_hash").isNotNull()).groupBy("url_hash").agg(F.count("*").alias("n"))
    return p.join(copies, "url_hash", "left").select(F.col("id").alias("post_id"), F.col("community").alias("subreddit"), F.lit("ingest").alias("source"), F.coalesce(F.col("n") - 1, F.lit(0)).alias("matches_found"))


@query(f"WITH {COPIES}, {SEARCHES} SELECT *, {KNOBS} FROM searches")
def search_log(spark, sf_dir):
    return records.with_knobs(searches(spark, sf_dir), filters.Settings())


@query(f"WITH {COPIES}, {SEARCHES} SELECT post_id, matches_found FROM searches WHERE subreddit = 'de' AND matches_found > 0 ORDER BY post_id DESC LIMIT 1000")
def search_history(spark, sf_dir):
    return records.history(searches(spark, sf_dir), "de", "post_id", only_reposts=True).select("post_id", "matches_found")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'This Sub' ELSE 'Reddit' END AS scope, o_orderstatus <> 'O' AS check_title FROM orders")
def search_scopes(spark, sf_dir):
    status = F.col("o_orderstatus")
    return t(spark, sf_dir, "orders").select("o_orderkey", records.search_scope(status == "F").alias("scope"), records.checks_titles(F.when(status == "F", 0).when(status != "O", 80)).alias("check_title"))


@query("""SELECT s_suppkey, s_name, CASE WHEN u.user_id IS NOT NULL THEN v ELSE s_acctbal END AS s_acctbal FROM supplier
LEFT JOIN (SELECT user_id, max(struct_pack(ts := ts, event_id := event_id, v := CASE WHEN value < 10 THEN NULL ELSE value END)).v AS v FROM events WHERE event_type = 'purchase' GROUP BY user_id) u ON u.user_id = s_suppkey""")
def balances_updated(spark, sf_dir):
    """A supplier's balance becomes what its last purchase says; one of less than 10 says null."""
    e = t(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    changes = e.select(F.col("user_id").alias("s_suppkey"), F.when(F.col("value") >= 10, F.col("value")).alias("s_acctbal"), "ts", "event_id")
    return records.updated(t(spark, sf_dir, "supplier"), changes, "s_suppkey", ["ts", "event_id"]).select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE 72 END AS hours_since FROM supplier WHERE s_acctbal < 0 OR s_nationkey < 8")
def bans_upserted(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    known = s.where(F.col("s_nationkey") < 8).select("s_suppkey", F.lit(72).alias("hours_since"))
    return records.upserted(known, s.where(F.col("s_acctbal") < 0).select("s_suppkey", F.lit(0).alias("hours_since")), "s_suppkey")


@query(f"""WITH {LOG}, {RANGES} SELECT repost_of_id, post_type, day_range, count(*) AS repost_count FROM log, ranges WHERE {IN_RANGE} AND repost_of_id IS NOT NULL GROUP BY ALL HAVING count(*) > CASE WHEN post_type IN ('click', 'view') THEN 10 ELSE 5 END""")
def leaderboard_refreshed(spark, sf_dir):
    """The board of all types, in which those of clicks and views were refreshed with a higher bar."""
    log = views.reposts(spark, sf_dir)
    board = lambda rows, least: stats.leaderboard(rows, views.now(), "detected_at", "repost_of_id", least)
    anew = F.col("post_type").isin("click", "view")
    old = board(log, 5)
    return records.refreshed(old, board(log.where(anew), 10), old.where(anew).select("post_type", "day_range"))


@query(f"""WITH {LOG}, r AS (SELECT * FROM (VALUES (1), (7), (30), (365)) r(day_range)),
c AS (SELECT repost_of_id, day_range, count(*) AS repost_count FROM log, r WHERE post_type = 'click' AND detected_at > {NOW} - to_days(day_range) AND repost_of_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
SELECT repost_of_id, day_range, repost_count FROM c QUALIFY row_number() OVER (PARTITION BY day_range ORDER BY repost_count DESC, repost_of_id) <= 2000""")
def legacy_top_reposts(spark, sf_dir):
    clicks = views.reposts(spark, sf_dir).where(F.col("post_type") == "click")
    return stats.leaderboard(clicks, views.now(), "detected_at", "repost_of_id", 1, limit=2000, ranges=[1, 7, 30, 365]).drop("post_type")


@query("""WITH gone AS (SELECT p_partkey AS k FROM part WHERE p_size > 40)
SELECT 'lineitem' AS "table", count(*) AS n_left FROM lineitem WHERE l_partkey IS NULL OR l_partkey NOT IN (SELECT k FROM gone)
UNION ALL SELECT 'documents', count(*) FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT k FROM gone)
UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id IS NULL OR doc_id NOT IN (SELECT k FROM gone)
UNION ALL SELECT 'events', count(*) FROM events WHERE user_id IS NULL OR user_id NOT IN (SELECT k FROM gone)""")
def rows_after_cascade(spark, sf_dir):
    """How many rows each table keeps after posts were deleted with all that refers to them."""
    gone = t(spark, sf_dir, "part").where(F.col("p_size") > 40)
    tables = {name: (t(spark, sf_dir, name), c) for name, c in (("lineitem", "l_partkey"), ("documents", "doc_id"), ("labels", "doc_id"), ("events", "user_id"))}
    left = records.cascade(tables, gone, "p_partkey")
    return records.merged({name: df.agg(F.count("*").alias("n_left")) for name, df in left.items()}).withColumnRenamed("list", "table")


@query("""SELECT o_orderkey, CASE WHEN s_suppkey IS NOT NULL THEN 'message' ELSE 'reply' END AS route FROM orders LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 8) ON s_suppkey = o_custkey""")
def summons_replies(spark, sf_dir):
    bans = t(spark, sf_dir, "supplier").where(F.col("s_nationkey") < 8).select(F.col("s_suppkey").alias("o_custkey"))
    return records.reply_routes(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), bans, "o_custkey").select("o_orderkey", "route")


@query("""SELECT event_id, CAST(json_object('measurement', 'search', 'fields', json_object('rate_limit', user_id), 'tags', json_object('event_type', event_type, 'status', CASE WHEN event_type <> 'error' THEN 'success' END)) AS VARCHAR) AS point FROM events""")
def event_points(spark, sf_dir):
    kind = F.col("event_type")
    return t(spark, sf_dir, "events").select("event_id", records.point("search", {"rate_limit": F.col("user_id")}, {"event_type": kind, "status": F.when(kind != "error", "success")}).alias("point"))


@query("""SELECT o_orderkey, CAST(json_object('post_id', o_orderkey, 'created_at', CAST(epoch(o_orderdate) AS BIGINT), 'author', o_custkey, 'hashes', json_array(md5(o_orderstatus), md5(o_orderpriority))) AS VARCHAR) AS post FROM orders""")
def posts_as_json(spark, sf_dir):
    """Posts for a reply: times are seconds since 1970."""
    md5 = lambda c: F.md5(F.col(c).cast("binary"))
    post = F.struct(F.col("o_orderkey").alias("post_id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created_at"), F.col("o_custkey").alias("author"), F.array(md5("o_orderstatus"), md5("o_orderpriority")).alias("hashes"))
    return t(spark, sf_dir, "orders").select("o_orderkey", F.to_json(post).alias("post"))


@query("""SELECT o_orderkey, CAST(CASE o_orderpriority[1] WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 WHEN '4' THEN 6 END AS INT) AS post_type_id FROM orders""")
def post_type_ids(spark, sf_dir):
    digit = F.substring("o_orderpriority", 1, 1)
    name = F.when(digit == "1", "text").when(digit == "2", "image").when(digit == "3", "link").when(digit == "4", "gallery").otherwise("poll")
    return t(spark, sf_dir, "orders").select("o_orderkey", expr.post_type_id(name).alias("post_type_id"))


@query("""SELECT c_custkey, CAST(('0x' || substr(md5(c_name), 1, 6)) AS BIGINT) AS long_form, CAST(('0x' || md5(c_name)[1] || md5(c_name)[1] || md5(c_name)[2] || md5(c_name)[2] || md5(c_name)[3] || md5(c_name)[3]) AS BIGINT) AS short_form, CAST(0 AS BIGINT) AS other FROM customer""")
def flair_colours(spark, sf_dir):
    h = F.md5(F.col("c_name").cast("binary"))
    return t(spark, sf_dir, "customer").select("c_custkey", expr.hex_color(F.concat(F.lit("#"), F.left(h, F.lit(6)))).alias("long_form"), expr.hex_color(F.concat(F.lit("#"), F.left(h, F.lit(3)))).alias("short_form"), expr.hex_color(F.left(h, F.lit(5))).alias("other"))


@query(f"""SELECT user_id, count(*) AS attempts FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) < 10 AND max(ts) + INTERVAL 300 SECOND <= {NOW}""")
def retries_due(spark, sf_dir):
    return records.retries_due(t(spark, sf_dir, "events").where(F.col("event_type") == "error"), "user_id", "ts", views.now())


@query(f"""SELECT event_id, CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'recheck' ELSE 'update' END AS list FROM events JOIN (SELECT user_id, max(ts) AS checked FROM events WHERE event_type = 'click' GROUP BY user_id) USING (user_id)
WHERE ts > {NOW} - INTERVAL 20 DAY AND checked < {NOW} - INTERVAL 1 DAY""")
def deletion_sweep(spark, sf_dir):
    """Posts that are looked up again, by what the answer makes of them; those that were never checked are left out."""
    e = t(spark, sf_dir, "events")
    checked = e.where(F.col("event_type") == "click").groupBy("user_id").agg(F.max("ts").alias("checked"))
    due = e.join(checked, "user_id").where(records.sweep_due(F.col("ts"), F.col("checked"), views.now(), days=20)).select("event_id", "event_type")
    kind = F.col("event_type")
    lists = {"delete": due.where(kind == "error"), "recheck": due.where(kind == "view"), "update": due.where(~kind.isin("error", "view"))}
    return records.merged(lists).select("event_id", "list")


@query("""SELECT l_orderkey, l_linenumber, place, doc_id FROM (SELECT l_orderkey, l_linenumber, 0 AS place, l_partkey AS id FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 1, l_orderkey FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 2, l_suppkey FROM lineitem) JOIN documents ON doc_id = id""")
def posts_in_order(spark, sf_dir):
    requests = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_partkey", "l_orderkey", "l_suppkey").alias("ids"))
    return records.in_order(requests, "ids", t(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("""SELECT l_orderkey, min(struct_pack(l_linenumber := l_linenumber, l_partkey := l_partkey)).l_partkey AS l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size % 3 = 0 GROUP BY l_orderkey""")
def first_live_match(spark, sf_dir):
    status = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") % 3 == 0, 200).when(F.col("p_size") % 3 == 1, 404).alias("status"))
    return records.first_live(t(spark, sf_dir, "lineitem"), status, "l_orderkey", "l_partkey", "l_linenumber")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'held' ELSE md5(coalesce(text, '')) END AS hash, l.doc_id IS NULL AS inserted FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""")
def template_hashes_cached(spark, sf_dir):
    cache = t(spark, sf_dir, "labels").select("doc_id", F.lit("held").alias("hash")).dropDuplicates(["doc_id"])
    d = t(spark, sf_dir, "documents").select("doc_id", "text")
    return records.cached(d, cache, "doc_id", "hash", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).drop("text")


@query("""SELECT doc_id, count(DISTINCT w) AS fingerprints FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents UNION ALL SELECT doc_id, unnest(string_split(reverse(text), ' ')) FROM documents) WHERE w IS NOT NULL GROUP BY doc_id""")
def channel_fingerprints(spark, sf_dir):
    """A text and its reverse as two channels, whose words are fingerprints."""
    words = lambda c: F.split(c, " ")
    return records.fingerprints_of_channels(t(spark, sf_dir, "documents"), "doc_id", [words(F.col("text")), words(F.reverse("text"))]).groupBy("doc_id").agg(F.count("*").alias("fingerprints"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 8 THEN s_acctbal ELSE 90 END AS percent, CAST(190 AS DOUBLE) AS days, CASE WHEN s_nationkey < 8 THEN CAST(1 AS DOUBLE) END AS own, CASE WHEN s_nationkey < 8 THEN 3 ELSE 2 END AS n FROM supplier")
def settings_merged(spark, sf_dir):
    """A community's own settings over the defaults."""
    defaults = F.create_map(F.lit("percent"), F.lit(90.0), F.lit("days"), F.lit(190.0))
    own = F.when(F.col("s_nationkey") < 8, F.create_map(F.lit("percent"), F.col("s_acctbal"), F.lit("own"), F.lit(1.0))).otherwise(F.create_map().cast("map<string,double>"))
    m = records.right_wins(defaults, own)
    return t(spark, sf_dir, "supplier").select("s_suppkey", *(F.try_element_at(m, F.lit(k)).alias(k) for k in ("percent", "days", "own")), F.size(m).alias("n"))


@query(f"""{duplicates.ORACLES["oldest_earlier_copy"].replace("SELECT id, repost_of_id, author, of_author FROM pairs WHERE rn = 1", "SELECT id AS post_id, CASE WHEN id IN (SELECT doc_id FROM labels) THEN -1 ELSE repost_of_id END AS repost_of_id, CASE WHEN id IN (SELECT doc_id FROM labels) THEN 'log' ELSE 'ingest' END AS source FROM pairs WHERE rn = 1")}
UNION ALL SELECT doc_id, -1, 'log' FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT id FROM pairs WHERE rn = 1)""")
def searched_and_saved(spark, sf_dir):
    """The table of reposts after a search of all posts was saved; what it held for a post stays."""
    held = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("post_id"), F.lit(-1).cast("bigint").alias("repost_of_id"), F.lit("log").alias("source")).dropDuplicates(["post_id"])
    found = views.posts(spark, sf_dir).transform(search.oldest_earlier).select(F.col("id").alias("post_id"), "repost_of_id", F.lit("ingest").alias("source"))
    return found.transform(lambda rows: writes.insert_absent(held, rows, "post_id"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN -1 WHEN n > 5 AND c_mktsegment IN ('BUILDING', 'FURNITURE') THEN c_custkey END AS template_id, CASE WHEN c_acctbal > 5000 OR (n > 5 AND c_mktsegment IN ('BUILDING', 'FURNITURE')) THEN 'meme' ELSE 'image' END AS search
FROM customer JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON user_id = c_custkey""")
def searches_of_second_pass(spark, sf_dir):
    n = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"))
    first = t(spark, sf_dir, "customer").join(n, "c_custkey").withColumn("template_id", F.when(F.col("c_acctbal") > 5000, F.lit(-1).cast("bigint")))
    due = gates.template_due(F.col("template_id"), F.col("n"), F.when(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"), "DankMemes").otherwise("pics"))
    again = lambda df: df.withColumn("search", F.when(F.col("template_id").isNotNull(), "meme").otherwise("image"))
    return records.second_pass(first, due, "c_custkey", again).select("c_custkey", "template_id", "search")


@query("""SELECT page_id AS post_id, CASE WHEN url LIKE '%/es/%' THEN 'text' WHEN length(html) > 2000 THEN 'link' END AS post_type, url, true AS crosspost_checked, 'archive' AS ingested_from, CASE WHEN length(html) > 2000 THEN html END AS selftext FROM pages""")
def legacy_submissions(spark, sf_dir):
    """Submissions of the older form: self posts are texts, of others the hint is the type, whatever the url says."""
    p = t(spark, sf_dir, "pages")
    long = F.length("html") > 2000
    raw = p.select(F.col("page_id").alias("id"), "url", F.when(long, "link").alias("post_hint"), F.contains("url", F.lit("/es/")).alias("is_self"), F.when(long, F.col("html")).alias("selftext"))
    return raw.select(F.col("id").alias("post_id"), F.when(F.col("is_self"), "text").otherwise(F.col("post_hint")).alias("post_type"), "url", F.lit(True).alias("crosspost_checked"), F.lit("archive").alias("ingested_from"), "selftext")


@query("SELECT l_orderkey, l_linenumber, l_returnflag AS hash_1, l_linestatus AS hash_2, l_shipdate AS created_at FROM lineitem")
def legacy_rows(spark, sf_dir):
    """Rows of an older table under the names of posts."""
    names = {"dhash_h": "hash_1", "dhash_v": "hash_2"}
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("dhash_h"), F.col("l_linestatus").alias("dhash_v"), F.col("l_shipdate").alias("created_at"))
    return rows.withColumnsRenamed(names)
