"""Leaderboards, counts, buckets, windows and set algebra over the log of reposts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..operators import boards, search, stats
from ..sources import tables, views
from .registry import registry

QUERIES, ORACLES, query = registry()

LOG = "log AS (SELECT event_id, user_id AS author, event_type AS post_type, CAST(json_extract(props, '$.k') AS BIGINT) AS repost_of_id, ts AS detected_at, value FROM events)"
RANGES = "ranges AS (SELECT * FROM (VALUES (1), (7), (14), (30), (NULL)) r(day_range))"
NOW = f"TIMESTAMP '{views.NOW}'"
IN_RANGE = f"(day_range IS NULL OR detected_at > {NOW} - to_days(day_range))"


def log(spark, sf_dir):
    return views.reposts(spark, sf_dir)


@query(f"WITH {LOG}, {RANGES} SELECT repost_of_id, post_type, day_range, count(*) AS repost_count FROM log, ranges WHERE {IN_RANGE} AND repost_of_id IS NOT NULL GROUP BY ALL HAVING count(*) > 5")
def top_reposts(spark, sf_dir):
    return stats.leaderboard(log(spark, sf_dir), views.now(), "detected_at", "repost_of_id", 5)


@query(f"WITH {LOG}, {RANGES} SELECT author, post_type, day_range, count(*) AS repost_count FROM log, ranges WHERE {IN_RANGE} AND author IS NOT NULL AND CAST(author AS VARCHAR) <> '[deleted]' GROUP BY ALL HAVING count(*) > 10")
def top_reposters(spark, sf_dir):
    return stats.leaderboard(log(spark, sf_dir), views.now(), "detected_at", "author", 10, excluded=stats.EXCLUDED, left_out=stats.DELETED)


@query(f"WITH {LOG}, {RANGES} SELECT CASE WHEN author % 10 = 0 THEN 'AutoModerator' ELSE 'u' || author END AS author, post_type, day_range, count(*) AS repost_count FROM log, ranges WHERE {IN_RANGE} AND author IS NOT NULL AND author % 10 NOT IN (0, 1) GROUP BY ALL HAVING count(*) > 10")
def top_reposters_kept_up(spark, sf_dir):
    """The board after three refreshes, of which each reads new days only; a tenth of the authors is gone, a tenth is left out at the end."""
    name = F.when(F.col("author") % 10 == 1, "[deleted]").when(F.col("author") % 10 == 0, "AutoModerator").otherwise(F.concat(F.lit("u"), F.col("author").cast("string")))
    rows = log(spark, sf_dir).select(name.alias("author"), "post_type", "detected_at")
    board = boards.Board(tables.shared_folder(spark), "detected_at", "author", left_out=stats.DELETED)
    now = datetime.fromisoformat(views.NOW)
    for days in (20, 3):
        then = now - timedelta(days=days, hours=5)
        board.update(rows.where(F.col("detected_at") <= F.lit(then)), then)
    return board.refresh(rows, now, 10, excluded=stats.EXCLUDED)


@query(f"""WITH {LOG} SELECT post_type, author, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY post_type ORDER BY n DESC, author) AS rank FROM (SELECT post_type, author, count(*) AS n FROM log GROUP BY ALL)) WHERE rank <= 5""")
def top_five_reposters(spark, sf_dir):
    counts = log(spark, sf_dir).groupBy("post_type", "author").agg(F.count("*").alias("n"))
    return search.top_by(counts, ["post_type"], [F.col("n").desc(), F.col("author")], 5)


@query(f"""WITH {LOG} SELECT count(*) AS reposts, count(*) FILTER (detected_at > {NOW} - INTERVAL 1 DAY) AS reposts_24h, count(DISTINCT author) AS authors, count(*) FILTER (post_type = 'click') AS clicks,
count(*) FILTER (post_type = 'click' AND detected_at > {NOW} - INTERVAL 1 DAY) AS clicks_24h FROM log""")
def daily_stats(spark, sf_dir):
    recent = F.col("detected_at") > views.now() - F.expr("INTERVAL 1 DAY")
    click = F.col("post_type") == "click"
    return log(spark, sf_dir).agg(F.count("*").alias("reposts"), F.count_if(recent).alias("reposts_24h"), F.count_distinct("author").alias("authors"), F.count_if(click).alias("clicks"), F.count_if(click & recent).alias("clicks_24h"))


@query(f"WITH {LOG} SELECT author, count(*) FILTER (detected_at > {NOW} - INTERVAL 24 HOUR) AS day, count(*) FILTER (detected_at > {NOW} - INTERVAL 720 HOUR) AS month, count(*) AS all_time FROM log GROUP BY author")
def counts_by_author(spark, sf_dir):
    since = lambda h: F.count_if(F.col("detected_at") > views.now() - F.expr(f"INTERVAL {h} HOUR"))
    return log(spark, sf_dir).groupBy("author").agg(since(24).alias("day"), since(720).alias("month"), F.count("*").alias("all_time"))


@query(f"WITH {LOG} SELECT author, count(*) FILTER (post_type = 'click') AS click, count(*) FILTER (post_type = 'error') AS error, count(*) FILTER (post_type = 'view') AS view_, count(*) FILTER (post_type = 'purchase') AS purchase FROM log GROUP BY author")
def pivot_by_type(spark, sf_dir):
    kind = lambda k: F.count_if(F.col("post_type") == k)
    return log(spark, sf_dir).groupBy("author").agg(kind("click").alias("click"), kind("error").alias("error"), kind("view").alias("view_"), kind("purchase").alias("purchase"))


@query(f"WITH {LOG} SELECT author, CAST(sum(repost_of_id) AS BIGINT) AS total, arg_min(event_id, detected_at) AS first_event, arg_max(event_id, detected_at) AS last_event FROM log GROUP BY author")
def first_and_last_by_author(spark, sf_dir):
    return log(spark, sf_dir).groupBy("author").agg(F.sum("repost_of_id").alias("total"), F.min_by("event_id", "detected_at").alias("first_event"), F.max_by("event_id", "detected_at").alias("last_event"))


@query(f"""WITH {LOG}, b AS (SELECT CAST(floor(epoch(detected_at) / 600) AS BIGINT) AS bucket, round(avg(value), 6) AS mean_value FROM log GROUP BY 1),
s AS (SELECT unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b))) AS bucket) SELECT CAST(s.bucket * 600 AS BIGINT) AS bucket_start, mean_value FROM s LEFT JOIN b USING (bucket)""")
def bucket_means(spark, sf_dir):
    return stats.bucket_means(log(spark, sf_dir), "detected_at", "value", 600)


@query(f"WITH {LOG} SELECT event_id, count(*) OVER (PARTITION BY author ORDER BY epoch_us(detected_at) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS trailing FROM log")
def requests_in_last_hour(spark, sf_dir):
    return stats.trailing_count(log(spark, sf_dir), "author", "detected_at", 3600).select("event_id", "trailing")


@query("SELECT l_orderkey AS after_id, nxt - l_orderkey - 1 AS missing FROM (SELECT l_orderkey, lead(l_orderkey) OVER (ORDER BY l_orderkey) AS nxt FROM (SELECT DISTINCT l_orderkey FROM lineitem)) WHERE nxt - l_orderkey > 1")
def id_gaps(spark, sf_dir):
    return stats.gaps(views.table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT o_custkey, o_orderkey, CAST(rank AS INT) AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rank FROM orders) WHERE rank <= 5")
def newest_by_customer(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return search.top_by(o, ["o_custkey"], [F.col("o_orderkey").desc()], 5)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 100 OFFSET 20")
def feed_page(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").orderBy(F.col("o_orderkey").desc()).offset(20).limit(100)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").where(F.col("o_orderkey") > 100).select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(50)


@query("""WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000)
SELECT k, 'a' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'b' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def ids_on_one_side(spark, sf_dir):
    a = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    b = views.table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 200_000).select(F.col("o_custkey").alias("k"))
    return stats.symmetric_difference(a, b, "k")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def watches_without_post(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").join(views.table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 200_000), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(f"WITH {LOG} SELECT post_type, author, count(*) AS n FROM log GROUP BY ROLLUP (post_type, author)")
def rollup_by_type_and_author(spark, sf_dir):
    return log(spark, sf_dir).rollup("post_type", "author").agg(F.count("*").alias("n"))


@query(f"WITH {LOG} SELECT CAST(day AS VARCHAR) AS day, post_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, CAST(detected_at AS DATE) AS day FROM log) GROUP BY ALL")
def counts_by_day(spark, sf_dir):
    return log(spark, sf_dir).groupBy(F.date_format("detected_at", "yyyy-MM-dd").alias("day"), "post_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT label, count(*) AS posts, CAST(sum(quality) AS BIGINT) AS good, round(100.0 * sum(toxic) / count(*), 4) AS toxic_percent FROM (SELECT l.*, d.lang AS label FROM labels l JOIN documents d USING (doc_id)) GROUP BY label")
def delete_percent(spark, sf_dir):
    d = views.table(spark, sf_dir, "labels").join(views.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label")), "doc_id")
    return d.groupBy("label").agg(F.count("*").alias("posts"), F.sum("quality").alias("good"), F.round(100.0 * F.sum("toxic") / F.count("*"), 4).alias("toxic_percent"))
