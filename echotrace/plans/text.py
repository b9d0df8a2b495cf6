"""Scalar and string functions over ids, urls, pages and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..sources import views
from .registry import registry

QUERIES, ORACLES, query = registry()


@query("SELECT doc_id, CASE WHEN doc_id = 0 THEN '' ELSE lower(to_base(doc_id, 36)) END AS post_id FROM documents")
def base36_ids(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", expr.base36(F.col("doc_id")).alias("post_id"))


@query("SELECT doc_id AS id, doc_id + 4 AS last_id FROM documents")
def next_ids_round_trip(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    ids = expr.next_ids(expr.base36(F.col("doc_id")), 5)
    return d.select(expr.from_base36(F.get(ids, 0)).alias("id"), expr.from_base36(F.get(ids, 4)).alias("last_id"))


@query("SELECT doc_id, md5(text) AS url_hash, md5(source || '|' || lang) AS pair_hash FROM documents")
def content_hashes(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(F.col("text").cast("binary")).alias("url_hash"), F.md5(F.concat_ws("|", "source", "lang").cast("binary")).alias("pair_hash"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def url_parts(spark, sf_dir):
    return views.links(spark, sf_dir).select("page_id", "host", expr.path(F.col("url")).alias("path"))


@query("""SELECT page_id, CAST(len(l) AS INT) AS n_links, CAST(len(list_distinct(l)) AS INT) AS n_distinct FROM (SELECT page_id, regexp_extract_all(html, 'href=[''"]?([^''" >]+)', 1) AS l FROM pages)""")
def link_counts(spark, sf_dir):
    p = views.links(spark, sf_dir)
    return p.select("page_id", F.size(F.regexp_extract_all("html", F.lit("""href=['"]?([^'" >]+)"""), F.lit(1))).alias("n_links"), F.size(expr.hrefs(F.col("html"))).alias("n_distinct"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS pages, min(page_id) AS first_page FROM pages GROUP BY 1")
def pages_by_host(spark, sf_dir):
    return views.links(spark, sf_dir).groupBy("host").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '\\.(jpg|jpeg|png|gif)') THEN 'image' WHEN contains(html, '<video') THEN 'video' WHEN contains(html, '<img') THEN 'gallery' END AS post_type, CASE WHEN regexp_matches(lower(url), '\\.(jpg|jpeg|png|gif)') THEN 'image' END AS by_url, regexp_matches(lower(url), '\\.(jpg|jpeg|gif|png)') AS is_image FROM pages")
def post_types(spark, sf_dir):
    p = views.links(spark, sf_dir)
    return p.select("page_id", expr.post_type(F.lit(False), F.col("url"), is_video=F.contains("html", F.lit("<video")), is_gallery=F.contains("html", F.lit("<img"))).alias("post_type"), expr.post_type_of_url(F.col("url")).alias("by_url"), expr.is_image_url(F.col("url")).alias("is_image"))


@query("""SELECT conv_id, turn, CASE WHEN w IN ('repost', 'watch', 'unwatch') THEN w ELSE 'repost' END AS command FROM (SELECT conv_id, turn, lower(regexp_extract(trim(text), '^(\\S*)', 1)) AS w FROM conversations WHERE role = 'user')""")
def commands(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select("conv_id", "turn", expr.command(F.col("text")).alias("command"))


@query("""SELECT conv_id, turn, trim(substring(text, strpos(lower(text), 'the') + 3)) AS rest FROM conversations WHERE strpos(lower(text), 'the') > 2""")
def text_after_tag(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", expr.strip_tag(F.col("text"), "the", "?no such fallback").alias("rest")).where(F.col("rest").isNotNull())


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'and')")
def keyword_matches(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").where(expr.has_keyword(F.col("text"), F.lit("license,and"))).select("doc_id")


@query("SELECT o_orderkey, CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(o_orderdate)) / 86400000000) AS BIGINT) AS age_days FROM orders")
def post_ages(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select("o_orderkey", expr.age_days(views.now(), F.col("o_orderdate")).alias("age_days"))


@query("SELECT p_partkey, round_even(100.0 - (p_size % 33) / 32.0 * 100, 2) AS percent, 64 - p_size / 100.0 * 64 AS target FROM part")
def match_percents(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    return p.select("p_partkey", expr.match_percent(F.col("p_size") % 33, F.lit(32.0)).alias("percent"), expr.target_distance(F.col("p_size"), 64).cast("double").alias("target"))


@query()
def title_similarities(spark, sf_dir):
    """Each part's name against its type."""
    p = views.table(spark, sf_dir, "part")
    return p.select("p_partkey", expr.title_similarity(F.col("p_name"), F.col("p_type")).alias("similarity"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT n_regionkey, string_agg('|' || n_name || '|' || n_nationkey || '|', chr(10) ORDER BY n_nationkey) AS table_text FROM nation GROUP BY n_regionkey")
def markdown_rows(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation")
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return n.groupBy("n_regionkey").agg(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("|"), r["n_name"], F.lit("|"), r["n_nationkey"].cast("string"), F.lit("|"))), "\n").alias("table_text"))
