"""Ingest, deletes, watches and moderation over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import promoters, writes
from ..sources import views
from .registry import registry

QUERIES, ORACLES, query = registry()


def t(spark, sf_dir, name):
    return views.table(spark, sf_dir, name)


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang FROM documents WHERE lang IS DISTINCT FROM 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def ingest_absent(spark, sf_dir):
    """Good documents come in where a table already holds the English ones."""
    d = t(spark, sf_dir, "documents").select("doc_id", "lang")
    good = t(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")
    return writes.insert_absent(d.where(F.col("lang") == "en"), d.join(good, "doc_id", "left_semi"), "doc_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def watch_state(spark, sf_dir):
    return writes.latest_state(t(spark, sf_dir, "events"), ["user_id"], "event_id", "event_id", "event_type")


@query("SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def after_delete(spark, sf_dir):
    return writes.without(t(spark, sf_dir, "documents").select("doc_id", "source"), t(spark, sf_dir, "labels").where(F.col("toxic") == 1), "doc_id")


STATUS = "status AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'removed' WHEN quality = 0 THEN 'moderator' ELSE 'ok' END AS status FROM labels)"


def statuses(spark, sf_dir):
    return t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "removed").when(F.col("quality") == 0, "moderator").otherwise("ok").alias("status"))


@query(f"WITH {STATUS} SELECT d.doc_id FROM documents d LEFT JOIN status s USING (doc_id) WHERE coalesce(status NOT IN ('removed'), true)")
def dead_links_filtered(spark, sf_dir):
    """Unknown liveness keeps the match."""
    return writes.kept_by_status(t(spark, sf_dir, "documents").select("doc_id"), statuses(spark, sf_dir), "doc_id", ["removed"], True)


@query(f"WITH {STATUS} SELECT d.doc_id FROM documents d JOIN status s USING (doc_id) WHERE status NOT IN ('removed', 'moderator')")
def removed_posts_filtered(spark, sf_dir):
    """What the status table doesn't know is dropped."""
    return writes.kept_by_status(t(spark, sf_dir, "documents").select("doc_id"), statuses(spark, sf_dir), "doc_id", ["removed", "moderator"], False)


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND length(text) > 0 AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'assistant' AND turn = 0)")
def open_mentions(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    answered = c.where((F.col("role") == "assistant") & (F.col("turn") == 0))
    return c.where((F.col("role") == "user") & (F.length("text") > 0)).join(answered.select("conv_id"), "conv_id", "left_anti").select("conv_id", "turn")


@query("""SELECT c_custkey, CAST(CASE WHEN c_acctbal < 0 THEN c_nationkey % 5 + 1 ELSE 0 END AS INT) AS failures,
CASE WHEN c_acctbal >= 0 THEN 'reset' WHEN c_nationkey % 5 + 1 >= 4 THEN 'remove' WHEN c_nationkey % 5 + 1 = 2 THEN 'notify' ELSE 'count' END AS act FROM customer""")
def admin_checks(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    s = writes.admin_check(F.col("c_acctbal") < 0, F.col("c_nationkey") % 5)
    return c.withColumn("s", s).select("c_custkey", F.col("s.failures").cast("int").alias("failures"), F.col("s.act").alias("act"))


@query("SELECT o_custkey, CAST(ceil(count(*) / 3.0) AS INT) AS n_chunks, CAST(count(*) AS INT) AS n FROM orders GROUP BY o_custkey")
def order_chunks(spark, sf_dir):
    ids = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.col("o_orderkey").cast("string"))).alias("ids"))
    return ids.select("o_custkey", F.size(writes.chunks(F.col("ids"), 3)).alias("n_chunks"), F.size(F.flatten(writes.chunks(F.col("ids"), 3))).alias("n"))


@query("""SELECT r.event_id, p.doc_id AS post_id, o.doc_id AS original_id FROM events r JOIN documents p ON p.doc_id = r.user_id JOIN documents o ON o.doc_id = CAST(json_extract(r.props, '$.k') AS BIGINT) WHERE p.source <> o.source""")
def repost_history(spark, sf_dir):
    """The log joined with posts twice."""
    log, d = views.reposts(spark, sf_dir), t(spark, sf_dir, "documents").select("doc_id", "source")
    p, o = (d.select(F.col("doc_id").alias(f"{x}_id"), F.col("source").alias(f"{x}_source")) for x in ("post", "original"))
    both = log.join(p, F.col("post_id") == F.col("author")).join(o, F.col("original_id") == F.col("repost_of_id"))
    return both.where(F.col("post_source") != F.col("original_source")).select("event_id", "post_id", "original_id")


@query("""SELECT s.s_suppkey, coalesce(n.n_name, 'none') AS name, s.s_acctbal > 5000 OR s.s_acctbal IS NULL AS refresh FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey AND n.n_nationkey < 10""")
def enriched_communities(spark, sf_dir):
    n = t(spark, sf_dir, "nation").where(F.col("n_nationkey") < 10)
    s = t(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return s.select("s_suppkey", F.coalesce("n_name", F.lit("none")).alias("name"), ((F.col("s_acctbal") > 5000) | F.col("s_acctbal").isNull()).alias("refresh"))


@query(r"""WITH flagged AS (SELECT w AS word, min(doc_id) AS place FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]{11,}')) AS w FROM documents) GROUP BY w), landing(word, place) AS (VALUES ('example.net', 0), ('/de', 1)),
said AS (SELECT page_id AS u, 0 AS source, 0 AS pos, regexp_extract(html, '<title>([^<]*)', 1) AS text FROM pages UNION ALL SELECT page_id, 1, 0, url FROM pages
UNION ALL SELECT page_id, 3, unnest(range(0, len(links))), unnest(links) FROM (SELECT page_id, list_distinct_ordered AS links FROM (SELECT page_id, list_reduce(regexp_extract_all(html, 'href=[''"]?([^''" >]+)', 1), lambda a, x: CASE WHEN list_contains(a, x) THEN a ELSE list_append(a, x) END, CAST([] AS VARCHAR[])) AS list_distinct_ordered FROM pages))),
hits AS (SELECT u, source, word FROM (SELECT u, source, word, row_number() OVER (PARTITION BY u, source ORDER BY pos, place, word) AS rn FROM said JOIN flagged ON contains(said.text, flagged.word)) WHERE rn = 1),
led AS (SELECT u, source, text AS url FROM (SELECT u, source, text, row_number() OVER (PARTITION BY u, source ORDER BY pos) AS rn FROM said JOIN landing ON contains(text, word) WHERE source > 0) WHERE rn = 1),
guilty AS (SELECT url, word FROM (SELECT p.url, word, row_number() OVER (PARTITION BY p.url ORDER BY place, word) AS rn FROM (SELECT DISTINCT p.url, html FROM pages p JOIN led USING (url)) p JOIN flagged ON contains(html, word)) WHERE rn = 1),
every AS (SELECT u, source, word FROM hits UNION ALL SELECT u, source + 1, word FROM led JOIN guilty USING (url))
SELECT u AS "user", ['Bio', 'Profile', 'Profile landing', 'Comment', 'Comment landing'][arg_min(source, source) + 1] AS source, arg_min(word, source) AS url FROM every GROUP BY u""")
def promoting_users(spark, sf_dir):
    """Each page as a user: its title is the bio, its own address the profile's link, its links those in comments; long words are flagged."""
    words = t(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z]{11,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.min("doc_id").alias("place"))
    landing = spark.createDataFrame([("example.net", 0), ("/de", 1)], "word string, place bigint")
    pages, user = t(spark, sf_dir, "pages"), F.col("page_id").alias("user")
    bios = pages.select(user, F.regexp_extract("html", "<title>([^<]*)", 1).alias("bio"))
    return promoters.promoters(bios, pages.select(user, F.array("url").alias("links")), pages.select(user, expr.hrefs(F.col("html")).alias("links")), words, landing, pages)


@query("""SELECT doc_id, CASE WHEN contains(text, 'http') THEN 'bio' WHEN contains(text, '@') THEN 'profile' WHEN contains(text, 'password') THEN 'comment' END AS found_in FROM documents""")
def promoter_links(spark, sf_dir):
    """The first source that hits names the finding."""
    text = F.col("text")
    hit = F.coalesce(F.when(F.contains(text, F.lit("http")), "bio"), F.when(F.contains(text, F.lit("@")), "profile"), F.when(F.contains(text, F.lit("password")), "comment"))
    return t(spark, sf_dir, "documents").select("doc_id", hit.alias("found_in"))


@query("""SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AND d.source NOT IN ('src0', 'src1') AND d.n_chars >= 100""")
def front_page_gates(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    commented = t(spark, sf_dir, "labels").where(F.col("quality") == 0).select("doc_id")
    banned = spark.createDataFrame([("src0",), ("src1",)], "source string")
    return d.where(F.col("n_chars") >= 100).join(commented, "doc_id", "left_anti").join(F.broadcast(banned), "source", "left_anti").select("doc_id")


@query("""SELECT doc_id, 'text' AS search FROM documents WHERE lang = 'en' UNION ALL SELECT page_id, 'link' FROM pages WHERE contains(url, 'example.com') UNION ALL SELECT vec_id, 'image' FROM embeddings WHERE label <> 0""")
def search_router(spark, sf_dir):
    """One branch for each kind of post, with its own gate."""
    branch = lambda name, key, gate, kind: t(spark, sf_dir, name).where(gate).select(F.col(key).alias("doc_id"), F.lit(kind).alias("search"))
    return branch("documents", "doc_id", F.col("lang") == "en", "text").unionByName(branch("pages", "page_id", F.contains("url", F.lit("example.com")), "link")).unionByName(branch("embeddings", "vec_id", F.col("label") != 0, "image"))


@query("""SELECT p_partkey, substring(sha1(p_name || '|' || p_brand || '|' || p_size), 1, 20) AS fingerprint FROM part""")
def pair_fingerprints(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.substring(F.sha1(F.concat_ws("|", "p_name", "p_brand", F.col("p_size").cast("string")).cast("binary")), 1, 20).alias("fingerprint"))


@query("""SELECT a.event_id, b.event_id AS next_event FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) a JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) b
ON a.user_id = b.user_id AND b.rn > a.rn AND b.rn <= a.rn + 3""")
def peak_pairs(spark, sf_dir):
    """Each event with the next three of its user."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, 3)
    return t(spark, sf_dir, "events").withColumn("following", F.collect_list("event_id").over(w)).select("event_id", F.explode("following").alias("next_event"))
