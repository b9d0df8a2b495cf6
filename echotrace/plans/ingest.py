"""From raw submissions to posts, and the parts of replies, over the derived tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr, media, messages
from ..operators import filters, ingest
from ..sources import views
from .registry import registry

QUERIES, ORACLES, query = registry()

SITE = "https://search.example/search"


def t(spark, sf_dir, name):
    return views.table(spark, sf_dir, name)


@query("""SELECT CASE WHEN doc_id = 0 THEN '' ELSE lower(to_base(doc_id, 36)) END AS post_id, CAST(doc_id * 60 + 1700000000 AS BIGINT) AS created, source AS author, lang AS subreddit, n_chars > 1000 AS is_crosspost, CASE WHEN n_chars < 2000 THEN n_chars < 200 END AS nsfw,
md5('https://host/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.jpg' ELSE '' END) AS url_hash, CAST(CASE WHEN n_chars < 500 THEN 1 WHEN n_chars < 1500 THEN 3 WHEN doc_id % 3 = 0 THEN 2 WHEN doc_id % 3 = 1 THEN 7 WHEN n_chars < 3000 THEN 6 END AS INT) AS post_type_id FROM documents""")
def submissions_as_posts(spark, sf_dir):
    """Submissions written as JSON and read back as posts."""
    n = F.col("n_chars")
    raw = t(spark, sf_dir, "documents").select(F.to_json(F.struct(
        expr.base36(F.col("doc_id")).alias("id"), F.concat(F.lit("https://host/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".jpg").otherwise("")).alias("url"), F.col("source").alias("author"), (F.col("doc_id") * 60 + 1_700_000_000).cast("double").alias("created_utc"),
        F.col("lang").alias("subreddit"), F.when(n > 1000, "t3_parent").otherwise("").alias("crosspost_parent"), F.when(n < 2000, n < 200).alias("over_18"), (n < 500).alias("is_self"), F.when(n < 1500, "link").alias("post_hint"),
        F.when(F.col("doc_id") % 3 == 1, True).alias("is_video"), (n < 3000).alias("is_gallery"),
    )).alias("raw"))
    return ingest.posts_of(raw).select("post_id", F.unix_seconds("created_at").alias("created"), "author", "subreddit", "is_crosspost", "nsfw", "url_hash", "post_type_id")


@query("""SELECT l_orderkey, coalesce(string_agg('https://i.redd.it/' || l_orderkey || '_' || l_linenumber || CASE l_returnflag WHEN 'A' THEN '.jpg' WHEN 'N' THEN '.png' ELSE '.gif' END, ' ' ORDER BY l_linenumber, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 3 ELSE 1 END) FILTER (WHERE l_linestatus = 'O'), '') AS links FROM lineitem GROUP BY l_orderkey""")
def gallery_links(spark, sf_dir):
    """An order's lines as a gallery's pictures; F lines failed."""
    entry = F.struct("l_linenumber", F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"), F.when(F.col("l_linestatus") == "O", "valid").otherwise("failed").alias("status"), F.when(F.col("l_returnflag") == "A", "image/jpg").when(F.col("l_returnflag") == "N", "image/png").otherwise("image/gif").alias("m"))
    g = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("media"))
    return g.select("l_orderkey", F.array_join(messages.gallery_links(F.col("media")), " ").alias("links"))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN CAST(doc_id AS VARCHAR) WHEN 'de' THEN 'x' || doc_id END AS post_id FROM documents""")
def post_ids_of_urls(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    ident = F.col("doc_id").cast("string")
    url = F.when(F.col("lang") == "en", F.concat(F.lit("https://host/r/sub/comments/"), ident, F.lit("/title/"))).when(F.col("lang") == "de", F.concat(F.lit("https://short.it/x"), ident)).otherwise("https://host/other")
    return d.select("doc_id", messages.post_id_of_url(url).alias("post_id"))


@query("""SELECT o_custkey, min(o_orderkey) AS first_id, 't3_' || min(o_orderkey) || ',t3_' || max(o_orderkey) AS ids, CAST(min(o_orderkey) AS VARCHAR) || ' ' || max(o_orderkey) AS back FROM orders GROUP BY o_custkey""")
def request_ids(spark, sf_dir):
    """Ids into a request and out of its url."""
    o = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("b"))
    ids = messages.prefixed_ids(F.array(F.col("first_id").cast("string"), F.col("b").cast("string")))
    return o.select("o_custkey", "first_id", ids.alias("ids"), F.array_join(messages.ids_of_request(F.concat(F.lit("https://host/api/info?id="), ids)), " ").alias("back"))


@query("""WITH m AS (SELECT md5(text) AS h, lang, count(*) AS n, min(doc_id) AS a, max(doc_id) AS b, sum(n_chars) AS c FROM documents GROUP BY md5(text), lang)
SELECT a AS id, n - 1 AS match_count, CASE WHEN n - 1 > 1 THEN 'times' ELSE 'time' END AS times_word, '**Searched' || CASE lang WHEN 'en' THEN ' Images' WHEN 'de' THEN ' Links' ELSE '' END || ':** ' || format('{:,}', CAST(c * 1000 AS BIGINT)) AS searched, 
CASE WHEN n > 1 THEN 'First Seen ' || a || ' on ' || strftime(TIMESTAMP '2024-01-01' + to_minutes(a), '%Y-%m-%d') END AS first_seen, CASE WHEN n > 2 THEN 'Last Seen ' || b || ' on ' || strftime(TIMESTAMP '2024-01-01' + to_minutes(b), '%Y-%m-%d') ELSE CASE WHEN n > 1 THEN '' END END AS last_seen,
CASE WHEN lang = 'en' THEN 'Unlimited' ELSE '190' END AS max_age FROM m""")
def message_values(spark, sf_dir):
    """What a reply to each content's first post says."""
    g = t(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("h"), "lang").agg((F.count("*") - 1).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum("n_chars").alias("c"))
    kind = F.when(F.col("lang") == "en", "image").when(F.col("lang") == "de", "link").otherwise("text")
    day = lambda c: F.date_format(F.timestamp_add("MINUTE", F.col(c).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd")
    seen = lambda word, c: F.concat(F.lit(f"{word} Seen "), F.col(c).cast("string"), F.lit(" on "), day(c))
    n = F.col("n")
    return g.select(
        F.col("a").alias("id"), n.alias("match_count"), messages.times_word(n).alias("times_word"), messages.searched_line(kind, F.col("c") * 1000).alias("searched"), F.when(n > 0, seen("First", "a")).alias("first_seen"),
        F.when(n > 1, seen("Last", "b")).when(n > 0, "").alias("last_seen"), messages.max_age(F.when(F.col("lang") == "en", messages.NO_AGE_LIMIT).otherwise(190)).alias("max_age"),
    )


@query(f"""SELECT c_custkey, '{SITE}?postId=' || c_custkey || '&sameSub=' || CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END || '&filterOnlyOlder=true&memeFilter=false&filterDeadMatches=' || CASE WHEN c_nationkey > 10 THEN 'true' ELSE 'false' END || '&targetImageMatch=' || c_nationkey || '&targetImageMemeMatch=97' AS link,
CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 12 WHEN 'AUTOMOBILE' THEN 3 ELSE 7 END AS INT) AS strictness FROM customer""")
def search_links(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    word = F.when(F.col("c_mktsegment") == "BUILDING", "loose").when(F.col("c_mktsegment") == "AUTOMOBILE", "tight").otherwise("other")
    link = messages.search_link(SITE, F.col("c_custkey"), same_sub=F.col("c_acctbal") > 0, only_older=F.lit(True), meme_filter=F.lit(False), dead=F.col("c_nationkey") > 10, percent=F.col("c_nationkey"), meme_percent=F.lit(97))
    return c.select("c_custkey", link.alias("link"), messages.strictness_distance(word, 12, 3, 7).alias("strictness"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def report_bodies(spark, sf_dir):
    """Bodies that are JSON, or hold it between other words."""
    body = F.when(F.col("event_type") == "click", F.col("props")).otherwise(F.concat(F.lit("see this: "), F.col("props"), F.lit(" thanks } ")))
    return t(spark, sf_dir, "events").select("event_id", F.get_json_object(messages.body_json(body), "$.k").cast("bigint").alias("k"))


@query("SELECT page_id, regexp_replace(replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/i/', ''), '([^/.])\\.[^./]*$', '\\1') AS stem FROM pages")
def file_stems(spark, sf_dir):
    return views.links(spark, sf_dir).select("page_id", messages.file_stem(expr.path(F.col("url"))).alias("stem"))


@query("SELECT event_id, value >= 5 AS alike, value < 5 AS near, value IS NOT NULL AS hashed FROM events")
def distance_filters(spark, sf_dir):
    v = F.col("value")
    return t(spark, sf_dir, "events").select("event_id", filters.text_alike(v, 5).alias("alike"), filters.below(v, 5).alias("near"), filters.has_hash(v).alias("hashed"))


@query("SELECT d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 0 AND l.quality = 1")
def live_matches(spark, sf_dir):
    """A url that gave no answer, or another than 200, is dead."""
    status = t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, 404).when(F.col("quality") == 1, 200).alias("status"))
    return t(spark, sf_dir, "documents").select("doc_id").join(status, "doc_id", "left").where(filters.alive(F.col("status"))).select("doc_id")


@query("""WITH m AS (SELECT e.event_id, e.user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events e)
SELECT m.event_id FROM m LEFT JOIN labels l ON l.doc_id = m.k WHERE n > 100 OR coalesce(l.toxic, 0) <> 1""")
def matches_not_removed(spark, sf_dir):
    """A search of more than 100 matches keeps them all."""
    e = views.reposts(spark, sf_dir)
    n = e.groupBy("author").agg(F.count("*").alias("n"))
    gone = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("repost_of_id"), (F.col("toxic") == 1).alias("removed"))
    return e.join(n, "author").join(gone, "repost_of_id", "left").where(filters.not_removed(F.col("removed"), F.col("n"))).select("event_id")


@query("""SELECT e.event_id FROM events e JOIN customer c ON c.c_custkey = e.user_id LEFT JOIN supplier s ON s.s_suppkey = e.user_id
WHERE NOT coalesce(s.s_acctbal < 1000, false) AND ((e.event_type = 'click' AND c.c_acctbal > 0) OR (e.event_type = 'view' AND c.c_nationkey > 10)) AND NOT e.value > 20 AND NOT (contains(lower(c.c_name), '7') OR contains(lower(c.c_name), 'xyz'))""")
def posts_to_check(spark, sf_dir):
    """Posts of monitored communities whose settings ask for a check: a whitelist, flags by type, crossposts, keywords."""
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), (F.col("s_acctbal") < 1000).alias("ignored"))
    e = t(spark, sf_dir, "events").join(t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("user_id")).join(s, "user_id", "left")
    keep = filters.should_check(F.col("event_type"), {"click": F.col("c_acctbal") > 0, "view": F.col("c_nationkey") > 10}, ignored=F.col("ignored"), crosspost=F.col("value") > 20, title=F.col("c_name"), keywords=F.lit("7,xyz"))
    return e.where(keep).select("event_id")


@query("""SELECT e.event_id, d.doc_id AS post_id FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) e JOIN documents d ON d.doc_id = e.k WHERE e.event_type = 'error' AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def reports_for_voting(spark, sf_dir):
    """Reports of posts that are neither a template nor proposed as one, and that exist."""
    r, labels = views.reposts(spark, sf_dir).where(F.col("post_type") == "error").select("event_id", F.col("repost_of_id").alias("doc_id")), t(spark, sf_dir, "labels")
    for known in (labels.where(F.col("toxic") == 1), labels.where(F.col("quality") == 0)):
        r = r.join(known.select("doc_id"), "doc_id", "left_anti")
    return r.join(t(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi").select("event_id", F.col("doc_id").alias("post_id"))


@query("SELECT p.p_partkey FROM part p WHERE p.p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 AND l_partkey IS NOT NULL)")
def templates_without_vote(spark, sf_dir):
    voted = t(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)).select(F.col("l_partkey").alias("p_partkey"))
    return t(spark, sf_dir, "part").select("p_partkey").join(voted, "p_partkey", "left_anti")


@query("""SELECT d.doc_id, string_agg(DISTINCT b.h, ',' ORDER BY b.h) AS hashes, min(b.h) AS first_hash FROM documents d LEFT JOIN (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS doc_id, event_type AS h FROM events) b ON b.doc_id = d.doc_id GROUP BY d.doc_id""")
def posts_with_hashes(spark, sf_dir):
    """Each post with all that is stored for it, and the first of it; null where nothing is."""
    h = views.reposts(spark, sf_dir).select(F.col("repost_of_id").alias("doc_id"), F.col("post_type").alias("h")).distinct()
    g = h.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("h")), ",").alias("hashes"), F.min("h").alias("first_hash"))
    return t(spark, sf_dir, "documents").select("doc_id").join(g, "doc_id", "left")


@query("""SELECT s_suppkey, CASE WHEN n_nationkey < 5 THEN 'high' WHEN s_acctbal > 0 THEN 'low' ELSE 'none' END AS knob, string_agg(k, ',' ORDER BY k) AS missing FROM supplier JOIN nation ON n_nationkey = s_nationkey, LATERAL (VALUES ('age', s_acctbal > 5000), ('percent', n_nationkey > 12), ('title', false)) v(k, present) WHERE NOT present GROUP BY ALL""")
def missing_settings(spark, sf_dir):
    """Settings that a community's own configuration lacks, and one where its value wins over the default."""
    s = t(spark, sf_dir, "supplier").join(t(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    has = F.filter(F.array(F.when(F.col("s_acctbal") > 5000, "age"), F.when(F.col("n_nationkey") > 12, "percent")), lambda x: x.isNotNull())
    own = F.create_map(F.lit("knob"), F.when(F.col("n_nationkey") < 5, "high"))
    default = F.create_map(F.lit("knob"), F.when(F.col("s_acctbal") > 0, "low").otherwise("none"))
    return s.select("s_suppkey", F.coalesce(own["knob"], default["knob"]).alias("knob"), F.array_join(F.array_sort(F.array_except(F.array(F.lit("age"), F.lit("percent"), F.lit("title")), has)), ",").alias("missing"))


@query("""SELECT o_custkey, CAST(chunk AS BIGINT) AS chunk, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS ids FROM (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3 AS chunk FROM orders) GROUP BY o_custkey, chunk""")
def chunked_ids(spark, sf_dir):
    """Ids in lots of three, none collected whole."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(n / 3).alias("chunk"))
    return o.groupBy("o_custkey", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT event_id, round(sin(value), 9) AS s, round(cos(value), 9) AS c, round(10 * log10(value + 1), 9) AS db FROM events")
def trigonometry(spark, sf_dir):
    v = F.col("value")
    return t(spark, sf_dir, "events").select("event_id", F.round(F.sin(v), 9).alias("s"), F.round(F.cos(v), 9).alias("c"), F.round(10 * F.log10(v + 1), 9).alias("db"))


#: Bits of a list of truths as hexadecimal digits, whole bytes.
BITS = "array_to_string(list_transform(range(0, CAST(ceil(len(b) / 8.0) AS BIGINT) * 2), lambda k: format('{{:x}}', list_sum(list_transform(range(0, 4), lambda j: CASE WHEN coalesce(b[k * 4 + j + 1], false) THEN CAST(8 >> j AS INT) ELSE 0 END))::INT)), '')"


@query(f"""WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT id, list_transform(v, lambda x: round(x - list_avg(v), 9) > 0) AS b FROM e) SELECT id, {BITS.replace("{{", "{").replace("}}", "}")} AS ahash FROM p""")
def average_hashes(spark, sf_dir):
    """Each vector as a picture of eight by eight."""
    e = t(spark, sf_dir, "embeddings")
    pictures = e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("pixels"), F.lit(8).alias("width"))
    return media.with_hashes(pictures, size=8, names=("ahash",)).select("id", "ahash")


@query(f"""WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, unnest(range(0, 5)) AS place FROM embeddings),
p AS (SELECT id, place, list_transform(range(0, 9), lambda k: round(v[place * 12 + (k // 3) * 4 + k % 3 + 2], 6) > round(v[place * 12 + (k // 3) * 4 + k % 3 + 1], 6)) AS b FROM e) SELECT id, CAST(place AS INT) AS place, {BITS.replace("{{", "{").replace("}}", "}")} AS hash FROM p""")
def gallery_hashes(spark, sf_dir):
    """Each vector as a gallery of five pictures of three by four, and what is left over, which makes none."""
    e = t(spark, sf_dir, "embeddings")
    picture = lambda k: F.struct(F.transform(F.slice("embedding", 12 * k + 1, 12 if k < 5 else 3), lambda x: x.cast("double")).alias("pixels"), F.lit(4).alias("width"))
    galleries = e.select(F.col("vec_id").alias("id"), F.array(*(picture(k) for k in range(6))).alias("pictures"))
    return media.gallery_hashes(galleries, size=3).select("id", "place", "hash")
