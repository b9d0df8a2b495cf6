"""Exact and near-duplicate search over posts, hashes and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import filters, near, search, two_stage, vectors
from ..sources import tables, views
from .registry import registry

QUERIES, ORACLES, query = registry()

POSTS = "posts AS (SELECT doc_id AS id, source AS author, lang AS community, doc_id AS minute, md5(text) AS url_hash, n_chars FROM documents)"
HASHES = "hashes AS (SELECT vec_id AS id, label, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS hash FROM embeddings)"


def _signed(digits):
    """Documents by the signature of their words, of 16 times as many digits."""
    return f"""words AS (SELECT doc_id, source, lang, list_transform(list_distinct(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), lambda w: md5(w)) AS sums FROM documents WHERE text IS NOT NULL),
signed AS (SELECT doc_id AS id, source AS author, lang AS community, doc_id AS minute, array_to_string(list_transform(['0', '1', '2', '3', '4', '5', '6', '7', '8', '9', 'a', 'b', 'c', 'd', 'e', 'f'], lambda d: coalesce(right(list_min(list_filter(sums, lambda h: starts_with(h, d))), {digits}), '{"0" * digits}')), '') AS hash FROM words)"""


SIGNED = _signed(1)
CLASSES = f"{_signed(4)}, classes AS (SELECT hash, min(id) AS id FROM signed GROUP BY hash)"


@query(f"""WITH {POSTS}, pairs AS (SELECT p.id, p.author, m.id AS repost_of_id, m.author AS of_author, row_number() OVER (PARTITION BY p.id ORDER BY m.minute, m.id) AS rn
FROM posts p JOIN posts m ON p.url_hash = m.url_hash AND m.minute < p.minute AND m.author <> p.author)
SELECT id, repost_of_id, author, of_author FROM pairs WHERE rn = 1""")
def oldest_earlier_copy(spark, sf_dir):
    return search.oldest_earlier(views.posts(spark, sf_dir))


@query(f"WITH {POSTS} SELECT url_hash, count(*) AS match_count, arg_min(id, minute) AS oldest_id, arg_max(id, minute) AS newest_id FROM posts GROUP BY url_hash HAVING count(*) > 1")
def copy_groups(spark, sf_dir):
    return search.copy_groups(views.posts(spark, sf_dir))


@query(f"WITH {POSTS} SELECT community, count(*) AS posts, count(DISTINCT url_hash) AS contents, count(*) - count(DISTINCT url_hash) AS copies FROM posts GROUP BY community")
def copies_by_community(spark, sf_dir):
    g = views.posts(spark, sf_dir).groupBy("community", "url_hash").agg(F.count("*").alias("c")).groupBy("community").agg(F.sum("c").alias("posts"), F.count("*").alias("contents"))
    return g.select("community", "posts", "contents", (F.col("posts") - F.col("contents")).alias("copies"))


@query(f"""WITH {CLASSES} SELECT a.id AS id_a, b.id AS id_b, CAST(hamming(a.hash, b.hash) AS INT) AS distance, round_even((100.0 - hamming(a.hash, b.hash) / 64.0 * 100)::DOUBLE, 2) AS percent FROM classes a JOIN classes b ON a.id < b.id AND hamming(a.hash, b.hash) <= 16""")
def near_image_hashes(spark, sf_dir):
    """Hashes of 64 digits that match by 75 %."""
    return near.near_hashes(views.signatures(spark, sf_dir, 4).select("id", "hash"), 64, 75)


@query(f"""WITH {CLASSES}, scored AS (SELECT s.id, m.id AS match_id, hamming(s.hash, m.hash) AS distance FROM signed s JOIN signed m ON s.id <> m.id),
best AS (SELECT id, match_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, match_id) AS rn FROM scored) WHERE rn = 1)
SELECT id, match_id, round_even((100.0 - distance / 64.0 * 100)::DOUBLE, 2) AS percent FROM best WHERE 100.0 - distance / 64.0 * 100 > 40""")
def closest_image_match(spark, sf_dir):
    """Each picture's closest one of all, if they match by more than 40 %."""
    return near.closest(views.signatures(spark, sf_dir, 4).select("id", "hash"), 64, 40)


def _both_signed():
    """Documents with the first and the second hash; the second can't be worked out for short texts, but is stored for those with a label."""
    return f"""{_signed(1)}, long_ AS ({_signed(16).split("signed AS (")[1].rsplit(")", 1)[0].replace("FROM words", "FROM words")}),
cached AS (SELECT DISTINCT doc_id FROM labels WHERE doc_id IS NOT NULL),
both_ AS (SELECT s.id, s.hash, CASE WHEN c.doc_id IS NOT NULL OR d.n_chars >= 300 THEN l.hash END AS second FROM signed s JOIN long_ l USING (id) JOIN documents d ON d.doc_id = s.id LEFT JOIN cached c ON c.doc_id = s.id)"""


@query(f"""WITH {_both_signed()}, templates AS (SELECT hash, min(id) AS template_id FROM both_ GROUP BY hash HAVING count(*) > 1),
near_ AS (SELECT id, template_id FROM (SELECT b.id, t.template_id, row_number() OVER (PARTITION BY b.id ORDER BY hamming(b.hash, t.hash), t.template_id) AS rn FROM both_ b JOIN templates t ON hamming(b.hash, t.hash) <= 1) WHERE rn = 1),
classes AS (SELECT hash, second, min(id) AS match_id, count(*) AS members FROM both_ GROUP BY hash, second)
SELECT q.id, c.match_id, CASE WHEN q.second IS NOT NULL THEN n.template_id END AS template_id, CAST(CASE WHEN q.second IS NULL THEN 0 ELSE hamming(q.second, c.second) END AS INT) AS distance, CAST(CASE WHEN q.second IS NULL THEN 16 ELSE 256 END AS INT) AS size, c.members
FROM both_ q JOIN near_ n USING (id) JOIN classes c ON c.hash = q.hash AND c.match_id < q.id WHERE q.second IS NULL OR (c.second IS NOT NULL AND hamming(q.second, c.second) <= 64)""")
def template_matches(spark, sf_dir):
    """Pictures of a template (a first hash that several have) with earlier ones of the same first hash, judged by the second one.

    Matches of one first and second hash are one, by the least id.
    """
    d = views.table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    labelled = views.table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("post_id")).distinct()
    signed = tables.written(d.select(F.col("doc_id").alias("id"), "n_chars", expr.signature(F.col("text")).alias("hash"), expr.signature(F.col("text"), 16).alias("made")))
    cache = labelled.join(signed, F.col("post_id") == F.col("id")).select("post_id", F.col("made").alias("hash"))
    seconds = two_stage.second_hashes(signed.select("id", "made", "n_chars"), cache, F.when(F.col("n_chars") >= 300, F.col("made")))
    popular = signed.groupBy("hash").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1").select("id", "hash")
    queries = two_stage.detected(signed.select("id", "hash"), popular, 16, 90)
    both = signed.select("id", "hash").join(seconds, "id")
    classes = both.groupBy("hash", "second").agg(F.min("id").alias("match_id"), F.count("*").alias("members"))
    matches = queries.join(signed.select("id", "hash"), "id").join(classes, "hash").where(F.col("match_id") < F.col("id")).select("id", "match_id", F.lit(0).alias("distance"), F.lit(16).alias("size"), "members")
    found = two_stage.judged(matches, queries, seconds, 256, 75)
    return found.join(matches.select("id", "match_id", "members"), ["id", "match_id"]).select("id", "match_id", "template_id", "distance", "size", "members")


#: Hits of two indexes whose entries' ids overlap: what starts with the same two digits.
HITS = """queries AS (SELECT * FROM signed WHERE id % 100 = 0), hits AS (SELECT q.id, m.id AS match_id, hamming(q.hash, m.hash) / 16.0 AS annoy_distance FROM queries q JOIN signed m ON substring(q.hash, 1, 2) = substring(m.hash, 1, 2))"""
IMAGE_SEARCH = f"""WITH {SIGNED}, {HITS}, kept AS (SELECT q.id, m.id AS match_id, CAST(hamming(q.hash, m.hash) AS INT) AS distance, m.minute FROM hits h JOIN queries q ON q.id = h.id JOIN signed m ON m.id = h.match_id
WHERE hamming(q.hash, m.hash) <= 12 AND annoy_distance <= 0.75 AND m.id <> q.id AND m.author IS DISTINCT FROM q.author AND m.minute < q.minute)"""


def _image_search(spark, sf_dir, sort_by):
    # Hashes are worked out once.
    s = tables.written(views.signatures(spark, sf_dir))
    queries = s.where(F.col("id") % 100 == 0)
    # Entries are numbered anew in each index.
    index_map = s.select(F.when(F.col("community") == "en", "historical").otherwise("current").alias("index_name"), F.floor(F.col("id") / 2).alias("index_id"), F.col("id").alias("post_id"), "hash")
    index_map = index_map.withColumn("index_name", F.concat("index_name", (F.col("post_id") - 2 * F.col("index_id")).cast("string")))
    start, numbers = F.substring("hash", 1, 2), search.as_numbers(F.col("hash"), 16)
    asked = queries.select("id", F.col("hash").alias("q"), numbers.alias("qn"), start.alias("k"))
    apart = search.hamming_of(F.col("q"), F.col("hash"), F.col("qn"), F.col("hn"), 16)
    hits = asked.join(index_map.withColumn("k", start).withColumn("hn", numbers), "k").select("id", "index_id", "index_name", (apart / 16.0).alias("annoy_distance"))
    at = lambda c: F.timestamp_seconds(c * 60)
    settings = filters.Settings(max_matches=5, max_days_old=None, target_match_percent=25.0, target_distance=0.75)
    return search.image_search(queries, hits, index_map.drop("hash"), s, settings, at(F.lit(10**9)), at, size=16, sort_by=sort_by)


@query(f"""{IMAGE_SEARCH} SELECT id, match_id, distance, round_even((100.0 - distance / 16.0 * 100)::DOUBLE, 2) AS percent, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY minute, match_id) AS rank FROM kept) WHERE rank <= 5""")
def image_search_by_time(spark, sf_dir):
    """Every hundredth post against all: index hits, both distances, the filters, the five oldest."""
    return _image_search(spark, sf_dir, "created")


@query(f"""{IMAGE_SEARCH} SELECT id, match_id, distance, round_even((100.0 - distance / 16.0 * 100)::DOUBLE, 2) AS percent, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, match_id) AS rank FROM kept) WHERE rank <= 5""")
def image_search_by_percent(spark, sf_dir):
    return _image_search(spark, sf_dir, "percent")


@query(f"""WITH {HASHES}, t AS (SELECT min(id) AS template_id, arg_min(hash, id) AS th FROM hashes GROUP BY label), d AS (SELECT h.id, t.template_id, CAST(hamming(h.hash, t.th) AS INT) AS distance FROM hashes h, t)
SELECT id, template_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, template_id) AS rn FROM d) WHERE rn = 1 AND distance <= 22.4""")
def meme_template_of(spark, sf_dir):
    """The first picture of each label is its template."""
    h = views.hashes(spark, sf_dir).select("id", "label", "hash")
    templates = h.groupBy("label").agg(F.min("id").alias("id"), F.min_by("hash", "id").alias("hash")).select("id", "hash")
    return search.nearest_template(h.select("id", "hash"), templates, 64, 65)


@query(r"""WITH t AS (SELECT min(doc_id) AS id, text FROM documents WHERE text IS NOT NULL GROUP BY text), w AS (SELECT id, md5(unnest(list_distinct(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))) AS m FROM t),
v AS (SELECT id, CAST('0x' || m[1:2] AS INT) // 4 AS k, sum(CASE WHEN m[3:3] >= '8' THEN 1 ELSE -1 END) AS x FROM w GROUP BY ALL), norms AS (SELECT id, sqrt(CAST(sum(x * x) AS DOUBLE)) AS n FROM v GROUP BY id HAVING sum(x * x) > 0),
pairs AS (SELECT a.id, b.id AS match_id, CAST(sum(a.x * b.x) AS DOUBLE) AS dot FROM v a JOIN v b ON a.k = b.k AND a.id <> b.id GROUP BY ALL),
s AS (SELECT p.id, match_id, round(dot / (x.n * y.n), 6) AS similarity FROM pairs p JOIN norms x ON x.id = p.id JOIN norms y ON y.id = p.match_id)
SELECT id, match_id, similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, match_id) AS rank FROM s WHERE similarity >= 0.91) WHERE rank <= 5""")
def near_texts(spark, sf_dir):
    """Each distinct text's five nearest of all that are alike by 0.91, from a stored index."""
    own = tables.written(views.text_vectors(spark, sf_dir))
    return vectors.Index.build(own, tables.shared_folder(spark)).within(own, 0.91, 5)


@query("""WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT a.id, b.id AS match_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON a.id <> b.id)
SELECT id, match_id, similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, match_id) AS rank FROM s) WHERE rank <= 3""")
def nearest_vectors(spark, sf_dir):
    """Every vector's three nearest of all, from a stored index of which all cells are read: these vectors are drawn at random, and no cell is further than another."""
    own = views.hashes(spark, sf_dir).select("id", "embedding")
    index = vectors.Index.build(own, tables.shared_folder(spark))
    return index.nearest(own, 3, len(index.centres))


@query("""WITH s AS (SELECT a.vec_id AS id, b.vec_id AS match_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS similarity
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT id, match_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, match_id) AS rn FROM s) WHERE rn = 1""")
def nearest_vector_in_label(spark, sf_dir):
    return search.nearest_in_block(views.hashes(spark, sf_dir), "label")


@query(f"""WITH {POSTS}, pairs AS (SELECT p.id, m.id AS match_id, row_number() OVER (PARTITION BY p.id ORDER BY m.minute, m.id) AS rn FROM posts p JOIN posts m
ON p.url_hash = m.url_hash AND m.id <> p.id AND m.author IS DISTINCT FROM p.author AND m.minute < p.minute AND m.community = p.community AND floor((44640 - m.minute) / 1440.0) <= 30)
SELECT id, match_id FROM pairs WHERE rn = 1""")
def oldest_filtered_copy(spark, sf_dir):
    """The whole chain of filters on all copies of each post, of which the oldest that passes is taken."""
    at = lambda c: F.timestamp_micros(F.unix_micros(F.lit(views.START).cast("timestamp_ntz").cast("timestamp")) + c.cast("bigint") * 60_000_000)
    # The clock stands at 31 days after the first post.
    return search.oldest_passing(views.posts(spark, sf_dir), filters.Settings(same_sub=True, max_days_old=30), at(F.lit(44_640)), at)


@query(f"WITH {POSTS} SELECT author, count(*) AS copies FROM (SELECT author, row_number() OVER (PARTITION BY url_hash ORDER BY minute, id) AS rn FROM posts) WHERE rn > 1 GROUP BY author")
def copies_by_author(spark, sf_dir):
    p = views.posts(spark, sf_dir)
    first = p.groupBy("url_hash").agg(F.min("id").alias("first_id"))
    return p.join(first, "url_hash").where(F.col("id") > F.col("first_id")).groupBy("author").agg(F.count("*").alias("copies"))


@query(f"WITH {POSTS} SELECT id, url_hash FROM posts p WHERE NOT EXISTS (SELECT 1 FROM posts q WHERE q.url_hash = p.url_hash AND q.id < p.id)")
def deduplicated_posts(spark, sf_dir):
    return views.posts(spark, sf_dir).groupBy("url_hash").agg(F.min("id").alias("id")).select("id", "url_hash")
