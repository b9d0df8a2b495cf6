"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_max_wand, fingerprints, group_alignment, jaccard_join, log_bilinear, mixing, packing, pii, quality_rules, recompression, secrets_crf, sharding, suffix_dedup
from .common import documents

#: Production parameters.
SHARDS = 40


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.stream(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedupe(documents(spark, sf_dir))


def op4_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.dedupe(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality_rules.judge(documents(spark, sf_dir), labels)
    return out.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "rule")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(documents(spark, sf_dir), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_crf.find(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op11_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = block_max_wand.Index.of(documents(spark, sf_dir))
    return index.search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_group_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_alignment.align(documents(spark, sf_dir))


def op13_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.score(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_mixing, op3_suffix_dedup, op4_recompression, op5_quality_rules, op6_sharding, op7_pii, op8_fingerprints, op9_secrets, op10_packing, op11_block_max_wand, op12_group_alignment, op13_log_bilinear)}

#: For DuckDB, where SQL can say what a row must be; the other operators draw by hashes or learn.
ORACLES: dict[str, str] = {
    "op1_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * o >= 90 * (x.n + y.n - o)),
reach AS (SELECT doc_id AS id, doc_id AS r FROM w UNION SELECT l.v, reach.r FROM reach JOIN links l ON l.u = reach.id WHERE reach.r < l.v)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id FROM w LEFT JOIN sizes s ON s.doc_id = w.doc_id JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) c ON c.id = w.doc_id""",
    "op3_suffix_dedup": r"""WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS v FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM h)),
later AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY v) AS owner FROM strings) WHERE owner < doc_id),
spans AS (SELECT doc_id, min(i) AS low, max(i) + 50 AS high FROM (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM later) GROUP BY doc_id, run),
ends AS (SELECT h.doc_id, h.h, low, high, coalesce(lag(high) OVER (PARTITION BY s.doc_id ORDER BY low), 0) AS from_, coalesce(lead(low) OVER (PARTITION BY s.doc_id ORDER BY low), len(h.h) // 2) AS next_, lead(low) OVER (PARTITION BY s.doc_id ORDER BY low) IS NULL AS last_ FROM h JOIN spans s ON h.doc_id = s.doc_id),
kept AS (SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * from_ + 1, 2 * (low - from_)) || CASE WHEN last_ THEN substr(h, 2 * high + 1) ELSE '' END, '' ORDER BY low) AS rest FROM ends GROUP BY doc_id)
SELECT h.doc_id, CAST(len(h.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h.h))) AS kept_sha256 FROM h LEFT JOIN kept k ON h.doc_id = k.doc_id""",
    "op4_recompression": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS v FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY v ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, 20)) AS k FROM later)),
each AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
kept AS (SELECT e.doc_id, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN e.word END, ' ' ORDER BY e.i) AS text FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id""",
    "op11_block_max_wand": r"""WITH terms AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
total AS (SELECT count(*) AS n_docs, CAST(coalesce(sum(len(ts)), 0) AS BIGINT) AS n_terms FROM terms WHERE len(ts) > 0),
norms AS (SELECT doc_id, ts, 100 - 25 + ((25 * len(ts) * n_docs) // n_terms) AS m FROM terms, total WHERE len(ts) > 0),
held AS (SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, m, unnest(ts) AS term FROM norms) GROUP BY doc_id, m, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, total GROUP BY term, n_docs),
items AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM items JOIN weights USING (term) JOIN held USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20""",
}
