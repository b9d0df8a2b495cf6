"""The second look at pictures of a known template, whose first hashes say too little.

A picture near a template is searched with the first hash at 100 % and its matches are judged by a second, longer hash.
Second hashes come from a cache; those that it lacks are worked out, and what was worked out can be added to it. A match
whose second hash can't be had goes; a picture whose own can't be had is searched without its template, still at 100 %.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..sources.tables import written
from . import near


def search_targets(posts: DataFrame, hashes: DataFrame, of_url: Column) -> DataFrame:
    """``posts`` with ``hash``: the first of the post's hashes of type 1, else that of its url; ``hashes`` has id, post_id, hash_type_id and hash."""
    first = hashes.where(F.col("hash_type_id") == 1).groupBy("post_id").agg(F.min_by("hash", "id").alias("_stored"))
    both = posts.join(first, posts["id"] == first["post_id"], "left")
    return both.select(*(posts[c] for c in posts.columns), F.coalesce("_stored", of_url).alias("hash"))


def detected(pictures: DataFrame, templates: DataFrame, size: int, percent: float) -> DataFrame:
    """id, template_id: of each picture (id, hash) the nearest template (id, hash) that matches by ``percent``, the least id on a tie.

    Pictures of one hash are one class, and classes meet templates by choices of digits, so neither side is broadcast.
    """
    d = near.most_apart(size, percent)
    whole = pictures.where(F.length("hash") == size)
    own = written(whole.select("hash").distinct().withColumn("id", F.xxhash64("hash")))
    stored = written(templates.where(F.length("hash") == size).groupBy("hash").agg(F.min("id").alias("id")))
    equal = own.join(stored.select("hash", F.col("id").alias("other")), "hash").select("hash", F.lit(0).alias("distance"), "other")
    # Ids of the two sides don't stand for the same things; here one of them is negative, so that none are equal.
    how = near.plan(size, d, stored.count(), near.sampled(stored))
    met = near.candidates(own.withColumn("id", F.struct("id", F.lit("picture"))), stored.withColumn("id", F.struct("id", F.lit("template"))), how, size)
    met = met.where(F.col("distance") <= d).select(F.col("id.id").alias("id"), F.col("other.id").alias("other"), "distance").join(own, "id").select("hash", "distance", "other")
    best = equal.unionByName(met).groupBy("hash").agg(F.min(F.struct("distance", "other")).alias("best"))
    return whole.join(best, "hash").select("id", F.col("best.other").alias("template_id"))


def second_hashes(posts: DataFrame, cache: DataFrame, compute: Column) -> DataFrame:
    """id, second, added: from the cache (post_id, hash; one row each) or worked out; null if neither gives one."""
    both = posts.join(cache.select(F.col("post_id").alias("_post"), F.col("hash").alias("_held")), posts["id"] == F.col("_post"), "left")
    second = F.coalesce("_held", compute)
    return both.select("id", second.alias("second"), (F.col("_held").isNull() & second.isNotNull()).alias("added"))


def additions(seconds: DataFrame) -> DataFrame:
    """What the cache lacks, as its rows."""
    return seconds.where("added").select(F.col("id").alias("post_id"), F.col("second").alias("hash")).dropDuplicates(["post_id"])


def judged(matches: DataFrame, queries: DataFrame, seconds: DataFrame, size: int, percent: float) -> DataFrame:
    """The matches after the second look, with distance and size of the hash that decided.

    ``matches`` has id, match_id, distance and size by the first hash; ``queries`` id and template_id; ``seconds`` those of
    ``second_hashes`` for both.
    """
    theirs = seconds.select(F.col("id").alias("match_id"), F.col("second").alias("_theirs"))
    rows = matches.join(queries.select("id", "template_id"), "id", "left").join(seconds.select("id", F.col("second").alias("_own")), "id", "left").join(theirs, "match_id", "left")
    looked_at = F.col("template_id").isNotNull() & F.col("_own").isNotNull()
    distance = near.apart(near.packed(F.col("_own"), size), near.packed(F.col("_theirs"), size))
    rows = rows.withColumn("_second", F.when(looked_at & (F.length("_own") == F.length("_theirs")), distance))
    kept = rows.where((~looked_at & (F.col("template_id").isNull() | (F.col("distance") == 0))) | (F.col("_second") <= expr.target_distance(percent, size)))
    second = F.col("_second").isNotNull()
    return kept.select(
        "id", "match_id", F.when(looked_at, F.col("template_id")).alias("template_id"), F.when(second, F.col("_second")).otherwise(F.col("distance")).alias("distance"), F.when(second, size).otherwise(F.col("size")).alias("size"),
    )
