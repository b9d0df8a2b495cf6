"""Connected components of a table of links."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """``id`` and ``component`` (the least id reachable) of every id in ``links`` (columns ``u``, ``v``).

    Links with a null end or from an id to itself are none; repeated links count once; no links give no rows.

    Alternates large-star and small-star steps, each a grouped minimum and a join, until no link changes; the rounds
    grow with the logarithm of the longest path. No vertex's links meet in one task: minima are summed up before the
    shuffle and the join can split a hot key. Where ``most_rounds`` is given, links that change still are an error.
    """
    edges = written(links.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct())
    before = None
    for done in itertools.count():
        if done == most_rounds:
            raise RuntimeError(f"the links have not settled after {most_rounds} rounds")
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        last, edges = edges, written(small.where(F.col("u") != F.col("v")).distinct())
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # Every vertex points at its component's centre now, and the centre at itself.
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), "v"), F.struct(F.col("v").alias("id"), "v"))).alias("e"))
    out = written(ends.groupBy("e.id").agg(F.min("e.v").alias("component")))
    discard(edges)
    return out
