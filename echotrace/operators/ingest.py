"""Raw submissions as posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr

#: What is read of a submission; anything else it holds is left aside.
SUBMISSION = "id string, url string, permalink string, author string, selftext string, created_utc double, subreddit string, title string, crosspost_parent string, over_18 boolean, is_self boolean, is_video boolean, is_gallery boolean, post_hint string"


def posts_of(raw: DataFrame) -> DataFrame:
    """Posts from a column ``raw`` of submissions as JSON.

    An empty crosspost parent is none; what a submission doesn't say of its audience stays unknown.
    """
    s = raw.select(F.from_json("raw", SUBMISSION).alias("s")).select("s.*")
    kind = expr.post_type(F.coalesce("is_self", F.lit(False)), F.col("url"), F.col("post_hint"), is_video=F.col("is_video"), is_gallery=F.col("is_gallery"))
    return s.select(
        F.col("id").alias("post_id"), "url", F.col("permalink").alias("perma_link"), "author", "selftext", F.timestamp_seconds("created_utc").alias("created_at"), "subreddit", "title",
        (F.coalesce("crosspost_parent", F.lit("")) != "").alias("is_crosspost"), F.col("over_18").alias("nsfw"), F.md5(F.col("url").cast("binary")).alias("url_hash"), expr.post_type_id(kind).alias("post_type_id"),
    )
