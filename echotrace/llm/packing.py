"""Length buckets with the least padding, and batches of a token budget in each.

A text of more than ``max_len`` tokens is cut into pieces of that length and a rest, so lengths are bounded and the
histogram of lengths, one count for each, is all that the driver sees. Dynamic programming over it finds the bucket
boundaries of the least total padding exactly. Rows of a bucket are dealt into batches in the order of a hash; a batch
holds as many rows as the budget has room for at the bucket's length. Copies of a row (a mix sees documents repeatedly)
stand far apart in that order: each one a golden section of the whole further on.

Nulls: a null text has no tokens; a text without tokens is one piece of length 0 in the first bucket. Repeated rows and
ids are rows like others, each with its place in a batch; among rows with one place in the order any may come first. Very
long texts are cut into pieces and none is dropped. An empty table gives an empty result. Extra columns don't
matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, once, spread, words, written

#: The golden section of 2 ** 62, and copies of a row that are numbered together.
GOLDEN, MOST_COPIES = 2850178704830799872, 1024


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """The upper bounds of at most ``buckets`` buckets with the least padding in all.

    best[j] of k buckets is the least over i of best[i] of k - 1 plus what padding lengths i+1..j to length j costs.
    As a function of length j that is a minimum of lines whose slopes fall with i, so a hull finds it in one walk.
    """
    lengths = sorted(histogram)
    if not lengths:
        return []
    count, total = [0], [0]
    for x in lengths:
        count.append(count[-1] + histogram[x])
        total.append(total[-1] + x * histogram[x])
    n = len(lengths)
    best: list[int | None] = [0] + [None] * n
    chosen: list[list[int]] = []
    for _ in range(min(buckets, n)):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        at, now, came = 0, [None] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                line = (-count[j - 1], best[j - 1] + total[j - 1], j - 1)
                while len(hull) >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
            if hull:
                x = lengths[j - 1]
                at = min(at, len(hull) - 1)
                while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                    at += 1
                now[j] = hull[at][0] * x + hull[at][1] + x * count[j] - total[j]
                came[j] = hull[at][2]
        chosen.append(came)
        if best[n] is not None and now[n] is not None and best[n] <= now[n]:
            chosen.pop()
            break
        best = now
    bounds, j = [], n
    for came in reversed(chosen):
        bounds.append(lengths[j - 1])
        j = came[j]
    return bounds[::-1]


def _apart(placed: DataFrame) -> DataFrame:
    """Add ``_order``, a bigint that spreads evenly and keeps the copies of a row apart.

    Copies are numbered in one task unless there are more than MOST_COPIES; such rows are numbered in lots drawn by chance.
    """
    same = ["_key", "piece"]
    many = placed.groupBy(*same).agg(F.count("*").alias("_copies")).where(F.col("_copies") > MOST_COPIES)
    lot = F.lit(0)
    if not many.isEmpty():
        placed = placed.join(many, same, "left")
        lot = F.coalesce(F.pmod(F.xxhash64("_row"), F.floor(F.col("_copies") / MOST_COPIES) + 1), F.lit(0))
    placed = placed.withColumn("_lot", lot)
    copy = F.row_number().over(Window.partitionBy(*same, "_lot").orderBy("_row")) - 1
    # Of 62 bits, so that all bits of a sum are right; then over the whole range of a bigint.
    begin = F.shiftrightunsigned(F.xxhash64(*same, "_lot"), 2)
    wide = "decimal(38,0)"
    at = F.when(copy == 0, begin).otherwise(F.pmod(begin.cast(wide) + copy.cast(wide) * F.lit(GOLDEN).cast(wide), F.lit(1 << 62).cast(wide)).cast("bigint"))
    return placed.withColumn("_order", F.shiftleft(at, 2).bitwiseXOR(F.lit(-(2**63)))).drop("_lot", "_row", "_copies")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, buckets: int = 16, max_len: int = 8192, batch_tokens: int = 1 << 16) -> DataFrame:
    """One row for each piece: id, ``piece``, ``first_token``, ``n_tokens``, ``bucket``, ``padded_to``, ``batch``, ``place``.

    ``first_token`` counts from 0; ``batch`` counts within the bucket and ``place`` within the batch, from 0.
    """
    n = F.col("_n")
    counted = docs.select(F.col(id_col), F.size(words(F.col(text_col))).alias("_n"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key"))
    pieces = counted.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / F.lit(max_len)).cast("int") - 1))).alias("piece"))
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(max_len), n - F.col("piece") * max_len))
    pieces = written(once(pieces.drop("_n"), "_row", F.monotonically_increasing_id()))
    histogram = {r["n_tokens"]: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}
    bounds = boundaries(histogram, buckets)
    if not bounds:
        bounds = [max_len]
    bucket = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[k], F.lit(k)).otherwise(bucket)
    placed = pieces.withColumn("bucket", bucket).withColumn("padded_to", F.element_at(F.array(*(F.lit(b) for b in bounds)), F.col("bucket") + 1))
    ranked = spread(_apart(placed), ["bucket"], [F.col("_order")], {"_rank": F.lit(1)}, sum(histogram.values()))
    room = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest(F.lit(1), F.col("padded_to")))).cast("long")
    rank = F.col("_rank").cast("long")
    out = written(ranked.select(F.col(id_col), "piece", (F.col("piece") * max_len).alias("first_token"), "n_tokens", "bucket", "padded_to", F.floor(rank / room).cast("long").alias("batch"), F.pmod(rank, room).cast("int").alias("place")))
    discard(pieces)
    return out
