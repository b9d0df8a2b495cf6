"""Shards of near equal bytes, by sampled splitters.

Records are ordered by (hash of the text, id, hash of the other columns), so copies of a text stand together. Keys are
drawn with a chance in proportion to size, quantiles of the draw become splitters, ranges that turn out overfull are
cut again by a draw of their own, and exact byte sums of the ranges place each record: a shard is a run of the order,
cut at equal steps of the total bytes, so two shards differ by less than two records.

Nulls: a null text has 0 bytes, a null id stands first among equal texts. Repeated rows each get a slot; rows that tie in all of the order may
swap slots. A very long text is one record and makes its shard larger by what it exceeds. An empty table
gives an empty result. Extra columns don't matter: only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Bytes that a record takes besides its text.
OVERHEAD = 16


def _finder(splitters: list[tuple[int, int]]):
    """A pandas UDF that gives the range of (key, id): how many splitters are at or below it."""
    keys = np.array([k for k, _ in splitters], dtype=np.int64)
    ids = np.array([i for _, i in splitters], dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series, ident: pd.Series) -> pd.Series:
        k, i = key.to_numpy(np.int64), ident.to_numpy(np.int64)
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        out = low.copy()
        for at in np.flatnonzero(low < high):  # the key is a splitter's
            out[at] = low[at] + np.searchsorted(ids[low[at] : high[at]], i[at], "right")
        return pd.Series(out.astype(np.int32))

    return range_of


def _splitters(df: DataFrame, total: int, ranges: int, oversample: int) -> list[tuple[int, int]]:
    """Quantiles of a draw of about ``ranges * oversample`` keys, each record drawn in proportion to its size."""
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(float(ranges * oversample) / max(1, total)))
    draw = F.pmod(F.xxhash64("_key", "_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # A record larger than the step of the draw counts as often as it holds steps.
    times = F.greatest(F.lit(1), (F.col("size") * F.lit(float(ranges * oversample) / max(1, total))).cast("int"))
    drawn = sorted((r["_key"], r["_id"], r["times"]) for r in df.where(draw < chance).select("_key", "_id", times.alias("times")).collect())
    spread = [(k, i) for k, i, t in drawn for _ in range(t)]
    return sorted({spread[len(spread) * q // ranges] for q in range(1, ranges)}) if spread else []


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", *, range_bytes: int = 64 << 20, max_ranges: int = 4096, oversample: int = 24, overfull: float = 2.0, rounds: int = 3) -> DataFrame:
    """``id_col``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of each row.

    ``range_bytes`` is what a range should hold; there are at least eight for each shard and ``max_ranges`` at most, so
    the driver sees that many times ``oversample`` keys. A range of more than ``overfull`` times its share is cut
    again, ``rounds`` times at most; a range stays overfull only if it is one key, and then costs time but not balance.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(text).alias("_key"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    df = written(df)
    total, = df.agg(F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = int(min(max_ranges, max(8 * shards, total // range_bytes)))
    splitters = _splitters(df, total, ranges, oversample)
    for _ in range(rounds):
        placed = df.withColumn("_range", _finder(splitters)("_key", "_id"))
        sums = {r["_range"]: r["bytes"] for r in placed.groupBy("_range").agg(F.sum("size").alias("bytes")).collect()}
        full = {r: b for r, b in sums.items() if b > overfull * total / ranges}
        more: set[tuple[int, int]] = set()
        for bit in range(0, len(full), 512):
            part = sorted(full)[bit : bit + 512]
            held = placed.where(F.col("_range").isin(part))
            more.update(_splitters(held, sum(full[r] for r in part), int(2 * sum(full[r] for r in part) * ranges / max(1, total)) + 1, oversample))
        if not more - set(splitters):
            break
        splitters = sorted({*splitters, *more})
    placed = df.withColumn("_range", _finder(splitters)("_key", "_id"))
    sums = placed.groupBy("_range").agg(F.sum("size").alias("_bytes"))
    # One row for each range: few, so this window and the one over shards may run in one task.
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("_range").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(starts), "_range").withColumn("_at", F.col("_from") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # The middle of a record decides: a record across a cut goes to the side that holds more of it.
    middle = F.col("_at") + (F.col("size") / 2).cast("long")
    out = out.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(float(max(1, total))))).cast("int"))
    counts = out.groupBy("_range", "shard").count()
    prior = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    slots = counts.select(F.col("_range").alias("_r"), F.col("shard").alias("_s"), F.coalesce(F.sum("count").over(prior), F.lit(0)).alias("_slot"))
    here = Window.partitionBy("_range", "shard").orderBy("_key", "_id", "size")
    out = out.withColumn("_n", F.row_number().over(here)).join(F.broadcast(slots), (F.col("_range") == F.col("_r")) & (F.col("shard") == F.col("_s")))
    out = written(out.select(id_col, "size", "text_crc32", "shard", (F.col("_slot") + F.col("_n") - 1).cast("long").alias("slot")))
    discard(df)
    return out
