"""Temperature mixing of sources, all in DataFrame expressions.

A source with t tokens gets a weight in proportion to t ** exponent. The exponent is the largest (the mix nearest to
the natural one) whose entropy reaches the target, raised where needed so that no source is repeated more often than
allowed. The weights are realised as whole epochs, each a permutation of the source's documents of its own, and a last
one that is cut where the source's token budget ends; tokens are dealt into blocks, and the blocks of all sources are
interleaved so that every stretch of the stream holds the weights.

Nulls: a null source is a source of its own, a null text has no tokens. A source without tokens is kept once, at weight
0. Repeated rows are rows like others; rows of one id and text, and texts whose hashes tie,
follow each other in an order that does not matter. A very long text counts with all its tokens. An empty table gives an empty result. Extra columns are carried along by
``repeated`` and ignored by ``stream``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, discard, restored, spread, words, written

#: Sources up to which the plan of the sources is broadcast: some 100 bytes each.
MOST_BROADCAST = 50_000


def _draw(ident: Column, epoch: Column | int) -> Column:
    """A document's place in the permutation of an epoch."""
    return F.xxhash64(ident, epoch if isinstance(epoch, Column) else F.lit(epoch))


def exponent(shares: DataFrame, target: float, max_epochs: float, *, passes: int = 4) -> float:
    """The exponent for sources with positive ``tokens``; ``target`` is a share of the largest possible entropy.

    Entropy and the least repeated source's repetitions both fall as the exponent rises from 0 to 1. One pass over
    the sources judges 63 points between the bounds, which is six bisection steps.
    """
    most, n = shares.agg(F.max("tokens"), F.count("*")).first()
    if not n or n == 1:
        return 1.0

    def bisect(holds_low: bool, test) -> float:
        low, high = 0.0, 1.0
        for _ in range(passes):
            points = [low + (high - low) * k / 64 for k in range(65)]
            p = F.col("p")
            mass = F.pow(F.col("tokens") / F.lit(float(most)), p)
            rows = shares.select("tokens", F.explode(F.array(*(F.lit(x) for x in points))).alias("p")).groupBy("p").agg(F.sum(mass).alias("z"), F.sum(F.when(mass > 0, mass * F.log(mass)).otherwise(0.0)).alias("s"), F.min("tokens").alias("least")).collect()
            good = {r["p"] for r in rows if test(r)}
            at = [x in good for x in points]
            # True from the left up to a point (entropy), or from a point on (repetitions).
            k = (max((i for i, x in enumerate(at) if x), default=0) if holds_low else min((i for i, x in enumerate(at) if x), default=64))
            low, high = (points[k], points[min(64, k + 1)]) if holds_low else (points[max(0, k - 1)], points[k])
            if low == high:
                break
        return low if holds_low else high

    by_entropy = bisect(True, lambda r: math.log(r["z"]) - r["s"] / r["z"] >= target * math.log(n) - 1e-12)
    by_repeats = bisect(False, lambda r: (most / r["least"]) ** (1 - r["p"]) <= max_epochs + 1e-9)
    return max(by_entropy, by_repeats)


def plan(rows: DataFrame, target: float, max_epochs: float) -> DataFrame:
    """One row for each source: ``tokens``, ``weight``, ``epochs``, ``whole`` epochs, and ``cut``, the draw up to which the next epoch goes.

    ``rows`` has ``_id``, ``_source`` and ``_tokens``. The budget is such that the source with the least weight for its
    size is seen once, so no document is lost.
    """
    shares = first = written(rows.groupBy("_source").agg(F.sum("_tokens").alias("tokens")))
    full = shares.where(F.col("tokens") > 0)
    power = exponent(full, target, max_epochs)
    most = full.agg(F.max("tokens")).first()[0] or 1
    mass = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(most)), F.lit(power))).otherwise(0.0)
    z = full.agg(F.sum(mass)).first()[0] or 1.0
    epochs = F.when(F.col("tokens") > 0, F.pow(F.lit(float(most)) / F.col("tokens"), F.lit(1 - power))).otherwise(1.0)
    shares = shares.withColumns({"weight": mass / F.lit(z), "epochs": epochs, "whole": F.floor(epochs + 1e-9).cast("int")})
    shares = shares.withColumn("extra", ((F.col("epochs") - F.col("whole")) * F.col("tokens")).cast("long"))
    # Where the extra budget ends in the order of the next epoch's draw.
    sources = shares.select(F.col("_source").alias("_s"), "whole", "extra")
    drawn = rows.join(_small(sources, shares.count()), F.col("_source").eqNullSafe(F.col("_s"))).where(F.col("extra") > 0).select("_source", "extra", "_tokens", _draw(F.col("_id"), F.col("whole")).alias("_draw"))
    reached = spread(drawn, ["_source"], [F.col("_draw")], {"_before": F.col("_tokens")}, rows.count())
    cuts = reached.where(F.col("_before") + F.col("_tokens") <= F.col("extra")).groupBy(F.col("_source").alias("_s")).agg(F.max("_draw").alias("cut"))
    out = written(shares.join(cuts, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s", "extra"))
    discard(first)
    return out


def _small(sources: DataFrame, n: int) -> DataFrame:
    """Broadcast the sources only if they are few; else the join shuffles, and adaptive execution splits a hot source."""
    return F.broadcast(sources) if n <= MOST_BROADCAST else sources


def _copies(epoch_of: str = "_epoch") -> Column:
    n = F.col("whole") + F.coalesce(F.col("_next") <= F.col("cut"), F.lit(False)).cast("int")
    return F.explode(F.sequence(F.lit(0), n - 1)).alias(epoch_of)


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    # Texts of one id are told apart by their hash.
    ident = F.xxhash64(F.col(id_col), F.col(text_col))
    return docs.select(F.col(id_col).alias("_doc"), ident.alias("_id"), F.col(source_col).alias("_source"), F.size(words(F.col(text_col))).cast("long").alias("_tokens"))


def stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, target: float = 0.98, max_epochs: float = 4.0, block_tokens: int = 1 << 20) -> DataFrame:
    """One row for each time a document is seen: id, source, ``n_tokens``, ``epoch``, ``block``, ``stream_at``, ``weight``.

    ``block`` numbers the source's blocks of about ``block_tokens``; ``stream_at`` in [0, 1) orders the whole stream.
    """
    rows = written(_rows(docs, id_col, text_col, source_col))
    sources = plan(rows, target, max_epochs)
    of = sources.select(F.col("_source").alias("_s"), "tokens", "weight", "epochs", "whole", "cut")
    seen = rows.join(_small(of, of.count()), F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_next", _draw(F.col("_id"), F.col("whole")))
    seen = seen.select("_doc", "_id", "_source", "_tokens", "tokens", "weight", "epochs", _copies()).withColumn("_draw", _draw(F.col("_id"), F.col("_epoch")))
    seen = spread(seen, ["_source", "_epoch"], [F.col("_draw")], {"_before": F.col("_tokens")}, rows.count())
    block = F.floor((F.col("_epoch") * F.col("tokens") + F.col("_before")) / F.lit(block_tokens))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("tokens") * F.col("epochs") / F.lit(block_tokens)))
    jitter = F.pmod(F.xxhash64("_source", "block"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    seen = seen.withColumn("block", block.cast("long"))
    at = F.least(F.lit(1 - 1e-12), (F.col("block") + jitter) / blocks)
    out = written(seen.select(F.col("_doc").alias(id_col), F.col("_source").alias(source_col), F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"), "block", at.alias("stream_at"), "weight"))
    discard(rows, sources)
    return out


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, target: float = 0.98, max_epochs: float = 4.0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix has it. No text is shuffled; the plan of the sources stays in the shared folder, as the result reads it."""
    rows = written(_rows(docs, id_col, text_col, source_col))
    of = plan(rows, target, max_epochs).select(F.col("_source").alias("_s"), "whole", "cut")
    discard(rows)
    own = {c: F.col(f"_own{k}") for k, c in enumerate(docs.columns)}
    mine = aside(docs).select("*", F.xxhash64(own[id_col], own[text_col]).alias("_id"), own[source_col].alias("_source"))
    seen = mine.join(_small(of, of.count()), F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_next", _draw(F.col("_id"), F.col("whole")))
    return seen.select("*", _copies()).select(*restored(docs.columns))
