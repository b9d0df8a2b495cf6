"""One-permutation MinHash fingerprints, all in DataFrame expressions.

Every shingle of five words is hashed once; the hash's top byte names its bin and each of 256 bins keeps its least
hash. An empty bin borrows from the first filled bin in an order of its own (optimal densification). Of each bin the
lowest four bits are stored, packed into 16 longs that print as 256 hexadecimal digits. Two fingerprints agree in a bin
by chance once in 16 times, which ``likeness`` corrects.

Nulls: a null text is an empty one. A text of fewer than five words is one shingle; one without words has the empty
fingerprint, which is like another empty one (1) and unlike all else (0). Equal texts have equal fingerprints. Repeated
rows each get a row; equal ids are ordered by their texts' hash, a null id comes last. Ties of id and text are equal rows.
A very long text is hashed whole. A table of one row is its own
next document, an empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, once, words

BINS, BITS, SHINGLE = 256, 4, 5
LOW = (1 << 56) - 1
#: What an empty bin holds: the bin's number above all ones.
EMPTY = [((b - 128) << 56) | LOW for b in range(BINS)]
#: Probes before the search over all filled bins.
PROBES = 12


def _orders() -> tuple[list[int], list[int], list[int]]:
    """For each bin an order of all bins, t -> (step * t + start) mod 256, and the step's inverse."""
    draw = random.Random(5)
    steps = [draw.randrange(1, BINS, 2) for _ in range(BINS)]
    return steps, [draw.randrange(BINS) for _ in range(BINS)], [pow(s, -1, BINS) for s in steps]


STEPS, STARTS, INVERSES = _orders()


def _ints(values: list[int]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _dense(least: Column) -> Column:
    """``least`` has the least hash of each bin or EMPTY; fill the empty ones."""
    filled = F.filter(F.transform(least, lambda x, b: F.when(x.bitwiseAND(LOW) != LOW, b)), lambda b: b.isNotNull())

    def fill(has: Column) -> Column:
        def one(x: Column, b: Column) -> Column:
            def probe(t: int) -> Column:
                v = F.get(least, (F.get(_ints(STEPS), b) * t + F.get(_ints(STARTS), b)).bitwiseAND(BINS - 1))
                return F.when(v.bitwiseAND(LOW) != LOW, v)

            # The place of bin j in the order of bin b, with j below it.
            place = F.array_min(F.transform(has, lambda j: (F.get(_ints(INVERSES), b) * (j - F.get(_ints(STARTS), b))).bitwiseAND(BINS - 1) * BINS + j))
            nearest = F.get(least, place.bitwiseAND(BINS - 1))
            probed = F.when(F.size(has) > 32, F.coalesce(*(probe(t) for t in range(PROBES))))
            # Hashed with the bin, so that what is borrowed often agrees by chance no more often than the rest.
            return F.when(x.bitwiseAND(LOW) != LOW, x).otherwise(F.xxhash64(F.coalesce(probed, nearest), b))

        return F.when(F.size(has) == BINS, least).otherwise(F.transform(least, one))

    return let(filled, fill)


def packed(array: Column) -> Column:
    """The fingerprint of an array of words as 16 longs; none of no words."""
    n = F.size(array)
    shingles = F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - SHINGLE)), lambda i: F.xxhash64(*(F.get(array, i + k) for k in range(SHINGLE))))).otherwise(F.array(F.xxhash64(F.array_join(array, " "))))
    ordered = F.sort_array(F.concat(shingles, _ints(EMPTY)))
    least = let(ordered, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(F.get(s, i - 1), 56) != F.shiftright(x, 56))))
    longs = let(let(least, _dense), lambda d: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda g: F.aggregate(F.slice(d, g * 16 + 1, 16), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x.bitwiseAND(15)))))
    return F.when(n > 0, longs).otherwise(F.array().cast("array<bigint>"))


def digits(longs: Column) -> Column:
    return F.array_join(F.transform(longs, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity that two packed fingerprints tell, from 0 to 1."""
    ones = 0x1111111111111111

    def unlike(x: Column) -> Column:
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        return F.bit_count(any_bit.bitwiseAND(ones))

    agree = 1 - F.aggregate(F.zip_with(a, b, lambda x, y: unlike(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x) / F.lit(float(BINS))
    by_chance = 1 / (1 << BITS)
    estimate = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (agree - by_chance) / (1 - by_chance)))
    neither = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(neither, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(estimate)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``text`` (never null), ``packed`` and ``fingerprint`` of each row."""
    return _printed(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")))


def _printed(docs: DataFrame) -> DataFrame:
    df = once(docs, "_words", words(F.lower("text"))).withColumn("_packed", packed(F.col("_words"))).drop("_words")
    return once(df, "packed", F.col("_packed")).drop("_packed").withColumn("fingerprint", digits(F.col("packed")))


def _longs(values: list[int]) -> str:
    return f"array({', '.join(f'{x}L' for x in values)})"


def in_runs(docs: DataFrame, id_col: str, *, run: int = 1500, most_runs: int = 1 << 15) -> tuple[DataFrame, Window]:
    """``docs`` (id, text) cut into runs of ids, and the window in which a row's successor by falling id follows it.

    Ids are cut at quantiles, of which the driver sees one for each run; a run holds about ``run`` rows, or more where
    that would make over ``most_runs``. The row with a run's largest id is also sent, as a guest (``_guest`` = 1), to the
    run above it, whose last row it follows; the topmost one follows the lowest run.
    """
    n = docs.count()
    runs = max(1, min(most_runs, n // run))
    cuts = sorted({x for x in (docs.agg(F.percentile_approx(id_col, [k / runs for k in range(1, runs)], max(10_000, 4 * runs))).first()[0] or [])}) if runs > 1 else []
    number = F.lit(0)
    if cuts:
        # How many cuts are at or below the id: first whole stretches of them, then those of one stretch.
        each = max(1, math.isqrt(len(cuts)))
        stretches = [cuts[k : k + each] for k in range(0, len(cuts), each)]
        below = lambda array: F.size(F.filter(array, lambda x: x <= F.col(id_col)))
        whole = below(F.expr(_longs([s[-1] for s in stretches])))
        number = let(whole, lambda k: k * each + F.coalesce(below(F.get(F.expr(f"array({', '.join(map(_longs, stretches))})"), k)), F.lit(0)))
        number = F.when(F.col(id_col).isNull(), 0).otherwise(number)
    rows = docs.withColumn("_run", number).withColumn("_key", F.xxhash64("text"))
    # A row for each run: few enough for one task and to be broadcast.
    heads = rows.groupBy("_run").agg(F.max(F.struct(F.col(id_col).alias("i"), F.col("_key").alias("k"))).alias("_head"))
    up = Window.partitionBy(F.lit(0)).orderBy("_run")
    heads = heads.select(F.col("_run").alias("_of"), "_head", F.coalesce(F.lead("_run").over(up), F.min("_run").over(Window.partitionBy(F.lit(0)))).alias("_to"))
    guests = rows.join(F.broadcast(heads), (F.col("_run") == F.col("_of")) & F.col(id_col).eqNullSafe(F.col("_head.i")) & (F.col("_key") == F.col("_head.k")))
    guests = guests.dropDuplicates(["_of"]).withColumn("_run", F.col("_to")).select(*rows.columns)
    both = rows.withColumn("_guest", F.lit(0)).unionByName(guests.withColumn("_guest", F.lit(1)))
    return both, Window.partitionBy("_run").orderBy("_guest", F.col(id_col).desc_nulls_last(), F.col("_key").desc())


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, whose last third comes from the next text, and their likenesses."""
    rows, order = in_runs(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")), id_col)
    rows = _printed(rows).select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "packed")))
    rows = rows.where(F.col("_guest") == 0).drop("_guest", "_run", "_key")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = once(rows.withColumn("n_chars", n.cast("long")), "edited", edited).drop("text", "next_text")
    rows = once(rows, "_words", words(F.lower("edited")))
    rows = once(rows.withColumn("edited_sha256", F.sha2(F.col("edited"), 256)).drop("edited"), "edited_packed", packed(F.col("_words"))).drop("_words")
    return rows.select(
        id_col, "n_chars", "edited_sha256", "fingerprint", digits(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"), likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
