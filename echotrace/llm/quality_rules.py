"""Quality rules as a learned decision list, all in DataFrame expressions.

``features`` measures each text. ``learn`` runs sequential covering over labelled rows: it grows a conjunction of
threshold conditions by gain, prunes it on held-out rows, keeps it if it is precise enough there, takes the rows it
covers away and begins again. ``verdict`` turns the list into one ordered ``CASE WHEN``.

Nulls: a null text counts as an empty one, a null label as no label. An empty table gives an empty result, and no
labels give an empty list of rules, which keeps every row. Repeated rows and repeated ids are judged row by row. Ties: of two
conditions of equal gain the first ratio and the lower cut win. A very long text is measured whole. Extra
columns are carried along; a column of the input named like a feature is replaced in the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, discard, drawn, let, once, restored, words, written

#: Labelled rows that rules are learned from, at most.
MOST_LABELLED = 50_000
#: What ``features`` adds.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the rules look at, each a ratio, so that they don't depend on a text's length.
RATIOS = ["word_length", "symbols_per_word", "repeated_words", "repeated_lines", "distinct_words", "capitals", "digits", "marks"]


def repeat_words(array: Column) -> Column:
    """How many words of the array lie in a window of five that it holds twice or more."""
    n = F.size(array)
    hashes = F.when(n >= 5, F.transform(F.sequence(F.lit(0), F.greatest(n - 5, F.lit(0))), lambda i: F.xxhash64(*(F.get(array, i + k) for k in range(5))))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        # Sorted by hash, a repeated window stands next to its like.
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        repeated = let(ordered, lambda s: F.transform(F.filter(s, lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"]))), lambda x: x["at"]))
        return let(F.array_sort(repeated), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0), lambda a, b: a + b))

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add BASE (long) and RATIOS (double) to every row."""
    new = {*BASE, *RATIOS}
    docs = docs.drop(*(c for c in docs.columns if c in new and c != text_col))
    df = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    df = once(df, "_words", words(F.col("_text")))
    df = once(df, "_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    text = F.col("_text")

    def share(count: Column, of: Column) -> Column:
        return F.when(of > 0, count / of).otherwise(0.0)

    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("_words")),
        "_distinct": F.size(F.array_distinct("_words")),
        "_n_lines": F.size("_lines"),
        "_capitals": without(r"[A-ZÀ-Þ]+"),
        "_digits": without("[0-9]+"),
        "_marks": without(r"[!?.,;:]+"),
    })
    df = once(df.drop("_words", "_lines", "_text"), "_", F.lit(0))
    n = F.col("n_words")
    df = df.withColumns({
        "word_length": share(F.col("word_chars"), n),
        "symbols_per_word": share(F.col("n_symbols"), n),
        "repeated_words": share(F.col("n_repeat_words"), n),
        "repeated_lines": share(F.col("n_dup_lines"), F.col("_n_lines")),
        # The share of distinct words falls with length by nature; its logarithms' ratio hardly does.
        "distinct_words": F.when(n > 1, F.log(F.col("_distinct").cast("double")) / F.log(n.cast("double"))).otherwise(1.0),
        "capitals": share(F.col("_capitals"), F.col("word_chars")),
        "digits": share(F.col("_digits"), F.col("word_chars")),
        "marks": share(F.col("_marks"), n),
    })
    return df.drop("_distinct", "_n_lines", "_capitals", "_digits", "_marks", "_")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def learn(labelled: DataFrame, label: str, id_col: str, *, max_rules: int = 8, max_conditions: int = 3, cuts: int = 48, min_cover: int = 10, precision: float = 0.97, max_rows: int = MOST_LABELLED) -> list[list[Condition]]:
    """Rules that reject, in order, from rows with RATIOS and a label (1: to be rejected, 0: to be kept).

    ``max_rows`` bounds the labelled rows that are fitted on: beyond it, the rows with the lowest hash of the id are
    taken. Of them a third is held out for pruning. All counts are aggregates; the driver sees ``cuts`` x 2 counts for
    each ratio.
    """
    mine = labelled.where(F.col(label).isNotNull())
    df = written(drawn(mine, F.col(id_col), max_rows).select(F.col(label).cast("int").alias("bad"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)).alias("draw"), *RATIOS))
    # Cuts come from both classes, so that the rare one has its own.
    quantiles = [k / cuts for k in range(1, cuts)]
    points: dict[str, set[float]] = {r: set() for r in RATIOS}
    for row in df.groupBy("bad").agg(*(F.percentile_approx(r, quantiles, 2000).alias(r) for r in RATIOS)).collect():
        for r in RATIOS:
            points[r].update(float(x) for x in row[r] or () if x is not None)
    thresholds = {r: sorted(x) for r, x in points.items() if x}
    # From here on a ratio is the number of cuts below it: rounds then ask for small numbers only.
    plain, df = df, written(df.select("bad", (F.col("draw") % 3 == 0).alias("held"), *(_cell(r, t).alias(r) for r, t in thresholds.items())))
    rules: list[list[Condition]] = []
    left = F.lit(True)
    for _ in range(max_rules):
        grown: list[Condition] = []
        grow = df.where(left & ~F.col("held"))
        for _ in range(max_conditions):
            found = _best(grow.where(_all(grown)), {r: len(t) for r, t in thresholds.items()}, min_cover)
            if found is None:
                break
            grown.append(found[0])
            if found[1] >= 0.999:
                break
        if not grown:
            break
        # Prune from the end, by what each shorter rule is worth on the held-out rows.
        bad, good = F.col("bad") == 1, F.col("bad") == 0
        held = df.where(left & F.col("held")).agg(*(F.count_if(_all(grown[:k]) & c) for k in range(1, len(grown) + 1) for c in (bad, good))).first()
        worth = [((held[2 * k] - held[2 * k + 1]) / max(1, held[2 * k] + held[2 * k + 1]), held[2 * k], k + 1) for k in range(len(grown))]
        _, hit, size = max(worth, key=lambda x: (round(x[0], 2), x[1], -x[2]))
        miss = held[2 * size - 1]
        if hit < max(1, min_cover // 3) or hit < precision * (hit + miss):
            break
        rules.append(grown[:size])
        left = left & ~_all(grown[:size])
    discard(plain, df)
    # A ratio is above cut k if more than k cuts are below it.
    return [[Condition(c.feature, c.above, thresholds[c.feature][int(c.threshold)]) for c in rule] for rule in rules]


def _cell(ratio: str, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*(F.lit(x) for x in cuts)), lambda x: x < F.col(ratio)))


def _best(df: DataFrame, cuts: dict[str, int], min_cover: int) -> tuple[Condition, float] | None:
    """The condition (on numbers of cuts) of the largest gain over ``df``, and its precision; None if none gains."""
    cells = [F.struct(F.lit(r).alias("r"), F.col(r).alias("bin")) for r in cuts]
    if not cells:
        return None
    counts: dict[str, dict[int, list[int]]] = {}
    for row in df.select("bad", F.explode(F.array(*cells)).alias("c")).groupBy("c.r", "c.bin", "bad").count().collect():
        if row["bad"] in (0, 1):
            counts.setdefault(row["r"], {}).setdefault(row["bin"], [0, 0])[row["bad"]] += row["count"]
    best: tuple[float, Condition, float] | None = None
    for r, bins in counts.items():
        all_good, all_bad = (sum(v[k] for v in bins.values()) for k in (0, 1))
        if not all_bad:
            return None
        before = math.log2(all_bad / (all_bad + all_good))
        good = bad = 0
        for k in range(cuts[r]):
            # Rows in bins up to k are at or below cut k.
            good, bad = good + bins.get(k, [0, 0])[0], bad + bins.get(k, [0, 0])[1]
            for above, g, b in ((False, good, bad), (True, all_good - good, all_bad - bad)):
                if b >= min_cover and g + b < all_good + all_bad:
                    gain = b * (math.log2((b + 0.5) / (b + g + 1)) - before)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = gain, Condition(r, above, k), b / (b + g)
    return best and best[1:]


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that rejects, from 1, or 0 for a row that is kept."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(_all(rules[k - 1]), F.lit(k)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _truth(labels: DataFrame, most: int) -> DataFrame:
    """The labels that rules are learned from, ``most`` at most: the same rows whoever asks."""
    truth = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_id"), (1 - F.col("quality")).alias("_bad"))
    return drawn(truth, F.col("_id"), most)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """All features of every row, ``base_failed``, ``rule`` (0: none) and ``kept``.

    The texts are read once: features are written, then rules are learned from those with a label and applied to all.
    """
    measured = written(features(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), "_t").drop("_t"))
    truth = _truth(labels, learning.get("max_rows", MOST_LABELLED))
    rules = learn(measured.join(F.broadcast(truth), "_id"), "_bad", "_id", **learning)
    out = measured.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    out = written(out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).withColumnRenamed("_id", id_col))
    discard(measured)
    return out


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns only.

    Only the labelled rows that the rules are learned from are measured beforehand: at most ``max_rows``, so their ids
    are broadcast. Then one pass reads, measures and filters. No text is shuffled.
    """
    truth = _truth(labels, learning.get("max_rows", MOST_LABELLED))
    mine = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    measured = written(features(mine.join(F.broadcast(truth), "_id"), "_t").drop("_t"))
    rules = learn(measured, "_bad", "_id", **learning)
    discard(measured)
    mine = aside(docs).withColumn("_t", F.col(f"_own{docs.columns.index(text_col)}"))
    return features(mine, "_t").where(~base_failed() & (verdict(rules) == 0)).select(*restored(docs.columns))
