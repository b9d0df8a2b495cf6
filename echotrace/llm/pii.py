"""Personal data by weak supervision, all in DataFrame expressions.

Four base patterns give spans that always stay. Looser patterns give candidates; labelers (patterns, word lists, words
around) vote on each, for, against or not at all. Candidates are counted by their votes and shape, a table of bounded
size; on it expectation-maximisation estimates how reliable each labeler is, without any label, and the posteriors
train a logistic span classifier over votes and shape, which decides about the candidates outside base spans.

Candidates are written mail addresses, addresses of other alphabets or without a dot, names after titles and greetings,
numbers in groups, and long whole numbers, such as those of cards that fail the check digit.

Nulls: a null text is an empty one. Repeated rows are judged row by row; all rows with equal texts get equal spans. Very long
texts are searched whole. An
empty table gives an empty result, and without candidates nothing is added. Extra columns are ignored by ``find`` and
carried along by ``redact``. Starts and ends count code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, discard, once, restored, written

KINDS = ["email", "ip", "card", "phone"]
#: Leftmost, non-overlapping. A local part starts where its run of characters does, or where the match before ended:
#: a start further right could not match either. Possessive repeats don't change what matches and keep the stack flat.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": r"@[A-Za-z0-9-]+\.", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Looser patterns, for what the base ones don't cover.
LOOSE = {
    "mail": r"[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT|@)[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(](?:dot|DOT|\.)[\])]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    "address": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[\p{L}0-9-]++(?:\.[\p{L}0-9-]++)*+",
    "name": r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20\p{Lu}\p{L}++(?:\x20\p{Lu}\p{L}++)?+|(?<=\b(?:name is|[Cc]ontact|[Dd]ear|[Rr]egards,|[Ss]igned by)\x20)\p{Lu}\p{L}++\x20\p{Lu}\p{L}++)",
    "number": r"\(?[0-9]++(?:[\x20()./-]{1,2}[0-9]++)++",
    "account": r"(?<![\p{L}0-9])[0-9]{12,19}+(?![\p{L}0-9])",
}
LOOSE_HINTS = {"mail": r"[\[(](?:at|AT|@)[\])]", "address": r"[\p{L}0-9._%+-]@[\p{L}0-9-]", "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra|name is|[Cc]ontact|[Dd]ear|[Rr]egards,|[Ss]igned by)\b", "number": r"[0-9][\x20()./-]{1,2}[0-9]", "account": r"[0-9]{12}"}
#: Given names, and words that stand before personal data or before other numbers.
NAMES = ["Anna", "Anne", "Ben", "Carlos", "Carmen", "Claire", "David", "Elena", "Emma", "Eva", "Hans", "James", "Jean", "John", "Jorge", "Jose", "Juan", "Julia", "Karl", "Laura", "Lucia", "Luis", "Maria", "Marie", "Mark", "Mary", "Michael", "Nina", "Paul", "Peter", "Pierre", "Robert", "Sarah", "Sofia", "Thomas", "William"]
CUES = ["address", "call", "card", "contact", "correo", "dial", "email", "e-mail", "fax", "mail", "mobile", "nombre", "nummer", "phone", "reach", "ssn", "tel", "telefon", "telefono", "text me", "whatsapp", "write to"]
COUNTER_CUES = ["article", "chapter", "edition", "equation", "figure", "isbn", "page", "pages", "price", "section", "table", "total", "version", "vol"]
#: Digits before and after the separators, by which a number looks like a date, a time or a decimal.
DATE = r"^(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:[0-9]{2}|[0-9]{4})|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]+[.][0-9]+)$"
#: Whole numbers that count milliseconds, microseconds or nanoseconds from 1970 to the years from 2014 to 2033.
CLOCK = r"^1[4-9][0-9]{11}(?:[0-9]{3}){0,2}$"
#: First digits and lengths by which payment cards are issued.
ISSUED = r"^(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6[05][0-9]{14})$"
LABELERS = ["pattern", "digits", "not_date", "gazetteer", "context", "counter_context", "alone", "variety"]

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
SPAN_ENDS = "array<struct<kind:string,start:int,end:int>>"


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.split(F.regexp_replace(value, "[^0-9]", ""), ""))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(F.coalesce(d, F.lit(0)))) % 10 == 0


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


#: What a match must hold besides; one that doesn't is dropped, and nothing shorter is tried.
VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")).between(1, 3) & (p.cast("decimal(38,0)") <= 255)),
    "card": lambda v: _digits(v).between(13, 19) & _luhn(v),
    "phone": lambda v: _digits(v).between(9, 15),
}


def spans(text: Column, kind: str, pattern: str, hint: str, valid=lambda v: F.lit(True)) -> Column:
    """All matches with their places: the text between matches is matched too, so that lengths add up to starts."""
    whole = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    gaps, hits = (F.regexp_extract_all(text, whole, F.lit(g)) for g in (1, 2))
    seen = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("value")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["value"])
        found = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when((x["value"] != "") & valid(x["value"]), F.concat(state["out"], F.array(found))).otherwise(state["out"]).alias("out"))

    return F.when(text.rlike(hint), F.aggregate(seen, begin, step)["out"]).otherwise(F.array().cast(SPAN))


def _votes(text: Column, s: Column) -> Column:
    """A candidate with its votes (1, 0, -1) and its shape, each of few values."""
    v = s["value"]
    before = F.lower(F.substring(text, F.greatest(F.lit(1), s["start"] - 23), F.least(F.lit(24), s["start"])))
    n = _digits(v)
    number, account = s["kind"] == "number", s["kind"] == "account"
    around = lambda at: F.substring(text, at, F.lit(1)).rlike(r"^[\s\p{P}]?$") & ~F.substring(text, at, F.lit(1)).rlike(r"^[-_/\\#%&@:]$")
    lone = F.when(s["start"] == 0, True).otherwise(around(s["start"])) & around(s["end"] + 1)
    kinds_of_digit = F.size(F.array_distinct(F.split(F.regexp_replace(v, "[^0-9]", ""), "")))
    strict = F.when(s["kind"] == "mail", True).when(s["kind"] == "address", v.rlike(r"@[^.]+\..*\p{L}{2,}$")).when(s["kind"] == "name", v.rlike(r"\x20\p{Lu}\p{L}+\x20\p{Lu}\p{L}+$")).when(account, v.rlike(ISSUED)).otherwise(v.rlike(r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4})$"))
    vote = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0)
    return F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        vote(strict).alias("pattern"),
        vote((number & n.between(9, 15)) | (account & n.between(13, 19)), number & (n < 7)).alias("digits"),
        vote(F.lit(False), (number & v.rlike(DATE)) | (account & v.rlike(CLOCK))).alias("not_date"),
        vote(v.rlike(rf"\b(?:{'|'.join(NAMES)})\b")).alias("gazetteer"),
        vote(before.rlike(rf"(?:{'|'.join(CUES)})\W*$")).alias("context"),
        vote(F.lit(False), before.rlike(rf"(?:{'|'.join(COUNTER_CUES)}|[$€£#])\W*$")).alias("counter_context"),
        vote(account & lone, (account | number) & ~lone).alias("alone"),
        vote(account & (kinds_of_digit > 5), (account | number) & (kinds_of_digit < 3)).alias("variety"),
        F.least(F.lit(3), F.floor(n / 4)).cast("int").alias("size"),
        F.least(F.lit(2), F.length(v) - n - F.length(F.regexp_replace(v, r"[^\p{L}]", ""))).cast("int").alias("separators"),
    )


def candidates(docs: DataFrame, text_col: str, hide: Column | None = None) -> DataFrame:
    """Add ``_base`` (spans) and ``_loose`` (candidates outside base spans, with votes).

    Rows for which ``hide`` holds are searched as if there were no base patterns; what those find stands in ``_hidden``.
    """
    df = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    text = F.col("_text")
    base = F.concat(*(spans(text, k, PATTERNS[k], HINTS[k], VALID[k]) for k in KINDS))
    df = once(df, "_base", base)
    if hide is not None:
        df = df.withColumn("_hidden", F.when(hide, F.col("_base")).otherwise(F.array().cast(SPAN))).withColumn("_base", F.when(hide, F.array().cast(SPAN)).otherwise(F.col("_base")))
    found = F.concat(*(spans(text, k, p, LOOSE_HINTS[k]) for k, p in LOOSE.items()))
    free = F.filter(found, lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return once(df, "_loose", F.transform(free, lambda s: _votes(text, s))).drop("_text")


def reliabilities(counts: dict[tuple[int, ...], float], rounds: int = 60) -> tuple[float, list[list[dict[int, float]]]]:
    """Expectation-maximisation over vote patterns: the prior, and each labeler's chance of each vote, by truth."""
    if not counts:
        return 0.5, []
    n = len(next(iter(counts)))
    prior = 0.5
    # It starts from votes that are more often right than wrong.
    chance = [[{-1: 0.4, 0: 0.4, 1: 0.2}, {-1: 0.2, 0: 0.4, 1: 0.4}] for _ in range(n)]
    for _ in range(rounds):
        total, mass = [1.0, 1.0], [[{v: 0.5 for v in (-1, 0, 1)} for _ in range(2)] for _ in range(n)]
        for votes, c in counts.items():
            p = posterior(votes, prior, chance)
            for z, w in ((0, c * (1 - p)), (1, c * p)):
                total[z] += w
                for k, v in enumerate(votes):
                    mass[k][z][v] += w
        prior = total[1] / sum(total)
        chance = [[{v: m / sum(mass[k][z].values()) for v, m in mass[k][z].items()} for z in range(2)] for k in range(n)]
    return prior, chance


def posterior(votes: tuple[int, ...], prior: float, chance: list[list[dict[int, float]]]) -> float:
    odds = math.log(prior / (1 - prior))
    for k, v in enumerate(votes):
        odds += math.log(chance[k][1][v] / chance[k][0][v])
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def _inputs(kind: str, votes: tuple[int, ...], size: int, separators: int) -> list[tuple]:
    """The classifier's features that are on: pairs of a name and a value."""
    return [("kind", kind), ("size", size), ("separators", separators), *((name, v) for name, v in zip(LABELERS, votes, strict=True) if v)]


def classifier(table: list[tuple[str, tuple[int, ...], int, int, int]], steps: int = 200, rate: float = 0.5, shrink: float = 1e-3) -> dict:
    """Weights of a logistic model of the posteriors, by gradient steps over the table of counts."""
    patterns: dict[tuple[int, ...], float] = {}
    for _, votes, _, _, c in table:
        patterns[votes] = patterns.get(votes, 0) + c
    prior, chance = reliabilities(patterns)
    # A vote for or against by no labeler at all tells nothing: such a candidate is held for clean.
    rows = [(_inputs(k, v, s, p), (posterior(v, prior, chance) if any(x > 0 for x in v) else 0.0), c) for k, v, s, p, c in table]
    total = sum(c for *_, c in rows) or 1
    weights: dict = {("bias", 0): 0.0}
    for _ in range(steps):
        slope: dict = {}
        for on, p, c in rows:
            odds = sum(weights.get(f, 0.0) for f in on) + weights["bias", 0]
            error = (1 / (1 + math.exp(-max(-50.0, min(50.0, odds)))) - p) * c / total
            for f in [*on, ("bias", 0)]:
                slope[f] = slope.get(f, 0.0) + error
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) - rate * 8 * (g + shrink * weights.get(f, 0.0))
    return weights


def train(found: DataFrame) -> dict:
    """The span classifier's weights from the candidates of all documents; the driver sees counts by votes and shape."""
    keys = ["kind", *LABELERS, "size", "separators"]
    rows = found.select(F.explode("_loose").alias("c")).groupBy(*(F.col(f"c.{k}").alias(k) for k in keys)).count().collect()
    return classifier([(r["kind"], tuple(r[k] for k in LABELERS), r["size"], r["separators"], r["count"]) for r in rows])


def accepted(weights: dict, threshold: float = 0.8) -> Column:
    """The candidates of ``_loose`` that the classifier takes, as kind, start, end; an overlapping one gives way to the one that starts earlier, or is longer."""
    def score(c: Column) -> Column:
        out = F.lit(weights["bias", 0])
        for (name, value), w in sorted(weights.items(), key=str):
            if name != "bias":
                out = out + F.when(c[name] == F.lit(value), F.lit(w)).otherwise(0.0)
        return out

    good = F.filter("_loose", lambda c: (score(c) > math.log(threshold / (1 - threshold))) & F.exists(F.array(*(c[n] for n in LABELERS)), lambda v: v > 0))
    spans_ = F.array_sort(F.transform(good, lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN_ENDS).alias("out"))

    def step(state: Column, s: Column) -> Column:
        kept = F.concat(state["out"], F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["back"]).alias("end"))))
        return F.when(s["start"] >= state["at"], F.struct((-s["back"]).alias("at"), kept.alias("out"))).otherwise(state)

    return F.aggregate(spans_, begin, step, lambda state: state["out"])


def _listed(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, a count for each base kind, ``base_sha256`` and ``spans`` of each row. Texts are read once."""
    found = written(candidates(docs.select(id_col, text_col), text_col).drop(text_col))
    added = accepted(train(found))
    plain = lambda xs: F.transform(xs, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    order = F.array_sort(plain(added))
    base = plain(F.col("_base"))
    out = written(found.select(id_col, *(_count(k) for k in KINDS), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.concat(base, order)).alias("spans")))
    discard(found)
    return out


def found_again(docs: DataFrame, hide: Column, text_col: str = "text") -> DataFrame:
    """How much the method finds without the base patterns, in rows for which ``hide`` holds.

    One row for each base kind with spans there: ``n`` and ``again`` (a span of the method overlaps it); and one of kind
    null: rows without any base span, and those of them that the method marks.
    """
    found = written(candidates(docs.select(F.col(text_col).alias("_t"), hide.alias("_hide")), "_t", F.col("_hide")).drop("_t"))
    marked = found.where("_hide").withColumn("_new", accepted(train(found)))
    each = marked.select(F.explode("_hidden").alias("s"), "_new").select(F.col("s.kind").alias("kind"), F.exists("_new", lambda x: (x["start"] < F.col("s.end")) & (F.col("s.start") < x["end"])).alias("hit"))
    clean = marked.where(F.size("_hidden") == 0).select(F.lit(None).cast("string").alias("kind"), (F.size("_new") > 0).alias("hit"))
    out = written(each.unionByName(clean).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("hit").alias("again")))
    discard(found)
    return out


def _count(kind: str) -> Column:
    return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with each span of personal data replaced by its kind in angle brackets.

    One pass trains on all candidates, a second finds and replaces; no text is shuffled.
    """
    found = written(candidates(docs.select(F.col(text_col).alias("_t")), "_t").select("_loose"))
    weights = train(found)
    discard(found)
    at = docs.columns.index(text_col)
    df = candidates(aside(docs).withColumn("_t", F.col(f"_own{at}")), "_t")
    simple = lambda xs: F.transform(xs, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    df = once(df, "_cut", F.array_sort(F.concat(simple(F.col("_base")), simple(accepted(weights)))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        # A span that begins inside what is already replaced only moves the end.
        kept = F.concat(state["out"], F.substring(F.col("_t"), state["at"] + 1, s["start"] - state["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], kept).otherwise(state["out"]).alias("out"))

    done = F.aggregate("_cut", begin, step)
    text = F.when(F.size("_cut") == 0, F.col("_t")).otherwise(F.concat(done["out"], F.substring(F.col("_t"), done["at"] + 1, F.length("_t"))))
    return df.withColumn(f"_own{at}", text).select(*restored(docs.columns))
