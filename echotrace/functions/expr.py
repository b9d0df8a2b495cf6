"""Scalar semantics as Column expressions: similarity, rounding, ids, ages, urls, message text."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    """Differing characters of two strings of equal length (null if lengths differ)."""
    apart = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), apart)


def match_percent(distance: Column, size: Column) -> Column:
    """How alike two hashes are, half-even to two places."""
    return F.bround(F.lit(100.0) - distance / size * 100, 2)


def target_distance(percent: Column | float, size: Column | int) -> Column:
    """The largest distance that still counts at a match percentage."""
    size, percent = F.lit(size) if isinstance(size, int) else size, F.lit(percent) if isinstance(percent, (int, float)) else percent
    return size - percent / 100 * size


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, one row of the table after the other."""
    xs, ys = F.split(a, ""), F.split(b, "")
    empty = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def row(above: Column, x: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            diagonal = F.get(above, j) + 1
            return F.concat(done, F.array(F.when(x == F.get(ys, j), diagonal).otherwise(F.greatest(F.get(above, j + 1), F.element_at(done, -1)))))

        return F.aggregate(F.sequence(F.lit(0), F.length(b) - 1), F.array(F.lit(0)), cell)

    table = F.aggregate(xs, empty, row)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(table, -1))


def title_similarity(a: Column, b: Column) -> Column:
    """Normalised indel similarity in percent, half-even; two empty strings are alike."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(F.bround(lcs_length(a, b) * 2 / total * 100, 0))


def age_days(now: Column, then: Column) -> Column:
    """Whole days between, floored, negative ones too."""
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(86_400_000_000.0)).cast("bigint")


def base36(n: Column) -> Column:
    """Lower-case base 36; 0 is empty, a negative number keeps its sign."""
    digits = F.lower(F.conv(F.abs(n).cast("string"), 10, 36))
    return F.when(n == 0, "").when(n < 0, F.concat(F.lit("-"), digits)).otherwise(digits)


def from_base36(s: Column) -> Column:
    return F.when(s == "", F.lit(0)).otherwise(F.conv(s, 36, 10).cast("bigint")).cast("bigint")


def next_ids(start: Column, count: int) -> Column:
    return F.transform(F.sequence(from_base36(start), from_base36(start) + (count - 1)), base36)


def knob_off(knob: Column) -> Column:
    """A setting of null or 0 switches its filter off."""
    return knob.isNull() | (knob == 0)


def has_keyword(title: Column, keywords: Column) -> Column:
    """Whether any of comma-separated keywords, taken as they are, is in the lower-case title."""
    return F.exists(F.split(keywords, ","), lambda k: F.contains(F.lower(title), k))


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://[^/?#]+([^?#]*)", 1)


def hrefs(html: Column) -> Column:
    """Distinct link targets in the order they come."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit("""href=['"]?([^'" >]+)"""), F.lit(1)))


def is_image_url(url: Column) -> Column:
    return F.lower(url).rlike(r"^.*\.(jpg|jpeg|gif|png)")


def post_type(is_self: Column, url: Column, hint: Column | None = None, *, is_video: Column | None = None, is_gallery: Column | None = None) -> Column:
    """text for self posts, else the hint, else image by the extension as it is written, video or gallery by their flags; null if nothing tells."""
    given = hint if hint is not None else F.lit(None).cast("string")
    flag = lambda c: F.lit(False) if c is None else F.coalesce(c, F.lit(False))
    return F.when(is_self, "text").when(given != "", given).when(url.rlike(r"\.(jpg|jpeg|png|gif)"), "image").when(flag(is_video), "video").when(flag(is_gallery), "gallery")


def post_type_of_url(url: Column) -> Column:
    """image if the url holds one of the extensions in either case, else null."""
    return F.when(F.lower(url).rlike(r"\.(jpg|jpeg|png|gif)"), "image")


def post_type_id(name: Column) -> Column:
    """Fixed ids of the post types."""
    out = F.lit(None).cast("int")
    for k, kind in ((7, "video"), (6, "gallery"), (5, "rich:video"), (4, "hosted:video"), (3, "link"), (2, "image"), (1, "text")):
        out = F.when(name == kind, k).otherwise(out)
    return out


def command(body: Column) -> Column:
    """The first word of what follows the bot's tag, if it is a command, else the default one."""
    first = F.lower(F.split(F.trim(body), r"\s+")[0])
    return F.when(first.isin("repost", "watch", "unwatch"), first).otherwise("repost")


def strip_tag(body: Column, tag: str, fallback: str) -> Column:
    """What follows the tag (if it is not at the very start) or the fallback, trimmed; null if neither is there."""
    low = F.lower(body)
    at, other = F.locate(tag, low), F.locate(fallback, low)
    return F.when(at > 2, F.trim(F.substring(body, at + len(tag), F.length(body)))).when(other > 0, F.trim(F.substring(body, other + len(fallback), F.length(body))))


def hex_color(color: Column) -> Column:
    """#rgb or #rrggbb as a number; anything else is 0."""
    h = F.regexp_replace(color, "^#", "")
    full = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    return F.when(full.rlike("^[0-9a-fA-F]{6}$"), F.conv(full, 16, 10).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def signature(text: Column, digits: int = 1) -> Column:
    """16 times ``digits`` hexadecimal digits that texts of mostly the same words share for the most part.

    The md5 sums of the distinct words fall into 16 bins by their first digit; of each bin's least sum the last digits are taken, zeros if it is empty.
    """

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        # A word comes in many texts and is summed once for a batch; bytes are split at space and tab to carriage return.
        known, out = {}, []
        for t in texts.cast(pa.large_binary()).to_pylist():
            words = set((t or b"").split())
            known.update((w, hashlib.md5(w).hexdigest()) for w in words if w not in known)
            least = {x[0]: x[-digits:] for x in sorted((known[w] for w in words), reverse=True)}
            out.append("".join(least.get(d, "0" * digits) for d in "0123456789abcdef"))
        return pa.array(out, type=pa.string())

    return of(text)


def bit_hash(vector: Column) -> Column:
    """A string of 0 and 1, one for each sign of the vector."""
    return F.array_join(F.transform(vector, lambda x: F.when(x > 0, "1").otherwise("0")), "")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
