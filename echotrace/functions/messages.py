"""What replies are made of: numbers, links, lists of ids, parsed bodies, gallery links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by the media type of a gallery's picture, and where such pictures are served.
EXTENSIONS = {"image/jpg": ".jpg", "image/png": ".png", "image/gif": ".gif"}
GALLERY_HOST = "https://i.redd.it/"
#: An age that stands for none.
NO_AGE_LIMIT = 99999


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def searched_line(kind: Column, count: Column) -> Column:
    """How many posts of the kind were searched."""
    what = F.when(kind == "image", " Images").when(kind == "link", " Links").otherwise("")
    return F.concat(F.lit("**Searched"), what, F.lit(":** "), thousands(count))


def times_word(matches: Column) -> Column:
    return F.when(matches > 1, "times").otherwise("time")


def max_age(days: Column) -> Column:
    return F.when(days == NO_AGE_LIMIT, "Unlimited").otherwise(days.cast("string"))


def search_link(site: str, post_id: Column, *, same_sub: Column, only_older: Column, meme_filter: Column, dead: Column, percent: Column, meme_percent: Column) -> Column:
    """A link that repeats a search; flags are written in lower case, percents as given."""
    pairs = {"postId": post_id, "sameSub": same_sub, "filterOnlyOlder": only_older, "memeFilter": meme_filter, "filterDeadMatches": dead, "targetImageMatch": percent, "targetImageMemeMatch": meme_percent}
    return F.concat(F.lit(f"{site}?"), F.concat_ws("&", *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in pairs.items())))


def strictness_distance(word: Column, loose: int, tight: int, default: int) -> Column:
    """Null stays null; a word that is neither loose nor tight is the default."""
    return F.when(word == "loose", loose).when(word == "tight", tight).when(word.isNotNull(), default)


def prefixed_ids(ids: Column) -> Column:
    """Ids of posts as a request wants them, joined by commas."""
    return F.array_join(F.transform(ids, lambda x: F.concat(F.lit("t3_"), x)), ",")


def ids_of_request(url: Column) -> Column:
    query = F.regexp_replace(F.regexp_extract(url, r"\?([^#]*)", 1), "id=", "")
    return F.transform(F.split(query, ","), lambda x: F.regexp_replace(x, "t3_", ""))


def post_id_of_url(url: Column) -> Column:
    """What follows ``.it/``, else what follows ``comments/``, up to the next slash; null if neither is there."""
    after = lambda mark: F.when(F.contains(url, F.lit(mark)), F.regexp_extract(url, rf"{mark.replace('.', '[.]')}([^/]*)", 1))
    return F.coalesce(after(".it/"), after("comments/"))


def file_stem(path: Column) -> Column:
    """The path without ``/i/`` and without its last extension."""
    return F.regexp_replace(F.replace(path, F.lit("/i/"), F.lit("")), r"(?<=[^/.])\.[^./]*$", "")


def body_json(body: Column) -> Column:
    """The body if it is JSON, else what stands from its first opening to its first closing brace, if that is JSON; else null."""
    as_json = lambda c: F.when(F.get_json_object(c, "$").isNotNull(), c)
    low, high = F.locate("{", body), F.locate("}", body)
    return F.coalesce(as_json(body), F.when((low > 0) & (high > low), as_json(F.substring(body, low, high - low + 1))))


def gallery_links(media: Column) -> Column:
    """Links of a gallery's pictures from (key, (status, m)) entries, in their order.

    Failed ones are left out; one that is still processed, or of an unknown status or media type, is an error.
    """

    def link(e: Column) -> Column:
        ending = F.element_at(F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair)), e["m"])
        good = F.concat(F.lit(GALLERY_HOST), e["key"], F.coalesce(ending, F.raise_error(F.concat(F.lit("unknown media type "), e["m"])).cast("string")))
        return F.when(e["status"] == "valid", good).otherwise(F.raise_error(F.concat(F.lit("picture "), e["key"], F.lit(" is "), e["status"])).cast("string"))

    return F.transform(F.filter(media, lambda e: e["status"] != "failed"), link)
