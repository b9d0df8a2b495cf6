"""Scalar functions and operators on small tables with known answers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from echotrace.functions import expr
from echotrace.operators import filters, policy, search, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@pytest.mark.parametrize(("a", "b", "want"), [("kitten", "sitting", 62.0), ("", "", 100.0), ("abc", "", 0.0), ("same", "same", 100.0)])
def test_title_similarity(spark, a, b, want):
    assert one(spark, expr.title_similarity(F.lit(a), F.lit(b))) == want


def test_lcs(spark):
    pairs = [("abcbdab", "bdcaba"), ("xaxbxc", "abc"), ("zz", "yy"), ("a", "a")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", expr.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r["n"] == lcs(r["a"], r["b"]) for r in rows)


def test_hamming_and_percent(spark):
    assert one(spark, expr.hamming(F.lit("abcd"), F.lit("abxy"))) == 2
    assert one(spark, expr.hamming(F.lit("abc"), F.lit("ab"))) is None
    assert one(spark, expr.match_percent(F.lit(3), F.lit(32.0))) == 90.62
    assert abs(one(spark, expr.target_distance(92, 64).cast("double")) - 5.12) < 1e-9


def test_base36(spark):
    assert one(spark, expr.base36(F.lit(1546791610))) == "pkx41m"
    assert one(spark, expr.base36(F.lit(0))) == ""
    assert one(spark, expr.base36(F.lit(-35))) == "-z"
    assert one(spark, expr.from_base36(F.lit("pkx41m"))) == 1546791610
    assert one(spark, expr.next_ids(F.lit("pkx41m"), 5)) == ["pkx41m", "pkx41n", "pkx41o", "pkx41p", "pkx41q"]


def test_age_floors(spark):
    at = lambda s: F.lit(datetime(2024, 1, 10) + timedelta(seconds=s))
    assert one(spark, expr.age_days(at(0), at(-86_399))) == 0
    assert one(spark, expr.age_days(at(0), at(-86_400))) == 1
    assert one(spark, expr.age_days(at(0), at(1))) == -1


def test_messages(spark):
    strip = lambda s: one(spark, expr.strip_tag(F.lit(s), "u/somebot", "?repost"))
    assert strip("This test u/SomeBot some junk") == "some junk"
    assert strip("just text") is None
    assert strip("?repost") == ""
    assert one(spark, expr.command(F.lit("Watch this"))) == "watch"
    assert one(spark, expr.command(F.lit("what"))) == "repost"


@pytest.mark.parametrize(("color", "want"), [("#fff", 0xFFFFFF), ("ff8000", 0xFF8000), ("nope", 0), ("#12345", 0)])
def test_hex_color(spark, color, want):
    assert one(spark, expr.hex_color(F.lit(color))) == want


def test_filter_semantics(spark):
    assert one(spark, filters.not_crosspost(F.lit(None).cast("boolean"))) is True
    assert one(spark, filters.not_same_author(F.lit(None).cast("string"), F.lit(None).cast("string"))) is False
    assert one(spark, filters.no_keyword(F.lit("A Repost here"), F.lit("repost,x"))) is False
    assert one(spark, filters.alike_titles(F.lit(76.0), 76)) is False
    assert one(spark, filters.within_distance(F.lit(11), 11)) is True
    assert one(spark, expr.knob_off(F.lit(0))) is True


def test_oldest_earlier_copy(spark):
    rows = [(1, "a", "h"), (2, "a", "h"), (3, "b", "h"), (4, "a", "h"), (5, "c", "g"), (6, "c", "g"), (7, "d", "g")]
    posts = spark.createDataFrame(rows, "id bigint, author string, url_hash string").withColumn("minute", F.col("id"))
    got = {r["id"]: r["repost_of_id"] for r in search.oldest_earlier(posts).collect()}
    assert got == {3: 1, 4: 3, 7: 5}


def test_trailing_count_leaves_the_far_end_out(spark):
    at = [datetime(2024, 1, 1) + timedelta(seconds=s) for s in (0, 1800, 3600, 3601)]
    log = spark.createDataFrame([("u", t) for t in at], "k string, t timestamp")
    got = {r["t"]: r["trailing"] for r in stats.trailing_count(log, "k", "t", 3600).collect()}
    assert [got[t] for t in at] == [1, 2, 2, 3]


def test_gaps_across_runs(spark):
    ids = spark.createDataFrame([(i,) for i in (1, 2, 5, 9, 10, 21)], "i bigint")
    got = {(r["after_id"], r["missing"]) for r in stats.gaps(ids, "i", run=4).collect()}
    assert got == {(2, 2), (5, 3), (10, 10)}


def test_bucket_means_fill_gaps(spark):
    log = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 1), 2.0), (datetime(2024, 1, 1, 0, 0, 35), 4.0)], "t timestamp, v double")
    assert [r["mean_value"] for r in stats.bucket_means(log, "t", "v", 10).orderBy("bucket_start").collect()] == [2.0, None, None, 4.0]


def test_policy(spark):
    df = spark.createDataFrame([(1, 200, True), (2, 99, True)], "id bigint, n int, ban boolean")
    got = {(r["id"], r["action"]) for r in policy.actions(df, ["id"], {"remove": F.col("n") >= 100, "ban": (F.col("n") >= 100) & F.col("ban")}).collect()}
    assert got == {(1, "remove"), (1, "ban")}
    assert [one(spark, policy.vote_verdict(F.lit(v))) for v in (10, 0, -10)] == ["promote", "open", "remove"]


def test_templates_are_checked_to_be_few(spark):
    h = spark.createDataFrame([(k, "ab") for k in range(5)], "id bigint, hash string")
    with pytest.raises(ValueError, match="templates"):
        search.nearest_template(h, h, 2, 90, most=3)


def test_messages(spark):
    from echotrace.functions import messages as m

    rows = [("loose", '{"a": 1}', "/i/pic.v2.jpg"), ("tight", "see {\"a\": 2} and }", "noext"), ("x", "none", "/a/.hidden"), (None, None, None)]
    df = spark.createDataFrame(rows, "w string, b string, p string")
    got = [tuple(r) for r in df.select(m.strictness_distance(F.col("w"), 12, 3, 7), m.body_json(F.col("b")), m.file_stem(F.col("p"))).collect()]
    assert got == [(12, '{"a": 1}', "pic.v2"), (3, '{"a": 2}', "noext"), (7, None, "/a/.hidden"), (None, None, None)]
    urls = ["https://h/r/s/comments/abc/t/", "https://s.it/xyz", "https://s.it/xyz/comments/abc/", "https://h/", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(m.post_id_of_url(F.col("u"))).collect()]
    assert got == ["abc", "xyz", "xyz", None, None]
    assert spark.range(1).select(m.searched_line(F.lit("image"), F.lit(1234567))).first()[0] == "**Searched Images:** 1,234,567"


@pytest.mark.parametrize(("status", "kind", "want"), [("valid", "image/png", ["https://i.redd.it/k.png"]), ("failed", "image/png", []), ("unprocessed", "image/png", None), ("valid", "video/mp4", None)])
def test_gallery_links(spark, status, kind, want):
    from echotrace.functions import messages as m

    df = spark.createDataFrame([([("k", status, kind)],)], "media array<struct<key:string,status:string,m:string>>").select(m.gallery_links(F.col("media")).alias("x"))
    if want is None:
        with pytest.raises(Exception):  # noqa: B017
            df.collect()
    else:
        assert df.first()["x"] == want


def test_match_filters(spark):
    from echotrace.operators import filters

    df = spark.createDataFrame([(200, True, 5), (404, False, 101), (None, None, 1), (200, True, 101)], "status int, removed boolean, n int")
    got = [tuple(r) for r in df.select(filters.alive(F.col("status")), filters.not_removed(F.col("removed"), F.col("n"))).collect()]
    assert got == [(True, False), (False, True), (False, True), (True, True)]


def test_hamming_by_numbers(spark):
    """Numbers of a row, not strings of a pair; other strings are compared as before."""
    from echotrace.operators import search

    pairs = [("0123456789abcdef", "0123456789abcdef"), ("0123456789abcdef", "f123456789abcde0"), ("0" * 16, "f" * 16), ("xyz", "xya"), ("0" * 16, "0"), (None, "0" * 16), ("0" * 15 + "G", "0" * 16)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumns({f"{c}n": search.as_numbers(F.col(c), 16) for c in "ab"})
    assert [r[0] for r in df.select(search.hamming_of(F.col("a"), F.col("b"), F.col("an"), F.col("bn"), 16)).collect()] == [0, 2, 16, 1, None, None, 1]
