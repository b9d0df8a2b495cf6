"""The second look at pictures of a template."""

import random

import pytest
from pyspark.sql import functions as F

from echotrace.operators import two_stage

SECOND = {1: "0" * 256, 2: "0" * 250 + "f" * 6, 3: "f" * 256, 4: None, 5: "1" + "0" * 255}


@pytest.fixture
def posts(spark):
    # What can be worked out of post 5 differs from what is stored of it; of post 4 nothing can be.
    return spark.createDataFrame([(k, None if k == 4 else "a" * 256 if k == 5 else v) for k, v in SECOND.items()], "id bigint, made string")


def seconds_of(spark, posts):
    cache = spark.createDataFrame([(1, SECOND[1]), (5, SECOND[5])], "post_id bigint, hash string")
    return two_stage.second_hashes(posts, cache, F.col("made"))


def test_stored_hashes_come_first_and_new_ones_are_written_back(spark, posts):
    seconds = seconds_of(spark, posts)
    assert {r["id"]: (r["second"], r["added"]) for r in seconds.collect()} == {1: (SECOND[1], False), 2: (SECOND[2], True), 3: (SECOND[3], True), 4: (None, False), 5: (SECOND[5], False)}
    assert {r["post_id"] for r in two_stage.additions(seconds).collect()} == {2, 3}


def judged(spark, posts, matches, queries, percent=97):
    m = spark.createDataFrame(matches, "id bigint, match_id bigint, distance int, size int")
    q = spark.createDataFrame(queries, "id bigint, template_id bigint")
    return sorted(map(tuple, two_stage.judged(m, q, seconds_of(spark, posts), 256, percent).collect()))


def test_second_hashes_decide_and_overwrite(spark, posts):
    # 97 % of 256 digits: at most 7 may differ. Post 3 differs in all, post 4 has none.
    got = judged(spark, posts, [(1, 2, 0, 16), (1, 3, 0, 16), (1, 4, 0, 16), (1, 5, 0, 16)], [(1, 9)])
    assert got == [(1, 2, 9, 6, 256), (1, 5, 9, 1, 256)]
    assert judged(spark, posts, [(1, 2, 0, 16), (1, 5, 0, 16)], [(1, 9)], percent=99) == [(1, 5, 9, 1, 256)]


def test_without_a_template_or_a_second_hash(spark, posts):
    # No template: the first hash has decided already.
    assert judged(spark, posts, [(1, 3, 1, 16), (1, 4, 0, 16)], [(1, None)]) == [(1, 3, None, 1, 16), (1, 4, None, 0, 16)]
    # A template but no second hash of one's own: no second look, but still 100 %.
    assert judged(spark, posts, [(4, 1, 0, 16), (4, 2, 1, 16)], [(4, 9)]) == [(4, 1, None, 0, 16)]


def test_templates_are_detected(spark):
    draw = random.Random(2)
    templates = [(k, "".join(draw.choices("0123456789abcdef", k=16))) for k in range(40)]
    pictures = []
    for k in range(300):
        digits = list(draw.choice(templates)[1])
        for p in draw.sample(range(16), draw.randint(0, 6)):
            digits[p] = draw.choice("0123456789abcdef")
        pictures.append((k, "".join(digits)))
    pictures += [(300, None), (301, "abc")]
    want = {}
    for k, h in pictures[:300]:
        d, t = min((sum(x != y for x, y in zip(h, other, strict=True)), t) for t, other in templates)
        if d <= 3:
            want[k] = t
    got = two_stage.detected(spark.createDataFrame(pictures, "id bigint, hash string"), spark.createDataFrame(templates, "id bigint, hash string"), 16, 80)
    assert {r["id"]: r["template_id"] for r in got.collect()} == want and 100 < len(want) < 300


def test_search_targets(spark):
    posts = spark.createDataFrame([(1, "u"), (2, "v"), (3, None)], "id bigint, url string")
    hashes = spark.createDataFrame([(10, 1, 2, "no"), (12, 1, 1, "later"), (11, 1, 1, "first"), (13, 2, 2, "no")], "id bigint, post_id bigint, hash_type_id int, hash string")
    got = two_stage.search_targets(posts, hashes, F.concat(F.lit("of "), "url"))
    assert {r["id"]: r["hash"] for r in got.collect()} == {1: "first", 2: "of v", 3: None}
