"""Words and domains in what users say and link to."""

import random

import pyarrow as pa
import pytest

from echotrace.operators import promoters
from echotrace.operators.promoters import first_words


@pytest.mark.parametrize("lot", [40, 1 << 24])
def test_ten_thousand_words(spark, lot):
    draw = random.Random(1)
    lot = lot if lot > 100 else 60_000
    words = [("".join(draw.choices("abcd", k=draw.randint(6, 9))) + draw.choice([".com", ".io", ""]), k) for k in range(10_000)]
    texts = [(k, "".join(draw.choices("abcd./", k=draw.randint(0, 200)))) for k in range(300)] + [(300, None), (301, "")]
    want = {}
    place = {}
    for w, k in words:
        place.setdefault(w, k)
    for k, t in texts:
        held = [(p, w) for w, p in place.items() if t and w in t]
        if held:
            want[k] = min(held)[1]
    got = first_words(spark.createDataFrame(texts, "id bigint, text string"), spark.createDataFrame(words, "word string, place bigint"), lot=lot)
    assert {r["id"]: r["word"] for r in got.collect()} == want and 50 < len(want) < 300
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_a_lot_fits_a_worker():
    """Four workers of an executor hold an automaton each."""
    draw = random.Random(4)
    size, words = 0, set()
    while size < promoters.LOT:
        words.add("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=16)))
        size += 24
    assert promoters.automaton_of(pa.array(sorted(words))).get_stats()["total_size"] < 200 << 20


FLAGGED = [("fans.example", 0), ("only.example", 1)]
LANDING = [("links.example", 0), ("bio.example", 1)]
PAGES = [("https://links.example/a", "<a href='https://only.example/x'> fans.example"), ("https://bio.example/b", "nothing"), ("https://links.example/c", "only.example")]
USERS = {
    "bio": ("see only.example and fans.example", ["https://fans.example"], []),
    "profile": ("hello", ["https://x", "https://only.example/?fans.example", "https://fans.example"], ["https://fans.example"]),
    "landing": (None, ["https://bio.example.org", "https://links.example/a"], ["https://only.example"]),
    "second": (None, ["https://links.example/a", "https://bio.example/b"], []),
    "comment": ("", None, ["https://links.example/a", "https://only.example"]),
    "deep": ("", [], ["https://x", "https://links.example/c"]),
    "none": ("fans example", ["https://bio.example/b"], ["https://links.example/unknown"]),
}


def test_first_source_and_first_link_win(spark):
    bios = spark.createDataFrame([(u, b) for u, (b, _, _) in USERS.items()], "user string, bio string")
    links = [spark.createDataFrame([(u, x[k]) for u, x in USERS.items()], "user string, links array<string>") for k in (1, 2)]
    table = lambda rows: spark.createDataFrame(rows, "word string, place bigint")
    got = promoters.promoters(bios, *links, table(FLAGGED), table(LANDING), spark.createDataFrame(PAGES, "url string, html string"))
    assert {r["user"]: (r["source"], r["url"]) for r in got.collect()} == {
        "bio": ("Bio", "fans.example"), "profile": ("Profile", "fans.example"), "landing": ("Comment", "only.example"), "second": ("Profile landing", "fans.example"), "comment": ("Comment", "only.example"), "deep": ("Comment landing", "only.example"),
    }


def test_empty_tables_of_words(spark):
    texts = spark.createDataFrame([(1, "a")], "id bigint, text string")
    assert first_words(texts, spark.createDataFrame([("", 1), (None, 2)], "word string, place bigint")).collect() == []
    assert first_words(texts.limit(0), spark.createDataFrame([("a", 1)], "word string, place bigint")).collect() == []


def test_a_table_larger_than_a_lot_is_one_pass(spark, monkeypatch):
    """However many lots the words would fill, texts are read once and the words are worked out once; odd texts and words are told right."""
    draw = random.Random(5)
    words = [("".join(draw.choices("abä中", k=draw.randint(1, 14))), draw.randrange(50)) for _ in range(400)] + [(None, 0), ("", 0)]
    texts = [(k, k % 7, draw.choice([None, "", "".join(draw.choices("abä中 -", k=draw.randint(1, 60)))])) for k in range(200)] * 2
    least = {}
    for w, p in words:
        if w:
            least[w] = min(p, least.get(w, 99))
    want = sorted((k, m, t, min((p, w) for w, p in least.items() if w in t)[1]) for k, m, t in texts if t and any(w in t for w in least))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    asked = spark.createDataFrame(texts, "id bigint, m bigint, text string").mapInArrow(counted, "id bigint, m bigint, text string")
    monkeypatch.setattr(promoters, "PIECE", 100)
    got = first_words(asked, spark.createDataFrame(words, "word string, place bigint"), lot=50)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100
    assert read.value == len(texts)


def test_pages_of_one_address_count_together(spark):
    table = lambda rows: spark.createDataFrame(rows, "word string, place bigint")
    pages = [("https://links.example/a", f"flagged{k:02}.example") for k in (7, 3, 12, 3)] + [("https://links.example/a", None)]
    bios, none = spark.createDataFrame([("u", "hello")], "user string, bio string"), spark.createDataFrame([("u", [])], "user string, links array<string>")
    profile = spark.createDataFrame([("u", ["https://links.example/a"])], "user string, links array<string>")
    for order in (pages, pages[::-1]):
        got = promoters.promoters(bios, profile, none, table([(f"flagged{k:02}.example", k) for k in range(20)]), table([("links.example", 0)]), spark.createDataFrame(order, "url string, html string"))
        assert [tuple(r) for r in got.collect()] == [("u", "Profile landing", "flagged03.example")]
