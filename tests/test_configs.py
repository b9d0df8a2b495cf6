"""Settings from pages."""

import json

import pytest
from pyspark.sql import functions as F

from echotrace.operators import configs

EXPOSED = {"remove_repost": "boolean", "max_days_old": "int", "title_ignore_keywords": "string", "only_comment_on_repost": "boolean", "unknown_setting": "string"}
SCHEMA = "name string, active boolean, is_mod boolean, wiki_permission boolean, remove_repost boolean, max_days_old int, title_ignore_keywords string, only_comment_on_repost boolean"
FULL = {"remove_repost": True, "max_days_old": 30, "title_ignore_keywords": "a,b", "only_comment_on_repost": False}


@pytest.fixture
def done(spark):
    names = {
        "same": json.dumps(FULL), "flip": json.dumps(FULL | {"remove_repost": False, "max_days_old": None}), "empty": json.dumps(FULL | {"title_ignore_keywords": ""}), "lacks": json.dumps({"remove_repost": True, "more": [1]}),
        "types": json.dumps(FULL | {"remove_repost": "false", "max_days_old": 1.5, "only_comment_on_repost": 0, "title_ignore_keywords": 7}), "broken": "{not json", "list": "[1]", "blank": "", "known": json.dumps({"remove_repost": False}), "none": None,
    }
    subs = [(n, True, True, True, *FULL.values()) for n in names] + [("off", False, True, True, *FULL.values()), ("gone", True, False, True, *FULL.values()), ("shut", True, True, None, *FULL.values())]
    pages = [(n, f"r-{n}", c) for n, c in names.items() if n != "none"] + [(n, f"r-{n}", "{}") for n in ("off", "gone", "shut")]
    return configs.sync(spark.createDataFrame(subs, SCHEMA), spark.createDataFrame(pages, "name string, revision_id string, content string"), spark.createDataFrame([("r-known",), ("r-known",)], "revision_id string"), EXPOSED)


def test_outcomes(done):
    got = {r["name"]: (r["outcome"], r["missing"], r["wrong_type"]) for r in done.outcomes.collect()}
    rest = ["max_days_old", "title_ignore_keywords", "only_comment_on_repost"]
    assert got == {
        "same": ("loaded", [], []), "flip": ("loaded", [], []), "empty": ("loaded", [], []), "lacks": ("loaded", rest, []), "types": ("loaded", [], ["remove_repost", "max_days_old", "title_ignore_keywords", "only_comment_on_repost"]),
        "broken": ("invalid", None, None), "list": ("invalid", None, None), "blank": ("invalid", None, None), "known": ("current", rest, None), "none": ("no_page", None, None),
        "off": ("inactive", None, None), "gone": ("not_mod", None, None), "shut": ("no_permission", None, None),
    }


def test_changes_and_their_record(done):
    assert sorted(tuple(r) for r in done.audit.collect()) == [
        ("empty", "r-empty", "title_ignore_keywords", "a,b", None), ("flip", "r-flip", "max_days_old", "30", None), ("flip", "r-flip", "remove_repost", "true", "false"),
    ]
    after = {r["name"]: tuple(r[k] for k in FULL) for r in done.communities.collect()}
    assert len(after) == 13
    assert {n: v for n, v in after.items() if v != tuple(FULL.values())} == {"flip": (False, None, "a,b", False), "empty": (True, 30, None, False)}
    assert {(r["revision_id"], r["is_valid"]) for r in done.revisions.collect()} == {(f"r-{n}", True) for n in ("same", "flip", "empty", "lacks", "types")} | {(f"r-{n}", False) for n in ("broken", "list", "blank")}


def test_a_second_sync_changes_nothing(spark, done):
    pages = done.revisions.select("name", "revision_id", "content")
    again = configs.sync(done.communities, pages, done.revisions, EXPOSED)
    assert again.audit.count() == again.revisions.count() == 0
    assert sorted(map(tuple, again.communities.collect()), key=repr) == sorted(map(tuple, done.communities.collect()), key=repr)


def test_pages_from_what_is_stored(spark, done):
    said = {r["name"]: json.loads(r["page"]) for r in done.communities.select("name", configs.as_page({k: t for k, t in EXPOSED.items() if k in FULL}).alias("page")).collect()}
    assert said["same"] == FULL and said["flip"] == FULL | {"remove_repost": False, "max_days_old": None}
    # Such a page lacks nothing.
    page = spark.createDataFrame([(json.dumps(said["flip"]),)], "c string").select(configs.missing(F.parse_json("c"), {k: "string" for k in FULL}).alias("m"))
    assert page.first()["m"] == []
