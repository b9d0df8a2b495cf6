"""Replies letter by letter."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from echotrace.functions import templates
from echotrace.operators.replies import Parts, Site, replies

SITE = Site("search.example", "https://www.search.example/search", "ABot")
SETTINGS = {
    "target_match_percent": 90, "target_annoy_distance": 0.077, "target_meme_match_percent": 50, "meme_filter": False, "max_depth": 5000, "target_title_match": None, "max_matches": 75, "same_sub": False, "max_days_old": 190,
    "filter_dead_matches": True, "filter_removed_matches": True, "only_older_matches": True, "filter_same_author": True, "filter_crossposts": True,
}
MATCH = "struct<post_id:string,url:string,community:string,created_at:timestamp_ntz,percent:double>"
SCHEMA = f"""post_id string, author string, community string, post_type string, total_searched bigint, search_time bigint, template_id bigint,
match_count int, oldest {MATCH}, newest {MATCH}, closest {MATCH}, settings struct<target_match_percent:int,target_annoy_distance:double,target_meme_match_percent:int,meme_filter:boolean,max_depth:int,target_title_match:int,max_matches:int,same_sub:boolean,max_days_old:int,filter_dead_matches:boolean,filter_removed_matches:boolean,only_older_matches:boolean,filter_same_author:boolean,filter_crossposts:boolean>"""

FIRST = ("abc123", "u", "x", datetime(2019, 1, 28, 5, 20, 3), 68.75)
SECOND = ("123abc", "u", "x", datetime(2019, 6, 28, 5, 20, 3), 68.75)
CLOSE = ("abc123", "u", "x", datetime(2019, 1, 28, 5, 20, 3), 84.38)

NONE = "I didn't find any posts that meet the matching requirements for r/test.\n\nIt might be OC, it might not. Things such as JPEG artifacts and cropping may impact the results."
LINK = "\n\n[View Search On search.example](https://www.search.example/search?postId=abc123&sameSub=false&filterOnlyOlder=true&memeFilter=false&filterDeadMatches=true&targetImageMatch=90&targetImageMemeMatch=50)"
SCOPE = "**Scope:** Reddit | **Target Percent:** 90% | **Max Age:** 190"
TIMES = "**Searched Images:** 0 | **Search Time:** 10s"
BELOW = f"{LINK}\n\n---\n\n{SCOPE} | {TIMES}"
LINKS = "\n\n---\n\n**Scope:** Reddit | **Check Title:** False | **Max Age:** 190 | **Searched Links:** 0 | **Search Time:** 10s"
ALL, NOTHING = Parts(), Parts(stats=False, search_link=False, search_settings=False)


def rows(spark, kind="image", matches=(), closest=None, community="test", template=None, **settings):
    own = tuple((SETTINGS | settings).values())
    return spark.createDataFrame([("abc123", None, community, kind, 0, 10, template, len(matches), *([matches[0], matches[-1]] if matches else [None, None]), closest, own)], SCHEMA)


CASES = [
    ("image", [], None, ALL, f"{NONE}{BELOW}"),
    ("image", [], CLOSE, ALL, f"{NONE}\n\nI did find [this post](https://redd.it/abc123) that is 84.38% similar.  It might be a match but I cannot be certain.{BELOW}"),
    ("image", [], None, NOTHING, NONE),
    ("image", [], None, Parts(search_link=False, search_settings=False), f"{NONE}\n\n---\n\n{TIMES}"),
    ("image", [], None, Parts(stats=False, search_settings=False), f"{NONE}{LINK}"),
    ("image", [], None, Parts(stats=False, search_link=False), f"{NONE}\n\n---\n\n{SCOPE}"),
    ("image", [FIRST], None, ALL, f"Looks like a repost. I've seen this image 1 time.\n\nFirst Seen [Here](https://redd.it/abc123) on 2019-01-28 68.75% match.{BELOW}"),
    ("image", [FIRST], CLOSE, NOTHING, "Looks like a repost. I've seen this image 1 time.\n\nFirst Seen [Here](https://redd.it/abc123) on 2019-01-28 68.75% match."),
    ("image", [FIRST, SECOND], None, ALL, f"Looks like a repost. I've seen this image 2 times.\n\nFirst Seen [Here](https://redd.it/abc123) on 2019-01-28 68.75% match. Last Seen [Here](https://redd.it/123abc) on 2019-06-28 68.75% match{BELOW}"),
    ("link", [], None, ALL, f"Looks like this is the first time this link has been shared on Reddit{LINKS}"),
    ("link", [SECOND], None, ALL, f"This link has been shared 1 time.\n\nFirst Seen [Here](https://redd.it/123abc) on 2019-06-28. {LINKS}"),
]


@pytest.mark.parametrize(("kind", "matches", "closest", "parts", "want"), CASES)
def test_default_replies(spark, kind, matches, closest, parts, want):
    assert replies(rows(spark, kind, matches, closest), SITE, parts=parts).first()["message"] == want


def test_templates_of_communities(spark):
    own = spark.createDataFrame([
        ("test", "This is a custom repost template. {match_count} matches", "This is a custom OC template. Random Sub {this_subreddit}", "{match_count} of {{all}}"),
        ("bad", "Seen {no_such_name}", "", "Seen {no_such_name}"), ("broken", "Seen {match_count", "}", "{"),
    ], "community string, repost_response_template string, oc_response_template string, report_msg string")
    say = lambda df: replies(df, SITE, own).first()
    assert say(rows(spark, matches=[FIRST, SECOND]))["message"] == f"This is a custom repost template. 2 matches{BELOW}"
    assert say(rows(spark))["message"] == f"This is a custom OC template. Random Sub test{BELOW}"
    assert say(rows(spark, matches=[FIRST]))["report"] == "1 of {all}"
    for community in ("bad", "broken", "unknown"):
        for matches in ([], [FIRST]):
            got = say(rows(spark, matches=matches, community=community))
            assert got["message"] == replies(rows(spark, matches=matches, community=community), SITE).first()["message"]
            assert got["report"] == "ABot-Repost"


def test_values(spark):
    shown = "{search_scope}|{max_age}|{effective_target_match_percent}|{meme_filter_used}|{report_post_link}|{post_author}|{total_searched}|{check_title}|{same_sub}|{closest_sub}"
    own = spark.createDataFrame([("test", shown, shown, None)], "community string, repost_response_template string, oc_response_template string, report_msg string")
    df = rows(spark, same_sub=True, max_days_old=99999, target_title_match=80, template=7).withColumn("total_searched", F.lit(1234567))
    got = replies(df, SITE, own, NOTHING).first()["message"].split("|")
    report = json.dumps({"post_id": "abc123", "meme_template": 7})
    assert got == ["This Sub", "Unlimited", "50", "True", f"*I'm not perfect, but you can help. Report [ [False Negative](https://www.reddit.com/message/compose/?to=ABot&subject=False%20Negative&message={report}) ]*", "None", "1,234,567", "True", "True", "None"]


@pytest.mark.parametrize("template", ["plain", "{a}", "{{a}}", "{{{a}}}", "x{b}y{a}", "{c}", "{", "a}b", "{}", "", "{a}{{", "ünï {a}\n{b}"])
def test_filling_in_is_what_python_does(spark, template):
    named = {"a": "1", "b": "zwei {a}"}
    try:
        want = template.format(**named)
    except (KeyError, IndexError, ValueError):
        want = None
    df = spark.createDataFrame([(template,)], "t string")
    assert df.select(templates.filled(F.col("t"), templates.values(**{k: F.lit(v) for k, v in named.items()}))).first()[0] == want
