"""Actions by the flags of communities."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from echotrace.operators import moderation

COMMUNITY = "community string, high_volume_reposter_threshold int, high_volume_reposter_remove_post boolean, high_volume_reposter_ban_user boolean, high_volume_reposter_notify_mod_mail boolean, high_volume_reposter_removal_reason string, high_volume_reposter_ban_reason string"


def test_high_volume(spark):
    posts = spark.createDataFrame([(f"{a}-{c}", a, c) for a in ("many", "some", "none") for c in ("all", "mail", "low", "off", "unset")], "post_id string, author string, community string")
    communities = spark.createDataFrame([("all", 20, True, True, True, "Reason", ""), ("mail", 50, None, False, True, None, None), ("low", 9, True, True, True, None, None), ("off", 10, False, None, False, None, None), ("unset", None, True, True, True, None, None)], COMMUNITY)
    counts = spark.createDataFrame([("many", 50), ("some", 20), ("none", 0)], "author string, repost_count bigint")
    whitelist = spark.createDataFrame([("many", "mail", False), ("some", "all", True)], "author string, community string, ignore_high_volume_repost_detection boolean")
    got = {(r["post_id"], r["action"]): (r["reason"], r["text"]) for r in moderation.high_volume(posts, communities, counts, whitelist).collect()}
    assert set(got) == {("many-all", "remove_post"), ("many-all", "ban_user"), ("many-all", "mod_mail"), ("many-mail", "mod_mail")}
    assert got["many-all", "remove_post"] == ("Reason", moderation.NOTE) and got["many-all", "ban_user"] == (moderation.NOTE, None)
    assert got["many-mail", "mod_mail"][1].endswith("on [r/mail](https://reddit.com/r/mail) \n\nIn the last 7 days I have detected 50 reposts created by them")


FLAGS = ["comment_on_repost", "comment_on_oc", "remove_repost", "lock_post", "mark_as_oc", "report_reposts", "send_repost_modmail", "sticky_comment", "lock_response_comment"]


def test_seven_flags(spark):
    results = spark.createDataFrame([(f"{c}{n}", "u", c, "T {x}", "/p", n, "/old" if n else None, "text", "report") for c in ("all", "nothing", "quiet", "oc") for n in (0, 2)], "post_id string, author string, community string, title string, perma_link string, match_count int, oldest_match string, message string, report string")
    on = {"all": set(FLAGS), "nothing": set(), "quiet": set(FLAGS) - {"comment_on_oc", "sticky_comment"}, "oc": {"comment_on_oc", "mark_as_oc"}}
    rows = [(c, "Why", *(True if f in held else None if c == "nothing" else False for f in FLAGS)) for c, held in on.items()]
    communities = spark.createDataFrame(rows, f"community string, removal_reason string, {', '.join(f'{f} boolean' for f in FLAGS)}")
    rows = moderation.on_results(results, communities).collect()
    got = {}
    for r in rows:
        got.setdefault(r["post_id"], {})[r["action"]] = r
    assert {k: set(v) for k, v in got.items()} == {"all2": {"report_post", "lock_post", "remove_post", "mod_mail", "comment"}, "all0": {"mark_as_oc", "comment"}, "quiet2": {"report_post", "lock_post", "remove_post", "mod_mail", "comment"}, "oc0": {"mark_as_oc"}}
    assert got["all2"]["remove_post"]["reason"] == "Why" and got["all2"]["report_post"]["text"] == "report"
    assert [got["all2"]["comment"][c] for c in ("text", "sticky", "locked")] == ["text", True, True] and not got["quiet2"]["comment"]["sticky"]
    # A title with braces is a value, not a template.
    assert "**Title:** T {x}\n\n" in got["all2"]["mod_mail"]["text"] and got["all2"]["mod_mail"]["text"].endswith("**Oldest Match:** https://reddit.com/old\n\n")


def test_removal_reasons(spark):
    reasons = spark.createDataFrame([("a", "r1", "No Reposts", 1), ("a", "r0", "no reposts", 2), ("a", "r2", "Spam", 3), ("b", "r3", "Spam", 1), ("b", "r4", "", 2)], "community string, id string, title string, place int")
    wanted = spark.createDataFrame([(1, "a", "NO REPOSTS"), (2, "a", "spam"), (3, "b", "no reposts"), (4, "b", None), (5, "b", ""), (6, None, "spam")], "k int, community string, reason string")
    got = moderation.removal_reasons(wanted, reasons.withColumnRenamed("id", "reason_id")).collect()
    assert {r["k"]: r["reason_id"] for r in got} == {1: "r1", 2: "r2", 3: None, 4: None, 5: None, 6: None}


def test_deletes_by_age(spark):
    now = datetime(2024, 5, 1)
    rows = spark.createDataFrame([(k, now - timedelta(days=d)) for k, d in enumerate((0, 119, 120, 121))] + [(9, None)], "id int, at timestamp_ntz")
    assert sorted(r["id"] for r in moderation.recent(rows, "at", F.lit(now), 120).collect()) == [0, 1, 2, 9]
