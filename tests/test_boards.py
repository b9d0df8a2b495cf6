"""Boards that are kept up to date against full counts, and the semantics that leaderboards and ingest share."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from echotrace.functions import messages
from echotrace.operators import ingest, stats
from echotrace.operators.boards import Board

NOW = datetime(2024, 3, 20, 13, 30)


def log_rows(n, seed, until=NOW):
    draw = random.Random(seed)
    names = [f"u{k}" for k in range(12)] + ["[deleted]", "AutoModerator", None]
    return [(draw.choice(names), draw.choice(["image", "link"]), until - timedelta(seconds=draw.randrange(60 * 86400))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "author string, post_type string, at timestamp_ntz")


def whole(log, now, least):
    return sorted(map(tuple, stats.leaderboard(log, F.lit(now), "at", "author", least, excluded=stats.EXCLUDED, left_out=stats.DELETED).select("author", "post_type", "day_range", "repost_count").collect()), key=repr)


@pytest.mark.parametrize("late", [0, 2])
def test_refreshes_equal_the_whole_count(spark, tmp_path, late):
    rows = log_rows(4000, 1)
    board = Board(str(tmp_path / "board"), "at", "author", left_out=stats.DELETED, late=late)
    for now in (NOW - timedelta(days=40), NOW - timedelta(days=9, hours=3), NOW - timedelta(days=9), NOW):
        log = frame(spark, [r for r in rows if r[2] <= now])
        for _ in range(2 if now == NOW else 1):
            got = board.refresh(log, now, 3, excluded=stats.EXCLUDED)
            assert sorted(map(tuple, got.collect()), key=repr) == whole(log, now, 3)
    assert not any(r["author"] in ("[deleted]", "AutoModerator", None) for r in got.collect())


def test_a_refresh_reads_new_days_only(spark, tmp_path):
    rows = log_rows(1500, 2)
    board = Board(str(tmp_path / "board"), "at", "author", late=1)
    then = NOW - timedelta(days=3)
    board.update(frame(spark, [r for r in rows if r[2] <= then]), then)
    # What the settled days' log says later changes nothing but the piece of the day in which a range begins.
    kept = [r for r in rows if r[2].date() > (then - timedelta(days=2)).date()]
    starts = [NOW - timedelta(days=d) for d in (1, 7, 14, 30)]
    pieces = [r for r in rows if r not in kept and any(r[2].date() == s.date() for s in starts)]
    got = board.refresh(frame(spark, kept + pieces), NOW, 2)
    want = stats.leaderboard(frame(spark, rows), F.lit(NOW), "at", "author", 2).select(*got.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_an_interrupted_refresh_is_repeated(spark, tmp_path):
    rows = log_rows(1000, 3)
    board = Board(str(tmp_path / "board"), "at", "author", left_out=stats.DELETED, late=0)
    then = NOW - timedelta(days=5)
    board.update(frame(spark, [r for r in rows if r[2] <= then]), then)
    # Totals without their mark of success, as a broken write leaves them.
    half = tmp_path / "board" / "totals" / f"upto={(NOW - timedelta(days=1)).date()}"
    half.mkdir()
    log = frame(spark, rows)
    assert sorted(map(tuple, board.refresh(log, NOW, 2, excluded=stats.EXCLUDED).collect()), key=repr) == whole(log, NOW, 2)


def test_deleted_authors_are_not_counted(spark):
    log = frame(spark, [("[deleted]", "image", NOW)] * 12 + [("a", "image", NOW)] * 11)
    assert {r["author"] for r in stats.leaderboard(log, F.lit(NOW), "at", "author", 10, left_out=stats.DELETED).collect()} == {"a"}
    # They take no place among the highest either.
    assert {r["author"] for r in stats.leaderboard(log, F.lit(NOW), "at", "author", 10, limit=1, left_out=stats.DELETED).collect()} == {"a"}


def test_bodies_that_hold_json(spark):
    bodies = ['{"a": 1}', "see {not json} x", '} {"a":1}', 'x {"a":1} y', '{"a": {"b": 1}}', 'x {"a": {"b": 1}} y', "none", "{", None]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(messages.body_json(F.col("b"))).collect()]
    assert got == ['{"a": 1}', None, None, '{"a":1}', '{"a": {"b": 1}}', None, None, None, None]


def test_submissions(spark):
    rows = [
        {"id": "a", "url": "https://h/x", "is_video": True, "created_utc": 10},
        {"id": "b", "url": "https://h/x", "is_gallery": True, "over_18": True, "crosspost_parent": "t3_q"},
        {"id": "c", "url": "https://h/x.jpg", "is_video": True, "over_18": False, "crosspost_parent": ""},
        {"id": "d", "is_self": True, "is_video": True}, {"id": "e", "url": "https://h/x"}, {"id": "f", "url": "https://h/x", "post_hint": "link", "is_video": True},
    ]
    raw = spark.createDataFrame([(json.dumps(r),) for r in rows], "raw string")
    got = {r["post_id"]: (r["post_type_id"], r["nsfw"], r["is_crosspost"]) for r in ingest.posts_of(raw).collect()}
    assert got == {"a": (7, None, False), "b": (6, True, True), "c": (2, False, False), "d": (1, None, False), "e": (None, None, False), "f": (3, None, False)}
