"""Streams over files, run to the end."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from echotrace.streaming import ingest, limits

SCHEMA = "id bigint, post_id string, url_hash string, created_at timestamp, kind string"
START = datetime(2024, 1, 1)


@pytest.fixture
def posts(spark, tmp_path):
    rows = [(k, f"p{k % 8}", f"h{k % 3}", START + timedelta(minutes=k), ["image", "link"][k % 2]) for k in range(12)]
    spark.createDataFrame(rows, SCHEMA).write.json(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_deduplicated(spark, posts):
    assert len(drained(spark, ingest.deduplicated(posts, "post_id", "created_at", "1 day"), "t_dedup")) == 8


def test_against_history(spark, posts):
    history = spark.createDataFrame([(100, "h0", START - timedelta(days=1)), (101, "h0", START - timedelta(days=2)), (102, "h1", START + timedelta(days=9))], "id bigint, url_hash string, created_at timestamp")
    got = drained(spark, ingest.against_history(posts, history, "url_hash", "created_at"), "t_history")
    assert {(r["id"], r["repost_of_id"]) for r in got} == {(k, 101) for k in (0, 3, 6, 9)}


def test_periodic_counts(spark, posts):
    got = drained(spark, ingest.periodic_counts(posts, "created_at", "5 minutes", "kind"), "t_counts", "complete")
    assert sum(r["n"] for r in got) == 12


def test_fan_out_and_new_only(spark, posts, tmp_path):
    sinks = {k: str(tmp_path / k) for k in ("image", "link")}
    existing = spark.createDataFrame([("p0",)], "post_id string")

    def each(batch, _):
        ingest.fan_out(ingest.new_only(batch, existing, "post_id"), "kind", sinks)

    posts.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    stored = [r["post_id"] for k in sinks for r in spark.read.parquet(sinks[k]).collect()]
    assert sorted(stored) == [f"p{k}" for k in range(1, 8)]


def test_watched(spark):
    matches = spark.createDataFrame([(1, 7), (2, 8)], "id bigint, repost_of_id bigint")
    watches = spark.createDataFrame([(7, "u", True), (8, "v", False)], "post_id bigint, user string, enabled boolean")
    assert [(r["id"], r["user"]) for r in ingest.watched(matches, watches).collect()] == [(1, "u")]


def test_hourly_requests(spark, posts):
    got = ingest.hourly_requests(posts.withColumn("user", F.lit("u")), "user", "created_at", 5)
    assert max(r["requests"] for r in drained(spark, got, "t_hourly", "complete")) == 12


def test_append_new_across_batches_and_replays(spark, tmp_path):
    target = str(tmp_path / "posts")
    batch = lambda *ids: spark.createDataFrame([(i,) for i in ids], "post_id string")
    ingest.append_new(batch("a", "b", "a"), 0, target, "post_id")
    ingest.append_new(batch("b", "c"), 1, target, "post_id")
    ingest.append_new(batch("b", "c"), 1, target, "post_id")
    ingest.append_new(batch("a", "b", "a"), 0, target, "post_id")
    assert sorted(r["post_id"] for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_fan_out_is_safe_to_replay(spark, tmp_path):
    batch = spark.createDataFrame([("a", "image"), ("b", "link")], "post_id string, kind string")
    sinks = {k: str(tmp_path / k) for k in ("image", "link")}
    for batch_id in (0, 0, 1):
        ingest.fan_out(batch, "kind", sinks, batch_id)
    assert spark.read.parquet(sinks["image"]).count() == 2


def test_watches_expire_and_remember(spark):
    matches = spark.createDataFrame([(1, 7, START), (2, 7, START + timedelta(days=3)), (3, 9, START)], "id bigint, repost_of_id bigint, created_at timestamp")
    rows = [(7, "u", True, START + timedelta(days=1), None), (9, "v", True, None, START + timedelta(days=5)), (8, "w", True, None, None)]
    watches = spark.createDataFrame(rows, "post_id bigint, user string, enabled boolean, expires_at timestamp, last_detection timestamp")
    told = ingest.watched(matches, watches, "created_at")
    assert sorted((r["id"], r["user"]) for r in told.collect()) == [(1, "u"), (3, "v")]
    after = {r["user"]: r["last_detection"] for r in ingest.with_last_detection(watches, told, "created_at").collect()}
    assert after == {"u": START, "v": START + timedelta(days=5), "w": None}


def test_a_watch_that_expired_is_silent(spark):
    matches = spark.createDataFrame([(1, 7)], "id bigint, repost_of_id bigint")
    watches = spark.createDataFrame([(7, "u", True, START), (7, "v", True, None)], "post_id bigint, user string, enabled boolean, expires_at timestamp")
    assert [r["user"] for r in ingest.watched(matches, watches).collect()] == ["v"]


def test_first_ever_across_batches_restarts_and_replays(spark, tmp_path):
    name, changes = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, limits.PROVIDER)
    spark.conf.set(changes, "true")
    folder = tmp_path / "in"
    folder.mkdir()

    def arrive(k, ids):
        (folder / f"{k}.json").write_text("\n".join(f'{{"key": "{i}", "n": {k}}}' for i in ids))
        # Files come in the order of their times.
        os.utime(folder / f"{k}.json", (1_700_000_000 + k,) * 2)

    def run():
        stream = spark.readStream.schema("key string, n bigint").option("maxFilesPerTrigger", 1).json(str(folder))
        store = lambda batch, number: batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={number}"))
        assert ingest.first_ever(stream, "key").writeStream.foreachBatch(store).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(240)
        return sorted((r["key"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    def bytes_of(version):
        return sum(f.stat().st_size for f in (tmp_path / "state" / "state").rglob(f"{version}.*changelog"))

    try:
        arrive(0, range(5000))
        arrive(1, [*range(100), 5000, 5001])
        want = [(str(k), 0) for k in range(5000)] + [("5000", 1), ("5001", 1)]
        assert run() == sorted(want)
        for f in (tmp_path / "state" / "commits").glob("*1*"):
            f.unlink()
        assert run() == sorted(want)
        arrive(2, [1, 6000, 6000])
        assert run() == sorted([*want, ("6000", 2)])
        # What a batch adds to the state is its own keys, not the history.
        assert 0 < bytes_of(3) < bytes_of(1) / 5
    finally:
        spark.conf.set(name, before)
        spark.conf.unset(changes)
