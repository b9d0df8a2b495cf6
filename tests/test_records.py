"""Record operators on small tables: nulls, empty tables, files and streams."""

import gzip
import json

from pyspark.sql import functions as F

from echotrace.operators import records
from echotrace.sources.archive import archive

SCHEMA = "id string, created_utc bigint"


def test_archive_leaves_out_broken_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "x", "created_utc": 1, "more": 2}\nno json\n{"id": null}\n')
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        f.write(json.dumps({"id": "y", "created_utc": 2}) + "\n")
    want = {("x", 1), (None, None), ("y", 2)}
    assert {tuple(r) for r in archive(spark, str(tmp_path), SCHEMA).collect()} == want
    batches = []
    q = archive(spark, str(tmp_path), SCHEMA, files_at_once=1).writeStream.foreachBatch(lambda df, _: batches.append([tuple(r) for r in df.collect()])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(batches) == 2 and {r for b in batches for r in b} == want


def test_refreshed_partitions(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", 7), (3, "b", None)], "id int, kind string, days int")
    fresh = spark.createDataFrame([(9, "a", None)], rows.schema)
    parts = spark.createDataFrame([("a", None), ("c", 1)], "kind string, days int")
    assert sorted(r["id"] for r in records.refreshed(rows, fresh, parts).collect()) == [2, 3, 9]
    # A partition that nothing comes in for is emptied.
    assert sorted(r["id"] for r in records.refreshed(rows, fresh.limit(0), parts).collect()) == [2, 3]


def test_overwritten_partitions(spark, tmp_path):
    path = str(tmp_path / "board")
    write = lambda rows: records.overwrite_partitions(spark.createDataFrame(rows, "id int, kind string, days int"), path, ["kind", "days"])
    write([(1, "a", None), (2, "a", 7), (3, "b", None)])
    write([(9, "a", None)])
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [2, 3, 9]


def test_updated_writes_nulls_and_ignores_unknown(spark):
    table = spark.createDataFrame([(1, 5.0, "x"), (2, 6.0, "y"), (None, 7.0, "z")], "k int, v double, w string")
    changes = spark.createDataFrame([(1, 8.0, 1), (1, None, 2), (4, 9.0, 1), (None, 1.0, 1)], "k int, v double, at int")
    assert {tuple(r) for r in records.updated(table, changes, "k", ["at"]).collect()} == {(1, None, "x"), (2, 6.0, "y"), (None, 7.0, "z")}
    assert records.updated(table.limit(0), changes, "k", ["at"]).count() == 0


def test_cascade_keeps_rows_without_a_post(spark):
    table = spark.createDataFrame([(1,), (2,), (None,)], "post int")
    gone = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    assert {r["post"] for r in records.cascade({"t": (table, "post")}, gone, "id")["t"].collect()} == {2, None}


def test_retries_and_sweeps_at_their_limits(spark):
    rows = [("few", 0)] * 9 + [("many", 0)] * 10 + [("late", 0), ("late", 301), ("edge", 300)]
    now = F.timestamp_seconds(F.lit(600))
    fails = spark.createDataFrame(rows, "k string, s int").withColumn("at", F.timestamp_seconds("s"))
    assert {tuple(r) for r in records.retries_due(fails, "k", "at", now).collect()} == {("few", 9), ("edge", 1)}
    day = 86400
    posts = spark.createDataFrame([(1, 11 * day, 98 * day), (2, 10 * day, 98 * day), (3, 11 * day, 99 * day), (4, 11 * day, None)], "id int, c bigint, l bigint")
    due = records.sweep_due(F.timestamp_seconds("c"), F.timestamp_seconds("l"), F.timestamp_seconds(F.lit(100 * day)))
    assert [r["id"] for r in posts.where(due).collect()] == [1]


def test_order_first_live_and_cache(spark):
    requests = spark.createDataFrame([(1, ["b", "q", "a", "b"]), (2, []), (3, None)], "r int, ids array<string>")
    posts = spark.createDataFrame([("a", 1), ("b", 2)], "post_id string, id int")
    assert sorted((r["r"], r["place"], r["id"]) for r in records.in_order(requests, "ids", posts, "post_id").collect()) == [(1, 0, 2), (1, 2, 1), (1, 3, 2)]
    matches = spark.createDataFrame([(1, "u", 1), (1, "v", 2), (2, "u", 1), (2, None, 0)], "g int, url string, n int")
    status = spark.createDataFrame([("u", 404), ("v", 200), ("v", 200), (None, 200)], "url string, status int")
    assert [tuple(r) for r in records.first_live(matches, status, "g", "url", "n").collect()] == [(1, "v")]
    cache = spark.createDataFrame([("a", "held")], "post_id string, hash string")
    assert sorted((r["post_id"], r["hash"], r["inserted"]) for r in records.cached(posts, cache, "post_id", "hash", F.lit("new")).collect()) == [("a", "held", False), ("b", "new", True)]


def test_right_map_wins_and_history_limits(spark):
    row = spark.range(1).select(records.right_wins(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3), F.lit("c"), F.lit(4))).alias("m")).first()
    assert row["m"] == {"a": 1, "b": 3, "c": 4}
    log = spark.range(1200).select("id", F.lit("s").alias("subreddit"), (F.col("id") % 2).alias("matches_found"))
    assert records.history(log, "s", "id").count() == 1000
    assert [r["id"] for r in records.history(log, "s", "id", only_reposts=True, limit=2).collect()] == [1199, 1197]


def test_fingerprints_are_shuffled_as_sets(spark):
    """Rows of one recording join their sets; a row's repeats are gone before the shuffle, and no fingerprint is a row in it."""
    rows = spark.createDataFrame([(1, ["a", "b", "a"], ["c"]), (1, None, ["b", "d"]), (2, ["a"] * 50, None), (None, ["x"], ["x", None]), (3, [], None)], "id bigint, l array<string>, r array<string>")
    found = records.fingerprints_of_channels(rows, "id", [F.col("l"), F.col("r")])
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "a"), (None, "x"), (None, None)], key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")
