from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from echotrace.operators import gates
from echotrace.plans import ORACLES, QUERIES


def test_gates_with_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (2, "author", "x"), (3, "moderator", "https://i.imgur.com/a.gifv"), (4, None, "https://i.imgur.com/a.jpg")], "id int, removal string, url string")
    assert [r["id"] for r in df.where(gates.ingested(F.col("removal"), F.col("url"))).orderBy("id").collect()] == [1, 4]
    offers = spark.createDataFrame([("a https://redd.it/abc123x", "YES!"), ("https://redd.it/ab", "yes"), ("https://redd.it/abc123", None), (None, "yes")], "body string, reply string")
    assert [r[0] for r in offers.select(gates.offered_post(F.col("body"), F.col("reply"))).collect()] == ["abc123", None, None, None]


def test_promoter_that_only_wants_a_note(spark):
    rows = [(None, True, None, None, True), (None, True, False, True, True), (True, True, True, True, True), (None, None, True, True, True)]
    df = spark.createDataFrame(rows, "w boolean, f boolean, r boolean, b boolean, n boolean")
    flags = gates.promoter_flags(whitelisted=F.col("w"), links_found=F.col("f"), remove=F.col("r"), ban=F.col("b"), notify=F.col("n"))
    assert [tuple(r) for r in df.select(*flags.values()).collect()] == [(False, False, False), (False, True, True), (False, False, False), (False, False, False)]


def test_bans_and_revisions(spark):
    at = lambda d, h=0: datetime(2024, 1, d, h)
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    bans = spark.createDataFrame([("fresh", at(30, 12)), ("still", at(20)), ("lifted", at(20)), ("never", None)], "sub string, last_checked timestamp_ntz")
    still = spark.createDataFrame([("still",), ("still",), ("never",)], "sub string")
    out = {r["sub"]: r["last_checked"] for r in gates.recheck_bans(bans, still, "sub", now).collect()}
    assert out == {"fresh": at(30, 12), "still": at(31), "never": at(31)}
    log = spark.createDataFrame([("a", 2, '{"k": "1"}'), ("a", 1, "broken"), ("b", 1, '{"k": "7", "x": "1"}'), ("c", 1, None)], "rev string, at int, body string")
    first = gates.first_revisions(log, "rev", "at", "body")
    changed = gates.changed_settings(F.col("settings"), F.create_map(F.lit("k"), F.lit("1")), ["k"])
    assert [(r[0], r[1], r[2]) for r in first.select("rev", "is_valid", changed).orderBy("rev").collect()] == [("a", False, None), ("b", True, {"k": "7"}), ("c", False, None)]


def test_offers_of_posts_from_a_million_on(spark, tmp_path):
    """Ids of seven digits are other posts than the one of their first six, and are shown by these."""
    lines = [(7, p, "R", "F") for p in (12, 100_000, 1_000_001, 1_000_002, 1_000_003, 2_000_005)] + [(8, 1_000_001, "R", "F"), (8, 1_000_002, "R", "F"), (9, 1_000_004, "R", "F")]
    spark.createDataFrame(lines, "l_suppkey bigint, l_partkey bigint, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in (12, 100_000, 200_000, 1_000_001, 1_000_002)], "doc_id bigint").write.parquet(f"{tmp_path}/documents.parquet")
    watches = [(1, 7, "view", '{"k": 1000001}', datetime(2024, 1, 1), 1.0), (2, 8, "view", '{"k": 100000}', datetime(2024, 1, 1), 1.0)]
    spark.createDataFrame(watches, "event_id bigint, user_id bigint, event_type string, props string, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "documents", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = {(7, "000012"), (7, "100000"), (8, "100000")}
    assert set(con.sql(ORACLES["accepted_watch_offers"]).fetchall()) == want
    got = [tuple(r) for r in QUERIES["accepted_watch_offers"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
