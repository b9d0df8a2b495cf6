"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from echotrace.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rounded(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert rounded(tuple(r[c] for c in columns) for r in df.collect()) == rounded(tuple(r[k] for k in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "repost_of_id", "author", "of_author"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_come_before_the_pick(spark, tmp_path):
    # The oldest copy has the author of posts 3 and 6 and another community than 4; a later copy passes for each.
    rows = [(1, "a", "en"), (2, "b", "en"), (3, "a", "en"), (4, "b", "de"), (5, "c", "de"), (6, "a", "en"), (7, None, "en"), (8, None, "en"), (9, "a", None), (10, "b", None)]
    spark.createDataFrame([(d, "same", lang, s, 4) for d, s, lang in rows] + [(11, None, "en", "a", 0), (12, None, "en", "b", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {2: 1, 3: 2, 5: 4, 6: 2, 7: 1, 8: 1}
    assert dict(con.sql(ORACLES["oldest_filtered_copy"]).fetchall()) == want
    assert {r["id"]: r["match_id"] for r in QUERIES["oldest_filtered_copy"](spark, str(tmp_path)).collect()} == want
