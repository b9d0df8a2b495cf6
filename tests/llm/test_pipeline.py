"""The pipeline's stages on a small corpus, each against what its input must give."""

from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from echotrace.llm import quality_rules
from echotrace.llm.queries import ORACLES, QUERIES

from .cases import SCHEMA, WORD, awkward, corpus, empty
from .test_dedup import plain_components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    rows = corpus(150, 9)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{top}/documents.parquet")
    marks = [(d, 0 if "menu line" in (t or "") else 1, 0) for d, t, *_ in rows]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path_factory.mktemp('steps')}/{k}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [spark.read.parquet(f"{folder}/documents.parquet"), *out]


def test_columns(steps):
    for stage in steps[1:-1]:
        assert stage.columns == steps[0].columns


def test_quality_stage(spark, folder, steps):
    judged = quality_rules.judge(steps[0], spark.read.parquet(f"{folder}/labels.parquet"))
    assert {r["doc_id"] for r in steps[1].collect()} == {r["doc_id"] for r in judged.where("kept").collect()}


def test_near_copy_stage(steps):
    rows = [tuple(r) for r in steps[1].collect()]
    want = {d for d, (_, c) in plain_components(rows, 80, 5).items() if d == c}
    assert {r["doc_id"] for r in steps[2].collect()} == want


def test_personal_data_stage(steps):
    before = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    after = {r["doc_id"]: r for r in steps[3].collect()}
    assert set(before) == set(after)
    for d, t in before.items():
        assert "jo.doe@" not in (after[d]["text"] or "") and "192.168.1.77" not in (after[d]["text"] or "")
        assert after[d]["n_chars"] == (None if t is None else len(after[d]["text"]))
    assert sum(after[d]["text"] == t for d, t in before.items()) > len(before) / 2


def test_mixing_and_packing_stages(steps):
    before, mixed = {r["doc_id"] for r in steps[3].collect()}, steps[4].collect()
    assert {r["doc_id"] for r in mixed} == before
    tokens = defaultdict(int)
    for r in mixed:
        tokens[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    packed = defaultdict(int)
    for r in steps[5].collect():
        packed[r["doc_id"]] += r["n_tokens"]
    assert packed == tokens


def test_run(spark, folder, steps):
    assert corpus_pipeline.run(spark, folder).count() == steps[5].count()


@pytest.mark.parametrize("table", ["awkward", "empty"])
def test_run_on_odd_input(spark, tmp_path, table):
    rows = corpus(40)
    docs = awkward(spark, rows) if table == "awkward" else empty(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)][: len(rows) if table == "awkward" else 0], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ids == set() if table == "empty" else ids and ids <= {d for d, *_ in rows} | {None}


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert sorted(ORACLES) == ["op11_block_max_wand", "op1_jaccard_join", "op3_suffix_dedup", "op4_recompression"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.columns == want.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
