"""Ranked search against a plain version over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from echotrace.llm import block_max_wand
from echotrace.llm.block_max_wand import Index

from .cases import awkward, corpus, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plainly(docs, items, best=20):
    held = {d: terms(t) for d, t in docs}
    n, total = sum(1 for x in held.values() if x), sum(map(len, held.values()))
    df = Counter(t for x in held.values() for t in set(x))
    out = []
    for item, text in items:
        scores = []
        for d, x in held.items():
            tf, m = Counter(x), 100 - 25 + (25 * len(x) * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in terms(text) if tf[t])
            if s > 0:
                scores.append((-s, d))
        out += [(item, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scores)[:best])]
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    draw = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)] + ["ñandú", "ÀB", "x1"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = [(d, " ".join(draw.choices(vocabulary, weights, k=draw.randint(1, 120)))) for d in range(900)]
    rows += [(900 + k, t) for k, t in enumerate([None, "", "...", "W1-w2_W1", "日本 w3", "w5"] + ["same same w7"] * 40)]
    return rows


ITEMS = [(1, "w1 w2 w3"), (2, "w50 w51 w1 w1 w1"), (3, "nothing known"), (4, "same"), (5, "日本 ÀB Àb ñandú"), (6, None), (7, ""), (8, " ".join(f"w{k}" for k in range(60)))]


@pytest.mark.parametrize("size", [500, 20_000, 1 << 24])
def test_search_against_all_scores(spark, docs, size):
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    index = Index.of(table, segment_bytes=size)
    got = index.search(spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == plainly(docs, ITEMS)


def test_fewer_and_more_results(spark, docs):
    index = Index.of(spark.createDataFrame(docs, "doc_id bigint, text string"))
    for best in (1, 2000):
        got = index.search(spark.createDataFrame(ITEMS, "item_id bigint, text string"), best)
        assert sorted(map(tuple, got.collect())) == plainly(docs, ITEMS, best)


def test_lots_of_queries(spark, docs, monkeypatch):
    monkeypatch.setattr(block_max_wand, "QUERY_BYTES", 20)
    index = Index.of(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted(map(tuple, index.search(spark.createDataFrame(ITEMS, "item_id bigint, text string")).collect())) == plainly(docs, ITEMS)


def test_blocks_stay_compressed():
    """A rare term next to a frequent one: of the frequent one's blocks only those that meet the rare one's documents are read, if it alone reaches what is needed."""
    texts = ["common " * (1 + k % 3) + ("rare " * 5 if k in (700, 9000, 30_000) else "") for k in range(40_000)]
    table = pa.table({"doc_id": pa.array(range(len(texts)), type=pa.int64()), "text": pa.array(texts)})
    rows = block_max_wand._segment(0, table, len(texts), sum(len(terms(t)) for t in texts))
    lists = block_max_wand._Lists(pa.Table.from_batches([rows]))
    docs, scores = block_max_wand.top(lists, [("common", 1), ("rare", 9000)], 5_000_000, 2)
    assert set(docs.tolist()) <= {700, 9000, 30_000} and len(docs) >= 2
    assert lists.seen == 313 + 1 and lists.read <= 10


def test_top_is_exact_on_random_lists():
    draw = random.Random(9)
    for trial in range(40):
        texts = [" ".join(draw.choices("abcdefgh", [2**k for k in range(8)], k=draw.randint(1, 30))) for _ in range(draw.choice([1, 50, 700]))]
        n, total = len(texts), sum(len(t.split()) for t in texts)
        table = pa.table({"doc_id": pa.array(range(n), type=pa.int64()), "text": pa.array(texts)})
        lists = block_max_wand._Lists(pa.Table.from_batches([block_max_wand._segment(0, table, n, total)]))
        query = [(t, draw.randint(1, 5000)) for t in draw.sample("abcdefghz", draw.randint(1, 5))]
        best, needed = draw.choice([1, 5, 20]), draw.choice([0, 0, 3_000_000])
        norm = block_max_wand.norms(np.array([len(t.split()) for t in texts]), n, total)
        want = []
        for k, t in enumerate(texts):
            c = Counter(t.split())
            s = sum(w * int(block_max_wand.impact(np.int64(c[x]), norm[k])) for x, w in query if c[x])
            if s > 0 and s >= needed:
                want.append((-s, k))
        docs, scores = block_max_wand.top(lists, query, needed, best)
        got = sorted((-s, k) for s, k in zip(scores.tolist(), docs.tolist()))
        assert got[:best] == sorted(want)[:best], trial


def test_odd_input(spark):
    index = Index.of(awkward(spark, corpus(60)))
    items = spark.createDataFrame([(None, "no id here"), (1, "same words"), (1, "same words"), (2, None)], "item_id bigint, text string").selectExpr("*", "1 AS rank", "2 AS score", "3 AS doc_id")
    got = index.search(items).collect()
    assert any(r["item_id"] is None and r["doc_id"] is None and r["rank"] == 1 for r in got)
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"]) if r["item_id"] == 1] == list(range(1, 1 + sum(r["item_id"] == 1 for r in got)))
    assert index.search(items.limit(0)).collect() == []
    assert Index.of(empty(spark)).search(items).collect() == []


def test_very_long_texts(spark):
    docs = [(1, " ".join(f"t{k % 997}" for k in range(200_000))), (2, "t1 t2"), (3, "q" * 300_000)]
    items = [(0, "t1 t5"), (1, "q" * 300_000)]
    index = Index.of(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted(map(tuple, index.search(spark.createDataFrame(items, "item_id bigint, text string")).collect())) == plainly(docs, items)
