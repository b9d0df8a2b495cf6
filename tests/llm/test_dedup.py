"""Joins and substring operators against plain versions."""

import hashlib
import inspect
import random
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from echotrace.llm import jaccard_join, recompression, suffix_dedup
from echotrace.llm.components import components

from .cases import SCHEMA, WORD, awkward, corpus, empty

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def plain_components(rows, percent, width):
    sets = {d: shingles(t, width) for d, t, *_ in rows}
    of = {d: d for d in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root(a), root(b)))
                of[high] = low
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("percent", "width", "seed"), [(90, 3, 3), (80, 5, 4)])
def test_jaccard_components(spark, percent, width, seed):
    rows = corpus(160, seed)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.join(spark.createDataFrame(rows, SCHEMA), percent=percent, shingle=width).collect()}
    assert got == plain_components(rows, percent, width)


def test_small_sets_link_by_subsets(spark):
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(words[:n]) for n in range(3, 30)] + [" ".join(words[1:n]) for n in range(10, 24)]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.join(spark.createDataFrame(rows, SCHEMA), percent=80, shingle=1).collect()}
    assert got == plain_components(rows, 80, 1)


def test_subsets_alone_find_all_links(spark, monkeypatch):
    # With every small set listed by subsets, sizes up to the bound must link as by brute force.
    monkeypatch.setattr(jaccard_join, "small_bound", lambda histogram, percent: 14)
    words = [f"w{k}" for k in range(16)]
    texts = [" ".join(words[:n]) for n in range(3, 15)] + [" ".join(words[2:n]) for n in range(10, 17)] + [" ".join(["zz", *words[1:n]]) for n in range(8, 15)]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.join(spark.createDataFrame(rows, SCHEMA), percent=80, shingle=1).collect()}
    assert got == plain_components(rows, 80, 1)


@pytest.mark.parametrize("block", [6, 1000])
def test_long_lists_use_leaders(spark, monkeypatch, block):
    # Both are read on the driver. Lists of 50 are cut into up to ten blocks, or none.
    monkeypatch.setattr(jaccard_join, "SHORT", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = corpus(160, 8)
    base = rows[40][1].split(" ")
    for k in range(60, 110):
        words = list(base)
        words[(k * 7) % len(words)] = f"new{k}"
        rows[k] = (k, " ".join(words), "en", "s0", 0)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain_components(rows, 90, 3)


def test_jaccard_odd_input(spark):
    rows = corpus(60)
    out = jaccard_join.join(awkward(spark, rows)).collect()
    assert len(out) == 62
    want = plain_components(rows, 90, 3)
    assert {r[0]: (r[1], r[2]) for r in out if r[0] is not None} == want
    assert jaccard_join.join(empty(spark)).collect() == []
    kept = jaccard_join.keep_one(awkward(spark, rows), percent=90, shingle=3)
    assert {r[0] for r in kept.collect()} == {d for d, (_, c) in want.items() if c == d} | {None}
    assert "component_id" in kept.columns


def test_components(spark):
    links = [(k + 1, k) for k in range(40)] + [(100, 101), (103, 102), (101, 103), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100, 103: 100}


def test_components_odd_input(spark):
    links = [(1, 2), (1, 2), (2, 1), (None, 3), (4, None), (5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {1: 1, 2: 1}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_components_settle_or_fail(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(40)], "u bigint, v bigint")
    with pytest.raises(RuntimeError):
        components(links, most_rounds=2)
    assert inspect.signature(components).parameters["most_rounds"].default is None
    assert {r["component"] for r in components(links).collect()} == {0}


def plain_windows(rows, window):
    seen, out = set(), {}
    for d, t, *_ in sorted(rows):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[d] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [3, 5])
def test_recompression(spark, seed):
    rows = corpus(140, seed)
    got = {r[0]: tuple(r)[1:] for r in recompression.dedupe(spark.createDataFrame(rows, SCHEMA), parts=8).collect()}
    assert got == plain_windows(rows, 20)


def test_recompression_odd_input(spark):
    rows = corpus(60)
    out = recompression.dedupe(awkward(spark, rows), parts=4).collect()
    assert len(out) == 62
    assert {r[0]: tuple(r)[1:] for r in out if r[0] is not None} == plain_windows(rows, 20)
    assert recompression.dedupe(empty(spark)).collect() == []


def test_symbols_depend_on_what_they_say():
    draw = np.random.default_rng(1)
    inner = draw.integers(0, 6, 60).astype(np.uint64)
    runs = []
    for _ in range(2):
        names = np.concatenate([draw.integers(0, 6, 30).astype(np.uint64), inner, draw.integers(0, 6, 25).astype(np.uint64)])
        s = recompression.Symbols(names, np.zeros(len(names), dtype=np.int64))
        for k in range(4):
            s.round(2 * k + 1)
        inside = (s.low >= 30) & (s.high <= 90)
        runs.append({(a, b, n) for a, b, n in zip(s.low[inside], s.high[inside], s.name[inside], strict=True)})
    assert runs[0] == runs[1]
    assert runs[0]


def plain_bytes(rows, width):
    seen, out = set(), {}
    for d, t, *_ in sorted(rows):
        data = (t or "").encode()
        gone, mine = bytearray(len(data)), set()
        for k in range(len(data) - width + 1):
            key = data[k : k + width]
            if key in seen:
                gone[k : k + width] = b"\1" * width
            mine.add(key)
        seen |= mine
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[d] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [3, 5])
def test_suffix_dedup(spark, seed):
    rows = corpus(140, seed)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.dedupe(spark.createDataFrame(rows, SCHEMA), parts=8).collect()}
    assert got == plain_bytes(rows, 50)


def test_hot_anchors_spread(spark):
    rows = corpus(100, 6)
    passage = "a passage that stands in each of these documents, with other words around it each time, " * 2
    rows = [(d, f"{(t or '')[:200]} {d} {passage}{d % 7}" if d % 2 else t, *rest) for d, t, *rest in rows]
    # Held by more than one group is hot here: suffixes are dealt one by one.
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.dedupe(spark.createDataFrame(rows, SCHEMA), parts=8, hot=1).collect()}
    assert got == plain_bytes(rows, 50)


def test_rows_of_one_id_keep_their_own_places(spark):
    # Two rows of one id are one document, and each loses what the smaller id holds where it stands in that row.
    shared = "".join(chr(97 + (k * k + k // 3) % 26) for k in range(80))
    rows = [(1, shared), (5, "x" * 30 + shared), (5, shared + "y" * 10), (5, None)]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedupe(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == sorted([(1, 80, 0, 0, sha(shared)), (5, 110, 80, 1, sha("x" * 30)), (5, 90, 80, 1, sha("y" * 10)), (5, 0, 0, 0, sha(""))])


def test_suffix_dedup_odd_input(spark):
    rows = corpus(60)
    out = suffix_dedup.dedupe(awkward(spark, rows), parts=4).collect()
    assert len(out) == 62
    assert {r[0]: tuple(r)[1:] for r in out if r[0] is not None} == plain_bytes(rows, 50)
    assert suffix_dedup.dedupe(empty(spark)).collect() == []


@pytest.mark.parametrize("letters", [2, 30])
def test_prefix_ranks(letters):
    draw = np.random.default_rng(letters)
    text = draw.integers(65, 65 + letters, 3000).astype(np.uint8)
    text[500:900] = text[1500:1900]
    text[2000:2100] = 65
    text[2500:2620] = text[600:720]
    padded = np.concatenate([text, np.zeros(100, dtype=np.uint8)])
    at = np.arange(0, 2950)
    rank = suffix_dedup.prefix_ranks(padded, at, 50)
    raw = text.tobytes()
    keys = [raw[k : k + 50] for k in at]
    want = {k: n for n, k in enumerate(sorted(set(keys)))}
    assert rank.tolist() == [want[k] for k in keys]


def test_cover_meets_every_difference():
    member = set(suffix_dedup.COVER)
    assert all(any((a + d) % 31 in member and (b + d) % 31 in member for d in range(31)) for a in range(31) for b in range(31))


def shuffled_rows(spark):
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty()
    none = gateway.jvm.java.util.ArrayList()
    return sum(s.shuffleWriteRecords() for s in (lambda x: [x.apply(k) for k in range(x.size())])(sc.statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)))


def test_shingles_of_one_text_are_not_shuffled_as_rows(spark):
    draw = random.Random(12)
    texts = [" ".join(f"w{draw.randrange(10**9)}" for _ in range(400)) for _ in range(300)]
    texts += [t + " end" for t in texts[:3]]
    before = shuffled_rows(spark)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], SCHEMA)).collect()}
    assert got == {k: k - 300 if k >= 300 else k for k in range(303)}
    # Each set lists forty shingles.
    assert shuffled_rows(spark) - before < 303 * 40


def test_entries_of_shingles_that_sets_share(spark):
    draw = random.Random(5)
    rows = [(k << 33, 50 + k, draw.sample(range(-(2**63), 2**63 - 1, 2**54), 20), draw.choice([0, 7, 20])) for k in range(200)]
    rows += [(1, 9, [], 0), (2, 9, [-(2**63), 2**63 - 1], 2), (3, 9, [2**63 - 1], 1)]
    got = {tuple(r) for r in jaccard_join._entries(spark.createDataFrame(rows, "id bigint, n bigint, rare array<bigint>, few int").repartition(3), 0).select("id", "n", "at", "token").collect()}
    asked = Counter(t for _, _, rare, few in rows for t in rare[:few])
    want = {(i, n, at, t) for i, n, rare, few in rows for at, t in enumerate(rare) if at >= few or asked[t] > 1}
    assert got == want and 0 < len(want) < sum(len(r[2]) for r in rows)


def test_entries_without_a_partner_go(spark):
    draw = random.Random(6)
    tokens = draw.sample(range(-(2**63), 2**63 - 1, 2**54), 60)
    rows = [(k, draw.choice([10, 11, 13, 40]), draw.sample(tokens, 3), 3) for k in range(60)] + [(100, 20, [7], 1), (101, 90, [7], 1), (102, 20, [8], 1), (103, 20, [8], 1)]
    got = {tuple(r) for r in jaccard_join._entries(spark.createDataFrame(rows, "id bigint, n bigint, rare array<bigint>, few int").repartition(3), 0, 80).collect()}
    lists = {}
    for i, n, rare, _ in rows:
        for at, t in enumerate(rare):
            lists.setdefault(t, []).append((i, n, at))
    want = set()
    for t, entries in lists.items():
        assert len(entries) <= jaccard_join.SHORT
        fit = [(i, n, at) for i, n, at in entries if any(j != i and 100 * min(n, m) >= 80 * max(n, m) and min(n - at, m - bt) >= jaccard_join.required(n, m, 80) for j, m, bt in entries)]
        want |= {(i, n, at, t, len(fit)) for i, n, at in fit}
    # Of one size two sets meet, of sizes far apart they don't.
    assert got == want and {e[0] for e in want if e[3] in (7, 8)} == {102, 103} and len(want) < len(rows) * 3


def test_parities_tell_large_sets_apart():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 1000, dtype=np.uint64)
    for other in (0, 20, 150, 400):
        a, b = (np.unique(np.concatenate([base[other:], draw.integers(0, 1 << 63, other, dtype=np.uint64)])) for _ in range(2))
        differ = len(np.setxor1d(a, b))
        apart = int(np.bitwise_count(jaccard_join.parity(jaccard_join.set_key(a)[0]) ^ jaccard_join.parity(jaccard_join.set_key(b)[0])).sum())
        # Never more than differ; of sets that share 850 of 1150 members enough to see that they don't share four fifths.
        assert apart <= differ and (apart == 0) == (differ == 0)
        assert (apart > len(a) + len(b) - 2 * jaccard_join.required(len(a), len(b), 80)) == (other >= 150)


def test_pairs_that_do_not_quite_link_stay_in_the_scan(spark):
    """A list of forty sets of which each two share 850 of 1150 members: none of the 780 pairs leaves it."""
    draw = np.random.default_rng(4)
    base = draw.integers(0, 1 << 63, 1000, dtype=np.uint64)
    fields = {c: [] for c in jaccard_join.POSTING} | {"parity": []}
    for k in range(40):
        s = np.unique(np.concatenate([base[150:], draw.integers(0, 1 << 63, 150, dtype=np.uint64)]))
        again, _ = jaccard_join.set_key(s)
        sketch = np.bincount((again & np.uint64(8 * jaccard_join.SKETCH - 1)).astype(np.int64), minlength=8 * jaccard_join.SKETCH).astype(np.uint8).view(np.int64)
        row = {"token": 5, "id": k, "n": len(s), "at": 0, "component": k, "c": 40, "side": 2, **{f"p{j}": int(x) for j, x in enumerate(sketch)}, "parity": jaccard_join.parity(again).tobytes()}
        for c, x in row.items():
            fields[c].append(x)
    batch = pa.RecordBatch.from_pydict(fields)
    found = lambda b: sum(x.num_rows for x in jaccard_join._scan("rest", 0, 80, 3, 32)(iter([b])))
    assert found(batch) == 0 and found(batch.drop_columns(["parity"])) > 700


@pytest.mark.parametrize("marks", [1 << 17, 1])
def test_texts_that_stay_do_not_move(spark, monkeypatch, marks):
    monkeypatch.setattr(jaccard_join, "MARKS", marks)
    rows = [(k if k % 50 else None, f"text {k}") for k in range(2000)]
    rows += rows[:300]
    gone = list(range(1, 2000, 97))
    docs, ids = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame([(k,) for k in gone], "doc_id bigint")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_rows(spark)
        got = jaccard_join.without(docs, ids, "doc_id").collect()
        moved = shuffled_rows(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert Counter(map(tuple, got)) == Counter(r for r in rows if r[0] not in gone)
    assert marks == 1 or moved < 200
