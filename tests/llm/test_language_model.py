"""The log-bilinear model: counts against a plain version, probabilities that add up, and what it knows of texts held out."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from echotrace.llm import log_bilinear
from echotrace.llm.log_bilinear import END, KINDS, Model, Vocabulary

from .cases import SCHEMA, WORD, awkward, corpus, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), END]


def check_base(rows, got):
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in rows}
    count = Counter(t for d, text, *_ in rows if not held[d] for t in tokens(text))
    n, v = sum(count.values()), len(count)
    for d, text, *_ in rows:
        own = tokens(text)
        assert (got[d]["held_out"], got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (held[d], len(own), sum(count[t] > 0 for t in own), n), d
        assert math.isclose(got[d]["base_score"], sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own), rel_tol=1e-9)
        assert math.isfinite(got[d]["score"]) and got[d]["score"] <= 1e-9


def test_counts_and_base_score(spark):
    rows = corpus(150)
    got = {r["doc_id"]: r for r in log_bilinear.score(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got) == len(rows)
    check_base(rows, got)
    texts = {}
    for d, text, *_ in rows:
        texts.setdefault(text or "", []).append(got[d]["score"])
    assert all(max(x) - min(x) < 1e-3 for x in texts.values())


def sentences(n, seed):
    """Verbs follow nouns of their kind: a model of single words can't know."""
    draw = random.Random(seed)
    nouns, verbs = [[f"{x}{k}" for k in range(20)] for x in ("dog", "star")], [[f"{x}{k}" for k in range(20)] for x in ("barks", "shines")]
    out = []
    for k in range(n):
        words = []
        for _ in range(30):
            kind = draw.randrange(2)
            words += [draw.choice(nouns[kind]), draw.choice(verbs[kind])]
        out.append((k, " ".join(words)))
    return out


def test_texts_held_out_are_told_better_than_by_counts(spark):
    rows = sentences(1500, 3)
    got = log_bilinear.score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)).collect()
    held = [r for r in got if r["held_out"]]
    mean, base = (sum(r[c] for r in held) / sum(r["n_tokens"] for r in held) for c in ("score", "base_score"))
    # A noun costs log10(40), a verb after it log10(20); counts alone give log10(80) to either.
    assert base == pytest.approx(-math.log10(80), abs=0.1)
    assert mean > base + 0.3
    shuffled = [(k + 10_000, " ".join(t.split()[::2] + t.split()[1::2])) for k, t in rows[:100]]
    both = {r["doc_id"]: r["score"] for r in log_bilinear.score(spark.createDataFrame(rows + shuffled, "doc_id bigint, text string")).collect()}
    assert sum(both[k] > both[k + 10_000] for k in range(100)) > 90


def test_probabilities_add_up(spark):
    rows = corpus(100)
    table, vocabulary = log_bilinear.coded(spark.createDataFrame(rows, SCHEMA))
    model = log_bilinear.fit(table, vocabulary)
    held = {d for d, *_ in rows if zlib.crc32(str(d).encode()) % 10 == 0}
    count = Counter(t for d, text, *_ in rows if d not in held for t in tokens(text))
    words = vocabulary.values(spark.createDataFrame(list(count.items()), "key string, c bigint")).collect()
    assert len(words) == vocabulary.v
    share = np.zeros(vocabulary.classes)
    for r in words:
        share[r["class"]] += 10 ** r["inside"]
    unseen = spark.createDataFrame([(x,) for x in ("zz", "z9", "zé", "z,", "z.", "z!")], "key string").select(vocabulary.defaults()["class"].alias("k"), vocabulary.defaults()["inside"].alias("s")).collect()
    assert len({r["k"] for r in unseen}) == KINDS
    for r in unseen:
        share[r["k"]] += 10 ** r["s"]
    # A kind of which no word was seen once has the unseen ones alone, at less than all of its class.
    assert (share <= 1 + 1e-9).all() and np.isclose(share, 1).sum() >= vocabulary.classes - KINDS
    before = np.array([[1], [2], [vocabulary.classes]])
    each = [model.log10(np.array([k]), before)[0] for k in range(vocabulary.classes)]
    assert np.isclose((10 ** np.array(each)).sum(), 1, atol=1e-4)


def test_averages_follow_the_tokens(spark):
    model = Model(np.array([0.5, 0.3, 0.2]))
    same = model.unpacked(model.packed())
    assert all((x == y).all() for x, y in zip(model.parts, same.parts, strict=True))
    # Contexts: nearest first, and nothing from the text before.
    context = model.contexts(np.array([0, 1, 2, 0, 1]), np.array([0, 3, 5]))
    assert context.tolist() == [[3, 0, 1, 3, 0], [3, 3, 0, 3, 3], [3, 3, 3, 3, 3]]


def test_odd_input(spark):
    rows = corpus(60)
    got = log_bilinear.score(awkward(spark, rows)).collect()
    assert len(got) == 62 and sum(r["doc_id"] is None for r in got) == 1
    assert {r["n_tokens"] for r in got if r["doc_id"] in (0, 1, 2)} == {1}
    assert log_bilinear.score(empty(spark)).collect() == []
    # Nothing to learn from: the only text is held out.
    alone = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    row, = log_bilinear.score(spark.createDataFrame([(alone, "one two")], "doc_id bigint, text string")).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0) and row["score"] < 0


def test_very_long_texts(spark):
    rows = [(1, "word " * 300_000), (2, "x" * 200_000), (3, "one"), (4, None)]
    got = {r["doc_id"]: r for r in log_bilinear.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    check_base(rows, got)


def test_vocabulary_without_words(spark):
    empty_one = Vocabulary(spark.createDataFrame([], "key string, c bigint"))
    assert (empty_one.n, empty_one.v, empty_one.classes) == (0, 0, KINDS)


def test_words_beyond_the_most_frequent_have_their_own_context(spark):
    """240 nouns, each with its own verb: counts can't know the verb, nor can a model that gives only a few words a vector."""
    draw = random.Random(4)
    rows = [(k, " ".join(f"noun{n:03}a verb{n:03}b" for n in draw.choices(range(240), k=60))) for k in range(1500)]
    got = log_bilinear.score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)).collect()
    held = [r for r in got if r["held_out"]]
    mean, base = (sum(r[c] for r in held) / sum(r["n_tokens"] for r in held) for c in ("score", "base_score"))
    assert base == pytest.approx(-math.log10(480), abs=0.1)
    assert mean > base + 0.6


def test_contexts_that_come_again_are_normalised_once():
    draw = np.random.Generator(np.random.PCG64(2))
    share = draw.random(40) + 0.1
    model = Model(share / share.sum())
    vectors, matrices, _, _ = model.parts
    model.parts[2], bias = draw.normal(0, 0.5, model.parts[2].shape).astype(np.float32), model.parts[3]
    classes, bounds = draw.integers(0, 40, 5000), np.array([0, 7, 7, 1200, 5000])
    context = model.contexts(classes, bounds)
    products = sum(vectors[b] @ m for b, m in zip(context, matrices, strict=True)) @ model.parts[2].T + bias
    want = (products[np.arange(5000), classes] - np.log(np.exp(products).sum(axis=1))) / np.log(10)
    assert np.allclose(model.log10(classes, context), want, atol=1e-5)
    assert model.log10(classes[:0], context[:, :0]).shape == (0,)
