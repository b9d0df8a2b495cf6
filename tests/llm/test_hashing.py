"""Hashes of words and of runs of words: equal for equal ones, and different also where sums of bytes times powers are equal."""

import random

import numpy as np
import pytest

from echotrace.llm import jaccard_join, recompression
from echotrace.llm.groups import dealt
from echotrace.llm.hashing import Words, sequences

from .cases import SCHEMA


def regular(n):
    """Letters by the parity of their place's one bits (Thue-Morse), and the same with the letters swapped."""
    word = "".join("ab"[bin(k).count("1") & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_are_told_apart():
    draw = random.Random(1)
    texts = [" ".join("".join(draw.choices("ab\x00é", k=draw.randint(1, 40))) for _ in range(200)) for _ in range(30)] + ["", " ", *(x for n in (8, 64, 1024, 4096) for x in regular(n))]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    words = Words(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    own = [data[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)]
    of = {}
    assert all(of.setdefault(w, h) == h for w, h in zip(own, words.hashes().tolist(), strict=True))
    assert len(set(of.values())) == len(of) > 3000


@pytest.mark.parametrize("width", [1, 2, 3, 5, 19, 20, 64])
def test_sequences_are_told_apart(width):
    values = np.random.Generator(np.random.PCG64(width)).integers(0, 2, 4000, dtype=np.uint64) << np.uint64(40)
    got = sequences(values, width)
    runs = [values[k : k + width].tobytes() for k in range(len(got))]
    assert len(got) == 4000 - width + 1 and len(set(runs)) == len(set(got.tolist())) == len(set(zip(runs, got.tolist(), strict=True)))
    assert sequences(values[: width - 1], width).tolist() == []


def test_regular_words_remove_and_link_nothing(spark):
    one, other = regular(1024)
    nineteen = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{nineteen} {one}", "en", "s", 0), (2, f"{nineteen} {other}", "en", "s", 0), (3, f"{nineteen} {one}", "en", "s", 0)]
    assert {r["doc_id"]: r["n_removed"] for r in recompression.dedupe(spark.createDataFrame(rows, SCHEMA)).collect()} == {1: 0, 2: 0, 3: 20}
    rows = [(k, f"x y {w}", "en", "s", 0) for k, w in enumerate((one, other, one))]
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.join(spark.createDataFrame(rows, SCHEMA)).collect()} == {0: 0, 1: 1, 2: 0}


def test_values_are_dealt_once():
    values = np.random.Generator(np.random.PCG64(4)).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    for parts in (1, 8, 1 << 22):
        got = list(dealt(values, parts))
        assert sorted(np.concatenate([k for _, k in got]).tolist()) == list(range(500))
        assert [p for p, _ in got] == sorted({p for p, _ in got}) and max(p for p, _ in got) < parts
    assert list(dealt(values[:0], 8)) == []
