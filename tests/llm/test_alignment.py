"""Links between two tokenizers, against a plain version."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from echotrace.llm import group_alignment

from .cases import SCHEMA, awkward, corpus, empty


def plainly(rows):
    """Every contract column, from occurrence pairs alone."""
    files = [open(f"{group_alignment.FOLDER}/{f}", "rb").read() for f in (group_alignment.A_FILE, group_alignment.B_FILE)]
    pair = group_alignment.Pair(*files)
    tokens, held, links = [], defaultdict(set), []
    for k, text in enumerate(rows):
        a, b = (pair.encoded([text])[0] if text else None) or ([], [])
        ends = []
        for ids, raw in ((a, pair.a_bytes), (b, pair.b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((i, at, at + len(raw[i])))
                at += len(raw[i])
            ends.append(out)
        found = Counter((x, y) for x, s, e in ends[0] for y, t, f in ends[1] if s < f and t < e) if len(a) < 3000 else None
        tokens.append(ends)
        links.append(found)
        for p in found or ():
            held[p].add(k)
    count = {p: len(x) for p, x in held.items()}
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (a, b), found in zip(tokens, links, strict=True):
        common = {e for *_, e in a} & {e for *_, e in b}
        groups, i, j = [], 0, 0
        for end in sorted(common):
            left, right = [x for x, s, e in a if i < e <= end], [x for x, s, e in b if i < e <= end]
            groups.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
            i = end
        n_best = sum(n for (x, y), n in found.items() if count[x, y] == most[x])
        out.append((len(a), len(b), len(groups), sum(found.values()), n_best, sum(n * count[p] for p, n in found.items()), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = ["two  spaces", " leading", "\n\nlines\t", "日本語のテキスト", "é ﬁ   x", "<|endoftext|> and <s> </s> <0x41>", "▁▁ piece", "a\x00b", "😀😀", "tion tion tions", "x\u00a0 y \u00a0z é à", "a \u3000 b", "don't 'tis '' 's", "x\u0085 y", "end ", "a b\n c\t d"]


def test_alignment_against_all_pairs(spark):
    texts = [t for _, t, *_ in corpus(60)] + ODD
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in group_alignment.align(docs).collect()}
    want = plainly(texts)
    assert len(got) == len(texts)
    for k, row in enumerate(want):
        assert got[k] == row, (k, texts[k])
    assert sum(1 for x in want if x[0]) > 50 and any(x[3] > x[2] for x in want)


def test_chunks_do_not_matter(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(80), SCHEMA)
    whole = sorted(group_alignment.align(docs.coalesce(1)).collect())
    assert sorted(group_alignment.align(docs.repartition(7)).collect()) == whole
    assert sum(r["n_links"] for r in whole) > 0


def test_lexicon_counts_documents(spark):
    docs = spark.createDataFrame([(k, "the house the house") for k in range(5)], "doc_id bigint, text string").repartition(3)
    rows = group_alignment.lexicon(group_alignment.tokenized(docs)).collect()
    assert rows and {(r["n_docs"], r["best"]) for r in rows} == {(5, True)}


def test_odd_input(spark):
    rows = corpus(40)
    got = group_alignment.align(awkward(spark, rows)).collect()
    assert len(got) == 42 and [r["n_a"] for r in got if r["doc_id"] is None] == [5]
    assert {tuple(r[c] for c in COLUMNS) for r in got if r["doc_id"] in (0, 1)} == {(0, 0, 0, 0, 0, 0, "")}
    assert group_alignment.align(empty(spark)).collect() == []


def test_very_long_texts(spark):
    text = "word" * 20_000 + " and more" * 20_000
    rows = [(1, text), (2, "x" * 100_000), (3, text)]
    got = {r["doc_id"]: r for r in group_alignment.align(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1]["groups_sha256"] == got[3]["groups_sha256"] != "" and got[2]["n_a"] > 0


def test_unknown_folder(spark):
    with pytest.raises(FileNotFoundError):
        group_alignment.tokenized(empty(spark), folder="/nowhere")


def test_pieces_are_encoded_as_in_the_whole():
    files = [open(f"{group_alignment.FOLDER}/{f}", "rb").read() for f in (group_alignment.A_FILE, group_alignment.B_FILE)]
    pair = group_alignment.Pair(*files)
    assert pair.apart()
    draw = random.Random(8)
    texts = ["".join(draw.choices(["a", "the", "é", "ß", " ", " ", "  ", "\n", "\u00a0", "\u3000", "1", "'s", ".", "日", "×"], k=draw.randint(1, 60))) for _ in range(400)]
    bounds, codes, pieces = group_alignment._pieces(pa.array(texts), True)
    assert len(codes) > 2 * len(texts)
    for k, text in enumerate(texts):
        own = [pieces[c] for c in codes[bounds[k] : bounds[k + 1]]]
        assert "".join(f" {x}" for x in own) == f" {text}"
        (a, b), at, broken = pair.tokens(own, block=5)
        assert (None if broken.any() else (a.tolist(), b.tolist())) == pair.encoded([text])[0], text
        parts = pair.encoded(own)
        assert [x.tolist() for x in at] == [[sum(len(p[side]) for p in parts[:k] if p) for k in range(len(own) + 1)] for side in (0, 1)]
