"""Near hashes and closest matches against comparisons of all pairs."""

import random

import numpy as np
import pytest

from echotrace.operators import near


def hashes_of(n, size, seed, families=10, letters="0123456789abcdef"):
    """Random hashes, with families whose members differ in 0 to all of their digits."""
    draw = random.Random(seed)
    out = ["".join(draw.choices(letters, k=size)) for _ in range(n)]
    heads = draw.sample(range(n), families)
    for k in range(n // 2):
        digits = list(out[draw.choice(heads)])
        for p in draw.sample(range(size), draw.randint(0, size)):
            digits[p] = draw.choice(letters)
        out[draw.randrange(n)] = "".join(digits)
    return out


def distances(hashes):
    a = np.array([[ord(c) for c in h] for h in hashes], dtype=np.uint8)
    return np.stack([(a != row).sum(axis=1) for row in a])


def frame(spark, hashes):
    return spark.createDataFrame(list(enumerate(hashes)), "id bigint, hash string")


@pytest.mark.parametrize(("size", "percent"), [(64, 75), (64, 90), (16, 90), (20, 60), (3, 30)])
def test_all_near_pairs(spark, size, percent):
    hashes = hashes_of(500, size, size)
    apart = distances(hashes)
    first = {}
    for k, h in enumerate(hashes):
        first.setdefault(h, k)
    d = near.most_apart(size, percent)
    want = {(a, b, int(apart[a, b])) for a in first.values() for b in first.values() if a < b and apart[a, b] <= d}
    got = near.near_hashes(frame(spark, hashes), size, percent).collect()
    assert len(got) == len(want) > 5 and {(r["id_a"], r["id_b"], r["distance"]) for r in got} == want
    assert all(r["percent"] == round(100 - r["distance"] / size * 100, 2) for r in got)


def test_all_near_pairs_of_many_hashes(spark):
    """100,000 hashes of 64 digits at 75 %: the families' pairs, and what is compared for them."""
    hashes = hashes_of(100_000, 64, 1, families=2000)
    a = np.array([[int(c, 16) for c in h] for h in hashes], dtype=np.uint8)
    first = {}
    for k, h in enumerate(hashes):
        first.setdefault(h, k)
    own = np.array(sorted(first.values()))
    got = near.near_hashes(frame(spark, hashes), 64, 75).toPandas()
    pairs = set(zip(got["id_a"], got["id_b"], strict=True))
    assert ((a[got["id_a"]] != a[got["id_b"]]).sum(axis=1) == got["distance"]).all() and got["distance"].max() <= 16
    for k in random.Random(2).sample(own.tolist(), 400):
        near_ones = own[(a[own] != a[k]).sum(axis=1) <= 16]
        assert all((min(k, m), max(k, m)) in pairs for m in near_ones.tolist() if m != k)
    how = near.plan(64, 16, len(own), [hashes[k] for k in own[:400]])
    assert how.met < 0.01 * len(own)


@pytest.mark.parametrize(("size", "floor"), [(64, 40), (16, 40), (10, 75)])
def test_closest_at_any_distance(spark, size, floor):
    hashes = hashes_of(400, size, 7)
    apart = distances(hashes)
    want = {}
    for k in range(len(hashes)):
        d, m = min((int(apart[k, m]), m) for m in range(len(hashes)) if m != k)
        if 100 - d / size * 100 > floor:
            want[k] = (m, round(100 - d / size * 100, 2))
    assert {r["id"]: (r["match_id"], r["percent"]) for r in near.closest(frame(spark, hashes), size, floor).collect()} == want
    assert 30 < len(want)


@pytest.mark.parametrize("block", [3, 40])
def test_hot_keys_meet_in_blocks(spark, block):
    # All hashes share all bands but one.
    hashes = [f"{'a' * 12}{k:04x}" for k in range(100)]
    own = frame(spark, hashes)
    how = near.plan(16, 4, 100, hashes)
    met = near.candidates(own, own, how, 16, block)
    got = {(r["id"], r["other"]): r["distance"] for r in met.distinct().collect()}
    apart = distances(hashes)
    assert got == {(a, b): int(apart[a, b]) for a in range(100) for b in range(100) if a != b}
    # A pair meets as often as it shares keys, whatever the blocks.
    assert met.count() == near.candidates(own, own, how, 16, 10_000).count()


def test_plans(spark):
    for size, d, n in ((64, 16, 10**5), (64, 38, 1000), (64, 38, 10**8), (16, 1, 10**4), (64, 0, 10), (8, 7, 100)):
        how = near.plan(size, d, n, hashes_of(100, size, 5))
        # Whatever d digits differ, one choice has none of them.
        draw = random.Random(size * d)
        for _ in range(200):
            wrong = set(draw.sample(range(size), d))
            assert any(not wrong & set(c) for c in how.choices)
    one, many = (near.plan(64, 38, n, hashes_of(200, 64, 5)) for n in (1000, 10**9))
    assert len(many.choices) >= len(one.choices) and one.met < 1000 / 20
    # Where digits say nothing there is no better way than to compare all.
    assert near.plan(8, 2, 50, ["0" * 8] * 50).choices == ((),)


def test_digits_that_go_together(spark):
    """Digits in fours, each four of one of twenty kinds: a twentieth of the pairs is looked at all the same."""
    draw = random.Random(3)
    fours = ["".join(draw.choices("0123456789abcdef", k=4)) for _ in range(20)]
    hashes = ["".join(draw.choices(fours, k=16)) for _ in range(1000)]
    how = near.plan(64, 38, 1000, hashes[:400])
    own = frame(spark, hashes)
    looked_at = near.candidates(own, own, how, 64).select("id", "other").distinct().count()
    assert looked_at < 1000 * 999 / 20


@pytest.mark.parametrize("size", [16, 64, 80, 300])
def test_blocks_of_all_hashes(spark, size):
    """Small blocks give what all pairs give, and a task holds two of them."""
    hashes = sorted(set(hashes_of(120, size, 9)))
    apart, own, d = distances(hashes), frame(spark, hashes), size * 6 // 10
    want = {(a, b, int(apart[a, b])) for a in range(len(hashes)) for b in range(len(hashes)) if a != b and apart[a, b] <= d}
    assert {tuple(r) for r in near.tiled(own, own, len(hashes), size, d, best=False, side=25).collect()} == want and len(want) > 30
    best = {}
    for r in near.tiled(own.where("id % 3 = 0"), own, len(hashes), size, d, best=True, side=25).collect():
        best[r["id"]] = min(best.get(r["id"], (size, 0)), (r["distance"], r["other"]))
    closest = {k: min((int(apart[k, m]), m) for m in range(len(hashes)) if m != k) for k in range(0, len(hashes), 3)}
    assert best == {k: x for k, x in closest.items() if x[0] <= d}


def test_few_keys_where_all_are_asked(spark):
    """No hash is written under more keys than blocks of all hashes are worth."""
    draw = random.Random(3)
    fours = ["".join(draw.choices("0123456789abcdef", k=4)) for _ in range(20)]
    sample = ["".join(draw.choices(fours, k=16)) for _ in range(400)]
    assert near.plan(64, 38, 50_000, sample).costs() > 50_000
    assert len(near.plan(64, 16, 3_000_000, sample, near.FEW_KEYS).choices) <= near.FEW_KEYS


def test_odd_hashes(spark):
    rows = spark.createDataFrame([(1, None), (2, "abcd"), (3, "abce"), (4, "abcde"), (5, ""), (6, "abcd"), (None, "abcf")], "id bigint, hash string")
    assert {tuple(r) for r in near.closest(rows, 4, 40).collect() if r["id"]} == {(2, 6, 100.0), (6, 2, 100.0), (3, 2, 75.0)}
    assert near.near_hashes(rows.limit(0), 4, 75).collect() == near.closest(rows.limit(0), 4, 40).collect() == []


@pytest.mark.parametrize("size", [16, 64, 80, 300])
def test_each_two_blocks_meet_once(spark, size):
    """Both sides of a pair are answered where it meets, and every hash has the closest of all."""
    hashes = sorted(set(hashes_of(120, size, 9)))
    apart, own, d = distances(hashes), frame(spark, hashes), size * 6 // 10
    for side in (25, 1000):
        best = {}
        for r in near.met_once(own, len(hashes), size, d, side=side).collect():
            best[r["id"]] = min(best.get(r["id"], (size, 0)), (r["distance"], r["other"]))
        closest = {k: min((int(apart[k, m]), m) for m in range(len(hashes)) if m != k) for k in range(len(hashes))}
        assert best == {k: x for k, x in closest.items() if x[0] <= d} and len(best) > 20


def test_hashes_are_worked_out_once(spark):
    rows, worked = spark.createDataFrame(list(enumerate(hashes_of(200, 16, 3))), "id bigint, hash string"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            worked.add(len(batch))
            yield batch

    assert near.closest(rows.mapInArrow(counted, "id bigint, hash string"), 16, 40).count() > 10
    assert worked.value == 200
