"""Hashes of images and clips."""

import numpy as np

from echotrace.functions import media


def test_difference_hash(spark):
    ramp = np.tile(np.arange(64.0), (64, 1))
    assert media.difference_hash(ramp) == "f" * 64
    assert media.difference_hash(ramp, vertical=True) == "0" * 64
    assert len(media.difference_hash(ramp, 32)) == 256
    df = spark.createDataFrame([(1, ramp.ravel().tolist(), 64), (2, None, 64), (3, ramp.T.ravel().tolist(), 64)], "id int, pixels array<double>, width int")
    got = {r["id"]: (r["dhash_h"], r["dhash_v"]) for r in media.with_hashes(df).collect()}
    assert got == {1: ("f" * 64, "0" * 64), 2: (None, None), 3: ("0" * 64, "f" * 64)}


def test_resized_keeps_means():
    draw = np.random.default_rng(0).random((50, 37))
    small = media.resized(draw, 7, 5)
    assert small.shape == (7, 5)
    assert abs(small.mean() - draw.mean()) < 1e-9


def test_audio_fingerprints_of_a_part_are_among_those_of_the_whole(spark):
    draw = np.random.default_rng(5)
    t = np.arange(8000 * 30) / 8000
    clip = sum(2000 * np.sin(2 * np.pi * draw.uniform(200, 3500) * t) * (np.abs(t - draw.uniform(0, 30)) < 0.4) for _ in range(60))
    df = spark.createDataFrame([(1, [clip.tolist(), None]), (2, [clip[8192:].tolist()]), (3, None)], "id bigint, channels array<array<double>>")
    rows = media.audio_fingerprints(df, rate=8000).collect()
    hashes = {k: {r["hash"] for r in rows if r["id"] == k} for k in (1, 2)}
    assert len(hashes[1] & hashes[2]) > 10


def test_average_hashes_and_pictures_that_cannot_be_read(spark):
    draw = np.random.default_rng(1).random((16, 16))
    flat = (draw > draw.mean()).ravel()
    assert media.average_hash(draw) == "".join(f"{int(''.join('01'[int(b)] for b in flat[k : k + 4]), 2):x}" for k in range(0, 256, 4))
    assert media.average_hash(np.ones((20, 30)), 8) == "0" * 16
    bad = [None, [], [1.0, 2.0, 3.0], [1.0, float("nan")], [1.0, 2.0]]
    df = spark.createDataFrame([(k, v, w) for k, (v, w) in enumerate(zip(bad, [2, 2, 2, 2, 0], strict=True))], "id int, pixels array<double>, width int")
    assert {r["ahash"] for r in media.with_hashes(df).collect()} == {None}


def test_galleries_skip_what_fails(spark):
    draw = np.random.default_rng(2)
    pictures = [draw.random((17, 23)) for _ in range(3)]
    entry = lambda p: (p.ravel().tolist(), p.shape[1])
    df = spark.createDataFrame([(1, [entry(pictures[0]), (None, 4), entry(pictures[1]), ([1.0, 2.0, 3.0], 2)]), (2, [entry(pictures[2])]), (3, None), (4, [])], "id bigint, pictures array<struct<pixels:array<double>,width:int>>")
    got = sorted((r["id"], r["place"], r["hash"], r["hash_type_id"]) for r in media.gallery_hashes(df).collect())
    assert got == [(1, 0, media.difference_hash(pictures[0]), 1), (1, 2, media.difference_hash(pictures[1]), 1), (2, 0, media.difference_hash(pictures[2]), 1)]


def plain_maxima(level, reach):
    out = np.empty_like(level)
    for i in range(level.shape[0]):
        for j in range(level.shape[1]):
            out[i, j] = max(level[a, b] for a in range(max(0, i - reach), min(level.shape[0], i + reach + 1)) for b in range(level.shape[1]) if abs(a - i) + abs(b - j) <= reach)
    return out


def test_maxima_over_a_diamond():
    draw = np.random.default_rng(3)
    for shape, reach in (((12, 15), 3), ((5, 30), 6), ((1, 9), 2), ((20, 20), 0)):
        level = draw.random(shape)
        assert (media.diamond_maxima(level, reach) == plain_maxima(level, reach)).all()
    # A corner of the square is no neighbour in a diamond.
    level = np.zeros((9, 9))
    level[2, 2], level[4, 4] = 5, 3
    assert media.diamond_maxima(level, 3)[4, 4] == 3 and media.diamond_maxima(level, 4)[4, 4] == 5


def test_power_of_a_tone():
    # A tone of amplitude a has power a * a / 2, spread over its line by the window.
    t = np.arange(8192) / 8000
    power = media.power_spectrum(3 * np.sin(2 * np.pi * 1000 * t), 8000, 1024)
    assert power.shape == (513, 15)
    assert abs(power[:, 5].sum() * 8000 / 1024 - 4.5) < 0.05 and power[:, 5].argmax() == 128
    assert media.power_spectrum(np.ones(10), 8000, 1024).shape == (513, 1)


def test_channels_join_as_a_set(spark):
    draw = np.random.default_rng(4)
    a, b = (draw.normal(size=44_100) * 3000 for _ in range(2))
    want = media.fingerprints_of(a, 44_100, 14, 200) | media.fingerprints_of(b, 44_100, 14, 200)
    df = spark.createDataFrame([(1, [a.tolist(), b.tolist(), a.tolist()]), (2, []), (3, [[]])], "id bigint, channels array<array<double>>")
    got = media.audio_fingerprints(df).collect()
    assert len(got) == len(want) > 50 and {(r["hash"], r["offset"]) for r in got} == want
