"""Hashes that differ in some of their hexadecimal digits: all pairs up to a distance, and each hash's closest one at any distance.

A hash is cut into bands. Two hashes that differ in at most d digits differ in at most d // bands digits of some band, so
they agree in one choice of that band's other digits. Each hash is listed under all such choices of every band; hashes
under one key are compared. Fewer and longer bands make keys more telling and more of them: ``plan`` weighs the keys that
a hash writes against the hashes that it meets under them, so the choice follows the number of hashes. How many it meets
is counted on the pairs of SAMPLE hashes, since digits of pictures aren't drawn by chance; that only chooses the cut, and
any cut finds all. A band's digits lie far from each other, as neighbours often agree for one reason.

A pair of hashes may share many keys, and is met under each of them.

A key that many hashes share is cut into blocks, and each two blocks meet as a key of their own: no task compares more
than ``BLOCK`` hashes with as many others. Where keys tell too little, blocks of all hashes meet instead (``tiled``).
Equal hashes are one class and are never compared.

A hash is compared as four planes of bits, one for each bit of its digits: two hashes differ in the digits at which any
plane does. Hashes are lower-case hexadecimal digits; others, those of another length than ``size``, and null have no partner.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..sources.tables import discard, written

#: Hashes of one key in one block.
BLOCK = 4096
#: What a key costs against a comparison: it is written, shuffled and sorted, a comparison takes some nanoseconds.
KEY_COST = 300.0
#: A cut under which more than this share of all pairs meets is taken only if there is no other.
MANY = 0.05
#: Most keys of a hash, and of one that blocks of all hashes could be compared with instead.
MOST_KEYS, FEW_KEYS = 10_000, 100
#: Hashes whose pairs are looked at to choose a cut.
SAMPLE = 400
#: Digits in one number.
LANE = 15
#: Hashes in one block where all meet, and rows of an array of comparisons.
SIDE, ROWS = 65_536, 16


@dataclass(frozen=True)
class Plan:
    """The choices of digits under which a hash is listed, and how many others a hash is expected to meet under them."""

    choices: tuple[tuple[int, ...], ...]
    met: float
    #: How often it meets them.
    times: float = 0.0

    def costs(self) -> float:
        """In comparisons, for each hash."""
        return len(self.choices) * KEY_COST + self.times


def bands(size: int, n: int) -> list[range]:
    return [range(k, size, n) for k in range(n)]


def plan(size: int, distance: int, hashes: int, sample: Sequence[str], most_keys: int = MOST_KEYS) -> Plan:
    """The cheapest cut of those that keep most pairs apart, for ``hashes`` hashes of ``size`` digits of which at most ``distance`` differ, judged by a sample of them."""
    digits = np.array([[ord(c) for c in h] for h in sample], dtype=np.uint8).reshape(-1, size)
    same = (digits[:, None, :] == digits[None, :, :]).reshape(len(sample), len(sample), size)
    pairs = max(1, len(sample) * (len(sample) - 1))
    # Without any digits to tell hashes apart all meet.
    best = (True, float(hashes)), Plan(((),), float(hashes), float(hashes))
    for n in range(1, min(size, distance + 1) + 1):
        wrong, cut = distance // n, bands(size, n)
        if min(map(len, cut)) <= wrong or (keys := sum(comb(len(b), wrong) for b in cut)) > most_keys:
            continue
        # A pair meets under every choice among the digits of a band that it shares.
        under = np.array([[comb(m, len(b) - wrong) for m in range(size + 1)] for b in cut], dtype=np.float64)
        shared = sum(under[k][same[:, :, b.start :: n].sum(axis=2)] for k, b in enumerate(cut))
        times = hashes * float(shared.sum() - np.trace(shared)) / pairs
        share = (np.count_nonzero(shared) - np.count_nonzero(np.diag(shared))) / pairs
        if (share > MANY, keys * KEY_COST + times) < best[0]:
            best = (share > MANY, keys * KEY_COST + times), Plan(tuple(c for b in cut for c in combinations(b, len(b) - wrong)), hashes * share, times)
    return best[1]


def sampled(rows: DataFrame) -> list[str]:
    """SAMPLE hashes, those with the least hash of their own."""
    draw = F.xxhash64("hash", F.lit(5))
    return [r["hash"] for r in rows.orderBy(draw, "hash").select("hash").limit(SAMPLE).collect()]


def packed(digits: Column, size: int) -> list[Column]:
    """The hash as numbers of LANE digits each."""
    return [F.conv(F.substring(digits, k + 1, LANE), 16, 10).cast("bigint") for k in range(0, size, LANE)]


def apart(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """How many digits differ: of each four bits one says if any does."""
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        bits = x.bitwiseXOR(y)
        bits = bits.bitwiseOR(F.shiftright(bits, 1))
        bits = bits.bitwiseOR(F.shiftright(bits, 2))
        total = total + F.bit_count(bits.bitwiseAND(F.lit(0x111111111111111)))
    return total


def digits_of(hashes: pa.Array, size: int) -> np.ndarray:
    """A row of ``size`` numbers for each hash."""
    letters = np.frombuffer("".join(hashes.to_pylist()).encode(), dtype=np.uint8).reshape(-1, size)
    return np.where(letters < ord("a"), letters - ord("0"), letters - ord("a") + 10).astype(np.uint8)


def planes_of(digits: np.ndarray) -> np.ndarray:
    """Words of 64 digits each for the four bits of the digits: a row for each word of a plane, a column for each hash."""
    n, size = digits.shape
    words = -(-size // 64)
    padded = np.zeros((n, words * 64), dtype=np.uint8)
    padded[:, :size] = digits
    planes = [np.packbits((padded >> bit) & 1, axis=1).view(np.uint64) for bit in range(4)]
    return np.ascontiguousarray(np.stack(planes, axis=1).reshape(n, 4 * words).T)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many digits differ, of planes in the first axis whose others go together."""
    words, total = len(a) // 4, None
    for w in range(words):
        bits = a[w] ^ b[w]
        for bit in range(1, 4):
            bits |= a[bit * words + w] ^ b[bit * words + w]
        counts = np.bitwise_count(bits)
        total = counts if words == 1 else counts.astype(np.int32) + (0 if total is None else total)
    return total


def _packed(planes: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(planes.T)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(flat.shape[1] * 8), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())


def _unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    held = b"".join(column.to_pylist())
    return np.ascontiguousarray(np.frombuffer(held, dtype=np.uint64).reshape(len(column), -1).T)


def of_size(size: int) -> Column:
    return F.col("hash").rlike(f"^[0-9a-f]{{{size}}}$") & (F.length("hash") == size)


def classes(hashes: DataFrame, size: int) -> DataFrame:
    """One row for each hash: its least id, the next one that has it too (null if none has)."""
    hashes = hashes.where(of_size(size))
    least = hashes.groupBy("hash").agg(F.min("id").alias("id"), F.count("*").alias("_n"))
    more = hashes.join(least.where(F.col("_n") > 1).select("hash", F.col("id").alias("_least")), "hash").where(F.col("id") > F.col("_least"))
    return least.drop("_n").join(more.groupBy("hash").agg(F.min("id").alias("second")), "hash", "left")


def _listed(rows: DataFrame, how: Plan, size: int) -> DataFrame:
    """id, asked, ``planes`` and ``key``: one row for each choice."""
    choices = [np.array(c, dtype=np.int64) for c in how.choices]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, (1 << 18) // len(choices))
            for begin in range(0, len(whole), step):
                batch = whole.slice(begin, step)
                digits = digits_of(batch.column("hash"), size)
                keys = np.empty((len(batch), len(choices)), dtype=np.uint64)
                for k, c in enumerate(choices):
                    key = np.full(len(batch), k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    for at in c:
                        key = (key ^ digits[:, at]) * np.uint64(0xBF58476D1CE4E5B9)
                        key ^= key >> np.uint64(29)
                    keys[:, k] = key
                row = pa.array(np.repeat(np.arange(len(batch)), len(choices)))
                columns = [batch.column("id").take(row), batch.column("asked").take(row), _packed(planes_of(digits)).take(row), pa.array(keys.view(np.int64).ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "asked", "planes", "key"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.where("id IS NOT NULL").select("id", "asked", "hash").mapInArrow(of, f"id {kind}, asked boolean, planes binary, key bigint")


def _meetings(first: np.ndarray, size: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that meet, by groups of ``size`` rows from ``first`` on: all inside a block, or those of two blocks. Groups of one small size are taken at once."""
    two = low[first] != high[first]
    small = ~two & (size <= 64)
    for n in np.unique(size[small & (size > 1)]):
        begin = first[small & (size == n)]
        i, j = np.triu_indices(n, 1)
        step = max(1, (1 << 20) // len(i))
        for k in range(0, len(begin), step):
            yield (begin[k : k + step, None] + i).ravel(), (begin[k : k + step, None] + j).ravel()
    for begin, n, apart_ in zip(first[~small], size[~small], two[~small], strict=True):
        rows = np.arange(begin, begin + n)
        left, right = (rows[own[rows] == low[begin]], rows[own[rows] == high[begin]]) if apart_ else (rows, rows)
        for k in range(0, len(left), 256):
            part = left[k : k + 256]
            against = right if apart_ else right[k:]
            a, b = np.repeat(part, len(against)), np.tile(against, len(part))
            yield (a, b) if apart_ else (a[a < b], b[a < b])


def candidates(queries: DataFrame, rows: DataFrame, how: Plan, size: int, block: int = BLOCK, most: int | None = None) -> DataFrame:
    """(id, other, distance) of all that meet under a key, as often as they do, ``most`` apart; ``queries`` and ``rows`` have different hashes by id.

    A hot key is cut into blocks by id; each two blocks meet as a key of their own.
    """
    own_pairs, asking = queries is rows, queries.select("id", "hash", F.lit(True).alias("asked"))
    rows = asking if own_pairs else asking.unionByName(rows.select("id", "hash", F.lit(False).alias("asked")))
    listed = _listed(rows, how, size)
    hot = listed.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > block).select("key", F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    cut = listed.join(hot, "key", "left").fillna(1, ["_blocks"]).withColumn("_own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("_blocks")).cast("int"))
    cut = cut.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cells = cut.select("key", F.least("_own", "_with").alias("_low"), F.greatest("_own", "_with").alias("_high"), "_own", "id", "asked", "planes")

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, low, high, own, asked = (table[c].to_numpy() for c in ("key", "_low", "_high", "_own", "asked"))
        ident = pa.concat_arrays(table["id"].chunks)
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        sizes = np.diff(np.append(new, len(key)))
        planes = _unpacked(table["planes"])
        for a, b in _meetings(new, sizes, own, low, high):
            if not own_pairs:
                two = asked[a] != asked[b]
                a, b = a[two], b[two]
            distance = differing(planes[:, a], planes[:, b])
            keep = slice(None) if most is None else distance <= most
            a, b, distance = a[keep], b[keep], distance[keep].astype(np.int32)
            for x, y in ((a, b), (b, a)):
                mine = asked[x] if own_pairs else asked[x] & ~asked[y]
                if mine.any():
                    yield pa.RecordBatch.from_arrays([ident.take(pa.array(x[mine])), ident.take(pa.array(y[mine])), pa.array(distance[mine])], names=["id", "other", "distance"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups are compared; the last one of a batch may go on in the next."""
        held = []
        for batch in batches:
            if not len(batch):
                continue
            last = [batch.column(c)[len(batch) - 1] for c in ("key", "_low", "_high")]
            same = np.logical_and.reduce([batch.column(c).to_numpy() == x.as_py() for c, x in zip(("key", "_low", "_high"), last, strict=True)])
            begin = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if begin or (held and [held[-1].column(c)[0] for c in ("key", "_low", "_high")] != last):
                yield from compared(pa.Table.from_batches([*held, batch.slice(0, begin)]))
                held = []
            held.append(batch.slice(begin))
        if held:
            yield from compared(pa.Table.from_batches(held))

    order, kind = ["key", "_low", "_high"], rows.schema["id"].dataType.simpleString()
    return cells.repartition(*order).sortWithinPartitions(*order).mapInArrow(of, f"id {kind}, other {kind}, distance int").where("id <> other")


def tiled(queries: DataFrame, rows: DataFrame, n: int, size: int, most: int, best: bool, side: int = SIDE) -> DataFrame:
    """(id, other, distance) of each of the ``queries`` and all ``rows`` that are at most ``most`` apart, or of a query's ``best`` one in each block.

    Blocks of queries meet blocks of the ``n`` rows, so a task holds two of them, whatever there is in all.
    """
    blocks = max(-(-n // side), min(6, -(-n // 1024)), 1)

    def as_planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column("id"), _packed(planes_of(digits_of(batch.column("hash"), size)))], names=["id", "planes"])

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.where("id IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "hash").mapInArrow(as_planes, "id bigint, planes binary")
        df = df.select("id", "planes", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(other))
        return df.repartition(min(2 * blocks * blocks, 2000), "_a", "_b").groupBy("_a", "_b")

    def of(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if len(a) and len(b):
            b = b.sort_by("id")
            (mine, theirs), (x, y) = ((t["id"].to_numpy() for t in (a, b)), (_unpacked(t["planes"]) for t in (a, b)))
            for k in range(0, len(mine), ROWS):
                ids, part = mine[k : k + ROWS], x[:, k : k + ROWS, None]
                found = []
                for m in range(0, len(theirs), 2048):
                    distance = differing(part, y[:, None, m : m + 2048])
                    # Of different hashes none is 0 apart but a hash from itself.
                    if best:
                        distance[distance == 0] = size + 1 if size < 255 or len(y) > 4 else 255
                        at = distance.argmin(axis=1)
                        found.append((distance[np.arange(len(ids)), at].astype(np.int32), at + m))
                    else:
                        row, at = np.nonzero((distance <= most) & (distance > 0))
                        out.append((ids[row], theirs[at + m], distance[row, at].astype(np.int32)))
                if best:
                    # Of equal distances the first, whose id is the least.
                    distances = np.stack([f[0] for f in found])
                    pick = distances.argmin(axis=0)
                    least, at = distances[pick, np.arange(len(ids))], np.stack([f[1] for f in found])[pick, np.arange(len(ids))]
                    keep = least <= most
                    out.append((ids[keep], theirs[at[keep]], least[keep]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.array([], dtype=t) for t in ("i8", "i8", "i4")]
        return pa.table(dict(zip(("id", "other", "distance"), columns, strict=True)))

    return dealt(queries, "_a", "_b").cogroup(dealt(rows, "_b", "_a")).applyInArrow(of, "id bigint, other bigint, distance int")


def most_apart(size: int, percent: float) -> int:
    """The largest distance at a match percentage."""
    return int(size - percent / 100 * size + 1e-9)


def near_hashes(hashes: DataFrame, size: int, percent: float) -> DataFrame:
    """All pairs of different hashes that match by ``percent``, each hash by its least id: id_a, id_b, distance, percent."""
    d = most_apart(size, percent)
    own = written(hashes.where(of_size(size)).groupBy("hash").agg(F.min("id").alias("id")))
    n = own.count()
    how = plan(size, d, n, sampled(own))
    if how.costs() < n:
        pairs = candidates(own, own, how, size, most=d).where(F.col("id") < F.col("other")).distinct()
    else:
        pairs = tiled(own, own, n, size, d, best=False).where(F.col("id") < F.col("other"))
    out = written(pairs.select(F.col("id").alias("id_a"), F.col("other").alias("id_b"), "distance", expr.match_percent(F.col("distance"), F.lit(float(size))).alias("percent")))
    discard(own)
    return out


def met_once(own: DataFrame, n: int, size: int, most: int, side: int = SIDE) -> DataFrame:
    """(id, other, distance) of each of the ``n`` different hashes and its closest one in each block, the least id on a tie, if they are at most ``most`` apart.

    Each two blocks meet in one task, which answers for both. Two of the four planes tell how many digits differ at least;
    only pairs that may be closer than what either hash has found are compared as a whole.
    """
    blocks = max(-(-n // side), min(12, -(-n // 1024)), 1)
    words = -(-size // 64)

    def as_planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column("id"), _packed(planes_of(digits_of(batch.column("hash"), size)))], names=["id", "planes"])

    df = own.where("id IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "hash").mapInArrow(as_planes, "id bigint, planes binary")
    df = df.withColumn("_own", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).cast("int")).withColumn("_with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    df = df.select("id", "planes", "_own", F.least("_own", "_with").alias("_a"), F.greatest("_own", "_with").alias("_b"))

    def of(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        block, low, high = table["_own"].to_numpy(), table["_a"][0].as_py(), table["_b"][0].as_py()
        planes, ids = _unpacked(table["planes"]), table["id"].to_numpy()
        (mine, x), (theirs, y) = ((ids[block == k], np.ascontiguousarray(planes[:, block == k])) for k in (low, high))
        # Distance and place in one number: the least is the closest, of equal ones the least id.
        best_x, best_y = (np.full(len(z), (most + 1) << 40, dtype=np.int64) for z in (mine, theirs))
        kind = np.uint8 if words == 1 else np.int32
        limit_y = np.full(len(theirs), most + 1, dtype=kind)
        for k in range(0, len(mine), ROWS):
            part = x[:, k : k + ROWS, None]
            for m in range(0, len(theirs), 4096):
                if low == high and m + 4096 <= k:
                    continue
                other, least = y[:, None, m : m + 4096], None
                for w in range(words):
                    bits, more = part[w] ^ other[w], part[words + w] ^ other[words + w]
                    counts = np.bitwise_count(np.bitwise_or(bits, more, out=bits))
                    least = counts if words == 1 else counts.astype(kind) + (0 if least is None else least)
                limit = (best_x[k : k + ROWS] >> 40).astype(kind)
                at = np.flatnonzero(least <= np.maximum(limit[:, None], limit_y[m : m + 4096]))
                row, col = at // least.shape[1] + k, at % least.shape[1] + m
                distance = differing(x[:, row], y[:, col]).astype(np.int64) << 40
                # Of different hashes none is 0 apart but a hash from itself.
                some = np.flatnonzero(distance)
                row, col, distance = row[some], col[some], distance[some]
                np.minimum.at(best_x, row, distance + col)
                np.minimum.at(best_y, col, distance + row)
                limit_y[col] = best_y[col] >> 40
        out = []
        for best, own_ids, others in ((best_x, mine, theirs), (best_y, theirs, mine)):
            found = best < (most + 1) << 40
            out.append((own_ids[found], others[best[found] & ((1 << 40) - 1)], (best[found] >> 40).astype(np.int32)))
        return pa.table(dict(zip(("id", "other", "distance"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    return df.repartition(min(blocks * (blocks + 1), 2000), "_a", "_b").groupBy("_a", "_b").applyInArrow(of, "id bigint, other bigint, distance int")


def closest(hashes: DataFrame, size: int, floor: float) -> DataFrame:
    """For each id its best match by percent, the least id on a tie, if that is above ``floor``: id, match_id, percent.

    A copy is the closest of all. Hashes without one meet all hashes, block by block: so wide a distance leaves no keys
    that tell enough, and answers within smaller ones cost more than they spare, as most hashes have none.
    """
    # Hashes are worked out once.
    hashes = written(hashes.select("id", "hash"))
    own = written(classes(hashes, size))
    n = own.count()
    widest = max(d for d in range(size) if round(100 - d / size * 100, 2) > floor or d == 0)
    met = met_once(own, n, size, widest)
    best = written(met.groupBy("id").agg(F.min(F.struct("distance", "other")).alias("best")).select(F.col("id").alias("_met"), F.col("best.other").alias("match"), F.col("best.distance").alias("_apart")))
    of = own.join(best, own["id"] == best["_met"], "left").select("hash", F.col("id").alias("_of"), "second", "match", F.when(F.col("second").isNotNull(), 0).otherwise(F.col("_apart")).alias("distance")).where(F.col("distance").isNotNull())
    posts = hashes.join(of, "hash")
    match = F.when(F.col("second").isNull(), F.col("match")).when(F.col("id") == F.col("_of"), F.col("second")).otherwise(F.col("_of"))
    out = posts.select("id", match.alias("match_id"), expr.match_percent(F.col("distance"), F.lit(float(size))).alias("percent")).where(F.col("percent") > floor)
    out = written(out)
    discard(hashes, own, best)
    return out
