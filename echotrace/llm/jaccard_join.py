"""N-gram Jaccard join by size-aware heavy and light sets; its links' components.

A text's set holds its distinct shingles of a few words, in lower case. Equal sets are one class, and one set stands for it.
Small sets are joined by the subsets that a link needs: two sets of n and m shingles link exactly if they share a
subset of the required overlap, so each set lists its subsets of that size for each partner size and equal subsets
meet. Larger sets are joined by scanning inverted lists: each set is listed under the rarest of its shingles, as many as
make sure that linked sets meet; list by list, sizes, counting sketches and the places of the shared shingle rule pairs
out, and what is left is verified on the whole sets. The boundary between small and large is the size up to which listing subsets costs less.
Most of the rarest shingles are in one set only, and most others in two sets of unlike sizes or places. Entries go once,
packed by chunks of sets, to the range of their shingle, and only those that can tell of a link become rows.

Long lists come from groups of near copies. They are first scanned against leaders, a few for each list and band of
sizes, and linked sets need no further comparison with each other; only pairs across components are then scanned. No
list is in one task as a whole: a very long one is cut into blocks by a hash of the set, with leaders of their own, other
blocks in each round, and in the last scan each two blocks meet as a list of their own. Pairs in a group of near copies that
don't quite link grow with the square of the group, so entries of long lists bring along what rules nearly all of them out (``PARITY``).

Shingles stand as 64-bit hashes, so two sets could wrongly share a shingle with a chance of some 1e-14 for each pair
that is compared. Nulls: a null text is an empty one; empty sets link with nothing and are their own component. A
null id takes no part in choosing a component's least id. Repeated rows and ids share their set's component; shingles of equal
rarity are ordered by hash, which changes no link. Very long texts are sets like others, of as many shingles. An empty
table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import numbers, numbers_of
from .common import discard, small_batches, written
from .components import components
from .groups import by_part, power_of_two, squeezed, unsqueezed
from .hashing import Words, lowered, mixed, runs, sequences

#: Counters of the shingles' frequencies, one for so many bytes of text: 8 MB at least and 64 MB at most. They only order
#: shingles; any order is exact, but beyond some 4 GB of text it becomes less good and lists longer.
COUNTER_BYTES, LEAST_COUNTERS, MOST_COUNTERS = 128, 1 << 22, 1 << 25
#: Pairs up to which they are broadcast to the sets: 16 bytes each.
MOST_BROADCAST = 200_000
#: Bits that tell which sets are verified: 1 MB. A wrong hit only writes a set that nobody asks for.
BLOOM = 1 << 23
#: Longest list of which all pairs are scanned in the first round, and rounds of leaders for longer ones.
SHORT, LEADER_ROUNDS = 32, 3
#: Leaders of a list and band in the later rounds.
LEADERS = 2
#: Entries of a list in one block.
BLOCK = 16_384
#: Entries of a chunk of sets, and bytes of text for each range of shingles: some million entries. There are LEAST_RANGES at least.
CHUNK_ENTRIES, RANGE_BYTES, LEAST_RANGES = 1 << 18, 1 << 25, 256
#: A set's sketch: how many members fall into each of 8 buckets a word, one byte each, up to 255.
SKETCH = 16
#: Of a set in a long list: whether the members that fall into a bucket are odd in number, 256 bytes. Two sets differ by as many members at least as
#: buckets. Far more of unlike large sets are told apart than by a sketch, whose buckets are so few that differences cancel out.
PARITY = 2048
#: Rows of 64 bits that tell which rows of a table move to be compared with ids: 3 MB at most. A wrong hit only moves a row in vain.
MARKS = 1 << 17
#: Sets up to this size may be small.
MOST_SMALL = 24


def required(n: int, m: int, percent: int) -> int:
    """The overlap from which sets of n and m link: 100 * o >= percent * (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a run."""
    data = lowered(data)
    words = Words(data, bounds)
    hashes = words.hashes()
    whole = sequences(hashes, width)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            # The whole sequence is the one shingle, told apart from one of full length.
            out.append(mixed(sequences(hashes[a:b], b - a)[:1] + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _counted(width: int, counters: int):
    """The task's counters of shingles, each counted once for a text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's counters stop at 255.
        counts = np.zeros(counters, dtype=np.uint8)
        for batch in batches:
            for _, _, data, bounds in runs(batch.column(0)):
                for s in shingle_sets(data, bounds, width):
                    at = (s & np.uint64(counters - 1)).astype(np.int64)  # a set's shingles rarely share a counter
                    counts[at] += counts[at] < 255
        yield _segments(counts)

    return of


def _saturating(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a.astype(np.uint32) + b, 65535).astype(np.uint16)


def _segments(values: np.ndarray, parts: int = 16) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(parts), type=pa.int32()), pa.array([squeezed(x.tobytes()) for x in np.split(values, parts)], type=pa.binary())], names=["segment", "data"])


def _merged(df: DataFrame, kind: type, wide: type, merge: Callable) -> np.ndarray:
    """Merge the tasks' arrays of ``kind`` segment by segment, as ``wide``; the driver gets one array of fixed size."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(unsqueezed(data), dtype=kind)
                total[k] = merge(total[k], x) if k in total else x.astype(wide)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.int32()), pa.array([x.tobytes() for x in total.values()], type=pa.binary())], names=["segment", "data"])

    rows = df.repartition(16, "segment").mapInArrow(join, "segment int, data binary").collect()
    return np.concatenate([np.frombuffer(r["data"], dtype=wide) for r in sorted(rows, key=lambda r: r["segment"])]) if rows else np.zeros(0, dtype=wide)


def set_key(s: np.ndarray) -> tuple[np.ndarray, tuple[int, int]]:
    """The members hashed again, and two 64-bit sums that tell the set from others."""
    again = mixed(s ^ np.uint64(0x5851F42D4C957F2D))
    return again, tuple(x.sum(dtype=np.uint64).astype(np.int64).item() for x in (s, again))


def _sketched(counts: np.ndarray, percent: int, width: int):
    """Id, size, a 128-bit key of the set, its sketch, its rarest shingles, how many of these are in few sets, and all of them if it may be small."""
    # A task counts to 255; what is above that and what counters share by chance may be in a great many sets.
    many = 255 + 2 * float(counts.mean()) if len(counts) else 0

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for _, _, data, bounds in runs(batch.column(1)):
                for s in shingle_sets(data, bounds, width):
                    n = len(s)
                    again, key = set_key(s)
                    sketch = np.minimum(np.bincount((again & np.uint64(8 * SKETCH - 1)).astype(np.int64), minlength=8 * SKETCH), 255).astype(np.uint8).tobytes()
                    often = counts[(s & np.uint64(len(counts) - 1)).astype(np.int64)]
                    order = np.lexsort((s, often))[: n - -(-percent * n // 100) + 1] if n else np.zeros(0, dtype=np.int64)
                    rows.append((n, *key, sketch, s[order].view(np.int64), int((often[order] <= many).sum()), s.view(np.int64) if n <= MOST_SMALL else s[:0].view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds))], names=["id", "n", "k1", "k2", "sketch", "rare", "few", "small"])

    return of


def _packed(parts: int):
    """The entries of chunks of sets (id, n, rare, few), a row for each range of shingles; without those after the first ``few``."""
    cuts = np.arange(1, parts, dtype=np.uint64) << np.uint64(64 - parts.bit_length() + 1)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            token, ident, n, at = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ident, token))
            bounds = np.concatenate([[0], np.searchsorted(token[order], cuts), [len(order)]])
            part = np.flatnonzero(np.diff(bounds))
            blocks = [[numbers(x[order[bounds[k] : bounds[k + 1]]]) for k in part] for x in (token, ident, n, at)]
            return pa.RecordBatch.from_arrays([pa.array(part, type=pa.int32()), *(pa.array(x, type=pa.binary()) for x in blocks)], names=["part", "token", "id", "n", "at"])

        for batch in batches:
            ident, n, few = (batch.column(k).to_numpy() for k in (0, 1, 3))
            length = batch.column(2).value_lengths().to_numpy()
            at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            asks = at < np.repeat(few, length)
            held.append([batch.column(2).flatten().to_numpy().view(np.uint64)[asks], np.repeat(ident, length)[asks], np.repeat(n, length)[asks], at[asks]])
            if sum(len(x[0]) for x in held) >= CHUNK_ENTRIES:
                yield packed()
                held = []
        if held:
            yield packed()

    return of


def _partnered(token: np.ndarray, n: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """Which entries, sorted by token and size, may tell of a link: all of long lists; of others those that have another one in their list whose
    size fits, where as many members can follow as a link needs. The first shingle that linked sets share has both entries among these."""
    new = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    length = np.diff(np.append(new, len(token)))
    reach = np.repeat(new + length, length) - np.arange(len(token))
    out = np.repeat(length > SHORT, length)
    i = np.flatnonzero(~out)
    for k in range(1, SHORT):
        i = i[reach[i] > k]
        i = i[100 * n[i] >= percent * n[i + k]]  # sizes rise, so no later one fits either
        if not len(i):
            break
        ok = i[np.minimum(n[i] - at[i], n[i + k] - at[i + k]) >= -(-percent * (n[i] + n[i + k]) // (100 + percent))]
        out[ok] = out[ok + k] = True
    return out


def _met(percent: int):
    """The entries whose shingle is in two sets or more that may link, and their number by shingle, of a partition sorted by range."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in by_part(batches):
            token, *others = (np.concatenate([numbers_of(x) for x in table[c].to_pylist()]) for c in ("token", "id", "n", "at"))
            order = np.sort(token)
            again = np.unique(order[1:][order[1:] == order[:-1]])
            if not len(again):
                continue
            keep = again[np.minimum(np.searchsorted(again, token), len(again) - 1)] == token
            token, ident, n, at = (x[keep] for x in (token, *others))
            order = np.lexsort((n, token))
            token, ident, n, at = (x[order] for x in (token, ident, n, at))
            keep = _partnered(token, n, at, percent)
            if keep.any():
                token, ident, n, at = (x[keep] for x in (token, ident, n, at))
                _, c = np.unique(token, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ident), pa.array(n), pa.array(at, type=pa.int32()), pa.array(token), pa.array(np.repeat(c, c))], names=["id", "n", "at", "token", "c"])

    return of


def _entries(classes: DataFrame, size: int, percent: int = 0) -> DataFrame:
    """(id, n, at, token, c): the places of the rarest shingles in their sets, without those that are in no other set
    that may link, and how many entries the shingle has.

    Shingles that are in a great many sets aren't asked for, so no range is much larger than others.
    """
    parts = power_of_two(LEAST_RANGES, size // RANGE_BYTES)
    packed = classes.select("id", "n", "rare", "few").mapInArrow(_packed(parts), "part int, token binary, id binary, n binary, at binary")
    met = packed.repartition("part").sortWithinPartitions("part").mapInArrow(_met(percent), "id bigint, n bigint, at int, token bigint, c bigint")
    others = classes.where(F.size("rare") > F.col("few")).select("id", "n", "few", F.posexplode("rare").alias("at", "token")).where(F.col("at") >= F.col("few")).drop("few")
    others = others.join(others.groupBy("token").agg(F.count("*").alias("c")), "token")
    return met.unionByName(others)


def small_bound(histogram: dict[int, tuple[int, float]], percent: int) -> int:
    """The largest size of small sets: subsets listed against entries scanned, summed up to each size.

    ``histogram`` has for a size the number of sets and the mean length of the lists that they stand in.
    """
    best, at, saved = 0.0, 0, 0.0
    for n in range(1, MOST_SMALL + 1):
        sets, length = histogram.get(n, (0, 1.0))
        subsets = sum(comb(n, required(n, m, percent)) for m in partners(n, percent))
        saved += sets * ((n - -(-percent * n // 100) + 1) * length - subsets)
        if saved > best:
            best, at = saved, n
    return at


def partners(n: int, percent: int) -> list[int]:
    return [m for m in range(-(-percent * n // 100), 100 * n // percent + 1) if required(n, m, percent) <= min(n, m)]


def _subsets(bound: int, percent: int):
    """Each small set's subsets of the sizes that a link needs, hashed with the two sizes that they stand for."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, again, sizes, equal, ids = [], [], [], [], []
            for ident, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = np.array(values, dtype=np.int64).view(np.uint64)
                n = len(s)
                salted = mixed(s ^ np.uint64(0x2545F4914F6CDD1D))
                for m in partners(n, percent):
                    if m > bound:
                        continue
                    need = required(n, m, percent)
                    gone = np.array(list(combinations(range(n), n - need)), dtype=np.int64).reshape(comb(n, need), n - need)
                    pair = np.uint64(min(n, m) * 64 + max(n, m))
                    keys.append(mixed(s.sum(dtype=np.uint64) - s[gone].sum(axis=1, dtype=np.uint64) + pair))
                    again.append(mixed(salted.sum(dtype=np.uint64) - salted[gone].sum(axis=1, dtype=np.uint64) + pair))
                    sizes += [n] * len(gone)
                    equal += [n == m] * len(gone)
                    ids += [ident] * len(gone)
            flat = lambda xs: np.concatenate(xs).view(np.int64) if xs else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat(keys)), pa.array(flat(again)), pa.array(sizes, type=pa.int64()), pa.array(equal, type=pa.bool_()), pa.array(ids, type=batch.column(0).type)], names=["k1", "k2", "n", "equal", "id"])

    return of


def _small_links(sets: DataFrame, bound: int, percent: int) -> DataFrame:
    """Links among small sets. Sets under a key all link with those of the other size, so a star is enough."""
    subsets = sets.where(F.col("n").between(1, bound)).select("id", "small").mapInArrow(_subsets(bound, percent), "k1 bigint, k2 bigint, n bigint, equal boolean, id bigint")
    hubs = subsets.groupBy("k1", "k2").agg(F.min_by("id", F.struct("n", "id")).alias("low"), F.max_by("id", F.struct("n", "id")).alias("high"), F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("c")).where(F.col("c") > 1)
    # Sets of one size under a key for two sizes share less than they need.
    met = subsets.join(hubs, ["k1", "k2"]).where(F.col("equal") | (F.col("a") != F.col("b")))
    pairs = met.select(F.col("id").alias("u"), F.when(F.col("n") == F.col("a"), F.col("high")).otherwise(F.col("low")).alias("v"), "a", "b", "n")
    return pairs.where(F.col("u") != F.col("v")).select("u", "v").distinct()


#: How a posting's columns are laid out.
POSTING = ["token", "id", "n", "at", "component", "c", "side", *(f"p{k}" for k in range(SKETCH))]


def parity(again: np.ndarray) -> np.ndarray:
    """The 64-bit words of a set's parities; ``again`` are its members hashed again."""
    bucket = (again >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=PARITY) & 1).astype(np.uint8)).view(np.uint64)


def _near(n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n <= m with sketches p, q may link: by size, and as bucket by bucket the sets differ by at least
    the difference of their counts."""
    need = -(-percent * (n + m) // (100 + percent))
    apart = np.abs(p.view(np.uint8).astype(np.int16) - q.view(np.uint8)).sum(axis=1, dtype=np.int64)
    return (100 * n >= percent * m) & (apart <= n + m - 2 * need)


def _scan(mode: str, bound: int, percent: int, round_: int, short: int):
    """Pairs of a partition's lists that may link. The partition is sorted by token, size, id.

    ``all``: every pair of lists up to ``short`` entries (``c``), and pairs with leaders of longer ones; ``leaders``: only
    the latter; ``rest``: every pair of what is given, but of two blocks (``side`` 0 and 1) only those across; ``side`` is
    2 elsewhere. Pairs of one component are passed over, and where the entries have parities, those that these rule out. Where all pairs are scanned, a
    pair comes only from lists whose token may be the first that both sets hold, in the order of rarity: no more is
    shared than what follows it in either set.
    """

    def pairs_of(t: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        token, n = t["token"], t["n"]
        new = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.append(new, len(token)))
        long_ = t["c"] > short
        reach = np.repeat(new + length, length) - np.arange(len(token))  # entries from here to the list's end

        def near(i: np.ndarray, j: np.ndarray, first_shared: bool) -> np.ndarray:
            a, b = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            ok = (t["component"][i] != t["component"][j]) & ((b > bound) | (b == 0)) & ((t["side"][i] != t["side"][j]) | (t["side"][i] == 2))
            if first_shared:
                ok &= np.minimum(n[i] - t["at"][i], n[j] - t["at"][j]) >= -(-percent * (a + b) // (100 + percent))
            i, j, a, b = i[ok], j[ok], a[ok], b[ok]
            ok = _near(a, b, t["p"][i], t["p"][j], percent)
            i, j, a, b = i[ok], j[ok], a[ok], b[ok]
            if "parity" in t:
                apart = np.bitwise_count(t["parity"][i] ^ t["parity"][j]).sum(axis=1, dtype=np.int64)
                ok = apart <= a + b - 2 * (-(-percent * (a + b) // (100 + percent)))
                i, j = i[ok], j[ok]
            return np.stack([i, j])

        def against(where: dict, at: np.ndarray, band: np.ndarray) -> Iterator[np.ndarray]:
            for by in (-2, -1, 0, 1, 2):
                other = np.array([where.get((int(a), int(b) + by), -1) for a, b in zip(token[at], band, strict=True)], dtype=np.int64)
                ok = (other >= 0) & (other != at)
                if ok.any():
                    yield near(at[ok], other[ok], False)

        if mode != "leaders":
            at = np.arange(len(token)) if mode == "rest" else np.flatnonzero(~long_)
            for k in range(1, int(length.max())):
                at = at[reach[at] > k]
                at = at[100 * n[at] >= percent * n[at + k]]  # sizes rise, so no later one fits either
                if not len(at):
                    break
                for part in np.array_split(at, len(at) // 50_000 + 1):
                    yield near(part, part + k, True)
        if mode != "rest" and long_.any():
            at = np.flatnonzero(long_)
            band = np.floor(np.log(np.maximum(n[at], 1)) / -np.log(percent / 100) * 2).astype(np.int64)
            # The same posts lead wherever they are listed, others in each round.
            order = np.lexsort((mixed(t["id"][at].view(np.uint64) + np.uint64(round_)), band, token[at]))
            first = np.flatnonzero(np.concatenate([[True], (token[at][order][1:] != token[at][order][:-1]) | (band[order][1:] != band[order][:-1])]))
            within = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            for nth in range(LEADERS if round_ else 1):
                lead = order[within == nth]
                yield from against({(int(a), int(b)): int(at[x]) for a, b, x in zip(token[at][lead], band[lead], lead, strict=True)}, at, band)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            whole = pa.Table.from_batches(held).combine_chunks()
            token = whole["token"].to_numpy()
            # The last list may go on in the next batch.
            end = len(token) if last else int(np.searchsorted(token, token[-1]))
            now, rest = whole.slice(0, end), whole.slice(end)
            held, size = rest.to_batches(), len(rest)
            if len(now):
                t = {c: now[c].to_numpy() for c in ("token", "id", "n", "at", "component", "c", "side")}
                t["p"] = np.stack([now[f"p{k}"].to_numpy() for k in range(SKETCH)], axis=1).view(np.uint64)
                if "parity" in now.column_names:
                    t["parity"] = np.frombuffer(b"".join(now["parity"].to_pylist()), dtype=np.uint64).reshape(len(now), -1)
                for i, j in pairs_of(t):
                    u, v = np.minimum(t["id"][i], t["id"][j]), np.maximum(t["id"][i], t["id"][j])
                    if len(u):
                        u, v = np.unique(np.stack([u, v]), axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
                if size >= 100_000:
                    yield from flush(False)
        if size:
            yield from flush(True)

    return of


def _bloom(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BLOOM, dtype=bool)
    for batch in batches:
        bits[(mixed(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(BLOOM - 1)).astype(np.int64)] = True
    yield _segments(np.packbits(bits))


def _whole_sets(bloom: np.ndarray, width: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (mixed(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(BLOOM - 1)).astype(np.int64)
            batch = batch.filter(pa.array((bloom[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            if batch.num_rows:
                sets = [(*key, s.tobytes(), parity(again).tobytes()) for _, _, data, bounds in runs(batch.column(1)) for s in shingle_sets(data, bounds, width) for again, key in [set_key(s)]]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in sets], type=t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary())))], names=["rep", "k1", "k2", "members", "parity"])

    return of


def _verified(percent: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(a) + len(b) - len(np.union1d(a, b))
                keep[k] = 100 * both >= percent * (len(a) + len(b) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return of


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 90, shingle: int = 3) -> DataFrame:
    """Id, ``n_shingles`` and ``component_id`` of each row; sets of ``shingle`` words link from a similarity of ``percent`` / 100."""
    with small_batches(docs.sparkSession):
        # Written, as what runs later would run outside the block.
        out, *read = _join(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), percent, shingle)
        out = written(out.withColumnRenamed("id", id_col))
        discard(*read)
        return out


def _join(mine: DataFrame, percent: int, shingle: int) -> tuple[DataFrame, ...]:
    """The result and the written tables that it is read from."""
    size = mine.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    counters = LEAST_COUNTERS
    while counters < MOST_COUNTERS and counters * COUNTER_BYTES < size:
        counters *= 2
    counts = _merged(mine.select("text").mapInArrow(_counted(shingle, counters), "segment int, data binary"), np.uint8, np.uint16, _saturating)
    sets = written(mine.mapInArrow(_sketched(counts, percent, shingle), "id bigint, n bigint, k1 bigint, k2 bigint, sketch binary, rare array<bigint>, few int, small array<bigint>"))
    key = ["k1", "k2", "n"]
    # Numbered as they are written, so a number stays with its class.
    grouped = sets.where(F.col("n") > 0).groupBy(*key).agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("sketch", "rare", "few", "small")))
    classes = written(grouped.where(F.col("rep").isNotNull()).withColumn("id", F.monotonically_increasing_id()))
    last, sets = sets, written(sets.select("id", *key))
    discard(last)
    # Lists of one entry tell nothing.
    shared = written(_entries(classes, size, percent).where(F.col("c") > 1))
    lengths = {r["n"]: r["mean"] for r in shared.where(F.col("n") <= MOST_SMALL).groupBy("n").agg(F.avg("c").alias("mean")).collect()}
    histogram = {r["n"]: (r["count"], lengths.get(r["n"], 1.0)) for r in classes.where(F.col("n") <= MOST_SMALL).groupBy("n").count().collect()}
    bound = small_bound(histogram, percent)
    found = written(_small_links(classes, bound, percent))
    # Small sets stay in the lists as far as larger ones may link with them.
    least = -(-percent * (bound + 1) // 100)
    parts = [F.expr(f"cast(conv(hex(substring(sketch, {8 * k + 1}, 8)), 16, -10) as bigint)").alias(f"p{k}") for k in range(SKETCH)]
    wanted = written(shared.where(F.col("n") >= least).join(classes.select("id", *parts), "id"))

    def scanned(listed: DataFrame, mode: str, round_: int) -> DataFrame:
        # A hash of the token stands for it: after a join by token itself Spark would leave this shuffle out, and a skewed
        # join's split would cut a list in two.
        blocks = F.ceil(F.col("c") / BLOCK).cast("int")
        mine = F.pmod(F.xxhash64("id", F.lit(round_)), blocks).cast("int")
        if mode == "rest":
            # A block with itself, and with each other one: as the first or the second of the two.
            with_ = lambda x: F.struct(F.least(F.col("_mine"), x).alias("a"), F.greatest(F.col("_mine"), x).alias("b"), F.when(x == F.col("_mine"), 2).otherwise((x < F.col("_mine")).cast("int")).alias("side"))
            listed = listed.withColumn("_mine", mine).withColumn("_pair", F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), with_)))
            rows = listed.withColumn("token", F.xxhash64("token", "_pair.a", "_pair.b")).withColumn("side", F.col("_pair.side"))
        else:
            rows = listed.withColumn("token", F.xxhash64("token", mine)).withColumn("side", F.lit(2))
        rows = rows.select(*POSTING, *(["parity"] if "parity" in rows.columns else [])).repartition("token").sortWithinPartitions("token", "n", "id")
        return written(rows.mapInArrow(_scan(mode, bound, percent, round_, SHORT), "u bigint, v bigint").distinct())

    pairs = scanned(wanted.withColumn("component", F.col("id")), "all", 0)
    # Whole sets of all that may have to be verified: those in a pair now, and those in long lists.
    asked = pairs.select(F.explode(F.array("u", "v")).alias("id")).unionByName(wanted.where(F.col("c") > SHORT).select("id")).distinct().join(classes, "id").select("id", "rep", "k1", "k2")
    asked = written(asked)
    bloom = _merged(asked.select("rep").mapInArrow(_bloom, "segment int, data binary"), np.uint8, np.uint8, np.bitwise_or)
    whole = None
    if len(bloom):
        members = mine.where(F.col("id").isNotNull()).mapInArrow(_whole_sets(bloom, shingle), "rep bigint, k1 bigint, k2 bigint, members binary, parity binary")
        few = F.broadcast(asked) if asked.count() <= MOST_BROADCAST else asked
        whole = written(members.join(few, ["rep", "k1", "k2"]).select("id", "members", "parity"))
    discard(shared, asked)
    long_lists = whole is not None and not wanted.where(F.col("c") > SHORT).isEmpty()
    for mode, round_ in (("all", 0), *(("leaders", k) for k in range(1, LEADER_ROUNDS)), ("rest", LEADER_ROUNDS)):
        if whole is None or round_ and not long_lists:
            break
        if round_:
            labels = components(found)
            listed = wanted.where(F.col("c") > SHORT).join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
            # Only long lists that still hold more than one component.
            going = listed.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where(F.col("a") != F.col("b")).select("token")
            # Rows of one id and text give their set more than once.
            parities = whole.groupBy("id").agg(F.first("parity").alias("parity"))
            pairs = scanned(listed.join(going, "token", "left_semi").join(parities, "id"), mode, round_)
            discard(labels)
        n = pairs.count()
        if n:
            few = F.broadcast(pairs) if n <= MOST_BROADCAST else pairs
            a, b = (whole.select(F.col("id").alias(x), F.col("members").alias(f"m{x}")).join(few, x) for x in "uv")
            good = a.join(b, ["u", "v"]).select("u", "v", "mu", "mv").mapInArrow(_verified(percent), "u bigint, v bigint")
            last, found = found, written(found.unionByName(good))
            discard(last)
        discard(pairs)
    discard(wanted, whole)
    labels = components(found)
    discard(found)
    named = classes.join(labels, "id", "left").select(*key, "rep", F.coalesce("component", "id").alias("component"))
    least_id = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least_id, "component").select(*key, "component_id")
    out = sets.select("id", *key).join(named, key, "left")
    out = out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out, sets, classes, labels


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``ids`` (one bigint column of that name).

    Rows are large and most of them stay, so only those move whose id falls on a bit that one of ``ids`` has set.
    """
    hashed = lambda: F.xxhash64(F.col(id_col).cast("bigint"))
    row, bit = F.pmod(hashed(), F.lit(MARKS)).cast("int"), F.expr("cast(1 as bigint)")
    place = F.shiftrightunsigned(hashed(), 58).cast("int")
    marks = ids.groupBy(row.alias("_marks_row")).agg(F.bit_or(F.call_function("shiftleft", bit, place)).alias("_marks"))
    marked = docs.withColumn("_marks_row", row).join(F.broadcast(marks), "_marks_row", "left")
    hit = F.coalesce(F.call_function("shiftrightunsigned", F.col("_marks"), place).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    stay, asked = (marked.where(x).select(*docs.columns) for x in (~hit, hit))
    return stay.unionByName(asked.join(ids, id_col, "left_anti").select(*docs.columns))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 80, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller id. Rows of one id are one document; rows with a null id stay."""
    groups = join(docs, id_col, text_col, percent=percent, shingle=shingle)
    later = groups.where(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    return without(docs, later, id_col)
