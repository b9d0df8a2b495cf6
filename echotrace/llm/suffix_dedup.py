"""Removal of byte strings that an earlier document holds, by blockwise suffix sorting with a difference cover.

Whole stretches come first: every text is cut where its own bytes say so, and a stretch (with the 49 bytes after it) that
a smaller document holds too goes without further comparison.

Of what is left suffixes matter by their first 50 bytes. The least hash of 24 bytes in them is their anchor; equal strings
have equal anchors. Spark gathers all anchors and tells every group of texts which of its anchors another document holds;
the others rule their suffixes out. A bucket of suffixes is what has anchors in one range. It arrives as the pieces of
text around its anchors. Equal pieces are one, an anchor with one piece needs no comparison, and the suffixes of the rest
are sorted, one bucket at a time: suffixes at the positions of a difference cover are ranked first, then all suffixes are
sorted by 32 bytes, and longer ties are resolved by the ranks of the cover positions that lie at one distance from both,
which a cover modulo 31 always has within 31 bytes. Suffixes that agree in 50 bytes end up under one rank, of which the
least document is the owner. The suffixes of an anchor that very many groups hold are dealt by their own hash instead, so
they spread over all buckets. Memory is that of one bucket or one group of texts, and both are as many as the input asks for.

Strings are compared byte by byte; anchors are hashes, whose collisions cost time alone, and stretches are compared by
128-bit digests. Nulls: a null text is an empty one; a null id is set apart and takes no part. Rows with equal ids count as
one document. Texts of fewer bytes lose nothing; a very long one makes its group larger, which needs some hundred
bytes of memory for each of its bytes. Ties: of equal strings the least id's stays, at all its places. An empty table gives an
empty result. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .groups import PART_ANCHORS, QUESTION, Store, answer, answered, by_group, by_part, covered, cut_texts, dealt, in_order, packed_spans, power_of_two, question, repeated_stretches, single_spans, squeezed, unsqueezed, whole
from .hashing import BYTES, mixed, runs, windows

WIDTH, GRAM = 50, 24
#: A perfect difference set modulo 31: every difference is one of two members'.
COVER_MODULUS, COVER = 31, [1, 5, 11, 24, 25, 27]
#: Bytes by which suffixes are sorted before ties are resolved; more than any distance to a common cover position.
PREFIX = 32
#: Stretches: one cut in so many bytes on average, by hashes of so many bytes, at least so far from the last candidate.
CUT_EVERY, CUT_GRAM, CUT_APART = 512, 16, 64
#: Groups above which an anchor is hot: its suffixes are dealt by their own hash.
HOT = 256
#: Bytes of text for each bucket.
PART_BYTES = 4 << 20


def _distances() -> np.ndarray:
    """For residues a and b the least distance at which both meet the cover."""
    member = np.isin(np.arange(COVER_MODULUS), COVER)
    out = np.zeros((COVER_MODULUS, COVER_MODULUS), dtype=np.int64)
    for a in range(COVER_MODULUS):
        for b in range(COVER_MODULUS):
            out[a, b] = next(d for d in range(COVER_MODULUS) if member[(a + d) % COVER_MODULUS] and member[(b + d) % COVER_MODULUS])
    return out


DISTANCES = _distances()


def _spans(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` values, by doubling."""
    out, reach = values, 1
    while reach * 2 <= width:
        out = pick(out[:-reach], out[reach:])
        reach *= 2
    return pick(out[: len(out) - (width - reach)], out[width - reach :]) if reach < width else out


def window_anchors(data: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """For each byte the least hash among the grams of the window that starts there; 0 if none starts in its text."""
    out = np.zeros(len(data), dtype=np.uint64)
    if len(data) < width:
        return out
    least = _spans(windows(BYTES[data], GRAM) | np.uint64(1), width - GRAM + 1, np.minimum)
    out[: len(least)] = least
    # No window crosses the end of its text.
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[max(begin, end - width + 1) : end] = 0
    return out


def stretches(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of the stretches of a run, each with the ``width`` - 1 bytes after it where its text has them.

    Every string of ``width`` bytes that starts in a stretch lies in it. A cut depends on the bytes around it alone.
    """
    cut = np.flatnonzero(windows(BYTES[data], CUT_GRAM) % np.uint64(CUT_EVERY) == 0)
    cut = cut[np.concatenate([[True], np.diff(cut) > CUT_APART])] if len(cut) else cut
    start = np.unique(np.concatenate([bounds[:-1], cut]))
    text = np.searchsorted(bounds, start, side="right") - 1
    end = np.minimum(np.append(start[1:], len(data)) + width - 1, bounds[text + 1])
    ok = end - start >= width
    return start[ok], end[ok], text[ok]


def _digests(width: int):
    """A row for each stretch: digest, id, place (group and row) and span (start and end)."""

    def of(rows: pa.Table) -> pa.Table:
        ids, column = in_order(rows)
        digests, ident, place, span = [], [], [], []
        b = rows["b"][0].as_py()
        for i, _, data, bounds in runs(column):
            start, end, text = stretches(data, bounds, width)
            raw = data.tobytes()
            digests += [hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(start.tolist(), end.tolist(), strict=True)]
            ident.append(ids[i:][text])
            place.append((i + text) | (b << 32))
            span.append((start - bounds[text]) | ((end - bounds[text]) << 32))
        keys = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        columns = [keys[:, 0], keys[:, 1], *(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (ident, place, span))]
        return pa.table([pa.array(np.ascontiguousarray(x), type=pa.int64()) for x in columns], names=["k1", "k2", "id", "place", "span"])

    return of


class Anchors:
    """The anchors of a group's suffixes that no stretch resolves: their values' upper 56 bits, rows, starts, and how many suffixes each has."""

    def __init__(self, rows: pa.Table, sent: pa.Table, width: int) -> None:
        self.ids, self.column = in_order(rows)
        row, start, end = single_spans(sent)
        found: list[tuple] = []
        for i, j, data, bounds in runs(self.column):
            least = window_anchors(data, bounds, width)
            a, b = np.searchsorted(row, [i, j])
            at = bounds[row[a:b] - i]
            least[covered(at + start[a:b], at + end[a:b] - width + 1, len(data))] = 0
            head = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])) if len(least) else np.zeros(0, dtype=np.int64)
            count = np.diff(np.append(head, len(least)))
            ok = least[head] != 0
            head, count = head[ok], count[ok]
            text = np.searchsorted(bounds, head, side="right") - 1
            found.append((least[head] >> np.uint64(8), (i + text).astype(np.int64), head - bounds[text], count))
        kinds = (np.uint64, np.int64, np.int64, np.int64)
        self.value, self.row, self.start, self.count = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=t) for k, t in enumerate(kinds))
        #: Distinct values, and where each occurrence's is among them.
        self.values, self.which = np.unique(self.value, return_inverse=True)

    def shared(self) -> np.ndarray:
        """Which values two documents of the group hold."""
        ident = self.ids[self.row]
        low, high = np.full(len(self.values), np.iinfo(np.int64).max), np.full(len(self.values), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, ident)
        np.maximum.at(high, self.which, ident)
        return low < high


def _asked(width: int, parts: int):
    def of(rows: pa.Table, sent: pa.Table) -> pa.Table:
        found = Anchors(rows, sent, width)
        return question(rows["b"][0].as_py(), found.values, found.shared(), parts)

    return of


#: A piece's id, row, start, length and some bits of its anchor.
FIELDS = (np.int64, np.int32, np.int32, np.int32, np.uint32)


def packed_pieces(fields: list[np.ndarray], text: bytes) -> bytes:
    return squeezed(len(fields[0]).to_bytes(8, "little") + b"".join(x.astype(t).tobytes() for x, t in zip(fields, FIELDS, strict=True)) + text)


def unpacked_pieces(block: bytes) -> tuple[list[np.ndarray], bytes]:
    data = unsqueezed(block)
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for t in FIELDS:
        out.append(np.frombuffer(data, dtype=t, count=n, offset=at))
        at += n * np.dtype(t).itemsize
    return out, data[at:]


def _single(data: np.ndarray, at: np.ndarray, count: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the suffixes of hot anchors: which occurrence each is of and its place, and which only repeat a smaller or equal
    document's of the group (that one stands for them)."""
    of = np.repeat(np.arange(len(at)), count)
    place = at[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    raw = data.tobytes()
    first: dict[bytes, int] = {}
    order = np.argsort(ids[of], kind="stable")
    least = np.empty(len(of), dtype=np.int64)
    for k in order.tolist():
        least[k] = first.setdefault(raw[place[k] : place[k] + width], k)
    return of, place, ids[of] > ids[of][least]


def _pieces(width: int, asked: int, parts: int):
    """Pieces of text whose suffixes share an anchor that another document holds, by the range of the anchor (``part`` >= 0); what is known to go already (``part`` < 0)."""

    def of(rows: pa.Table, sent: pa.Table) -> pa.Table:
        found = Anchors(rows, sent, width)
        b = rows["b"][0].as_py()
        known, hot = answer(sent, found.values, asked)
        data, bounds = whole(found.column)
        out: list[tuple[int, bytes, bytes]] = []
        pick = np.flatnonzero(known[found.which] & ~hot[found.which])
        at, size, row, value = bounds[found.row[pick]] + found.start[pick], found.count[pick] + width - 1, found.row[pick], found.value[pick]
        spread = np.flatnonzero(hot[found.which])
        if len(spread):
            mine = bounds[found.row[spread]] + found.start[spread]
            which, place, gone = _single(data, mine, found.count[spread], found.ids[found.row[spread]], width)
            lost = found.row[spread][which]
            out.append((-1 - b % parts, b"", packed_spans(lost[gone], place[gone] - bounds[lost[gone]], place[gone] - bounds[lost[gone]] + width)))
            which, place = which[~gone], place[~gone]
            hashes = _at(data, place, width)
            at, size = np.concatenate([at, place]), np.concatenate([size, np.full(len(place), width)])
            row, value = np.concatenate([row, found.row[spread][which]]), np.concatenate([value, hashes >> np.uint64(8)])
        ids, raw = found.ids[row], data.tobytes()
        for part, k in dealt(mixed(value), parts):
            k = k[np.argsort(value[k], kind="stable")]
            text = b"".join(raw[x : x + n] for x, n in zip(at[k].tolist(), size[k].tolist(), strict=True))
            out.append((part, packed_pieces([ids[k], row[k], at[k] - bounds[row[k]], size[k], value[k] & np.uint64(0xFFFFFFFF)], text), b""))
        kinds = (pa.int32(), pa.binary(), pa.binary())
        part, *blocks = (pa.array([x[k] for x in out], type=t) for k, t in enumerate(kinds))
        return pa.table([part, pa.array([b] * len(out), type=pa.int32()), *blocks], names=["part", "b", "pieces", "spans"])

    return of


def _at(data: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` bytes from each place."""
    out = np.zeros(len(place), dtype=np.uint64)
    for k in range(width):
        out = mixed(out ^ BYTES[data[place + k]])
    return out


def _words(text: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """The ``width`` bytes from each position as big-endian words, the first one first; ``text`` is padded."""
    out = []
    for begin in range(0, width, 8):
        word = np.zeros(len(at), dtype=np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | (text[at + begin + k].astype(np.uint64) if begin + k < width else np.uint64(0))
        out.append(word)
    return out


def prefix_ranks(text: np.ndarray, suffixes: np.ndarray, width: int) -> np.ndarray:
    """The rank of each suffix by its first ``width`` bytes; equal ranks mean equal bytes.

    ``text`` must reach ``width`` + 40 bytes beyond the last suffix.
    """
    if not len(suffixes):
        return np.zeros(0, dtype=np.int64)
    tied = np.lexsort(_words(text, suffixes, PREFIX)[::-1])
    words = [w[tied] for w in _words(text, suffixes, PREFIX)]
    new = np.concatenate([[True], np.any([w[1:] != w[:-1] for w in words], axis=0)])
    rank = np.empty(len(suffixes), dtype=np.int64)
    rank[tied] = np.cumsum(new) - 1
    sizes = np.bincount(rank)
    unresolved = np.flatnonzero(sizes[rank] > 1)
    if not len(unresolved):
        return rank
    # Cover positions that a tie may ask for, ranked by their own first bytes.
    n = len(text)
    asked = np.bincount(suffixes[unresolved], minlength=n + COVER_MODULUS) - np.bincount(suffixes[unresolved] + COVER_MODULUS, minlength=n + COVER_MODULUS)
    near = np.flatnonzero(np.cumsum(asked)[:n] > 0)
    sample = near[np.isin(near % COVER_MODULUS, COVER)]
    words = _words(text, sample, width)
    order = np.lexsort(words[::-1])
    place = np.zeros(n, dtype=np.int32)
    place[sample[order]] = np.arange(len(sample))
    common = _shared_with_previous([w[order] for w in words], width)
    classes: dict[int, np.ndarray] = {}
    # Ternary quicksort over all groups at once. A suffix's way through the pivots is written as digits 0, 1, 2 of a
    # number, the first digit first, so that the numbers order a group in the end.
    way = np.zeros(len(suffixes), dtype=np.int64)
    open_ = unresolved[np.argsort(rank[unresolved], kind="stable")]
    group = rank[open_]
    for depth in range(38, -1, -1):
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, dtype=np.int64)
        length = np.diff(np.append(begin, len(group)))
        if depth == 0 or not len(group):
            break
        pivot = np.repeat(suffixes[open_[begin + length // 2]], length)
        mine = suffixes[open_]
        far = DISTANCES[mine % COVER_MODULUS, pivot % COVER_MODULUS]
        a, b = place[mine + far], place[pivot + far]
        digit = np.where(a < b, 0, 2)
        for d in np.flatnonzero(np.bincount(far)).tolist():
            if d not in classes:
                classes[d] = np.cumsum(common < width - d, dtype=np.int32)
            at = np.flatnonzero(far == d)
            digit[at] = np.where(classes[d][a[at]] == classes[d][b[at]], 1, digit[at])
        way[open_] += digit * 3**depth
        keep = digit != 1
        open_, group = open_[keep], np.repeat(np.arange(len(begin)), length)[keep] * 3 + digit[keep]
        order = np.argsort(group, kind="stable")
        open_, group = open_[order], group[order]
        # A suffix that is alone in its group has nothing left to be told from.
        if len(group):
            first = np.concatenate([[True], group[1:] != group[:-1]])
            alone = first & np.concatenate([first[1:], [True]])
            open_, group = open_[~alone], group[~alone]
    order = np.lexsort((way, rank))
    new = np.concatenate([[True], (rank[order][1:] != rank[order][:-1]) | (way[order][1:] != way[order][:-1])])
    out = np.empty(len(rank), dtype=np.int64)
    out[order] = np.cumsum(new) - 1
    if not len(open_):
        return out
    # Deeper than the digits reach: the same again for what is left, by whole strings.
    keys = np.lexsort([*_words(text, suffixes[open_], width)[::-1], out[open_]])
    left = open_[keys]
    words = [out[left], *_words(text, suffixes[left], width)]
    inner = np.zeros(len(rank), dtype=np.int64)
    inner[left] = np.cumsum(np.concatenate([[True], np.any([w[1:] != w[:-1] for w in words], axis=0)]))
    order = np.lexsort((inner, out))
    new = np.concatenate([[True], (out[order][1:] != out[order][:-1]) | (inner[order][1:] != inner[order][:-1])])
    final = np.empty(len(rank), dtype=np.int64)
    final[order] = np.cumsum(new) - 1
    return final


def _shared_with_previous(words: list[np.ndarray], width: int) -> np.ndarray:
    """How many of the first ``width`` bytes each sorted string shares with the one before it."""
    common = np.full(len(words[0]), width, dtype=np.int64)
    for k in range(len(words) - 1, -1, -1):
        apart = np.flatnonzero(words[k][1:] != words[k][:-1]) + 1
        x = words[k][apart] ^ words[k][apart - 1]
        byte = np.full(len(apart), 7, dtype=np.int64)
        for b in range(6, -1, -1):
            byte[x >= np.uint64(1 << (56 - 8 * b))] = b
        common[apart] = 8 * k + byte
    common[:1] = 0
    return common


def _sorted_bucket(width: int):
    """(b, spans) of what the suffixes of a bucket say goes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in by_part(batches):
            if part < 0:
                yield pa.RecordBatch.from_arrays([table["b"].combine_chunks(), table["spans"].combine_chunks()], names=["b", "spans"])
                continue
            blocks = [unpacked_pieces(x) for x in table["pieces"].to_pylist()]
            group = np.repeat(table["b"].to_numpy(), [len(f[0]) for f, _ in blocks])
            raw = b"".join(text for _, text in blocks)
            ids, row, start, size, anchor = (np.concatenate([f[k] for f, _ in blocks]).astype(np.int64) for k in range(len(FIELDS)))
            piece, low, high = lost_suffixes(raw, ids, size, anchor, width)
            out = list(by_group(group[piece], row[piece], start[piece] + low, start[piece] + high))
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], type=pa.int32()), pa.array([m for _, m in out], type=pa.binary())], names=["b", "spans"])

    return of


def lost_suffixes(raw: bytes, ids: np.ndarray, size: np.ndarray, anchor: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pieces of a bucket, one after the other in ``raw``: (piece, first byte, byte after the last) of what goes."""
    n = len(ids)
    at = np.cumsum(size) - size
    first: dict[bytes, int] = {}
    like = np.array([first.setdefault(raw[x : x + y], k) for k, (x, y) in enumerate(zip(at.tolist(), size.tolist(), strict=True))], dtype=np.int64)
    owner = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(owner, like, ids)
    # A piece that a smaller document holds goes as a whole.
    gone = np.flatnonzero(ids > owner[like])
    # Different pieces of one anchor may share suffixes.
    heads = np.flatnonzero(like == np.arange(n))
    _, which, times = np.unique(anchor[heads], return_inverse=True, return_counts=True)
    heads = heads[times[which] > 1]
    if not len(heads):
        return gone, np.zeros(len(gone), dtype=np.int64), size[gone]
    text = np.frombuffer(b"".join(raw[x : x + y] for x, y in zip(at[heads].tolist(), size[heads].tolist(), strict=True)) + bytes(width + 48), dtype=np.uint8)
    begin, count = np.cumsum(size[heads]) - size[heads], size[heads] - width + 1
    piece = np.repeat(np.arange(len(heads)), count)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    rank = prefix_ranks(text, begin[piece] + offset, width)
    held = owner[heads][piece]
    least = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, rank, held)
    lost = np.flatnonzero(held > least[rank])
    # Runs of suffixes that go, of each head, for every one of its owner's pieces.
    new = np.concatenate([[True], (np.diff(piece[lost]) != 0) | (np.diff(offset[lost]) > 1)]) if len(lost) else np.zeros(0, dtype=bool)
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(lost)) - 1 if len(a) else a
    of, low, high = heads[piece[lost[a]]], offset[lost[a]], offset[lost[z]] + width
    mine = np.flatnonzero(ids == owner[like])
    mine = mine[np.argsort(like[mine], kind="stable")]
    x, y = np.searchsorted(like[mine], of, side="left"), np.searchsorted(like[mine], of, side="right")
    run = np.repeat(np.arange(len(of)), y - x)
    copy = mine[np.arange(len(run)) - np.repeat(np.cumsum(y - x) - (y - x), y - x) + x[run]] if len(run) else mine[:0]
    return np.concatenate([gone, copy]), np.concatenate([np.zeros(len(gone), dtype=np.int64), low[run]]), np.concatenate([size[gone], high[run]])


class Bytes:
    """A text's units are its bytes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        self.first = bounds


def _kept(data: np.ndarray, units: Bytes, k: int, keep: np.ndarray | None) -> bytes:
    text = data[units.first[k] : units.first[k + 1]]
    return (text if keep is None else text[keep]).tobytes()


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, parts: int | None = None, hot: int = HOT) -> DataFrame:
    """Id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of each row.

    ``parts`` is the number of buckets, by default one for PART_BYTES of text and 64 at least; an anchor in more than
    ``hot`` groups is hot.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    store = Store(texts)
    parts = parts or power_of_two(64, store.bytes // PART_BYTES)
    asked = power_of_two(256, 2 * store.bytes // (width - GRAM) // PART_ANCHORS)
    stretched = repeated_stretches(store, _digests(width), ["id"])
    answers = answered(store.with_sent(stretched, _asked(width, asked), QUESTION), hot)
    both = stretched.unionByName(answers, allowMissingColumns=True)
    pieces = store.with_sent(both, _pieces(width, asked, parts), "part int, b int, pieces binary, spans binary")
    removed = written(pieces.repartition("part").sortWithinPartitions("part").mapInArrow(_sorted_bucket(width), "b int, spans binary"))
    out = cut_texts(texts, store, removed.unionByName(stretched, allowMissingColumns=True), Bytes, _kept)
    out = written(out.select(F.col("id").alias(id_col), F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256"))
    discard(stretched, answers, removed)
    store.drop()
    return out
