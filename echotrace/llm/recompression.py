"""Removal of word sequences that occur earlier, by recompression.

Each round names the runs of equal symbols, then pairs: a bit of each symbol's name puts it left or right, and a left
symbol followed by a right one becomes a pair. A name is a hash of what it stands for, so all tasks give equal
substrings equal interior symbols without exchanging names.

High symbols stand for long stretches of words. Spark gathers them, each verified by a digest of the words that it stands
for and of the 19 after it, and a stretch that occurs earlier goes as a whole. Then Spark gathers the low symbols of what
is left and answers every group of texts which of its symbols occur again. Each symbol knows the words that its parsing
depends on; one that occurs once rules out every window that holds all of these. Windows that are left are gathered by a
digest of their words, and of equal ones all but the earliest are removed. A window without any interior symbol is never
ruled out, so nothing is missed.

What decides is a cryptographic digest (BLAKE2b, 128 bits) of the words themselves, of a stretch's or of a window's. Two
different ones among n are taken for equal with a chance of n * n / 2 ** 129, whatever the words look like: below 1e-13 for
the 3e12 windows of 100 TB. Names are 64-bit hashes, whose collisions cost time alone.

Nulls: a null text has no words; a null id is set apart and takes no part in the comparison. Rows with equal ids count
as one document: an equal window at an equal start is not earlier. Texts of fewer words than a window lose nothing; a very
long one makes its group larger, which needs some hundred bytes of memory for each of its bytes. An empty table gives an empty
result. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .groups import PART_ANCHORS, QUESTION, Store, answer, answered, by_group, by_part, covered, cut_texts, dealt, in_order, power_of_two, question, repeated_stretches, single_spans, squeezed, unsqueezed
from .hashing import Words, mixed, runs

#: Rounds after which symbols are low (their parse fits a window) and high (some hundred words).
WINDOW, ROUNDS, HIGH_ROUNDS = 20, 3, 16
#: Bytes of text for each of the parts that windows are dealt into.
PART_BYTES = 4 << 20


class Symbols:
    """Symbols of a run of texts: name, text, how many words each stands for, and the words [low, high) that the parse depends on."""

    def __init__(self, names: np.ndarray, text: np.ndarray) -> None:
        n = len(names)
        self.name, self.text = names, text
        self.low, self.high = np.arange(n), np.arange(1, n + 1)
        self.size = np.ones(n, dtype=np.int64)

    def _with_neighbours(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each symbol depends on together with its left or right neighbour, where asked for. At a text's end
        the neighbour is missing, which a window inside another text couldn't know: it counts as one word beyond."""
        n = len(self.name)
        same = self.text[1:] == self.text[:-1]
        low, high = self.low.copy(), self.high.copy()
        before, after = self.low - 1, self.high + 1
        before[1:] = np.where(same, self.low[:-1], before[1:])
        after[:-1] = np.where(same, self.high[1:], after[:-1])
        return np.where(left, np.minimum(low, before), low) if n else low, np.where(right, np.maximum(high, after), high) if n else high

    def round(self, salt: int) -> None:
        if not len(self.name):
            return
        # Runs: a symbol's run is known once both neighbours are seen.
        every = np.ones(len(self.name), dtype=bool)
        low, high = self._with_neighbours(every, every)
        same = (self.name[1:] == self.name[:-1]) & (self.text[1:] == self.text[:-1])
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        tail = np.append(head[1:], len(self.name)) - 1
        length = (tail - head + 1).astype(np.uint64)
        self.name = np.where(length > 1, mixed(self.name[head] + mixed(length + np.uint64(salt))), self.name[head])
        self.text, self.low, self.high = self.text[head], low[head], high[tail]
        self.size = np.add.reduceat(self.size, head)
        # Pairs: a left symbol asks who follows, a right one who goes before.
        right = (mixed(self.name + np.uint64(salt)) & np.uint64(1)).astype(bool)
        low, high = self._with_neighbours(right, ~right)
        first = np.zeros(len(self.name), dtype=bool)
        first[:-1] = ~right[:-1] & right[1:] & (self.text[1:] == self.text[:-1])
        second = np.concatenate([[False], first[:-1]])
        # A pair depends on its two symbols alone.
        at = np.flatnonzero(first)
        name = self.name.copy()
        name[at] = mixed(self.name[at] * np.uint64(3) + mixed(self.name[at + 1]) + np.uint64(salt))
        low[at], high[at] = self.low[at], self.high[at + 1]
        self.size[at] += self.size[at + 1]
        stay = ~second
        self.size = self.size[stay]
        self.name, self.text, self.low, self.high = name[stay], self.text[stay], low[stay], high[stay]


def symbols(words: Words, hashes: np.ndarray, rounds: int) -> Symbols:
    out = Symbols(hashes, np.repeat(np.arange(len(words.first) - 1), np.diff(words.first)))
    for k in range(rounds):
        out.round(2 * k + 1)
    return out


def _digests(window: int, rounds: int):
    """A row for each high symbol: a digest of its words and of those after it that its windows reach."""

    def of(rows: pa.Table) -> pa.Table:
        ids, column = in_order(rows)
        b = rows["b"][0].as_py()
        digests: list[bytes] = []
        ident, place, span = [], [], []
        for i, _, data, bounds in runs(column):
            words = Words(data, bounds)
            s = symbols(words, words.hashes(), rounds)
            start = np.cumsum(s.size) - s.size
            end = np.minimum(start + s.size + window - 1, words.first[s.text + 1]) if len(start) else start
            ok = end - start >= window
            start, end, text = start[ok], end[ok], s.text[ok]
            raw = words.spaced()
            at, to = words.place(start), words.place(end) - 1
            digests += [hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(at.tolist(), to.tolist(), strict=True)]
            ident.append(ids[i:][text])
            place.append((i + text) | (b << 32))
            span.append((start - words.first[text]) | ((end - words.first[text]) << 32))
        keys = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        columns = [keys[:, 0], keys[:, 1], *(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (ident, place, span))]
        return pa.table([pa.array(np.ascontiguousarray(x), type=pa.int64()) for x in columns], names=["k1", "k2", "id", "place", "span"])

    return of


class Low:
    """The low symbols of a group that lie in a window which no stretch resolves."""

    def __init__(self, rows: pa.Table, sent: pa.Table, window: int, rounds: int) -> None:
        self.ids, self.column = in_order(rows)
        row, start, end = single_spans(sent)
        #: Of each run: first row, words, how many, which windows may go, symbols' low and high.
        self.runs: list[tuple] = []
        names = []
        for i, j, data, bounds in runs(self.column):
            words = Words(data, bounds)
            hashes = words.hashes()
            n = len(hashes)
            text = np.repeat(np.arange(j - i), np.diff(words.first))
            a, b = np.searchsorted(row, [i, j])
            at = words.first[row[a:b] - i]
            left = ~covered(at + start[a:b], at + end[a:b] - window + 1, n) & (np.arange(n) + window <= words.first[1:][text]) if n else np.zeros(0, dtype=bool)
            s = symbols(words, hashes, rounds)
            before = np.concatenate([[0], np.cumsum(left)])
            x, y = np.maximum(0, s.high - window), np.minimum(n, s.low + 1)
            useful = (s.high - s.low <= window) & (before[np.maximum(x, y)] > before[x])
            names.append(s.name[useful] >> np.uint64(8))
            self.runs.append((i, words, n, text, left, x[useful], y[useful]))
        every = np.concatenate(names) if names else np.zeros(0, dtype=np.uint64)
        self.values, which, times = np.unique(every, return_inverse=True, return_counts=True)
        self.which = np.split(which, np.cumsum([len(x) for x in names])[:-1]) if names else []
        self.shared = times > 1


def _asked(window: int, rounds: int, parts: int):
    def of(rows: pa.Table, sent: pa.Table) -> pa.Table:
        found = Low(rows, sent, window, rounds)
        return question(rows["b"][0].as_py(), found.values, found.shared, parts)

    return of


#: A window's digest in two parts, id, row and start.
FIELDS = (np.uint64, np.uint64, np.int64, np.int32, np.int32)


def _packed(fields: list[np.ndarray]) -> bytes:
    return squeezed(b"".join(x.astype(t).tobytes() for x, t in zip(fields, FIELDS, strict=True)))


def _unpacked(block: bytes) -> list[np.ndarray]:
    data, out, at = unsqueezed(block), [], 0
    n = len(data) // sum(np.dtype(t).itemsize for t in FIELDS)
    for t in FIELDS:
        out.append(np.frombuffer(data, dtype=t, count=n, offset=at))
        at += n * np.dtype(t).itemsize
    return out


def later_windows(k1: np.ndarray, k2: np.ndarray, ident: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by value, id and start, and which windows in it are not the earliest of their value (nor at its place)."""
    order = np.lexsort((start, ident, k2, k1))
    k1, k2, ident, start = k1[order], k2[order], ident[order], start[order]
    new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]) if len(k1) else np.zeros(0, dtype=bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, dtype=np.int64)
    return order, ~((ident == ident[head]) & (start == start[head]))


def joined_windows(group: np.ndarray, row: np.ndarray, start: np.ndarray, window: int) -> Iterator[tuple[int, bytes]]:
    """(group, message of the spans that its windows cover)."""
    order = np.lexsort((start, row, group))
    group, row, start = group[order], row[order], start[order]
    new = np.concatenate([[True], (np.diff(group) != 0) | (np.diff(row) != 0) | (np.diff(start) > 1)]) if len(row) else np.zeros(0, dtype=bool)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(row)) - 1 if len(head) else head
    return by_group(group[head], row[head], start[head], start[tail] + window)


def _open(window: int, rounds: int, asked: int, parts: int):
    """Windows that no symbol rules out: of equal ones the group's earliest (``part`` >= 0), the others as removed (``part`` < 0)."""

    def of(rows: pa.Table, sent: pa.Table) -> pa.Table:
        found = Low(rows, sent, window, rounds)
        b = rows["b"][0].as_py()
        known, _ = answer(sent, found.values, asked)
        held: list[tuple] = []
        for (i, words, n, text, left, low, high), which in zip(found.runs, found.which, strict=True):
            once = ~known[which]
            at = np.flatnonzero(left & ~covered(low[once], high[once], n))
            if len(at):
                raw, place = words.spaced(), words.place(np.arange(n + 1))
                digests = b"".join(hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(place[at].tolist(), (place[at + window] - 1).tolist(), strict=True))
                keys = np.frombuffer(digests, dtype=np.uint64).reshape(-1, 2)
                held.append((keys[:, 0], keys[:, 1], found.ids[i:][text[at]], i + text[at], at - words.first[text[at]]))
        k1, k2, ident, row, start = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, dtype=t) for k, t in enumerate(FIELDS))
        order, later = later_windows(k1, k2, ident, start)
        gone, go = order[later], order[~later]
        out = [(-1 - b % parts, b"", message) for _, message in joined_windows(np.full(len(gone), b), row[gone], start[gone], window)]
        out += [(part, _packed([x[go[k]] for x in (k1, k2, ident, row, start)]), b"") for part, k in dealt(k1[go], parts)]
        part, *blocks = (pa.array([x[k] for x in out], type=t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary())))
        return pa.table([part, pa.array([b] * len(out), type=pa.int32()), *blocks], names=["part", "b", "windows", "spans"])

    return of


def _earliest(window: int):
    """(b, spans) of all windows of a part but the earliest of each value."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in by_part(batches):
            if part < 0:
                yield pa.RecordBatch.from_arrays([table["b"].combine_chunks(), table["spans"].combine_chunks()], names=["b", "spans"])
                continue
            blocks = [_unpacked(x) for x in table["windows"].to_pylist()]
            group = np.repeat(table["b"].to_numpy(), [len(f[0]) for f in blocks])
            k1, k2, ident, row, start = (np.concatenate([f[k] for f in blocks]) for k in range(len(FIELDS)))
            order, later = later_windows(k1, k2, ident, start)
            gone = order[later]
            out = list(joined_windows(group[gone], row[gone], start[gone], window))
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], type=pa.int32()), pa.array([m for _, m in out], type=pa.binary())], names=["b", "spans"])

    return of


def _kept(data: np.ndarray, words: Words, k: int, keep: np.ndarray | None) -> bytes:
    at = np.arange(words.first[k], words.first[k + 1])
    if keep is not None:
        at = at[keep]
    raw = data.tobytes() if keep is not None else data[words.bounds[k] : words.bounds[k + 1]].tobytes()
    if keep is None:
        # All words: what stands between them is as good as one space each.
        return b" ".join(raw.translate(_SPACES).split())
    return b" ".join(raw[a:b] for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True))


_SPACES = bytes(0x20 if b in (0x20, *range(0x09, 0x0E)) else b for b in range(256))


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, rounds: int = ROUNDS, high_rounds: int = HIGH_ROUNDS, parts: int | None = None) -> DataFrame:
    """Id, ``n_words``, ``n_removed`` and ``kept_sha256`` of each row.

    ``parts`` is how many ranges the windows are dealt into, by default one for PART_BYTES of text and 64 at least.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    store = Store(texts)
    parts = parts or power_of_two(64, store.bytes // PART_BYTES)
    asked = power_of_two(256, store.bytes // 8 // PART_ANCHORS)
    stretched = repeated_stretches(store, _digests(window, high_rounds), ["id", "start"])
    answers = answered(store.with_sent(stretched, _asked(window, rounds, asked), QUESTION), store.groups)
    both = stretched.unionByName(answers, allowMissingColumns=True)
    left = store.with_sent(both, _open(window, rounds, asked, parts), "part int, b int, windows binary, spans binary")
    removed = written(left.repartition("part").sortWithinPartitions("part").mapInArrow(_earliest(window), "b int, spans binary"))
    out = cut_texts(texts, store, removed.unionByName(stretched, allowMissingColumns=True), Words, _kept)
    out = written(out.select(F.col("id").alias(id_col), F.col("n_units").alias("n_words"), "n_removed", "kept_sha256"))
    discard(stretched, answers, removed)
    store.drop()
    return out
