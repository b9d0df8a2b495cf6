"""Words and their hashes over runs of texts, as arrays; what the free-style operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: An odd multiplier and its inverse modulo 2 ** 64, for sums of bytes times powers.
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
BYTES = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2 ** 64; a worker keeps those it has worked out."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(max(1 << 16, n), base, dtype=np.uint64)
        out[0] = 1
        _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[base][:n]


def runs(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``most`` bytes of text: first row, row after the last, bytes, bounds of the texts."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


#: The bytes of words: all but space and tab to carriage return.
WORD = np.ones(256, dtype=bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False


class Words:
    """Where the words of a run of texts start and end, and the first word of each text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, inside: np.ndarray = WORD) -> None:
        word = inside[data]
        n = len(data)
        joined = np.zeros(n + 1, dtype=bool)
        joined[1:n] = word[1:] & word[:-1]
        joined[bounds] = False  # words don't cross from one text into the next
        self.data, self.bounds = data, bounds
        self.start = np.flatnonzero(word & ~joined[:n])
        self.end = np.flatnonzero(word & ~joined[1:]) + 1
        #: Words of text k are first[k] to first[k + 1].
        self.first = np.searchsorted(self.start, bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: eight at a time, each mixed with its place before they are added.

        A sum of bytes times powers would be linear, and words of some regular orders of two letters would be equal.
        """
        size = self.end - self.start
        lanes = (size + 7) // 8
        first = np.concatenate([[0], np.cumsum(lanes)])
        if not first[-1]:
            return np.zeros(0, dtype=np.uint64)
        each = np.arange(first[-1]) - np.repeat(first[:-1], lanes)
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        value = eight[np.repeat(self.start, lanes) + 8 * each]
        # Of the last eight only the word's own bytes.
        missing = 8 * np.maximum(0, 8 * (each + 1) - np.repeat(size, lanes)).astype(np.uint64)
        value = value << missing
        return mixed(np.add.reduceat(mixed(value + mixed(each.astype(np.uint64) + np.uint64(MULTIPLIER))), first[:-1]) + size.astype(np.uint64))

    def spaced(self) -> bytes:
        """All words, a space after each."""
        size = self.end - self.start
        at = self.place(np.arange(len(size) + 1))
        out = np.full(int(at[-1]), 0x20, dtype=np.uint8)
        inside = np.ones(len(out), dtype=bool)
        inside[at[1:] - 1] = False
        word = np.zeros(len(self.data) + 1, dtype=np.int8)
        word[self.start] += 1
        np.add.at(word, self.end, -1)
        out[inside] = self.data[np.cumsum(word)[:-1] > 0]
        return out.tobytes()

    def place(self, k: np.ndarray) -> np.ndarray:
        """Where words numbered ``k`` begin in ``spaced``."""
        return np.concatenate([[0], np.cumsum(self.end - self.start + 1)])[k]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)


def sequences(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` hashes that begins at a position, from hashes of its halves; for what has to tell runs apart."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.uint64)
    out, done, power, reach = None, 0, hashes, 1
    while True:
        if width & reach:
            # ``out`` stands for the first ``done`` values, ``power`` for each ``reach`` of them.
            out = power if out is None else mixed(mixed(out[: len(power) - done]) * np.uint64(3) + power[done:] + np.uint64(done))
            done += reach
        if done == width:
            return out
        power, reach = mixed(mixed(power[:-reach]) * np.uint64(3) + power[reach:] + np.uint64(reach)), reach * 2


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` values that begins at a position; those across the end are left out.

    It is linear in the values, so it serves to choose places; ``sequences`` is for telling runs apart.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(MULTIPLIER, len(hashes)), out=sums[1:])
    return mixed((sums[width:] - sums[:n]) * powers(INVERSE, n))
