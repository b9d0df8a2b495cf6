"""Texts in chunks of bounded size, and values looked up for a chunk's distinct keys.

A chunk is some neighbouring rows of a partition. What a corpus-wide count needs from it, and what it needs back, is one
entry for each of its distinct keys: a key that every document holds moves once for each chunk, so no key is hot, and
texts don't move at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import squeezed, unsqueezed, whole
from .hashing import WORD, Words, lowered

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows) of the chunks of a partition, in its order; the numbers differ between partitions."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        begin = 0
        for k, n in enumerate(sizes.tolist()):
            if size and size + n > most:
                yield number, pa.Table.from_batches([*held, batch.slice(begin, k - begin)])
                number, held, size, begin = number + 1, [], 0, k
            size += n
        if begin < len(sizes):
            held.append(batch.slice(begin))
    if held:
        yield number, pa.Table.from_batches(held)


def blob(values: np.ndarray, kind: type) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def numbers(values: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes each as the largest needs, byte plane by byte plane, compressed."""
    wide = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(values) or int(values.max()) <= np.iinfo(t).max)
    planes = np.ascontiguousarray(values.astype(wide).view(np.uint8).reshape(len(values), -1).T)
    return np.dtype(wide).itemsize.to_bytes(1, "little") + squeezed(planes.tobytes())


def numbers_of(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueezed(data[1:]), dtype=np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{data[0]}").ravel().astype(np.int64)


def cut(lengths: np.ndarray) -> np.ndarray:
    """Bounds of neighbouring runs of these lengths."""
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each run; empty ones have 0."""
    out = np.zeros(len(bounds) - 1, dtype=values.dtype)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values, bounds[some])
    return out


def interned(texts: pa.ChunkedArray, lower: bool, inside: np.ndarray = WORD) -> tuple[Words, np.ndarray, pa.Array]:
    """Where the words of all texts are, a code for each and the distinct words by code; a word's bytes are those marked in ``inside``."""
    column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    data, bounds = whole(column)
    data = lowered(data) if lower else data
    words = Words(data, bounds, inside)
    offsets = cut(words.end - words.start).astype(np.int32)
    array = pa.Array.from_buffers(pa.binary(), len(words.start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside[data]])]).dictionary_encode()
    return words, array.indices.to_numpy(), array.dictionary.cast(pa.string())


def looked_up(chunks: DataFrame, values: DataFrame, work: Callable[[dict, pa.Table], pa.Table], schema: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """``work(chunk's row, values)`` for every chunk: the values of its ``keys`` in the keys' order.

    ``values`` has one row for each ``key``; where there is none, ``defaults``, which may read ``key``, else null.
    """
    names = [c for c in values.columns if c != "key"]
    asked = chunks.select("chunk", F.posexplode("keys").alias("code", "key"))
    answers = asked.join(values, "key", "left")
    answers = answers.select("chunk", "code", *(F.coalesce(c, (defaults or {})[c]).alias(c) if c in (defaults or {}) else c for c in names))

    def both(rows: pa.Table, found: pa.Table) -> pa.Table:
        found = found.take(pa.array(np.argsort(found["code"].to_numpy(), kind="stable")))
        return pa.concat_tables([work(row, found) for row in rows.to_pylist()])

    mine = chunks.drop("keys").withColumnRenamed("chunk", "_chunk")
    return mine.groupBy("_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(both, schema)
