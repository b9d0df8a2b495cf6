"""Texts kept in groups of bounded size: what the substring operators pass over several times.

The texts are shuffled once, by a hash of the id, into a bucketed table. Every later pass reads a group of them next to
what other groups sent to it, and only that moves: Spark joins a bucketed table without moving it. So marks are exact and
go to the group that asked for them, and no filter has to fit into memory.

A row's place in its group is its number by id and text, so it is the same in every pass, whatever order rows arrive in.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_folder, written
from .hashing import runs

#: Bytes of text in a bucket, and groups in one. A group is at hand as a whole.
BUCKET_BYTES, GROUPS_EACH = 16 << 20, 4
#: Spark's limit.
MOST_BUCKETS = 100_000


class Store:
    """A bucketed table of (b, id, text): ``b`` is the group. Rows without id are left out."""

    def __init__(self, texts: DataFrame) -> None:
        spark = texts.sparkSession
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
        # Not below the session's own count, else Spark would deal both sides of a join anew; a small table needs fewer.
        buckets = min(MOST_BUCKETS, max(size // BUCKET_BYTES + 1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (128 << 10) + 1)))
        self.bytes, self.groups = size, max(buckets * GROUPS_EACH, size // (BUCKET_BYTES // GROUPS_EACH))
        rows = texts.where(F.col("id").isNotNull()).select(self.group_of(F.col("id")).alias("b"), "id", F.coalesce("text", F.lit("")).alias("text"))
        self.name, path = f"echotrace_{uuid.uuid4().hex}", shared_folder(spark)
        rows.repartition(buckets, "b").write.bucketBy(buckets, "b").option("path", path).option("compression", "zstd").saveAsTable(self.name)
        self.rows = spark.read.table(self.name)
        self.rows.written_to = path

    def group_of(self, ident: Column) -> Column:
        return F.pmod(F.xxhash64(ident), F.lit(self.groups)).cast("int")

    def each(self, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        """``work`` on every group."""
        return self.rows.groupBy("b").applyInArrow(work, schema)

    def with_sent(self, sent: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """``work`` on every group and what was sent to it; ``sent`` has a column ``b``."""
        return self.rows.groupBy("b").cogroup(sent.groupBy("b")).applyInArrow(work, schema)

    def drop(self) -> None:
        self.rows.sparkSession.sql(f"DROP TABLE {self.name}")
        discard(self.rows)


def in_order(texts: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Ids and texts of a group, by id, equal ids by text."""
    ids = texts["id"].to_numpy()
    column = texts["text"].combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=pa.string())
    order = np.argsort(ids, kind="stable")
    if (np.diff(ids[order]) == 0).any():
        raw = column.to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda k: (ids[k], raw[k])))
    return ids[order], column.take(pa.array(order))


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their bounds."""
    for _, _, data, bounds in runs(column, most=1 << 62):
        return data, bounds
    return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)


def spans_of(sent: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the spans that were sent, sorted by row: three int32 arrays a message, or a row for each span."""
    blocks = [np.frombuffer(x, dtype=np.int32).reshape(3, -1) for x in sent["spans"].to_pylist() if x]
    if "row" in sent.column_names:
        alone = sent.filter(sent["row"].is_valid())
        blocks.append(np.stack([alone[c].to_numpy() for c in ("row", "start", "end")]))
    row, start, end = np.concatenate(blocks, axis=1) if blocks else np.zeros((3, 0), dtype=np.int32)
    order = np.argsort(row, kind="stable")
    return row[order], start[order].astype(np.int64), end[order].astype(np.int64)


def packed_spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    return np.stack([row, start, end]).astype(np.int32).tobytes()


def by_group(groups: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(group, its spans as a message)."""
    order = np.argsort(groups, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(groups[order]) != 0, [True]])) if len(order) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        k = order[a:b]
        yield int(groups[k[0]]), packed_spans(row[k], start[k], end[k])


def covered(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in any of the ranges low <= place < high."""
    ok = low < high
    change = np.bincount(low[ok], minlength=n + 1) - np.bincount(high[ok], minlength=n + 1)
    return np.cumsum(change)[:n] > 0


def part_of(values: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges of the 64-bit values each one lies in."""
    return ((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def dealt(values: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, which of the values lie in it) for each part that has any."""
    part = part_of(values, parts)
    order = np.argsort(part, kind="stable")
    held, first = np.unique(part[order], return_index=True)
    for k, own in zip(held.tolist(), np.split(order, first[1:]), strict=False):
        yield k, own


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of one part after the other, of a partition sorted by its first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = batch.column(0).to_numpy()
        begin = 0
        for cut in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]:
            if held and held[0].column(0)[0].as_py() != part[begin]:
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                held = []
            if cut > begin:
                held.append(batch.slice(begin, cut - begin))
            begin = cut
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)


def squeezed(data: bytes) -> bytes:
    """Compressed, with its length before it."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def power_of_two(least: int, wanted: int) -> int:
    while least < wanted:
        least *= 2
    return least


#: Columns of what ``digests`` of ``repeated_stretches`` gives: digest, id, place (row, and group above bit 32), span (start, and end above bit 32).
STRETCH = "k1 bigint, k2 bigint, id bigint, place bigint, span bigint"


def repeated_stretches(store: Store, digests: Callable[[pa.Table], pa.Table], order: list[str]) -> DataFrame:
    """(b, row, start, end) of stretches that occur earlier: with less in the ``order`` of id or of id and start."""
    rows = written(store.each(digests, STRETCH).withColumn("start", F.expr("cast(span & 4294967295 as int)")))
    at = F.struct(*order)
    owners = rows.groupBy("k1", "k2").agg(F.min(at).alias("owner"), F.max(at).alias("_last")).where(F.col("owner") < F.col("_last")).drop("_last")
    later = rows.join(owners, ["k1", "k2"]).where(at > F.col("owner"))
    out = written(later.select(F.shiftright("place", 32).cast("int").alias("b"), F.expr("cast(place & 4294967295 as int)").alias("row"), "start", F.shiftright("span", 32).cast("int").alias("end")))
    discard(rows)
    return out


def single_spans(sent: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans among what was sent that are rows of their own: row, start, end, sorted by row."""
    rows = sent.filter(sent["row"].is_valid())
    row, start, end = (rows[c].to_numpy().astype(np.int64) for c in ("row", "start", "end"))
    order = np.argsort(row, kind="stable")
    return row[order], start[order], end[order]


#: A group asks by (part, group, its distinct anchors' lower 48 bits, which of them it holds twice).
QUESTION = "part int, b int, anchors binary, shared binary"
#: Anchors for each of the parts that they are dealt into.
PART_ANCHORS = 1 << 23


def _ranges(values: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, first value, value after the last) of sorted 56-bit values; there are 256 parts or more, so a part tells the upper 8 bits."""
    cuts = np.searchsorted(values, np.arange(parts + 1, dtype=np.uint64) << np.uint64(56 - parts.bit_length() + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, int(cuts[k]), int(cuts[k + 1])


def question(b: int, values: np.ndarray, shared: np.ndarray, parts: int) -> pa.Table:
    """What a group asks about its distinct anchors."""
    low = values.view(np.uint8).reshape(-1, 8)[:, :6]
    out = [(k, low[x:y].tobytes(), np.packbits(shared[x:y]).tobytes()) for k, x, y in _ranges(values, parts)]
    part, *blocks = (pa.array([x[k] for x in out], type=t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary())))
    return pa.table([part, pa.array([b] * len(out), type=pa.int32()), *blocks], names=["part", "b", "anchors", "shared"])


def _answers(hot_groups: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in by_part(batches):
            blocks = table["anchors"].to_pylist()
            sizes = np.array([len(x) // 6 for x in blocks])
            value = np.zeros((int(sizes.sum()), 8), dtype=np.uint8)
            value[:, :6] = np.frombuffer(b"".join(blocks), dtype=np.uint8).reshape(-1, 6)
            value = value.view(np.uint64).ravel()
            inside = np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n) for x, n in zip(table["shared"].to_pylist(), sizes.tolist(), strict=True)]).astype(bool)
            order = np.argsort(value, kind="stable")
            head = np.flatnonzero(np.concatenate([[True], np.diff(value[order]) != 0]))
            groups = np.diff(np.append(head, len(order)))
            again = (groups > 1) | np.logical_or.reduceat(inside[order], head)
            repeated, hot = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
            repeated[order], hot[order] = np.repeat(again, groups), np.repeat(groups > hot_groups, groups)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            bits = [np.packbits(np.stack([repeated[x:y], hot[x:y]]), axis=1).tobytes() if repeated[x:y].any() else None for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([table["b"].combine_chunks(), pa.array([part] * len(bits), type=pa.int32()), pa.array(bits, type=pa.binary())], names=["b", "part", "bits"])

    return of


def answered(questions: DataFrame, hot_groups: int) -> DataFrame:
    """(b, part, bits): for each anchor a bit if it occurs again, and one if more than ``hot_groups`` groups hold it."""
    rows = questions.repartition("part").sortWithinPartitions("part").mapInArrow(_answers(hot_groups), "b int, part int, bits binary")
    return written(rows.where(F.col("bits").isNotNull()))


def answer(sent: pa.Table, values: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of a group's distinct anchors occur again, and which are hot."""
    known, hot = np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=bool)
    rows = sent.filter(sent["bits"].is_valid())
    bits = dict(zip(rows["part"].to_pylist(), rows["bits"].to_pylist(), strict=True))
    for k, x, y in _ranges(values, parts):
        if k in bits:
            known[x:y], hot[x:y] = np.unpackbits(np.frombuffer(bits[k], dtype=np.uint8).reshape(2, -1), axis=1, count=y - x).astype(bool)
    return known, hot


RESULT = "id bigint, n_units bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _result(ids: pa.Array, column: pa.Array, units: Callable, kept: Callable, lost_of: Callable[[int, int], np.ndarray | None]) -> pa.RecordBatch:
    """A row for each text; ``lost_of(k, n)`` tells which of its n units go, None if none does."""
    counts, gone, spans, shas = [], [], [], []
    for i, j, data, bounds in runs(column):
        at = units(data, bounds)
        for k in range(j - i):
            n = int(at.first[k + 1] - at.first[k])
            lost = lost_of(i + k, n)
            counts.append(n)
            gone.append(0 if lost is None else int(lost.sum()))
            spans.append(0 if lost is None else int((np.diff(lost.astype(np.int8), prepend=0) == 1).sum()))
            shas.append(hashlib.sha256(kept(data, at, k, None if lost is None else ~lost)).hexdigest())
    numbers = (pa.array(x, type=pa.int64()) for x in (counts, gone, spans))
    return pa.RecordBatch.from_arrays([ids, *numbers, pa.array(shas, type=pa.string())], names=["id", "n_units", "n_removed", "n_spans", "kept_sha256"])


def cut_texts(texts: DataFrame, store: Store, removed: DataFrame, units: Callable, kept: Callable) -> DataFrame:
    """``id``, ``n_units``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of each text.

    ``removed`` has (b, spans), messages of row, first unit and unit after the last of what goes; it may have such spans as rows too. ``units(data, bounds)``
    tells by its ``first`` where each text's units begin, ``kept(data, units, k, keep)`` the bytes that remain of text k.
    """

    def cut(rows: pa.Table, sent: pa.Table) -> pa.Table:
        ids, column = in_order(rows)
        row, start, end = spans_of(sent)
        first = np.searchsorted(row, np.arange(len(ids) + 1))

        def lost_of(k: int, n: int) -> np.ndarray | None:
            a, b = first[k], first[k + 1]
            return covered(start[a:b], np.minimum(end[a:b], n), n) if a < b else None

        return pa.Table.from_batches([_result(pa.array(ids), column, units, kept, lost_of)])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _result(batch.column(0), batch.column(1), units, kept, lambda k, n: None)

    return store.with_sent(removed, cut, RESULT).unionByName(texts.where(F.col("id").isNull()).mapInArrow(untouched, RESULT))
