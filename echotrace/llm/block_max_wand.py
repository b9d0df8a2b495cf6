"""Ranked lexical search over an inverted index whose blocks say how much they can give at most (Block-Max WAND).

The index is cut by documents: a segment holds the postings of some neighbouring documents, sorted by term, so it is
written where texts are read and no term's list is in one place. A term's row in a segment has blocks of BLOCK postings:
gaps and frequencies in as few bytes each as the block's largest needs, and outside of them each block's last document and
largest impact. An impact is the part of a score that the document decides, an integer, so bounds are exact.

A search reads the rows of its terms only and goes through segments one by one. For a query the lists' block ends cut a
segment into windows; moving the lists' pointers over the block ends alone (shallow moves) gives each window the sum of its
blocks' largest products. Windows below the score that is needed are skipped with their blocks unread. In the others,
lists are taken by falling bound: once what is left can't lift a document over the score that is needed, only documents
met so far are looked up further (the pivot), and blocks without any of them stay compressed. Windows with the largest bounds
come first, so that the score that is needed rises early; a task keeps it from segment to segment, and a first round over
few segments gives it to all tasks of the second.

Null texts have no terms. Rows are documents of their own: repeated rows are ranked each by itself, and a null id comes
after all others of equal score. Queries are distinct pairs of item and text; one without known terms gives no row. Empty
tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import CHUNK_BYTES, blob, cut, gathered, interned
from .common import discard, small_batches, written
from .groups import by_part, whole
from .hashing import Words

#: Bytes of terms: letters, digits and all beyond ASCII.
TERM = np.zeros(256, dtype=bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Postings in a block; results for a query; bytes of a batch of queries' terms at the driver.
BLOCK, BEST, QUERY_BYTES = 128, 20, 8 << 20
#: Length normalisation in hundredths, saturation in hundredths (1.2), and the largest impact's scale.
SLOPE, SATURATION, SCALE = 25, 12, 1_000_000_000

_SEGMENT = "segment bigint, term string, df int, lasts binary, impacts binary, starts binary, data binary, ids array<bigint>, norms binary"
_FOUND = "query int, doc_id bigint, score bigint"


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a document's length adds to its terms' denominator."""
    return 100 - SLOPE + SLOPE * lengths * n // max(1, total)


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return SCALE * tf // (1000 * tf + SATURATION * norm)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in gathered(batches):
        lengths = np.diff(Words(*whole(rows["text"].combine_chunks()), TERM).first)
        yield pa.RecordBatch.from_arrays([pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())])], names=["n", "total"])


def _bytes_needed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run, 1, 2 or 4: what its largest value needs."""
    most = np.maximum.reduceat(values, starts)
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def packed(values: np.ndarray, starts: np.ndarray, width: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Write each run's values into ``out`` from the run's place on, in the run's width."""
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
    place = at[run] + (np.arange(len(values)) - starts[run]) * width[run]
    for byte in range(4):
        some = width[run] > byte
        out[place[some] + byte] = values[some] >> (8 * byte) & 0xFF


def _segment(number: int, rows: pa.Table, n: int, total: int) -> pa.RecordBatch:
    """The rows of a segment: one for each term by the terms' order, the first, without a term, has the documents."""
    words, codes, terms = interned(rows["text"], True, TERM)
    lengths = np.diff(words.first)
    norm = norms(lengths, n, total)
    order = np.array(pc.sort_indices(terms))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    posting, tf = np.unique(rank[codes] * len(lengths) + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
    term, doc = np.divmod(posting, max(1, len(lengths)))
    df = np.bincount(term, minlength=len(terms))
    firsts = cut(df)
    # Blocks begin at every BLOCK-th posting of a term.
    blocks = -(-df // BLOCK)
    of = np.repeat(np.arange(len(df)), blocks)
    starts = firsts[of] + (np.arange(len(of)) - cut(blocks)[of]) * BLOCK
    gaps = np.diff(doc, prepend=0)
    gaps[starts] = doc[starts]
    lists = [pa.array([number] * (len(terms) + 1)), pa.concat_arrays([pa.array([""]), terms.take(pa.array(order))]), pa.array([0, *df.tolist()], type=pa.int32())]
    if len(starts):
        ends = np.append(starts[1:], len(doc))
        impacts = np.maximum.reduceat(impact(tf, norm[doc]), starts)
        widths = _bytes_needed(gaps, starts), _bytes_needed(tf, starts)
        size = (ends - starts) * (widths[0] + widths[1]) + 2
        places = cut(size)
        data = np.zeros(int(places[-1]), dtype=np.uint8)
        data[places[:-1]], data[places[:-1] + 1] = widths
        packed(gaps, starts, widths[0], places[:-1] + 2, data)
        packed(tf, starts, widths[1], places[:-1] + 2 + (ends - starts) * widths[0], data)
        bounds = cut(blocks)
        begin = places[bounds[:-1]]
        relative = (places[:-1] - begin[of]).astype(np.int32)
        block_bytes = [_binaries(x, bounds) for x in (doc[ends - 1].astype(np.int32), impacts.astype(np.int32), relative)]
        lists += [pa.concat_arrays([pa.array([None], type=pa.binary()), x]) for x in (*block_bytes, _binaries(data, places[bounds]))]
    else:
        lists += [pa.array([None], type=pa.binary())] * 4
    ids = rows["doc_id"].combine_chunks()
    held = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * (len(terms) + 1), type=pa.int32()), ids)
    only_first = pa.array([True] + [False] * len(terms))
    lists += [pc.if_else(only_first, held, pa.scalar(None, held.type)), pa.array([blob(norm, np.int64)] + [None] * len(terms), type=pa.binary())]
    return pa.RecordBatch.from_arrays(lists, names=[c.split()[0] for c in _SEGMENT.split(", ")])


def _binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each run's bytes."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


class Index:
    """A written table of segments, with how many documents have terms and how many terms there are."""

    def __init__(self, rows: DataFrame, n: int, total: int) -> None:
        self.rows, self.n, self.total = rows, n, total

    @classmethod
    def of(cls, docs: DataFrame, segment_bytes: int = 4 * CHUNK_BYTES) -> Index:
        """The index of all rows of ``docs`` (doc_id, text)."""
        docs = docs.select("doc_id", "text")
        with small_batches(docs.sparkSession):
            n, total = (int(x or 0) for x in docs.mapInArrow(_lengths, "n bigint, total bigint").agg(F.sum("n"), F.sum("total")).first())

            def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for number, rows in gathered(batches, most=segment_bytes):
                    out = _segment(number, rows, n, total)
                    yield from (out.slice(k, 20_000) for k in range(0, len(out), 20_000))

            return cls(written(docs.mapInArrow(segments, _SEGMENT)), n, total)

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """term, df of those of ``terms`` that occur."""
        return self.rows.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))

    def search(self, queries: DataFrame, best: int = BEST) -> DataFrame:
        """item_id, rank, doc_id, score: the ``best`` documents of each of ``queries`` (item_id, text)."""
        spark = queries.sparkSession
        queries = queries.select("item_id", "text").where("text IS NOT NULL").distinct()
        size, = queries.agg(F.sum(F.octet_length("text").cast("bigint"))).first()
        lots = (size or 0) // QUERY_BYTES + 1
        out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
        for lot in range(lots):
            rows = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(lots)) == lot).collect()
            if rows:
                out = out.unionByName(self._lot(rows, best))
        return out

    def _lot(self, rows: Sequence, best: int) -> DataFrame:
        spark = self.rows.sparkSession
        column = pa.chunked_array([pa.array([r["text"] for r in rows], type=pa.string())])
        words, codes, terms = interned(column, True, TERM)
        names = terms.to_pylist()
        wanted = spark.createDataFrame([(x,) for x in names], "term string")
        known = {r["term"]: weight(r["df"], self.n) for r in self.frequencies(wanted).collect()}
        searched = []
        for k in range(len(rows)):
            held, times = np.unique(codes[words.first[k] : words.first[k + 1]], return_counts=True)
            searched.append([(names[c], known[names[c]] * t) for c, t in zip(held.tolist(), times.tolist(), strict=True) if known.get(names[c])])
        needed = spark.createDataFrame([("",), *((x,) for x in sorted(known))], "term string")
        lists = self.rows.join(F.broadcast(needed), "term", "left_semi").select(*self.rows.columns)
        # A first round over about the square root of the segments tells what the others have to reach.
        segments = self.rows.where("term = ''").count()
        some = F.pmod(F.xxhash64("segment"), F.lit(max(1, math.isqrt(segments)))) == 0
        first = written(_searched(lists.where(some), searched, {}, best))
        falling = Window.partitionBy("query").orderBy(F.desc("score"))
        reached = {r["query"]: r["score"] for r in first.withColumn("n", F.row_number().over(falling)).where(F.col("n") == best).collect()}
        found = written(first.unionByName(_searched(lists.where(~some), searched, reached, best)))
        discard(first)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        items = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], "query int, item_id bigint")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        return ranked.join(F.broadcast(items), "query").select("item_id", "rank", "doc_id", "score")


class _Lists:
    """The lists of one segment; blocks are decompressed once, when a query first reads them."""

    def __init__(self, rows: pa.Table) -> None:
        own = {t: k for k, t in enumerate(rows["term"].to_pylist())}
        self.at, self.rows, self.open = own, rows, {}
        head = own[""]
        self.ids = rows["ids"][head].values
        self.norms = np.frombuffer(rows["norms"][head].as_py(), dtype=np.int64)
        #: Blocks decompressed and blocks seen, for those who want to know what is skipped.
        self.read = self.seen = 0

    def list(self, term: str) -> tuple | None:
        """lasts, impacts, starts, data, block by block what is decompressed."""
        if term not in self.open:
            k = self.at.get(term)
            self.open[term] = None
            if k is not None:
                parts = [np.frombuffer(self.rows[c][k].as_py(), dtype=t) for c, t in (("lasts", np.int32), ("impacts", np.int32), ("starts", np.int32), ("data", np.uint8))]
                self.open[term] = (*parts, self.rows["df"][k].as_py(), {})
                self.seen += len(parts[0])
        return self.open[term]

    def block(self, found: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and their impacts."""
        lasts, _, starts, data, df, done = found
        if k not in done:
            self.read += 1
            n = min(BLOCK, df - k * BLOCK)
            wide_gap, wide_tf, at = int(data[starts[k]]), int(data[starts[k] + 1]), starts[k] + 2
            docs = np.cumsum(np.frombuffer(data[at : at + n * wide_gap].tobytes(), dtype=f"<u{wide_gap}").astype(np.int64))
            tf = np.frombuffer(data[at + n * wide_gap : at + n * (wide_gap + wide_tf)].tobytes(), dtype=f"<u{wide_tf}").astype(np.int64)
            done[k] = docs, impact(tf, self.norms[docs])
        return done[k]


def top(lists: _Lists, terms: list[tuple[str, int]], needed: int, best: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (numbers in the segment) and scores of those that may be among the ``best``: none below ``needed`` is of use."""
    found = [(x, w) for t, w in terms if (x := lists.list(t))]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    found.sort(key=lambda f: -int(f[0][1].max()) * f[1])
    # Shallow: windows between block ends, each list's block in them, and what these can give at most.
    ends = np.unique(np.concatenate([x[0] for x, _ in found])).astype(np.int64)
    block = [np.searchsorted(x[0], ends) for x, _ in found]
    bounds = np.zeros((len(found) + 1, len(ends)), dtype=np.int64)
    for k in range(len(found) - 1, -1, -1):
        (_, impacts, *_), w = found[k]
        inside = block[k] < len(impacts)
        bounds[k] = bounds[k + 1]
        bounds[k][inside] += impacts[block[k][inside]].astype(np.int64) * w
    order = np.argsort(-bounds[0], kind="stable")
    window_of = np.searchsorted(ends, np.arange(len(lists.norms)))
    docs, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    begin, step = 0, 8
    while begin < len(order):
        now = order[begin : begin + step]
        now = now[bounds[0][now] >= max(1, needed)]
        if not len(now):
            break
        begin, step = begin + step, step * 2
        live = np.zeros(len(ends) + 1, dtype=bool)
        live[now] = True
        total = np.zeros(len(lists.norms), dtype=np.int64)
        met = np.zeros(len(lists.norms), dtype=bool)
        for k, (x, w) in enumerate(found):
            # A document that wasn't met before can have the rest at most, one that was has its sum and the rest.
            fresh = live.copy()
            fresh[:-1] &= bounds[k] >= max(1, needed)
            old = np.flatnonzero(met)
            old = old[total[old] + bounds[k][window_of[old]] >= needed]
            met[:] = False
            met[old] = True
            windows = np.unique(np.concatenate([np.flatnonzero(fresh[:-1]), window_of[old]]))
            if not len(windows):
                break
            blocks = np.unique(block[k][windows])
            for b in blocks[blocks < len(x[0])].tolist():
                own, impacts = lists.block(x, b)
                use = met[own] | fresh[window_of[own]]
                own = own[use]
                total[own] += impacts[use] * w
                met[own] = True
        got = np.flatnonzero(met)
        got = got[(total[got] >= needed) & (total[got] > 0)]
        docs, scores = np.concatenate([docs, got]), np.concatenate([scores, total[got]])
        if len(scores) > best:
            needed = max(needed, int(np.partition(scores, -best)[-best]))
            keep = scores >= needed
            docs, scores = docs[keep], scores[keep]
    return docs, scores


def _searched(lists: DataFrame, searched: list[list[tuple[str, int]]], reached: dict[int, int], best: int) -> DataFrame:
    """_FOUND: of each partition the best documents of each query, ties by id."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bool, int]]] = {}
        for _, rows in by_part(batches):
            segment = _Lists(rows)
            for query, terms in enumerate(searched):
                own = held.get(query, [])
                needed = max(reached.get(query, 0), -own[best - 1][0] if len(own) >= best else 0)
                docs, scores = top(segment, terms, needed, best)
                if len(docs):
                    ids = segment.ids.take(pa.array(docs)).to_pylist()
                    held[query] = sorted([*own, *((-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids, strict=True))])[:best]
        rows = [(q, None if null else i, -s) for q, own in held.items() for s, null, i in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])

    return lists.repartition("segment").sortWithinPartitions("segment").mapInArrow(found, _FOUND)
