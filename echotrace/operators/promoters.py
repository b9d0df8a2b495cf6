"""Which users lead to flagged places: tables of words and domains held against what users say and link to.

Texts meet words that fit a lot of a checked size by an automaton that reads each text once. Larger tables are never held
by a task: a filter of bits, of one size whatever the number of words, tells which places of a text may start a word and
which stretches there may be one, by hashes; those stretches are joined with the table. So a text is read once, what is
shuffled follows texts and words, and the join on the stretches themselves decides; texts and words are never paired.

Of a user's findings the first source counts (bio, profile links, pages that these lead to, links in comments, pages that
those lead to), inside a source the first link, inside a link the first word of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import written

#: Characters of words in one lot; an automaton takes some 36 bytes for each, in every Python worker.
LOT = 4 << 20
#: Bits of the filter, as a power of two; bytes at a word's start that are asked for first, at most; bytes of texts that are hashed at once.
BITS, START, PIECE = 27, 8, 1 << 20
SOURCES = ["Bio", "Profile", "Profile landing", "Comment", "Comment landing"]


def automaton_of(words: pa.Array):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for n, word in enumerate(words):
        automaton.add_word(word.as_py(), n)
    automaton.make_automaton()
    return automaton


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Stretches:
    """Hashes of stretches of a text's bytes: sums of bytes times powers, of which any difference is a stretch's."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data), self.BASE), dtype=np.uint64)])
        self.back = _powers(len(data) + 1, pow(self.BASE, -1, 1 << 64))

    def places(self, begin: np.ndarray, length: int | np.ndarray, salt: int) -> np.ndarray:
        """A bit of the filter for each stretch."""
        x = (self.sums[begin + length] - self.sums[begin]) * self.back[begin] + np.uint64(salt)
        for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
        return (x >> np.uint64(64 - BITS)).astype(np.int64)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; null ones are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def _filter(words: DataFrame, start: int) -> np.ndarray:
    """The bits of all words' first ``start`` bytes and of the words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _bytes_of(batch.column(0))
            hashes = Stretches(data)
            places = np.unique(np.concatenate([hashes.places(at[:-1], start, 1), hashes.places(at[:-1], np.diff(at), 2)]))
            yield pa.RecordBatch.from_arrays([pa.array((places >> 5).astype(np.int32)), pa.array(np.int64(1) << (places & 31))], names=["at", "bits"])

    rows = words.select("word").mapInArrow(of, "at int, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 5), dtype=np.uint32)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return out


def _held(column: pa.Array, bits: np.ndarray, start: int, lengths: list[int]) -> list[set[str]]:
    """Of each text the stretches that may be words."""
    data, at = _bytes_of(column)
    out: list[set[str]] = [set() for _ in range(len(column))]
    if len(data) < start:
        return out
    known = lambda places: bits[places >> 5] >> (places & 31).astype(np.uint32) & 1 == 1
    hashes, every = Stretches(data), np.arange(len(data) - start + 1)
    begin = every[known(hashes.places(every, start, 1))]
    row = np.searchsorted(at, begin, side="right") - 1
    whole = data.tobytes()
    for n in lengths:
        fits = np.flatnonzero(begin + n <= at[row + 1])
        fits = fits[known(hashes.places(begin[fits], n, 2))]
        for k, x in zip(row[fits].tolist(), begin[fits].tolist(), strict=True):
            # What is cut inside a character is no word.
            out[k].add(whole[x : x + n].decode(errors="ignore"))
    return out


def _joined(texts: DataFrame, words: DataFrame, keep: list[str]) -> DataFrame:
    """``first_words`` for tables of any size."""
    spark = texts.sparkSession
    lengths = sorted(r[0] for r in words.select(F.octet_length("word")).distinct().collect())
    start = min(START, lengths[0])
    shared = spark.sparkContext.broadcast(_filter(words, start))
    schema = T.StructType([*(texts.schema[c] for c in keep), T.StructField("_row", T.LongType()), T.StructField("_held", T.ArrayType(T.StringType()))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            cut = np.cumsum(np.diff(_bytes_of(text)[1])) // PIECE
            # Neighbouring texts whose bytes end in one piece are hashed at once.
            first = np.flatnonzero(np.diff(cut, prepend=-1)).tolist()
            held = [x for begin, end in zip(first, [*first[1:], len(text)], strict=False) for x in _held(text.slice(begin, end - begin), shared.value, start, lengths)]
            some = [k for k, x in enumerate(held) if x]
            part = batch.take(pa.array(some, type=pa.int64()))
            lists = pa.array([sorted(held[k]) for k in some], type=pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(number + np.arange(len(some))), lists], names=[*keep, "_row", "_held"])
            number += len(some)

    marked = written(texts.mapInArrow(of, schema))
    asked = marked.select("_row", F.explode("_held").alias("word"))
    best = asked.join(words, "word").groupBy("_row").agg(F.min(F.struct("place", "word")).alias("_best"))
    return marked.drop("_held").join(best, "_row").select(*keep, F.col("_best.word").alias("word"))


def listed(words: DataFrame) -> DataFrame:
    """Words that can be found, each with its least place, written: they are read several times."""
    return written(words.where(F.coalesce(F.length("word"), F.lit(0)) > 0).groupBy("word").agg(F.min("place").alias("place")))


def first_words(texts: DataFrame, words: DataFrame, lot: int = LOT) -> DataFrame:
    """``texts`` (with a string column ``text``) that hold a word of ``words`` (word, place), with the one of least place (then by itself) as ``word``.

    Null texts, null and empty words match nothing.
    """
    return _first(texts, listed(words), lot, texts.columns)


def _first(texts: DataFrame, words: DataFrame, lot: int, keep: list[str]) -> DataFrame:
    """``first_words`` of ``listed`` words, with the columns ``keep`` of the texts."""
    spark = texts.sparkSession
    size, = words.agg(F.coalesce(F.sum(F.length("word") + 8), F.lit(0))).first()
    if not size:
        return texts.limit(0).select(*keep, F.lit(None).cast("string").alias("word"))
    if size >= lot:
        return _joined(texts, words, keep)
    rows = words.orderBy("place", "word").collect()
    # As Arrow's arrays, which hold no object for each word.
    shared = spark.sparkContext.broadcast(pa.array([r["word"] for r in rows]))
    schema = T.StructType([*(texts.schema[c] for c in keep), T.StructField("word", T.StringType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = shared.value
        automaton = automaton_of(word)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            best = [min((n for _, n in automaton.iter(t)), default=None) if t else None for t in batch.column(at).to_pylist()]
            some = [i for i, n in enumerate(best) if n is not None]
            part = batch.take(pa.array(some, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), word.take(pa.array([best[i] for i in some], type=pa.int64()))], names=[*keep, "word"])

    return texts.mapInArrow(of, schema)


def promoters(bios: DataFrame, profile: DataFrame, comments: DataFrame, flagged: DataFrame, landing: DataFrame, pages: DataFrame) -> DataFrame:
    """user, source, url: each user's first finding.

    ``bios`` has user and bio; ``profile`` and ``comments`` user and links (an array, in order); ``flagged`` and ``landing``
    word and place; ``pages`` url and html of pages that landing links lead to. A landing link without a page finds nothing.
    """
    links = [df.select("user", F.lit(n).alias("source"), F.posexplode("links").alias("at", "text")) for n, df in ((1, profile), (3, comments))]
    linked = links[0].unionByName(links[1])
    said = bios.select("user", F.lit(0).alias("source"), F.lit(0).alias("at"), F.col("bio").alias("text")).unionByName(linked)
    flagged = listed(flagged)
    hits = written(_first(said, flagged, LOT, ["user", "source", "at"]))
    direct = hits.groupBy("user", "source").agg(F.min_by("word", "at").alias("word"))
    led = first_words(linked, landing).groupBy("user", "source").agg(F.min_by("text", "at").alias("url"))
    led = written(led)
    sources = pages.join(led.select("url").distinct(), "url", "left_semi").select("url", F.col("html").alias("text"))
    # An address that several pages have counts as one of all their words.
    guilty = _first(sources, flagged, LOT, ["url"]).distinct().join(flagged, "word").groupBy("url").agg(F.min(F.struct("place", "word")).alias("f")).select("url", "f.word")
    landed = led.join(guilty, "url").select("user", (F.col("source") + 1).alias("source"), "word")
    first = direct.unionByName(landed).groupBy("user").agg(F.min(F.struct("source", "word")).alias("f"))
    return first.select("user", F.get(F.array(*(F.lit(s) for s in SOURCES)), F.col("f.source")).alias("source"), F.col("f.word").alias("url"))
