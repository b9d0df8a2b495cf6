"""A log-bilinear language model, trained by noise-contrastive estimation, and the scores it gives to texts.

Tokens fall into classes: each of the most frequent words is one, the others share one with words of about the same
count and the same kind of last letter. A token's probability is that of its class after the classes before it, times
its share of the class. The first is the log-bilinear model: the vectors of the classes before, each through a matrix
for its place, add up to a prediction, and a class has its product with that plus a bias; the second is the corpus's
count. A class's products are normalised over all classes, so a text's probabilities add up to one, with the words that
training never saw counted as one word for each kind of last letter. Their share is what Turing's estimate gives them.

Counts are those of all training documents. Training passes over every training token once, in ROUNDS rounds: every task
starts from the same parameters, goes through its share of the tokens, and the results are averaged, weighted by tokens.
The number of parameters is fixed by HEAD and SIZE, so what goes to tasks has a size that doesn't grow with the corpus.

Null texts are empty and have the end token alone. A null id counts as the empty string. Rows are documents of their own,
also with equal ids. Without training documents the counts are zero and all scores stay defined. An empty table gives an
empty result. Equal texts get equal scores up to rounding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import blob, gathered, interned, looked_up, numbers, numbers_of, sums
from .common import discard, small_batches, written

#: Words that are a class each, words of context (``Model.log10`` takes three), length of a vector.
HEAD, ORDER, SIZE = 512, 3, 32
#: Rounds of averaging, tokens of a step, noise samples of a step, rate of learning.
ROUNDS, STEP, NOISE, RATE = 4, 1024, 128, 0.08
#: Bytes of text in a chunk: larger ones have fewer distinct words for each of their words.
TEXT_BYTES = 16 << 20
#: Kinds of last letter.
KINDS = 6
#: The end of a text, as no word can be.
END = ""

_TOKENS = "chunk bigint, doc_ids array<bigint>, held array<boolean>, bounds binary, codes binary, keys array<string>, trained array<bigint>"
_CODED = "doc_ids array<bigint>, held array<boolean>, bounds binary, classes binary, n_known array<bigint>, base array<double>, inside array<double>"
RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def held_out(ids: list[int | None]) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in ids], dtype=bool)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, rows in gathered(batches, most=TEXT_BYTES):
        held = held_out(rows["doc_id"].to_pylist())
        words, codes, keys = interned(rows["text"], lower=True)
        # An end behind the words of every text.
        bounds = words.first + np.arange(len(held) + 1)
        all_codes = np.full(int(bounds[-1]), len(keys), dtype=np.int32)
        inside = np.ones(len(all_codes), dtype=bool)
        inside[bounds[1:] - 1] = False
        all_codes[inside] = codes
        keys = pa.concat_arrays([keys, pa.array([END])])
        trained = np.bincount(all_codes[np.repeat(~held, np.diff(bounds))], minlength=len(keys))
        lists = [rows["doc_id"].combine_chunks(), pa.array(held), keys, pa.array(trained)]
        ids, held, keys, trained = (pa.ListArray.from_arrays(pa.array([0, len(x)], type=pa.int32()), x) for x in lists)
        yield pa.RecordBatch.from_arrays([pa.array([number]), ids, held, pa.array([numbers(bounds)]), pa.array([numbers(all_codes)]), keys, trained], names=["chunk", "doc_ids", "held", "bounds", "codes", "keys", "trained"])


def _kind(key: Column) -> Column:
    """Of a word's last letter: a letter, a digit, beyond ASCII, comma, full stop, other."""
    last = F.ascii(F.substring(key, -1, 1))
    return F.when(last.between(97, 122), 0).when(last.between(48, 57), 1).when(last > 127, 2).when(last == 44, 3).when(last == 46, 4).otherwise(5)


def _band(count: Column) -> Column:
    """Counts of about the same size; 1, 2 and 3 are by themselves."""
    return F.floor(F.log2(count) * 2).cast("int")


class Vocabulary:
    """The classes of a table of counts (key, c): what is known of them fits the driver, as it doesn't grow with the words."""

    def __init__(self, counts: DataFrame) -> None:
        spark = counts.sparkSession
        # Rare words stay out of the head, since the unseen ones are judged by them.
        head = counts.where("c > 2").orderBy(F.desc("c"), "key").limit(HEAD).collect()
        self.n, self.v = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).first())
        self._head = spark.createDataFrame([(r["key"], k) for k, r in enumerate(head)], "key string, _head int")
        rest = counts.join(F.broadcast(self._head), "key", "left_anti")
        groups = {(r["band"], r["kind"]): (r["total"], r["n"]) for r in rest.groupBy(_band(F.col("c")).alias("band"), _kind(F.col("key")).alias("kind")).agg(F.sum("c").alias("total"), F.count("*").alias("n")).collect()}
        for kind in range(KINDS):
            groups.setdefault((0, kind), (0, 0))
        self._rest = {g: len(head) + k for k, g in enumerate(sorted(groups))}
        self.classes = len(head) + len(groups)
        mass = np.array([r["c"] for r in head] + [groups[g][0] for g in sorted(groups)], dtype=np.float64) + 0.5
        #: Share of each class among the training tokens.
        self.share = mass / mass.sum()
        once, twice = ([groups.get((band, kind), (0, 0))[1] for kind in range(KINDS)] for band in (0, 2))
        #: By kind: share of the unseen word in its class, and of each word seen once.
        self.unseen = [(a + 0.5) / (a + 2 * b + 1) for a, b in zip(once, twice, strict=True)]
        seen = [(1 - u) / max(1, a) for u, a in zip(self.unseen, once, strict=True)]
        rows = [(band, kind, self._rest[band, kind], float(np.log10(seen[kind])) if band == 0 else None, float(groups[band, kind][0])) for band, kind in self._rest]
        self._table = spark.createDataFrame(rows, "_band int, _kind int, _class int, _once double, _total double")

    def values(self, counts: DataFrame) -> DataFrame:
        """key, c, class, inside: log10 of the word's share of its class."""
        df = counts.join(F.broadcast(self._head), "key", "left").withColumns({"_band": _band(F.col("c")), "_kind": _kind(F.col("key"))})
        df = df.join(F.broadcast(self._table), ["_band", "_kind"], "left")
        inside = F.when(F.col("_head").isNotNull(), F.lit(0.0)).otherwise(F.coalesce("_once", F.log10(F.col("c") / F.col("_total"))))
        return df.select("key", "c", F.coalesce("_head", "_class").alias("class"), inside.alias("inside"))

    def defaults(self) -> dict[str, Column]:
        """Of an unseen ``key``."""
        kind = _kind(F.col("key"))
        place, share = F.array(*(F.lit(self._rest[0, k]) for k in range(KINDS))), F.array(*(F.lit(float(np.log10(u))) for u in self.unseen))
        return {"c": F.lit(0).cast("bigint"), "class": F.get(place, kind), "inside": F.get(share, kind)}


class Model:
    """vectors (one more for what lies before a text), matrices by place, outputs and biases."""

    def __init__(self, share: np.ndarray, seed: int = 5) -> None:
        draw = np.random.Generator(np.random.PCG64(seed))
        self.share = share
        self.parts = [
            draw.normal(0, 0.3, (len(share) + 1, SIZE)).astype(np.float32), np.stack([np.eye(SIZE, dtype=np.float32) / (k + 1) for k in range(ORDER)]),
            np.zeros((len(share), SIZE), dtype=np.float32), np.log(share).astype(np.float32),
        ]

    def packed(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts])

    def unpacked(self, flat: np.ndarray) -> Model:
        out, at = Model.__new__(Model), 0
        out.share, out.parts = self.share, []
        for x in self.parts:
            out.parts.append(flat[at : at + x.size].astype(np.float32).reshape(x.shape).copy())
            at += x.size
        return out

    def contexts(self, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The classes before each token, nearest first."""
        place = np.arange(len(classes)) - np.repeat(bounds[:-1], np.diff(bounds))
        return np.stack([np.where(place > k, np.roll(classes, k + 1), len(self.share)) for k in range(ORDER)])

    def learn(self, classes: np.ndarray, context: np.ndarray, draw: np.random.Generator) -> None:
        """One pass by noise-contrastive estimation: a token against NOISE samples that its step shares, drawn by share."""
        vectors, matrices, outputs, bias = self.parts
        log_noise = np.log(NOISE * self.share).astype(np.float32)
        samples, edges = draw.random((len(classes) // STEP + 1, NOISE)), np.cumsum(self.share)
        slopes = [np.full(x.shape, 1e-6, dtype=np.float32) for x in self.parts]

        def stepped(k: int, gradient: np.ndarray) -> None:
            slopes[k] += gradient * gradient
            self.parts[k] += RATE * gradient / np.sqrt(slopes[k])

        for k, begin in enumerate(range(0, len(classes), STEP)):
            word, before = classes[begin : begin + STEP], context[:, begin : begin + STEP]
            noise = np.minimum(np.searchsorted(edges, samples[k]), len(self.share) - 1)
            inputs = vectors[before]
            moved = np.matmul(inputs, matrices)
            predicted = moved[0]
            for more in moved[1:]:
                predicted += more
            # Of a token being the corpus's, of a sample being noise: one minus what the model thinks.
            own, others = outputs[word], outputs[noise]
            scale = np.float32(1 / len(word))
            data = scale - scale * _sigmoid(np.einsum("ij,ij->i", predicted, own) + (bias - log_noise)[word])
            false = -scale * _sigmoid(predicted @ others.T + (bias - log_noise)[noise])
            back = data[:, None] * own + false @ others
            rows = np.concatenate([data[:, None] * predicted, false.T @ predicted])
            out = _added(np.concatenate([word, noise]), np.column_stack([rows, np.concatenate([data, false.sum(axis=0)])]), len(outputs))
            to_matrices = np.matmul(inputs.transpose(0, 2, 1), back)
            to_vectors = _added(before.ravel(), np.matmul(back, matrices.transpose(0, 2, 1)).reshape(-1, SIZE), len(vectors))
            for part, gradient in enumerate((to_vectors, to_matrices, out[:, :SIZE], out[:, SIZE])):
                stepped(part, gradient)

    def log10(self, classes: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log10 of the normalised probability of each token's class.

        What a probability is divided by depends on the context alone, so it is worked out once for each distinct one: as
        the product of what the two nearest classes give, exponentials that contexts share, and what the third gives.
        """
        vectors, matrices, outputs, bias = self.parts
        # By place, what a class before gives to each class; the biases go with the nearest.
        given = [(vectors @ m) @ outputs.T + (bias if k == 0 else 0) for k, m in enumerate(matrices)]
        far, far_top = _exponentials(given[2])
        key = np.zeros(len(classes), dtype=np.int64)
        for before in context:
            key = key * len(vectors) + before
        order = np.argsort(key, kind="stable")
        held = key[order]
        first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, dtype=np.int64)
        whole = np.empty(len(first), dtype=np.float64)
        for begin in range(0, len(first), 256):
            before = context[:, order[first[begin : begin + 256]]]
            # Sorted, so that equal pairs stand together.
            new = np.concatenate([[True], (before[0, 1:] != before[0, :-1]) | (before[1, 1:] != before[1, :-1])])
            near, near_top = _exponentials(given[0][before[0, new]] + given[1][before[1, new]])
            pair = np.cumsum(new) - 1
            total = np.einsum("ij,ij->i", near[pair], far[before[2]])
            some = np.maximum(total, 1e-30)
            whole[begin : begin + 256] = np.log(some) + near_top[pair] + far_top[before[2]]
            for k in np.flatnonzero(total <= 1e-30):
                # What one part favours the other all but rules out.
                x = sum(g[b].astype(np.float64) for g, b in zip(given, before[:, k], strict=True))
                whole[begin + k] = np.log(np.exp(x - x.max()).sum()) + x.max()
        out = np.empty(len(classes), dtype=np.float64)
        out[order] = -np.repeat(whole, np.diff(np.append(first, len(held))))
        for g, before in zip(given, context, strict=True):
            out += g[before, classes]
        return out / np.log(10)


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row without its largest value, and that value."""
    top = x.max(axis=1)
    return np.exp(x - top[:, None]), top


def _added(places: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows by place."""
    # Short numbers are sorted digit by digit.
    order = np.argsort(places.astype(np.int16), kind="stable")
    held = places[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    out = np.zeros((n, rows.shape[1]), dtype=np.float32)
    out[held[first]] = np.add.reduceat(rows[order], first)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Of an array that nothing else reads: it takes the result."""
    np.negative(np.maximum(x, -80, out=x), out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _training(coded: DataFrame, model: Model, turn: int) -> Model:
    """The parameters after a round over a share of the training documents, averaged over tasks."""
    flat = model.packed()

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tokens, draw = model.unpacked(flat), 0, np.random.Generator(np.random.PCG64(turn))
        for batch in batches:
            for row in batch.to_pylist():
                bounds, classes = numbers_of(row["bounds"]), numbers_of(row["classes"])
                mine = ~np.array(row["held"], dtype=bool) & (np.arange(len(bounds) - 1) % ROUNDS == turn)
                at = np.flatnonzero(np.repeat(mine, np.diff(bounds)))
                if len(at):
                    at = draw.permutation(at)
                    own.learn(classes[at], own.contexts(classes, bounds)[:, at], draw)
                    tokens += len(at)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], type=pa.int32()), pa.array([tokens]), pa.array([blob(own.packed().astype(np.float64) * tokens, np.float64)])], names=["task", "tokens", "sums"])

    def added(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task")
        total = np.zeros(len(flat))
        for x in rows["sums"]:
            total += np.frombuffer(x.as_py(), dtype=np.float64)
        return pa.table({"task": rows["task"][:1], "tokens": [sum(rows["tokens"].to_pylist())], "sums": [total.tobytes()]})

    schema = "task int, tokens bigint, sums binary"
    results = written(coded.select("held", "bounds", "classes").mapInArrow(learned, schema))
    # Two levels: no task adds more than about the square root of all results.
    wide = max(1, int(results.count() ** 0.5))
    level = results.groupBy(F.pmod("task", F.lit(wide))).applyInArrow(added, schema)
    row = level.groupBy(F.pmod("task", F.lit(1))).applyInArrow(added, schema).first()
    discard(results)
    return model.unpacked(np.frombuffer(row["sums"], dtype=np.float64) / row["tokens"]) if row else model


def coded(docs: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """Chunks of ``docs`` (doc_id, text) as classes, written, and what the classes are."""
    with small_batches(docs.sparkSession):
        tokens = written(docs.select("doc_id", "text").mapInArrow(_tokens, _TOKENS))
    each = tokens.select(F.explode(F.arrays_zip("keys", "trained")).alias("x")).where("x.trained > 0")
    counts = written(each.groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.trained").alias("c")))
    vocabulary = Vocabulary(counts)
    n, v = vocabulary.n, vocabulary.v

    def as_classes(row: dict, found: pa.Table) -> pa.Table:
        bounds, codes = numbers_of(row["bounds"]), numbers_of(row["codes"])
        c, kind, inside = (found[x].to_numpy() for x in ("c", "class", "inside"))
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        lists = [pa.array(row["doc_ids"], type=pa.int64()), pa.array(row["held"], type=pa.bool_()), *(pa.array(sums(x[codes], bounds)) for x in ((c > 0).astype(np.int64), base, inside))]
        ids, held, known, base, inside = (pa.ListArray.from_arrays(pa.array([0, len(x)], type=pa.int32()), x) for x in lists)
        return pa.table([ids, held, pa.array([row["bounds"]]), pa.array([numbers(kind[codes])]), known, base, inside], names=["doc_ids", "held", "bounds", "classes", "n_known", "base", "inside"])

    out = written(looked_up(tokens.drop("trained"), vocabulary.values(counts), as_classes, _CODED, vocabulary.defaults()))
    discard(tokens, counts)
    return out, vocabulary


def fit(table: DataFrame, vocabulary: Vocabulary) -> Model:
    model = Model(vocabulary.share)
    for turn in range(ROUNDS):
        model = _training(table, model, turn)
    return model


def score(docs: DataFrame) -> DataFrame:
    """RESULT for every row of ``docs``."""
    table, vocabulary = coded(docs)
    model, n = fit(table, vocabulary), vocabulary.n

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bounds, classes = numbers_of(row["bounds"]), numbers_of(row["classes"])
                total = sums(model.log10(classes, model.contexts(classes, bounds)), bounds) + np.array(row["inside"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], type=pa.int64()), pa.array(row["held"], type=pa.bool_()), pa.array(np.diff(bounds)), pa.array(row["n_known"], type=pa.int64()),
                    pa.array(np.full(len(bounds) - 1, n)), pa.array(row["base"], type=pa.float64()), pa.array(total),
                ], names=[c.split()[0] for c in RESULT.split(", ")])

    out = written(table.mapInArrow(scored, RESULT))
    discard(table)
    return out
