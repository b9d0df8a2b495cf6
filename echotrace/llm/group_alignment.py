"""How two tokenizers cut the same bytes: groups of tokens with common ends, interned once, and links between ids.

A group is the tokens of both sides between two places where both end. Equal groups have equal links, so each distinct
group is expanded once: a chunk interns its groups, the corpus interns those of all chunks, links are worked out and
weighed for each distinct group, and a document multiplies them by how often it holds the group.

Texts are encoded in pieces. No token of either side crosses from a character that isn't white space to a single space
before another such character, so what lies between two such places is encoded alike wherever it stands, and a chunk
encodes each distinct piece once. Where a vocabulary doesn't have this property, a text is one piece.

How many documents hold an id pair linked is counted in two steps: distinct documents inside a chunk, then a sum over
chunks. Only pairs and group keys move between tasks, each once for a chunk.

Null and empty texts, and those that a tokenizer doesn't give back byte for byte, have no tokens: zeros and an empty
digest. Rows are documents of their own, also with equal or null ids. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import blob, cut, gathered, looked_up, sums
from .common import discard, small_batches, written
from .groups import whole

#: Where the vocabularies are, and their names; the driver reads them and sends their bytes along.
FOLDER, A_FILE, B_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"

_CHUNK = "chunk bigint, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, shas array<string>, bounds binary, codes binary, times binary, keys array<string>, a array<int>, b array<int>, n array<int>"
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [k for k in range(256) if k not in set(plain)]
    return {chr(k): k for k in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    _loaded: dict[str, Pair] = {}

    def __init__(self, a: bytes, b: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = importlib.import_module("tokenizers").Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = importlib.import_module("sentencepiece").SentencePieceProcessor(model_proto=b)
        bytes_of, names = _characters(), json.loads(a)
        special = {x["id"] for x in names.get("added_tokens", []) if x.get("special")}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, k in vocabulary.items():
            self.a_bytes[k] = piece.encode() if k in special else bytes(bytes_of[c] for c in piece)
        ids = range(self.b.get_piece_size())
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, self.b.id_to_piece(k)) for k in ids)]
        #: Bytes of each token.
        self.sizes = [np.array([len(x) for x in y], dtype=np.int64) for y in (self.a_bytes, self.b_bytes)]

    @classmethod
    def of(cls, a: bytes, b: bytes) -> Pair:
        """Loaded once for each worker."""
        key = hashlib.sha256(a + b).hexdigest()
        if key not in cls._loaded:
            cls._loaded[key] = cls(a, b)
        return cls._loaded[key]

    def apart(self) -> bool:
        """If texts may be encoded in pieces: side B has no token with a space behind something else, and changes no characters."""
        plain = "ﬁ ①  x e\u0301 \t\uff21 "
        return not any("▁" in self.b.id_to_piece(k).lstrip("▁") for k in range(self.b.get_piece_size())) and self._right([plain])[0] is not None

    def _right(self, texts: list[str]) -> list[list[int] | None]:
        """Ids of side B; None for a text that isn't given back."""
        ids = self.b.encode(texts, out_type=int, num_threads=1)
        return [x if b"".join(map(self.b_bytes.__getitem__, x)) == f" {t}".encode() else None for t, x in zip(texts, ids, strict=True)]

    def encoded(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both sides for a space and each text; None for a text that either side doesn't give back."""
        if not texts:
            return []
        left = (e.ids for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False))
        return [(x, y) if y is not None and b"".join(map(self.a_bytes.__getitem__, x)) == f" {t}".encode() else None for t, x, y in zip(texts, left, self._right(texts), strict=True)]

    def tokens(self, pieces: list[str], block: int = 2048) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Of both sides the ids of all pieces and their bounds by piece, and which pieces a side doesn't give back (they have none).

        Pieces that begin and end with a visible character are encoded many at a time, as parts of one text.
        """
        plain = np.array([bool(t) and t[0] > " " and t[-1] > " " and (t[0] < "\x7f" or "À" <= t[0] <= "ÿ") and (t[-1] < "\x7f" or "À" <= t[-1] <= "ÿ") for t in pieces], dtype=bool)
        lots = [x.tolist() for x in np.split(np.flatnonzero(plain), range(block, int(plain.sum()), block))]
        joined = self.encoded([" ".join(pieces[k] for k in lot) for lot in lots if lot])
        alone, ids, owner = np.flatnonzero(~plain).tolist(), ([], []), ([], [])
        for lot, both in zip(lots, joined, strict=False):
            if both is None:
                alone += lot
                continue
            ends = np.cumsum([len(pieces[k].encode()) + 1 for k in lot])
            for side in (0, 1):
                own = np.array(both[side], dtype=np.int64)
                ids[side].append(own)
                owner[side].append(np.array(lot)[np.searchsorted(ends, np.cumsum(self.sizes[side][own]))])
        broken = np.zeros(len(pieces), dtype=bool)
        for k, both in zip(alone, self.encoded([pieces[k] for k in alone]), strict=True):
            broken[k] = both is None
            for side in (0, 1) if both else ():
                ids[side].append(np.array(both[side], dtype=np.int64))
                owner[side].append(np.full(len(both[side]), k))
        out, bounds = [], []
        for own, of in zip(ids, owner, strict=True):
            own, of = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (own, of))
            order = np.argsort(of, kind="stable")
            out.append(own[order])
            bounds.append(np.searchsorted(of[order], np.arange(len(pieces) + 1)))
        return out, bounds, broken

    def links(self, key: str) -> list[tuple[int, int]]:
        """The id pairs of a group whose bytes overlap, as often as they do."""
        a, b = ([int(x) for x in side.split(",")] for side in key.split("|"))
        size_a, size_b = self.sizes
        out, i, j, end_a, end_b = [], 0, 0, size_a[a[0]], size_b[b[0]]
        while True:
            out.append((a[i], b[j]))
            low = min(end_a, end_b)
            if end_a == low:
                i += 1
                end_a += size_a[a[i]] if i < len(a) else 0
            if end_b == low:
                j += 1
                end_b += size_b[b[j]] if j < len(b) else 0
            if i == len(a) or j == len(b):
                return out


def _pieces(texts: pa.Array, apart: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Bounds of each text's pieces, a code for each piece, and the distinct pieces without the space before them."""
    raw, bounds = whole(texts)
    size = np.diff(bounds)
    size = size + (size > 0)
    bounds = cut(size)
    data = np.full(int(bounds[-1]), 0x20, dtype=np.uint8)
    own = np.ones(len(data), dtype=bool)
    first = bounds[:-1][size > 0]
    own[first] = False
    data[own] = raw
    start = np.zeros(len(data), dtype=bool)
    if apart and len(data) > 2:
        # Next to white space beyond ASCII no cut is made: of other letters, those of two bytes from U+00C0 on will do.
        visible = (data > 0x20) & (data < 0x7F)
        latin = data == 0xC3
        start[2:-1] = (data[2:-1] == 0x20) & (visible[1:-2] | latin[:-3]) & (visible[3:] | latin[3:])
    start[first] = True
    places = np.flatnonzero(start)
    offsets = np.append(places, len(data)).astype(np.int32)
    array = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return np.searchsorted(places, bounds), array.indices.to_numpy(), [x[1:] for x in array.dictionary.cast(pa.string()).to_pylist()]


def _interned(a: np.ndarray, b: np.ndarray, bounds_a: np.ndarray, bounds_b: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """A code for each group and the distinct groups' keys; group k has tokens bounds[k] to bounds[k + 1] of either side."""
    n_a, n_b = np.diff(bounds_a), np.diff(bounds_b)
    codes = np.zeros(len(n_a), dtype=np.int64)
    keys: list[str] = []
    # Groups of up to three tokens have a number; longer ones are compared as they are.
    for x, y in ((1, 1), (2, 1), (1, 2)):
        at = np.flatnonzero((n_a == x) & (n_b == y))
        ids = [a[bounds_a[at] + k] for k in range(x)] + [b[bounds_b[at] + k] for k in range(y)]
        number = ids[0]
        for i in ids[1:]:
            number = (number << 20) | i
        distinct, where = np.unique(number, return_inverse=True)
        codes[at] = len(keys) + where
        parts = [(distinct >> (20 * (x + y - 1 - k)) & 0xFFFFF).tolist() for k in range(x + y)]
        keys += [f"{','.join(map(str, p[:x]))}|{','.join(map(str, p[x:]))}" for p in zip(*parts, strict=True)]
    longer: dict[str, int] = {}
    for k in np.flatnonzero(n_a + n_b > 3).tolist():
        key = f"{','.join(map(str, a[bounds_a[k] : bounds_a[k + 1]].tolist()))}|{','.join(map(str, b[bounds_b[k] : bounds_b[k + 1]].tolist()))}"
        codes[k] = len(keys) + longer.setdefault(key, len(longer))
    return codes, keys + list(longer)


def _flat(bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of the runs ``which``, one run after the other, and how many each has."""
    size = np.diff(bounds)[which]
    return np.repeat(bounds[which] - cut(size)[:-1], size) + np.arange(int(size.sum())), size


def _chunk(number: int, ids: pa.Array, texts: pa.Array, pair: Pair, apart: bool) -> pa.RecordBatch:
    bounds, codes, pieces = _pieces(texts, apart)
    n = len(bounds) - 1
    (a, b), (bounds_a, bounds_b), broken = pair.tokens(pieces)
    # A text with a piece that isn't given back has no pieces.
    fine = sums(broken.astype(np.int64)[codes], bounds) == 0
    codes, bounds = codes[np.repeat(fine, np.diff(bounds))], cut(np.diff(bounds) * fine)
    # Groups and their links, once for each distinct group of the distinct pieces: both sides of a piece have the same
    # bytes, so ends in all pieces are common if they are in one.
    ends = [np.cumsum(size[x]) for size, x in zip(pair.sizes, (a, b), strict=True)]
    common = np.intersect1d(*ends, assume_unique=True)
    cuts = [np.concatenate([[0], np.searchsorted(x, common) + 1]) for x in ends]
    group_of, keys = _interned(a, b, *cuts)
    group_bounds = np.searchsorted(cuts[0], bounds_a)
    names = [keys[g] for g in group_of.tolist()]
    strings = [";".join(names[x:y]) for x, y in zip(group_bounds[:-1].tolist(), group_bounds[1:].tolist(), strict=True)]
    links = [pair.links(x) for x in keys]
    pairs, which = np.unique(np.array([x << 20 | y for z in links for x, y in z], dtype=np.int64), return_inverse=True)
    link_bounds = cut([len(x) for x in links])
    n_a, n_b = np.diff(bounds_a), np.diff(bounds_b)
    shas = [hashlib.sha256(";".join(map(strings.__getitem__, codes[x:y].tolist())).encode()).hexdigest() if x < y else "" for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    # Each document's distinct pieces, then its distinct groups, with their frequencies.
    held, times = np.unique(np.repeat(np.arange(n), np.diff(bounds)) * len(pieces) + codes, return_counts=True)
    doc, piece = np.divmod(held, max(1, len(pieces)))
    at, size = _flat(group_bounds, piece)
    held, inverse = np.unique(np.repeat(doc, size) * len(keys) + group_of[at], return_inverse=True)
    times = np.bincount(inverse, weights=np.repeat(times, size), minlength=len(held)).astype(np.int64)
    doc, code = np.divmod(held, max(1, len(keys)))
    # The distinct pairs of each document, and in how many each one is.
    at, size = _flat(link_bounds, code)
    in_doc = np.unique(np.repeat(doc, size) * len(pairs) + which[at])
    n_docs = np.bincount(in_doc % max(1, len(pairs)), minlength=len(pairs))
    doc_bounds = np.searchsorted(doc, np.arange(n + 1))
    lists = {
        "doc_ids": ids, "n_a": sums(n_a[codes], bounds), "n_b": sums(n_b[codes], bounds), "n_groups": sums(np.diff(group_bounds)[codes], bounds), "n_links": sums(np.diff(link_bounds)[code] * times, doc_bounds),
        "shas": shas, "keys": keys, "a": pairs >> 20, "b": pairs & 0xFFFFF, "n": n_docs,
    }
    blobs = {"bounds": blob(doc_bounds, np.int64), "codes": blob(code, np.int32), "times": blob(times, np.int32)}
    columns = []
    for field in _ARROW:
        if field.name in lists:
            values = lists[field.name]
            values = values if isinstance(values, pa.Array) else pa.array(values, type=_LISTS[field.name])
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], type=pa.int32()), values))
        else:
            columns.append(pa.array([number if field.name == "chunk" else blobs[field.name]], type=field.type))
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


_LISTS = {"doc_ids": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "shas": pa.string(), "keys": pa.string(), "a": pa.int32(), "b": pa.int32(), "n": pa.int32()}
_ARROW = pa.schema([(c.split()[0], pa.list_(_LISTS[c.split()[0]]) if c.split()[0] in _LISTS else pa.binary() if c.endswith("binary") else pa.int64()) for c in _CHUNK.split(", ")])


def tokenized(docs: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """The chunks of ``docs`` (doc_id, text), written."""
    files = []
    for name in (a_file, b_file):
        with open(os.path.join(folder, name), "rb") as file:
            files.append(file.read())
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(*shared.value)
        apart = pair.apart()
        for number, rows in gathered(batches):
            yield _chunk(number, rows["doc_id"].combine_chunks(), rows["text"].combine_chunks(), pair, apart)

    with small_batches(docs.sparkSession):
        return written(docs.select("doc_id", "text").mapInArrow(chunks, _CHUNK))


def lexicon(chunks: DataFrame) -> DataFrame:
    """(a, b, n_docs, best): how many documents hold an id pair linked, and if no pair of its A id is held by more."""
    pairs = written(chunks.select(F.explode(F.arrays_zip("a", "b", "n")).alias("x")).groupBy("x.a", "x.b").agg(F.sum("x.n").alias("n_docs")))
    # One row for each id of a vocabulary: at most some 50,000.
    most = pairs.groupBy("a").agg(F.max("n_docs").alias("_most"))
    out = written(pairs.join(F.broadcast(most), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("_most")).alias("best")))
    discard(pairs)
    return out


def align(docs: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """RESULT for every row of ``docs``."""
    chunks = tokenized(docs, folder, a_file, b_file)
    pairs = lexicon(chunks)
    with open(os.path.join(folder, a_file), "rb") as one, open(os.path.join(folder, b_file), "rb") as other:
        shared = docs.sparkSession.sparkContext.broadcast([one.read(), other.read()])

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(*shared.value)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            links = [pair.links(x) for x in keys]
            flat = [x for y in links for x in y]
            key = pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in links]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(key), pa.array([x for x, _ in flat], type=pa.int32()), pa.array([y for _, y in flat], type=pa.int32())], names=["key", "a", "b"])

    keys = chunks.select(F.explode("keys").alias("key")).distinct()
    weighed = keys.mapInArrow(expanded, "key string, a int, b int").join(pairs, ["a", "b"])
    groups = weighed.groupBy("key").agg(F.sum("n_docs").alias("total"), F.sum(F.col("best").cast("bigint")).alias("best"))

    def multiplied(row: dict, found: pa.Table) -> pa.Table:
        bounds, codes, times = (np.frombuffer(row[c], dtype=t) for c, t in (("bounds", np.int64), ("codes", np.int32), ("times", np.int32)))
        best, total = (found[c].to_numpy() for c in ("best", "total"))
        best, total = (sums((x[codes] if len(codes) else np.zeros(0)).astype(np.int64) * times, bounds) for x in (best, total))
        return pa.table([pa.array(row["doc_ids"], type=pa.int64()), *(pa.array(row[c], type=pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(best), pa.array(total), pa.array(row["shas"], type=pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    out = written(looked_up(chunks.drop("a", "b", "n"), groups, multiplied, RESULT))
    discard(chunks, pairs)
    return out
