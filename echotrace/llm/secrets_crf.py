"""Secret scan with a linear-chain conditional random field.

Three base patterns give spans that always stay. The field tags every token of every text as outside, beginning or
inside a secret, from the token's shape, its neighbours and the file it is in, and Viterbi decoding adds the spans that
the patterns miss. It learns from the values that the patterns find in a bounded sample of texts, seen by their shape
alone, so it knows them by form and not by prefix.

Texts are tokenised, scored and decoded by the batch on arrays of bytes, in the tasks that read them; nothing is
shuffled. A token whose own score for "outside" beats any gain that its neighbours could give is outside in the best
path, so decoding runs exactly and only between such tokens.

Nulls: a null text is an empty one and has no spans. Repeated rows each get a row; equal texts get equal spans. Of paths that tie the
one with the lower tag is taken. A very long text is tagged whole; it needs some hundred bytes of memory for each of its bytes. An
empty table gives an empty result. Extra columns don't matter. Starts and ends count code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ["assign", "access", "hex", "secret"]
#: Least characters of a value, by kind.
LEAST = {"assign": 8, "access": 16, "hex": 32, "secret": 8}

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
SPACE, LOWER, UPPER, DIGIT, JOINER, FOREIGN, EQUALS, COLON, QUOTE, MARK = range(10)
#: Four-letter beginnings of words that announce a secret.
ANNOUNCE = [b"pass", b"pwd\x20", b"secr", b"toke", b"apik", b"api_", b"auth", b"bear", b"cred", b"key\x20"]


def _classes() -> np.ndarray:
    out = np.full(256, MARK, dtype=np.uint8)
    out[: 0x21] = SPACE
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = LOWER, UPPER, DIGIT
    out[128:] = FOREIGN
    for chars, kind in (("+/_.-", JOINER), ("=", EQUALS), (":", COLON), ("\"'`", QUOTE)):
        out[[ord(c) for c in chars]] = kind
    return out


CLASS = _classes()
#: Number of values of each feature; the offsets place them in one table of weights.
SIZES = {"kind": 5, "length": 8, "digits": 5, "capitals": 4, "changes": 4, "length_changes": 32, "hexadecimal": 2, "foreign": 2, "announced": 2, "before": 6, "before_2": 6, "after": 6, "near_announced": 2, "file": 3, "length_digits": 40}
OFFSETS = dict(zip(SIZES, np.cumsum([0, *SIZES.values()])[:-1].tolist(), strict=True))
N_WEIGHTS = sum(SIZES.values())
CHANGES, LENGTH = list(SIZES).index("changes"), list(SIZES).index("length")


class Tokens:
    """The tokens of a run of texts: where they start and end in the bytes, their text, and their features."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        n = len(data)
        kind = CLASS[data]
        word = (kind >= LOWER) & (kind <= FOREIGN)
        first = np.zeros(n + 1, dtype=bool)
        first[bounds] = True  # a text's first byte never continues the token before it
        joined = np.zeros(n + 1, dtype=bool)
        joined[1:n] = word[1:] & word[:-1]
        joined &= ~first
        solid = kind != SPACE
        self.start = np.flatnonzero(solid & ~joined[:n]).astype(np.int64)
        self.end = np.flatnonzero(solid & ~joined[1:]).astype(np.int64) + 1
        self.text = np.searchsorted(bounds, self.start, side="right") - 1
        self.features = self._features(data, kind, bounds)

    def _features(self, data: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        start, end = self.start, self.end
        n = len(start)

        def count(mask: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
            return sums[end] - sums[start]

        size = (end - start).astype(np.int32)
        digits, capitals = count(kind == DIGIT), count(kind == UPPER)
        foreign = count(kind == FOREIGN)
        lower = data | 0x20
        hexa = count((kind == DIGIT) | ((lower >= ord("a")) & (lower <= ord("f")) & (kind <= UPPER)))
        turn = np.zeros(len(data), dtype=bool)
        turn[1:] = (kind[1:] == DIGIT) != (kind[:-1] == DIGIT)
        changes = count(turn) - (turn[start] if n else 0)
        length = np.digitize(size, [4, 8, 12, 16, 20, 32, 40])
        share = digits / np.maximum(size, 1)
        digit_bin = np.where(digits == 0, 0, 1 + np.digitize(share, [0.2, 0.5, 0.8]))
        change_bin = np.digitize(changes, [1, 3, 6])
        shape = np.array([0, 0, 0, 0, 0, 0, 1, 2, 3, 4])[kind[start]] if n else np.zeros(0, dtype=int)
        padded = np.concatenate([data, np.full(4, 0x20, dtype=np.uint8)]) | 0x20
        reach = np.minimum(size, 4)
        head = np.zeros(n, dtype=np.uint32)
        for k in range(4):
            head |= np.where(reach > k, padded[start + k], 0x20).astype(np.uint32) << np.uint32(8 * k)
        announced = np.isin(head, np.frombuffer(b"".join(ANNOUNCE), dtype="<u4")) & (shape == 0) & (size <= 16) & (digits == 0)

        def shifted(values: np.ndarray, by: int, edge: int) -> np.ndarray:
            out = np.full(n, edge, dtype=values.dtype)
            if by > 0:
                out[by:] = values[:-by]
                out[by:][self.text[by:] != self.text[:-by]] = edge
            else:
                out[:by] = values[-by:]
                out[:by][self.text[:by] != self.text[-by:]] = edge
            return out

        near = np.zeros(n, dtype=bool)
        for by in (1, 2, 3, 4):
            if n > by:
                near |= shifted(announced, by, False)
        # Of the file: how much of it is neither letters nor spaces.
        odd = np.concatenate([[0], np.cumsum(kind >= DIGIT, dtype=np.int64) - np.cumsum(kind == FOREIGN, dtype=np.int64)])
        sizes = np.maximum(np.diff(bounds), 1)
        file = np.digitize((odd[bounds[1:]] - odd[bounds[:-1]]) / sizes, [0.05, 0.2])
        columns = {
            "kind": shape, "length": length, "digits": digit_bin, "capitals": np.where(capitals == 0, 0, np.where(capitals == 1, 1, np.where(2 * capitals <= size, 2, 3))),
            "changes": change_bin, "length_changes": length * 4 + change_bin, "hexadecimal": (hexa == size) & (digits > 0) & (size >= 8), "foreign": foreign > 0, "announced": announced,
            "before": shifted(shape, 1, 5) if n > 1 else np.full(n, 5), "before_2": shifted(shape, 2, 5) if n > 2 else np.full(n, 5), "after": shifted(shape, -1, 5) if n > 1 else np.full(n, 5),
            "near_announced": near, "file": file[self.text] if n else np.zeros(0, dtype=int), "length_digits": length * 5 + digit_bin,
        }
        return np.stack([columns[k].astype(np.int16) + OFFSETS[k] for k in SIZES], axis=1) if n else np.zeros((0, len(SIZES)), dtype=np.int16)


def emissions(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((*features.shape[:-1], 3), dtype=np.float32)
    for k in range(features.shape[-1]):
        out += weights[features[..., k]]
    return out


def fit(features: np.ndarray, tags: np.ndarray, mask: np.ndarray, rounds: int = 120, rate: float = 0.15, shrink: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (values x 3) and transitions (3 x 3) that maximise the likelihood of the tags of padded windows.

    ``features`` is windows x length x features, ``tags`` and ``mask`` windows x length. Gradients are exact, from
    forward and backward sums; steps are Adam's.
    """
    n, length = tags.shape
    theta = np.zeros(N_WEIGHTS * 3 + 9)
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    gold = np.zeros((n, length, 3))
    np.put_along_axis(gold, tags[..., None], mask[..., None].astype(float), axis=2)
    both = mask[:, 1:] & mask[:, :-1]
    gold_pairs = np.einsum("nti,ntj,nt->ij", gold[:, :-1], gold[:, 1:], both.astype(float))
    flat = features.reshape(-1, features.shape[-1])

    def by_value(p: np.ndarray) -> np.ndarray:
        p = p.reshape(-1, 3)
        return np.stack([sum(np.bincount(flat[:, k], weights=p[:, t], minlength=N_WEIGHTS) for k in range(flat.shape[1])) for t in range(3)], axis=1)

    gold_values = by_value(gold)
    tokens = max(1, int(mask.sum()))
    for step in range(1, rounds + 1):
        weights, moves = theta[: N_WEIGHTS * 3].reshape(-1, 3), theta[N_WEIGHTS * 3 :].reshape(3, 3)
        e = emissions(features, weights.astype(np.float32)).astype(float)
        forward, backward = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        forward[:, 0] = e[:, 0]
        for t in range(1, length):
            x = forward[:, t - 1, :, None] + moves
            top = x.max(axis=1)
            forward[:, t] = np.where(mask[:, t, None], e[:, t] + top + np.log(np.exp(x - top[:, None]).sum(axis=1)), forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            x = moves + (e[:, t + 1] + backward[:, t + 1])[:, None, :]
            top = x.max(axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], top + np.log(np.exp(x - top[:, :, None]).sum(axis=2)), 0.0)
        last = forward[:, -1]
        top = last.max(axis=1)
        z = top + np.log(np.exp(last - top[:, None]).sum(axis=1))
        p = np.exp(forward + backward - z[:, None, None]) * mask[..., None]
        pairs = np.zeros((3, 3))
        for t in range(1, length):
            x = forward[:, t - 1, :, None] + moves + (e[:, t] + backward[:, t])[:, None, :] - z[:, None, None]
            pairs += (np.exp(x) * both[:, t - 1, None, None]).sum(axis=0)
        slope = np.concatenate([((by_value(p) - gold_values) / tokens).ravel(), ((pairs - gold_pairs) / tokens).ravel()]) + shrink * theta
        moment, square = 0.9 * moment + 0.1 * slope, 0.999 * square + 0.001 * slope * slope
        theta -= rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return theta[: N_WEIGHTS * 3].reshape(-1, 3).astype(np.float32), theta[N_WEIGHTS * 3 :].reshape(3, 3).astype(np.float32)


def decode(e: np.ndarray, text: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of each text's tokens, by Viterbi between tokens that are outside whatever their neighbours are.

    A text's ends count as outside.
    """
    n = len(e)
    tags = np.zeros(n, dtype=np.int8)
    if not n:
        return tags
    gain = max(moves[p, s] + moves[s, q] - moves[p, 0] - moves[0, q] for s in (1, 2) for p in range(3) for q in range(3))
    open_ = np.flatnonzero(e[:, 0] - np.maximum(e[:, 1], e[:, 2]) <= gain)
    if not len(open_):
        return tags
    new = np.ones(len(open_), dtype=bool)
    new[1:] = (np.diff(open_) > 1) | (text[open_[1:]] != text[open_[:-1]])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(open_)))
    order = np.argsort(-length, kind="stable")
    begin, length = open_[begin[order]], length[order]  # the longest first: those still running are a prefix
    score = e[begin] + moves[0]
    came: list[np.ndarray] = []
    for t in range(1, int(length[0])):
        on = int(np.searchsorted(-length, -t, side="left"))  # runs longer than t
        x = score[:on, :, None] + moves
        came.append(x.argmax(axis=1).astype(np.int8))
        score[:on] = x.max(axis=1) + e[begin[:on] + t]
    at = (score + moves[:, 0]).argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        on = int(np.searchsorted(-length, -t, side="left"))
        tags[begin[:on] + t] = at[:on]
        if t:
            at[:on] = came[t - 1][np.arange(on), at[:on]]
    return tags


def base_spans(text: str, hexes: bool = True) -> list[tuple[int, int, str, int]]:
    """(start, kind's number, end, start of the value) of the base patterns. ``hexes``: whether a long hex run may be there."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if hexes:
        out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out)


def _runs(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``most`` bytes of text: first row, row after the last, bytes, bounds of the texts."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _has_hex(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts hold a run of hex digits as long as a base span must be."""
    hexa = ((data >= ord("0")) & (data <= ord("9"))) | ((data >= ord("a")) & (data <= ord("f")))
    first = np.zeros(len(data) + 1, dtype=bool)
    first[bounds] = True  # a run never goes on into the next text
    begins, stops = hexa.copy(), hexa.copy()
    begins[1:] &= ~hexa[:-1] | first[1:-1]
    stops[:-1] &= ~hexa[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    out = np.zeros(len(bounds) - 1, dtype=bool)
    out[np.searchsorted(bounds, start[end - start >= LEAST["hex"]], side="right") - 1] = True
    return out


def _byte(text: str, at: int) -> int:
    return len(text[:at].encode())


def _windows(length: int, each: int):
    """Windows of features and tags around base spans and, as many, elsewhere."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[bytes, bytes, bool]] = []
            for i, j, data, bounds in _runs(batch.column(0)):
                tokens, hexes = Tokens(data, bounds), _has_hex(data, bounds)
                tags = np.zeros(len(tokens.start), dtype=np.int8)
                middles = []
                for k in range(i, j):
                    text = batch.column(0)[k].as_py() or ""
                    for _, _, end, value in base_spans(text, bool(hexes[k - i])):
                        low, high = bounds[k - i] + _byte(text, value), bounds[k - i] + _byte(text, end)
                        inside = np.flatnonzero((tokens.start < high) & (tokens.end > low))
                        tags[inside] = INSIDE
                        tags[inside[:1]] = BEGIN
                        middles.append((int(inside[0]), True))
                quiet = np.flatnonzero(tags == 0)
                middles += [(int(x), False) for x in quiet[:: max(1, len(quiet) // (each * (j - i)))]]
                for m, hit in middles:
                    low = max(0, m - length // 2)
                    pick = np.arange(low, min(len(tags), low + length))
                    pick = pick[tokens.text[pick] == tokens.text[m]]
                    # A token that looks drawn at random though no pattern covers it is no proof of an outside one.
                    shape = tokens.features[pick]
                    unknown = (tags[pick] == 0) & (shape[:, CHANGES] >= OFFSETS["changes"] + 2) & (shape[:, LENGTH] >= OFFSETS["length"] + 2)
                    if unknown.any():
                        continue
                    rows.append((tokens.features[pick].tobytes(), tags[pick].tobytes(), hit))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.binary(), pa.binary(), pa.bool_()))], names=["features", "tags", "hit"])

    return of


def train(docs: DataFrame, id_col: str, text_col: str, *, sample: int = 20_000, windows: int = 600, length: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Fit the field on about ``sample`` texts (those with the lowest hash of the id), of which at most ``windows``
    windows with a base span and as many without reach the driver, each of ``length`` tokens."""
    n = docs.count()
    if n > sample:
        # Some more or fewer than ``sample`` by chance; a null id is drawn by its text.
        docs = docs.where(F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text_col))), 2) < int(2**62 * (sample / n)))
    seen = written(docs.select(F.col(text_col)).mapInArrow(_windows(length, 1), "features binary, tags binary, hit boolean"))
    got = [r for hit in (True, False) for r in seen.where(F.col("hit") == hit).orderBy(F.xxhash64("features"), "features").limit(windows).collect()]
    discard(seen)
    if not got:
        return np.zeros((N_WEIGHTS, 3), dtype=np.float32) - np.array([0, 20, 20], dtype=np.float32), np.zeros((3, 3), dtype=np.float32)
    features, tags, mask = np.zeros((len(got), length, len(SIZES)), dtype=np.int16), np.zeros((len(got), length), dtype=np.int64), np.zeros((len(got), length), dtype=bool)
    for k, r in enumerate(got):
        t = np.frombuffer(r["tags"], dtype=np.int8)
        features[k, : len(t)] = np.frombuffer(r["features"], dtype=np.int16).reshape(len(t), -1)
        tags[k, : len(t)], mask[k, : len(t)] = t, True
    hits = np.array([r["hit"] for r in got])
    return fit(np.concatenate([features, _unannounced(features[hits], tags[hits])]), np.concatenate([tags, tags[hits]]), np.concatenate([mask, mask[hits]]))


def _unannounced(features: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """The windows as if no word announced their secrets and nothing led up to them, and with values in the other case."""
    out = features.copy()
    at = {name: list(SIZES).index(name) for name in SIZES}
    for name in ("announced", "near_announced"):
        out[..., at[name]] = OFFSETS[name]
    first = tags == BEGIN
    for name in ("before", "before_2", "after"):
        out[..., at[name]] = np.where(first, OFFSETS[name], out[..., at[name]])
    capitals = out[..., at["capitals"]] - OFFSETS["capitals"]
    out[..., at["capitals"]] = np.where(first, OFFSETS["capitals"] + np.where(capitals == 0, 2, 0), out[..., at["capitals"]])
    return out


def _tagger(weights: np.ndarray, moves: np.ndarray, sure: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[tuple[int, int, int]]] = []
            for i, j, data, bounds in _runs(batch.column(1)):
                tokens, hexes = Tokens(data, bounds), _has_hex(data, bounds)
                e = emissions(tokens.features, weights)
                e[:, OUTSIDE] += sure
                tags = decode(e, tokens.text, moves)
                hit = np.flatnonzero(tags)
                head = np.ones(len(hit), dtype=bool)
                head[1:] = (np.diff(hit) > 1) | (tags[hit[1:]] == BEGIN) | (tokens.text[hit[1:]] != tokens.text[hit[:-1]])
                firsts = np.flatnonzero(head)
                lasts = np.append(firsts[1:], len(hit)) - 1
                more: dict[int, list[tuple[int, int]]] = {}
                for a, b in zip(hit[firsts], hit[lasts], strict=True) if len(hit) else ():
                    k = int(tokens.text[a])
                    more.setdefault(k, []).append((int(tokens.start[a] - bounds[k]), int(tokens.end[b] - bounds[k])))
                for k in range(i, j):
                    text = batch.column(1)[k].as_py() or ""
                    base = base_spans(text, bool(hexes[k - i]))
                    found = [(s, kind, end) for s, kind, end, _ in base]
                    if k - i in more:
                        raw = text.encode()
                        for a, b in more[k - i]:
                            s = len(raw[:a].decode(errors="replace"))
                            end = s + len(raw[a:b].decode(errors="replace"))
                            if end - s >= LEAST["secret"] and not any(x < end and s < y for x, _, y, _ in base):
                                found.append((s, 3, end))
                    out.append(sorted(found))
            lines = [[f"{KINDS[k]}:{s}:{e}" for s, k, e in f] for f in out]
            base = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in f if k < 3) for f in out]
            counts = [pa.array([sum(x[1] == k for x in f) for f in out], type=pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], type=pa.string()), pa.array([",".join(x) for x in lines], type=pa.string())], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return of


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sure: float = 1.5, **training) -> DataFrame:
    """Id, a count for each base kind, ``base_sha256`` and ``spans`` of each row.

    ``sure`` is added to the score of "outside": how many nats better the path through a secret must be.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    weights, moves = train(rows, "id", "text", **training)
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_tagger(weights, moves, sure), f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)
