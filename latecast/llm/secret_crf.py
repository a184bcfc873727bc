"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags tokens as begin, inside or outside of a secret from their shape, the words around them
and features of the whole text. It is fitted on windows around the patterns' own matches and around
other tokens with digits, in a bounded sample. Decoding is exact: a token whose preference for outside is
larger than anything transitions can gain is outside on the best path, so the path falls into short
runs between such tokens, which Viterbi decodes side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latecast.llm import memory, pieces
from latecast.llm.shared import bound_batches, whole_text

#: Fixed patterns and the least lengths of what they find.
ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "crf")

#: Rows that windows for the fit are taken from, about, drawn by a hash of their id and text; how many windows
#: are fitted at most, and how many around tokens that are no secrets each text offers.
FIT_ROWS = 16384
FIT_WINDOWS = 6000
FIT_OTHERS = 2
AROUND = 8
BUCKETS = 1 << 15
STEPS = 60
#: What a secret must be better than outside by, so that few clean tokens are tagged.
CAUTION = 1.0
SECTION = 1 << 21  # bytes of texts that are looked at together; a longer text is, too
TOKENS = 1 << 18  # tokens that are scored at once
REACH = 2  # tokens that features look at on either side
OUT, BEGIN, INSIDE = range(3)
SPANS = "array<struct<kind: string, start: int, end: int>>"
SIZES = np.array([2, 3, 6, 10, 16, 20, 24, 40])


def _table(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


_LOWER, _UPPER = _table(bytes(range(97, 123))), _table(bytes(range(65, 91)))
_DIGIT, _HEX = _table(b"0123456789"), _table(b"0123456789abcdef")
_CAPS = _UPPER | _DIGIT
_HIGH, _MARK = _table(bytes(range(128, 256))), _table(b"+/_.-")
_KIND = np.where(_LOWER | _UPPER | _DIGIT | _HIGH | _MARK, 1, 2).astype(np.uint8)
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0


def _runs(flags: np.ndarray, limits: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Longest runs of set flags that cross no text limit, of ``least`` bytes or more."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[limits] = True
    before = np.concatenate([[False], flags[:-1]])
    after = np.concatenate([flags[1:], [False]])
    starts = np.flatnonzero(flags & (~before | edge[:-1]))
    ends = np.flatnonzero(flags & (~after | edge[1:])) + 1
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def base_spans(data: np.ndarray, limits: np.ndarray) -> list[tuple[int, str, int, int, int]]:
    """(text, kind, start, end, start of the secret itself) of all fixed patterns, in bytes of ``data``."""
    found = []
    text_of = lambda at: int(np.searchsorted(limits, at, side="right")) - 1
    for start, end in _runs(_HEX[data], limits, HEX_LEAST):
        found.append((text_of(start), "hex", start, end, start))
    for start, end in _runs(_CAPS[data], limits, ACCESS_LEAST):
        at = data[start:end].tobytes().find(b"AKIA")
        if at >= 0 and end - start - at >= ACCESS_LEAST:
            found.append((text_of(start), "access", start + at, end, start + at))
    lower = (data | ((data >= 65) & (data <= 90)).astype(np.uint8) << 5).tobytes()
    named = set()
    for word in KEYWORDS:
        at = lower.find(word)
        while at >= 0:
            text = text_of(at)
            named.add(text)
            at = lower.find(word, int(limits[text + 1]) - len(word) + 1)
    for text in named:
        low = int(limits[text])
        for match in ASSIGN.finditer(data[low:int(limits[text + 1])].tobytes()):
            if match.end(2) - match.start(2) >= ASSIGN_LEAST:
                found.append((text, "assign", low + match.start(), low + match.end(), low + match.start(2)))
    return sorted(found, key=lambda x: (x[0], x[2], KINDS.index(x[1])))


def _files(data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Of each text: its length, and how much of it is digits."""
    sums = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int64)])
    size = np.diff(limits)
    share = np.searchsorted([0.005, 0.02, 0.1], (sums[limits[1:]] - sums[limits[:-1]]) / np.maximum(1, size))
    return (share * 8 + np.searchsorted([200, 1000, 5000, 50000], size)).astype(np.uint64)


class Tokens:
    """Tokens of several texts and their features."""

    def __init__(self, data: np.ndarray, limits: np.ndarray) -> None:
        kind = _KIND[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[limits] = True
        change = np.concatenate([[True], kind[1:] != kind[:-1]]) | edge[:-1]
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], len(data))
        some = kind[starts] != 0
        self.starts, self.ends = starts[some], ends[some]
        self.texts = np.searchsorted(limits, self.starts, side="right") - 1
        self.data = data
        self.word = kind[self.starts] == 1
        self.files = _files(data, limits)  # by text

    def part(self, first: int, last: int) -> Tokens:
        """Some tokens with what belongs to them; the features of whole texts stay."""
        out = object.__new__(Tokens)
        low, high = int(self.starts[first]), int(self.ends[last - 1])
        out.starts, out.ends = self.starts[first:last] - low, self.ends[first:last] - low
        out.texts, out.word = self.texts[first:last], self.word[first:last]
        out.data, out.files = self.data[low:high], self.files
        return out

    def features(self) -> np.ndarray:
        """Hashed features, one row a kind of feature."""
        data, starts, ends = self.data, self.starts, self.ends
        size = ends - starts

        def count(table: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
            return sums[ends] - sums[starts]

        digits = count(_DIGIT)
        flips = np.concatenate([[0], np.cumsum(_DIGIT[data][1:] != _DIGIT[data][:-1], dtype=np.int32), [0]])
        flips = np.minimum(flips[ends - 1] - flips[starts], 4) // 2 + (flips[ends - 1] > flips[starts])
        length = np.searchsorted(SIZES, size, side="right")
        parts = [count(_LOWER) > 0, count(_UPPER) > 0, digits > 0, count(_HIGH) > 0, count(_MARK) > 0,
                 self.word, count(_HEX) == size, count(_CAPS) == size]
        shape = np.zeros(len(size), np.uint64)
        for part in parts:
            shape = shape * np.uint64(2) + part
        shape = (shape * np.uint64(10) + length.astype(np.uint64)) * np.uint64(4) + flips.astype(np.uint64)
        lower = data | ((data >= 65) & (data <= 90)).astype(np.uint8) << 5
        keys = pieces.short_keys(lower, starts, size)
        name = np.zeros(len(size), np.uint64)
        for i in range(keys.shape[1]):
            name = pieces.mixed(name + keys[:, i] + np.uint64(i + 1))
        prefix = pieces.mixed(keys[:, 0] & np.uint64(0xFFFFFFFF)) ^ length.astype(np.uint64)
        name = np.where(digits > 0, np.uint64(1), name)  # what may be secret is not learnt by heart
        before, before2 = self._shifted(name, 1), self._shifted(name, 2)
        after, shape_before = self._shifted(name, -1), self._shifted(shape, 1)
        file = self.files[self.texts]
        return np.stack([
            self._bucket(0, shape), self._bucket(1, name), self._bucket(2, shape, before),
            self._bucket(3, before), self._bucket(4, before, before2), self._bucket(5, after),
            self._bucket(6, shape, file), self._bucket(7, prefix), self._bucket(8, shape, shape_before),
        ])

    def _shifted(self, values: np.ndarray, by: int) -> np.ndarray:
        """The value of the token ``by`` places before, zero beyond the text."""
        out = np.zeros_like(values)
        if by > 0:
            same = self.texts[by:] == self.texts[:-by]
            out[by:][same] = values[:-by][same]
        else:
            same = self.texts[:by] == self.texts[-by:]
            out[:by][same] = values[-by:][same]
        return out

    @staticmethod
    def _bucket(kind: int, *values: np.ndarray) -> np.ndarray:
        out = np.full(len(values[0]), kind + 1, np.uint64)
        for value in values:
            out = pieces.mixed(out * np.uint64(0x9E3779B97F4A7C15) + value)
        return (out % np.uint64(BUCKETS)).astype(np.int32)

    def tags(self, spans: list[tuple[int, str, int, int, int]]) -> np.ndarray:
        """Begin and inside for the tokens of the spans' secrets."""
        out = np.zeros(len(self.starts), np.int8)
        for _, _, _, end, start in spans:
            first = int(np.searchsorted(self.ends, start, side="right"))
            last = int(np.searchsorted(self.starts, end, side="left"))
            out[first:last] = INSIDE
            out[first:first + 1] = BEGIN
        return out


def viterbi(scores: np.ndarray, moves: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Best tags of all tokens; a text's first and last tokens have outside beyond them."""
    size = len(scores)
    best = np.zeros(size, np.int8)
    if not size:
        return best
    gain = max(
        moves[a, y] + moves[y, b] - moves[a, OUT] - moves[OUT, b]
        for a in range(3) for y in (BEGIN, INSIDE) for b in range(3)
    )
    open_ = scores[:, OUT] - scores[:, 1:].max(axis=1) <= gain
    if not open_.any():
        return best
    begins = open_ & np.concatenate([[True], ~open_[:-1] | (texts[1:] != texts[:-1])])
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(open_ & np.concatenate([begins[1:] | ~open_[1:], [True]])) + 1
    order = np.argsort(starts - ends, kind="stable")  # the longest first
    starts, lengths = starts[order], (ends - starts)[order]
    state = moves[OUT][None, :] + scores[starts]
    back = []
    for step in range(1, int(lengths[0])):
        n = int(np.searchsorted(-lengths, -step, side="left"))  # runs longer than this step
        options = state[:n, :, None] + moves[None]
        from_ = options.argmax(axis=1)
        back.append(from_)
        state[:n] = np.take_along_axis(options, from_[:, None, :], axis=1)[:, 0] + scores[starts[:n] + step]
    tag = (state + moves[:, OUT][None, :]).argmax(axis=1)
    for step in range(int(lengths[0]) - 1, 0, -1):
        n = len(back[step - 1])
        best[starts[:n] + step] = tag[:n]
        tag[:n] = back[step - 1][np.arange(n), tag[:n]]
    best[starts] = tag
    return best


def fit(features: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, moves) of largest conditional likelihood over windows, by gradient steps.

    ``features`` is window x token x kind, ``tags`` window x token, ``lengths`` the windows' tokens.
    """
    weights, moves = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
    n, most = tags.shape
    if not n:
        weights[:, 1:] = -1.0
        return weights, moves
    inside = np.arange(most)[None, :] < lengths[:, None]
    truth = np.eye(3)[tags] * inside[..., None]
    pairs = np.zeros((3, 3))
    follow = inside[:, 1:]
    np.add.at(pairs, (tags[:, :-1][follow], tags[:, 1:][follow]), 1)
    np.add.at(pairs, (np.zeros(n, int), tags[:, 0]), 1)
    np.add.at(pairs, (tags[np.arange(n), lengths - 1], np.zeros(n, int)), 1)
    squares, move_squares = np.full((BUCKETS, 3), 1e-6), np.full((3, 3), 1e-6)
    flat = features.reshape(n * most, -1)
    last = np.arange(n), lengths - 1
    for _ in range(STEPS):
        scores = weights[flat].sum(axis=1).reshape(n, most, 3)
        alpha, beta = np.zeros((n, most, 3)), np.zeros((n, most, 3))
        alpha[:, 0] = scores[:, 0] + moves[OUT]
        for t in range(1, most):
            step = _logsum(alpha[:, t - 1, :, None] + moves[None], 1) + scores[:, t]
            alpha[:, t] = np.where(inside[:, t, None], step, alpha[:, t - 1])
        beta[last] = moves[:, OUT]
        for t in range(most - 2, -1, -1):
            step = _logsum(moves[None] + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where((t < lengths - 1)[:, None], step, beta[:, t])
        total = _logsum(alpha[last] + moves[:, OUT][None], 1)
        chance = np.exp(alpha + beta - total[:, None, None]) * inside[..., None]
        joint = np.exp(alpha[:, :-1, :, None] + moves[None, None]
                       + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
        expected = (joint * follow[..., None, None]).sum(axis=(0, 1))
        expected[OUT] += chance[:, 0].sum(axis=0)
        expected[:, OUT] += chance[last].sum(axis=0)
        error = (chance - truth).reshape(n * most, 3)
        slope = np.stack([
            np.bincount(flat.ravel(), np.repeat(error[:, y], flat.shape[1]), minlength=BUCKETS)
            for y in range(3)
        ], axis=1) + 0.05 * weights
        squares += slope**2
        weights -= 0.3 * slope / np.sqrt(squares)
        slope = expected - pairs + 0.05 * moves
        move_squares += slope**2
        moves -= 0.3 * slope / np.sqrt(move_squares)
    return weights, moves


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def _windows_of(tokens: Tokens, tags: np.ndarray) -> Iterator[tuple[int, int]]:
    """Token ranges around every secret, around ``FIT_OTHERS`` other tokens with digits of each text, and one at
    the beginning of a text without secrets."""
    sums = np.concatenate([[0], np.cumsum(_DIGIT[tokens.data])])
    digits = sums[tokens.ends] > sums[tokens.starts]
    firsts = np.searchsorted(tokens.texts, np.arange(len(tokens.files) + 1))
    for low, high in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if low == high:
            continue
        secret = np.flatnonzero(tags[low:high] == BEGIN)
        other = np.flatnonzero(digits[low:high] & (tags[low:high] == OUT))[:FIT_OTHERS]
        for at in (*secret, *other, *([0] if not len(secret) else [])):
            yield max(low, low + int(at) - AROUND), min(high, low + int(at) + AROUND + 1)


@memory.tidy
def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buffer, offsets = pieces.text_buffer(batch.column(1))
        keys = batch.column(0).to_numpy()
        for first, last in pieces.slices(batch, offsets, SECTION):
            data = buffer[offsets[first]:offsets[last]]
            limits = offsets[first:last + 1] - offsets[first]
            tokens = Tokens(data, limits)
            tags = tokens.tags(base_spans(data, limits))
            if not len(tags):
                continue
            found = tokens.features()
            windows = list(_windows_of(tokens, tags))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(keys[first + tokens.texts[a]]) for a, _ in windows], pa.int64()),
                 pa.array([bool((tags[a:b] != OUT).any()) for a, b in windows], pa.bool_()),
                 pa.array([tags[a:b].astype(np.int32) for a, b in windows], pa.list_(pa.int32())),
                 pa.array([found[:, a:b].T.ravel() for a, b in windows], pa.list_(pa.int32()))],
                ["key", "secret", "tags", "features"],
            )


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          fit_rows: int = FIT_ROWS, fit_windows: int = FIT_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves of the field, fitted on at most ``fit_windows`` windows from about ``fit_rows``
    rows: all with secrets first, then others, both in the order of a hash of id and text.

    Rows without id are drawn by their text; null and empty texts offer no window, and without any window the
    field tags nothing. Very long texts offer a window for each secret like any other. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.xxhash64(F.col(id_col), whole_text(text_col), F.lit("crf")).alias("key"), whole_text(text_col).alias("text"))
    total = rows.count()
    if total > fit_rows:
        rows = rows.where(F.pmod("key", F.lit(1 << 32)) < int((1 << 32) * fit_rows / total))
    found = rows.mapInArrow(
        _samples, "key long, secret boolean, tags array<int>, features array<int>"
    ).orderBy(F.desc("secret"), "key", "tags", "features").limit(fit_windows).collect()
    most = 2 * AROUND + 1
    kinds = len(found[0]["features"]) // len(found[0]["tags"]) if found else 1
    tags = np.zeros((len(found), most), np.int64)
    features = np.zeros((len(found), most, kinds), np.int64)
    lengths = np.array([len(r["tags"]) for r in found], np.int64)
    for i, row in enumerate(found):
        tags[i, :lengths[i]] = row["tags"]
        features[i, :lengths[i]] = np.reshape(row["features"], (lengths[i], kinds))
    weights, moves = fit(features, tags, lengths)
    return weights.astype(np.float32), moves


def spans_of(data: np.ndarray, limits: np.ndarray, weights: np.ndarray, moves: np.ndarray
             ) -> list[list[tuple[str, int, int]]]:
    """Each text's spans (kind, start, end) in code points: the patterns' own and what the field adds."""
    base = base_spans(data, limits)
    found = [(text, kind, start, end) for text, kind, start, end, _ in base]
    taken = np.zeros(len(data) + 1, bool)
    for _, _, start, end, _ in base:
        taken[start:end] = True
    tokens = Tokens(data, limits)
    size = len(tokens.starts)
    scores = np.zeros((size, 3), np.float32)
    for first in range(0, size, TOKENS):
        last = min(size, first + TOKENS)
        low = max(0, first - REACH)
        for row in tokens.part(low, min(size, last + REACH)).features():
            scores[first:last] += weights[row[first - low:last - low]]
    scores[:, 1:] -= CAUTION
    tags = viterbi(scores.astype(np.float64), moves, tokens.texts)
    if size:
        before = np.concatenate([[True], (tags[:-1] == OUT) | (tokens.texts[1:] != tokens.texts[:-1])])
        for first in np.flatnonzero((tags != OUT) & ((tags == BEGIN) | before)).tolist():
            last = first
            while (last + 1 < size and tags[last + 1] == INSIDE
                   and tokens.texts[last + 1] == tokens.texts[first]):
                last += 1
            start, end = int(tokens.starts[first]), int(tokens.ends[last])
            if not taken[start:end].any():
                found.append((int(tokens.texts[first]), "crf", start, end))
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(limits) - 1)]
    if found:
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        for text, kind, start, end in sorted(found, key=lambda x: (x[0], x[2], KINDS.index(x[1]))):
            zero = points[limits[text]]
            out[text].append((kind, int(points[start] - zero), int(points[end] - zero)))
    return out


def _scan(weights: np.ndarray, moves: np.ndarray, names: list[str], text_at: int):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buffer, offsets = pieces.text_buffer(batch.column(text_at))
            for first, last in pieces.slices(batch, offsets, SECTION):
                data = buffer[offsets[first]:offsets[last]]
                spans = spans_of(data, offsets[first:last + 1] - offsets[first], weights, moves)
                listed = pa.array(
                    [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], kind
                )
                part = batch.slice(first, last - first)
                others = [part.column(i) for i in range(batch.num_columns) if i != text_at]
                yield pa.RecordBatch.from_arrays([*others, listed], names)

    return memory.tidy(run)


def scan(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], *, text_col: str = "text",
         spans_col: str = "spans") -> DataFrame:
    """The other columns and the spans of every whole text: kind, start, end (code points).

    Pattern spans of different kinds may overlap; the field's (kind ``crf``) overlap none of them. Null
    and empty texts have none. Repeated rows get the same spans. A column named like ``spans_col`` is
    replaced. Very long texts are tagged whole: their tokens are scored part by part with their neighbours, and
    decoded together. No rows give no rows.
    """
    weights, moves = model
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text_col, spans_col)]
    rows = docs.select(*kept, whole_text(text_col).alias(spans_col))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(
        _scan(weights, moves, rows.columns, len(kept)), f"{kinds}`{spans_col}` {SPANS}"
    )
