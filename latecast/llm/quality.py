"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every document. Expectation-maximisation over the
counts of vote patterns, which are exact and few, estimates how each heuristic votes on good and on bad
documents. The posteriors label a bounded sample, on which a linear scorer over hashed word features is
fitted; the scorer then judges every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latecast.llm import memory, pieces
from latecast.llm.shared import bound_batches, whole_text

#: Rows the scorer is fitted on, about: rows are drawn by a hash of their id and text.
FIT_ROWS = 4096
FIT_MOST = 2  # times as many at most: equal rows are drawn together
BUCKETS = 1 << 13
STEPS = 120
EM_ROUNDS = 100
THRESHOLD = 0.5
SHRINK = 8  # words that speak for nothing: a few odd ones do not condemn a short text
SPECIAL = b"#$%&*@^~<>{}[]\\"
#: (feature, bad from, good up to): a vote between the two is nothing; None never votes good.
HEURISTICS = (
    ("upper", 0.5, None), ("special", 0.3, None), ("bars", 0.1, None), ("exclaims", 0.3, None),
    ("repeats", 0.3, None), ("digits", 0.5, None), ("long", 0.3, None), ("prose", None, 0.2),
)


def _member(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_UPPER = _member(bytes(range(65, 91)))
_LETTER = _member(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_DIGIT = _member(b"0123456789")
_SPECIAL = _member(SPECIAL)


class Words:
    """What the words of one window look like."""

    def __init__(self, block: np.ndarray, starts: np.ndarray, lengths: np.ndarray, texts: np.ndarray,
                 last: tuple[int, np.uint64, np.uint64]) -> None:
        ends = starts + lengths

        def count(table: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(table[block])])
            return sums[ends] - sums[starts]

        self.texts, self.lengths = texts, lengths
        self.upper, self.letters = count(_UPPER), count(_LETTER)
        self.digits, self.special = count(_DIGIT), count(_SPECIAL)
        self.bar = (lengths == 1) & (block[starts] == ord("|"))
        self.exclaim = (lengths > 1) & (block[ends - 1] == ord("!")) & (
            block[np.maximum(ends - 2, 0)] == ord("!"))
        self.stop = np.isin(block[ends - 1], np.frombuffer(b".?!,;:", np.uint8))
        self.hashes = pieces.word_hashes(block, starts, lengths)
        earlier = np.concatenate([np.array([last[1]], np.uint64), self.hashes[:-1]])
        same_text = np.concatenate([[last[0]], texts[:-1]]) == texts
        self.repeat = same_text & (earlier == self.hashes)
        self.same_text = same_text
        self.shape_before = last[2]
        self.shape = self.shapes().astype(np.uint64)
        self.last = (int(texts[-1]), self.hashes[-1], self.shape[-1])

    def shapes(self) -> np.ndarray:
        """A small number for what kind of word it is."""
        share = 4 * self.upper // np.maximum(1, self.letters)
        parts = [
            (np.minimum(3, share) + (self.upper > 0), 5), (np.minimum(2, self.special), 3),
            (self.exclaim, 2), (self.bar, 2), (np.minimum(2, self.digits), 3), (self.repeat, 2),
            (self.stop, 2), (np.minimum(7, self.lengths // 3), 8), (self.letters > 0, 2),
        ]
        out = np.zeros(len(self.lengths), np.int64)
        for value, size in parts:
            out = out * size + value
        return out

    def buckets(self) -> np.ndarray:
        """Hashed features of each word: its shape, its shape after the one before, the word itself."""
        shape = self.shape
        before = np.concatenate([np.array([self.shape_before], np.uint64), shape[:-1]])
        before = np.where(self.same_text, before, np.uint64(1 << 40))
        raw = [
            shape * np.uint64(3) + np.uint64(1),
            (shape << np.uint64(20)) + before * np.uint64(3) + np.uint64(2), self.hashes,
        ]
        return np.stack([(pieces.mixed(x) % np.uint64(BUCKETS)).astype(np.int32) for x in raw])


def _windows(buffer: np.ndarray, offsets: np.ndarray):
    last = (-1, np.uint64(0), np.uint64(0))
    for block, starts, lengths, texts in pieces.word_windows(buffer, offsets):
        words = Words(block, starts, lengths, texts, last)
        last = words.last
        yield words


def votes(column: pa.Array) -> pa.Array:
    """Each text's votes as one number, three values a heuristic; a text without words has none."""
    buffer, offsets = pieces.text_buffer(column)
    size = len(column)
    names = ("n", "letters", "upper", "special", "bars", "exclaims", "repeats", "digits", "long", "bytes",
             "stops")
    sums = {x: np.zeros(size) for x in names}
    for w in _windows(buffer, offsets):
        each = (np.ones(len(w.texts)), w.letters, w.upper, w.special, w.bar, w.exclaim, w.repeat, w.digits,
                w.lengths > 30, w.lengths, w.stop)
        for name, values in zip(names, each, strict=True):
            sums[name] += np.bincount(w.texts, values, minlength=size)
    n, letters, size_ = (np.maximum(1, sums[x]) for x in ("n", "letters", "bytes"))
    share = {x: sums[x] / (sums["n"] + SHRINK) for x in ("special", "bars", "exclaims", "repeats", "long")}
    share |= {"upper": sums["upper"] / letters, "digits": sums["digits"] / size_}
    odd = np.max([share[x] for x in ("special", "bars", "exclaims", "repeats", "long")], axis=0)
    rhythm = sums["stops"] / n
    length = sums["bytes"] / n
    share["prose"] = np.where((rhythm > 0) & (length > 2) & (length < 15) & (share["upper"] < 0.2), odd, 1)
    out = np.zeros(size, np.int64)
    for name, bad, good in HEURISTICS:
        vote = np.zeros(size, np.int64)
        if bad is not None:
            vote[share[name] >= bad] = 1
        if good is not None:
            vote[share[name] <= good] = 2
        out = out * 3 + np.where(sums["n"] > 0, vote, 0)
    return pa.array(out)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of hashed features as (text, bucket, share)."""
    buffer, offsets = pieces.text_buffer(column)
    keys, counts = [], []
    n = np.zeros(len(column))
    for w in _windows(buffer, offsets):
        pairs, number = np.unique(w.texts[None, :] * BUCKETS + w.buckets(), return_counts=True)
        keys.append(pairs)
        counts.append(number)
        n += np.bincount(w.texts, minlength=len(n))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    pairs, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts))
    texts, buckets = pairs // BUCKETS, pairs % BUCKETS
    return texts, buckets, total / n[texts]


def scores(column: pa.Array, weights: np.ndarray, bias: float) -> pa.Array:
    """The chance that each whole text is good; a text without words gets the bias alone."""
    buffer, offsets = pieces.text_buffer(column)
    sums, n = np.zeros(len(column)), np.zeros(len(column))
    for w in _windows(buffer, offsets):
        sums += np.bincount(w.texts, weights[w.buckets()].sum(axis=0), minlength=len(n))
        n += np.bincount(w.texts, minlength=len(n))
    margin = sums / np.maximum(1, n) + bias
    return pa.array(np.round(1 / (1 + np.exp(-np.clip(margin, -500, 500))), 6))


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and each heuristic's votes by class (bad, good)."""

    good: float
    tables: np.ndarray  # heuristic x class x vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The chance of good, given votes (pattern x heuristic)."""
        logs = np.log([1 - self.good, self.good])[None, :] + sum(
            np.log(self.tables[i])[:, patterns[:, i]].T for i in range(patterns.shape[1])
        )
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))


def unpacked(codes: np.ndarray) -> np.ndarray:
    return np.stack(
        [codes // 3 ** (len(HEURISTICS) - 1 - i) % 3 for i in range(len(HEURISTICS))], axis=1
    )


def estimate(codes: np.ndarray, counts: np.ndarray) -> LabelModel:
    """Expectation-maximisation; it begins with heuristics that are more often right than wrong."""
    patterns = unpacked(codes)
    begin = np.array([[0.55, 0.4, 0.05], [0.5, 0.02, 0.48]])
    model = LabelModel(0.9, np.repeat(begin[None], len(HEURISTICS), axis=0))
    for _ in range(EM_ROUNDS):
        p = model.posterior(patterns)
        weight = np.stack([counts * (1 - p), counts * p])
        tables = np.stack([
            np.stack([np.bincount(patterns[:, i], weight[c], minlength=3) + 0.5 for c in (0, 1)])
            for i in range(len(HEURISTICS))
        ])
        tables /= tables.sum(axis=2, keepdims=True)
        good = (weight[1].sum() + 1) / (counts.sum() + 2)
        done = abs(good - model.good) < 1e-9 and np.allclose(tables, model.tables, atol=1e-9)
        model = LabelModel(good, tables)
        if done:
            break
    return model


def fit(rows: np.ndarray, buckets: np.ndarray, shares: np.ndarray, target: np.ndarray
        ) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by gradient steps of adapted length; classes weigh alike."""
    weights, bias = np.zeros(BUCKETS), 0.0
    size = len(target)
    if not size:
        return weights, 1.0
    mass = np.array([max(1e-9, (1 - target).sum()), max(1e-9, target.sum())])
    importance = (1 - target) / mass[0] + target / mass[1] if mass.min() > 1 else np.full(size, 2 / size)
    squares, bias_square = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(STEPS):
        margin = np.bincount(rows, weights[buckets] * shares, minlength=size) + bias
        error = importance * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - target)
        slope = np.bincount(buckets, error[rows] * shares, minlength=BUCKETS) + 1e-6 * weights
        squares += slope**2
        weights -= slope / np.sqrt(squares)
        bias_square += error.sum() ** 2
        bias -= 0.3 * error.sum() / np.sqrt(bias_square)
    return weights, bias


@dataclass(frozen=True)
class Scorer:
    labels: LabelModel
    weights: np.ndarray
    bias: float


@memory.tidy
def _feature_rows(batches):
    for batch in batches:
        texts, buckets, shares = features(batch.column(1))
        n = np.bincount(texts, minlength=batch.num_rows)
        limits = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(limits), pa.array(buckets.astype(np.int32)))
        valued = pa.ListArray.from_arrays(pa.array(limits), pa.array(shares))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), votes(batch.column(1)), listed, valued],
            ["key", "code", "buckets", "shares"],
        )


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          fit_rows: int = FIT_ROWS) -> Scorer:
    """Label model from all documents' votes; scorer from about ``fit_rows`` of them, drawn by id and text.

    The driver gets the pattern counts (3 ** heuristics rows at most) and the sample's hashed features
    (``BUCKETS`` numbers a row at most, ``FIT_MOST * fit_rows`` rows at most, the first by hash). Null and empty
    texts cast no votes; rows without id are drawn by their text; repeated rows vote each time. Very long texts are
    read whole. Without rows the scorer calls everything good.
    """
    bound_batches(docs.sparkSession)
    vote = F.arrow_udf(lambda column: votes(column), "long")
    counted = docs.select(vote(whole_text(text_col)).alias("code")).groupBy("code").count().collect()
    codes = np.array(sorted((r["code"], r["count"]) for r in counted), np.int64).reshape(-1, 2)
    labels = estimate(codes[:, 0], codes[:, 1].astype(float))
    total = int(codes[:, 1].sum())
    key = F.xxhash64(F.col(id_col), whole_text(text_col), F.lit("fit"))
    chosen = docs.select(key.alias("key"), whole_text(text_col).alias("text"))
    if total > fit_rows:
        chosen = chosen.where(F.pmod("key", F.lit(1 << 32)) < int((1 << 32) * fit_rows / total))
    sample = chosen.mapInArrow(
        _feature_rows, "key long, code long, buckets array<int>, shares array<double>"
    ).orderBy("key", "code").limit(FIT_MOST * fit_rows).toArrow().sort_by(
        [("key", "ascending"), ("code", "ascending")])
    buckets, shares = (sample.column(c).combine_chunks() for c in ("buckets", "shares"))
    lengths = np.diff(buckets.offsets.to_numpy()) if len(buckets) else np.zeros(0, np.int64)
    target = labels.posterior(unpacked(sample.column("code").to_numpy())) if len(sample) else np.zeros(0)
    weights, bias = fit(
        np.repeat(np.arange(len(lengths)), lengths),
        buckets.flatten().to_numpy() if len(buckets) else np.zeros(0, np.int64),
        shares.flatten().to_numpy() if len(shares) else np.zeros(0), target,
    )
    return Scorer(labels, weights, bias)


def judged(docs: DataFrame, scorer: Scorer, *, text_col: str = "text", score_col: str = "quality_score",
           keep_col: str = "quality_keep", threshold: float = THRESHOLD) -> DataFrame:
    """All columns, the score of the whole text (0 to 1, 1 is good) and whether it is kept.

    Null and empty texts are judged by the fitted bias, which stands for the average document. Columns
    named like the two that are added are replaced; repeated rows get the same score. Very long texts are
    scored whole, window by window. No rows give no rows.
    """
    bound_batches(docs.sparkSession)
    weights, bias = scorer.weights, scorer.bias
    score = F.arrow_udf(lambda column: scores(column, weights, bias), "double")
    return docs.withColumn(score_col, score(whole_text(text_col))).withColumn(
        keep_col, F.col(score_col) >= threshold
    )
