"""Periodic runs of words: seeds of guaranteed overlap, same-text pairs by lag, each stretch extended once.

A run of period q and length L is a stretch of L - q places at which a text equals itself q words later.
For lags from ``lo`` to ``2 lo - 1`` such a stretch has ``lo`` places at least, so one of every ``s``
places in it begins a k-gram that lies in the stretch whole (s + k - 1 = lo). Only those k-grams are
looked up, and only at such lags, which bounds the pairs by two for each word and octave of lags, whatever
repeats how often. Seeds that follow each other on a lag belong to one stretch: what the first one
covers is not extended again, and each stretch grows by less than ``s`` words on either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latecast.llm import memory, pieces
from latecast.llm.shared import bound_batches, whole_text

LEAST = 12  # words in a run
WINDOW = 4 << 20  # bytes of texts that are looked at together
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return pieces.mixed(a * _STEP + (b ^ (b >> np.uint64(29))))


def _lags(least: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """(first lag, last lag, places that a stretch has at least), up to half the longest text."""
    base = (least + 1) // 2
    if base > 1:
        yield 1, base - 1, least - base + 1
    lo = max(1, base)
    while 2 * lo <= longest:
        yield lo, 2 * lo - 1, lo
        lo *= 2


class Level:
    """Hashes of 1, 2, 4, ... words from every place; windows past a text's end equal nothing."""

    def __init__(self, words: np.ndarray) -> None:
        self.tables = [words]

    def table(self, t: int) -> np.ndarray:
        while len(self.tables) <= t:
            last, step = self.tables[-1], 1 << (len(self.tables) - 1)
            ahead = np.concatenate([last[step:], np.full(min(step, len(last)), last[-1])])
            self.tables.append(pair(last, ahead))
        return self.tables[t]

    def grams(self, k: int) -> np.ndarray:
        t = k.bit_length() - 1
        table, shift = self.table(t), k - (1 << t)
        return pair(table[:len(table) - shift], table[shift:]) if shift else table

    def keep(self, mask: np.ndarray) -> None:
        self.tables = [table[mask] for table in self.tables]

    def same(self, a: np.ndarray, b: np.ndarray, below: int, back: bool) -> np.ndarray:
        """How many words (fewer than ``below``) are equal from a and b on, or before a and b."""
        size, done = len(self.tables[0]), np.zeros(len(a), np.int64)
        for t in reversed(range((below - 1).bit_length())):
            table, step = self.table(t), 1 << t
            x = a - done - step if back else a + done
            y = b - done - step if back else b + done
            inside = (x >= 0) & (y < size)
            x, y = np.where(inside, x, 0), np.where(inside, y, 0)
            done += np.where(inside & (table[x] == table[y]), step, 0)
        return done


def _may_repeat(keys: np.ndarray) -> np.ndarray:
    """Places of all keys that occur twice, and of some others: keys are put into cells, the last one stays."""
    cells = (keys >> np.uint64(64 - max(10, (4 * len(keys)).bit_length()))).astype(np.int64)
    places = np.arange(len(keys))
    table = np.empty(1 << max(10, (4 * len(keys)).bit_length()), np.int64)
    table[cells] = places
    table[cells[table[cells] != places]] = -1
    return np.flatnonzero(table[cells] < 0)


def _stretches(level: Level, lo: int, hi: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, places, lag) of all stretches of at least ``least`` places at lags lo to hi."""
    none = np.zeros(0, np.int64)
    s = max(1, least // 2)
    k = least - s + 1
    keys = level.grams(k)
    may = _may_repeat(keys)
    order = may[np.argsort(keys[may], kind="stable")]
    ordered = keys[order]
    equal = ordered[1:] == ordered[:-1]
    again = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
    if not again.any():
        return none, none, none
    at = order[again]
    group = np.cumsum(np.concatenate([[True], ~equal])[again])
    size = len(level.tables[0])
    places = group * size + at  # ascending
    seeds = np.flatnonzero(at % s == 0)
    base = group[seeds] * size
    first = np.searchsorted(places, base + np.minimum(at[seeds] + lo, size - 1))
    last = np.searchsorted(places, base + np.minimum(at[seeds] + hi, size - 1), side="right")
    counts = np.maximum(last - first, 0)
    if not counts.sum():
        return none, none, none
    i = np.repeat(at[seeds], counts)
    lag = at[pieces.gather(first, counts)] - i
    real = (lag >= lo) & (lag <= hi)
    i, lag = i[real], lag[real]
    if not len(i):
        return none, none, none
    order = np.lexsort((i, lag))
    i, lag = i[order], lag[order]
    new = np.concatenate([[True], (lag[1:] != lag[:-1]) | (i[1:] != i[:-1] + s)])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(i)]]) - 1
    a, b, q = i[head], i[tail] + k, lag[head]
    a = a - level.same(a, a + q, s, True)
    b = b + level.same(b, b + q, s, False)
    long = b - a >= np.maximum(q, least)
    return a[long], (b - a)[long], q[long]


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = LEAST, salt: int = 0) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period.

    ``words`` are numbers of the words of all texts one after the other, ``sizes`` how many each text has.
    """
    texts = np.repeat(np.arange(len(sizes)), sizes)
    # a text's words, and a mark behind it that occurs nowhere else
    place = np.arange(len(words)) + texts
    full = np.zeros(len(words) + len(sizes), np.uint64)
    full[place] = pieces.mixed(words.astype(np.uint64) * np.uint64(2) + np.uint64(1) + np.uint64(salt << 40))
    ends = np.cumsum(sizes + 1) - 1
    full[ends] = np.arange(len(sizes), dtype=np.uint64) * np.uint64(2) + np.uint64(salt << 40)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    level = Level(pieces.mixed(full ^ pieces.mixed(owner.astype(np.uint64) + _STEP)))
    where = np.arange(len(full))
    found = []
    for lo, hi, fewest in _lags(least, int(sizes.max(initial=0))):
        some = (sizes >= max(least, 2 * lo))[owner]
        if not some.all():
            level.keep(some)
            where, owner = where[some], owner[some]
        if not len(where):
            break
        start, places, lag = _stretches(level, lo, hi, fewest)
        # lags below half the least length need more places than the octave guarantees
        enough = places + lag >= least
        found.append(np.stack([where[start], places + lag, lag], axis=1)[enough])
    if not found or not sum(map(len, found)):
        return np.zeros((0, 4), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # a stretch that has a smaller period as well begins and ends where that period's does
    fresh = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
    rows = rows[fresh]
    for start, length, period in rows:
        if not np.array_equal(full[start:start + length - period], full[start + period:start + length]):
            return runs_of(words, sizes, least, salt + 1)  # two k-grams shared a hash
    text = np.searchsorted(ends, rows[:, 0])
    begin = rows[:, 0] - (ends - sizes)[text]
    out = np.stack([text, begin, rows[:, 1], rows[:, 2]], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _found(names: list[str], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = pieces.text_buffer(batch.column(0))
            for first, last in pieces.slices(batch, offsets, WINDOW):
                numbers: dict[bytes, int] = {}
                split = [t.encode().split() for t in batch.column(0).slice(first, last - first).to_pylist()]
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                words = np.fromiter(
                    (numbers.setdefault(w, len(numbers)) for t in split for w in t), np.int64, int(sizes.sum())
                )
                rows = runs_of(words, sizes, least)
                limits = np.searchsorted(rows[:, 0], np.arange(len(split) + 1))
                texts = []
                for i, own in enumerate(split):
                    if limits[i] < limits[i + 1]:
                        change = np.zeros(len(own) + 1, np.int64)
                        some = rows[limits[i]:limits[i + 1]]
                        np.add.at(change, some[:, 1] + some[:, 3], 1)
                        np.add.at(change, some[:, 1] + some[:, 2], -1)
                        own = [own[j] for j in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                    texts.append(b" ".join(own).decode())
                spans = pa.StructArray.from_arrays(
                    [pa.array(rows[:, j]) for j in (1, 2, 3)], ["start", "length", "period"]
                )
                lists = pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), spans)
                others = [batch.column(j).slice(first, last - first) for j in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sizes), lists, pa.array(texts, pa.string()), *others], names
                )

    return memory.tidy(run)


def periodic_runs(
    docs: DataFrame, text_col: str = "text", *, least: int = LEAST,
    words_col: str = "n_words", runs_col: str = "runs", out_col: str = "collapsed",
) -> DataFrame:
    """The other columns and, of every whole text, its number of words, its runs, and the text collapsed.

    Words are separated by ASCII white space. A run is a stretch of at least ``least`` words and two
    periods that cannot be extended; it is listed once, with its smallest period, by start and period.
    Collapsed text keeps the first period of each run, words joined by one space.

    A null or empty text has no words, no runs and an empty collapsed text. Very long texts are taken
    whole: their words need about eight bytes each for every doubling of their length. Repeated rows stay
    and get the same result, no rows give no rows; a column called like one of the three is replaced.
    """
    bound_batches(docs.sparkSession)
    new = (words_col, runs_col, out_col)
    kept = [c for c in docs.columns if c not in (text_col, *new)]
    rows = docs.select(whole_text(text_col).alias(out_col), *[F.col(f"`{c}`") for c in kept])
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    schema = f"`{words_col}` bigint, `{runs_col}` {RUNS}, `{out_col}` string{kinds}"
    return rows.mapInArrow(_found([*new, *kept], least), schema)
