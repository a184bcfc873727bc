"""Passages that occur more than once, found by suffix automata of reference shards.

A window is a fixed number of consecutive words. The k-gram of a window with the smallest hash is its anchor;
windows side by side with the same anchor are a segment. Equal windows have equal anchors, so only segments
of one anchor need to meet: anchors that a counting Bloom filter has seen once lead nowhere. Segments that are equal
as a whole repeat in all their windows. Where an anchor has several different segments, these are reference
and query at once: shards of them, bounded in words, each get a suffix automaton with the number of
occurrences of every state, and the segments are streamed through it for their matching statistics.

An automaton goes to the task that holds its anchors' segments, not to all documents: as every document
would have to read every shard then, the work would grow with the square of the corpus. Anchors with very many
different segments would be one group in one task; their windows are counted by digest instead, which
combines before it shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latecast.llm import bloom, memory, pieces
from latecast.llm.runs import Level, pair
from latecast.llm.shared import Work, whole_text

LENGTH = 35  # words of a window
BLOCK = 32  # windows of a segment at most
WINDOW = 4 << 20  # bytes of texts that are looked at together
SHARD_WORDS = 1 << 16  # of the reference shard of one automaton
HOT = 1024  # different segments of one anchor; more are counted by window
MOST_BITS = 1 << 29
MOST_KEYS = 1 << 25  # anchors that go into a filter; beyond that, places are joined to texts
SPANS = "array<struct<start:bigint,length:bigint>>"


def _segments(words: np.ndarray, texts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first word, windows, anchor, signature) of all segments; ``texts`` numbers each word's text."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(words) < length:
        return none
    k = max(1, length // 3)
    level = Level(words)
    grams = level.grams(k)[:len(words) - k + 1]
    least, place, size, reach = grams, np.arange(len(grams)), 1, length - k + 1
    while size < reach:
        step = min(size, reach - size)
        take = least[step:] < least[:-step]
        place = np.where(take, place[step:], place[:-step])
        least = np.where(take, least[step:], least[:-step])
        size += step
    first = np.flatnonzero(texts[:len(texts) - length + 1] == texts[length - 1:])
    if not len(first):
        return none
    anchor = place[first]
    block = (anchor - first) // BLOCK
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])
                          | (first[1:] != first[:-1] + 1)])
    head = np.flatnonzero(new)
    windows = np.diff(np.concatenate([head, [len(first)]]))
    start, anchor, block = first[head], anchor[head], block[head]
    t = length.bit_length() - 1
    table, rest = level.table(t), windows + length - 1 - (1 << t)
    sign = pieces.mixed(rest.astype(np.uint64))
    for i in range(4):
        sign = pair(sign, table[start + rest * i // 3])
    return start, windows, pair(grams[anchor], block.astype(np.uint64)), sign


def _of_batches(batches: Iterator[pa.RecordBatch], length: int):
    """Per slice of a batch (text in its first column): the slice, each text's first word, its segments' texts and
    the segments."""
    for batch in batches:
        buffer, offsets = pieces.text_buffer(batch.column(0))
        for low, high in pieces.slices(batch, offsets, WINDOW):
            hashes, texts = [], []
            for block, starts, lengths, text in pieces.word_windows(buffer, offsets[low:high + 1]):
                hashes.append(pieces.word_hashes(block, starts, lengths))
                texts.append(text)
            words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            text = np.concatenate(texts) if texts else np.zeros(0, np.int64)
            found = _segments(words, text, length)
            begins = np.searchsorted(text, np.arange(high - low))
            yield batch.slice(low, high - low), begins, text[found[0]], found


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, (_, _, anchor, _) in _of_batches(batches, length):
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], ["anchor"])

    return memory.tidy(run)


def _places(length: int, repeated):
    """Rows (key, start, windows, anchor, signature) of segments whose anchor the filter names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins, text, (start, windows, anchor, sign) in _of_batches(batches, length):
            some = bloom.has(repeated.value, anchor)
            keys = rows.column(1).take(pa.array(text[some]))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array((start - begins[text])[some]), pa.array(windows[some].astype(np.int32)),
                 pa.array(anchor[some].view(np.int64)), pa.array(sign[some].view(np.int64))],
                ["key", "start", "windows", "anchor", "sign"],
            )

    return memory.tidy(run)


def _passages(length: int, named):
    """Rows (anchor, signature, words) of segments the filter names, each once per slice. Without a filter, column 1
    lists the first words of those that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins, text, (start, windows, anchor, sign) in _of_batches(batches, length):
            at = start - begins[text]
            if named is not None:
                some = np.flatnonzero(bloom.has(named.value, anchor))
            else:
                wanted = [set(x or ()) for x in rows.column(1).to_pylist()]
                some = np.array([i for i, (t, s) in enumerate(zip(text.tolist(), at.tolist(), strict=True))
                                 if s in wanted[t]], np.int64)
            order = some[np.lexsort((sign[some], anchor[some]))]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (anchor[order[1:]] != anchor[order[:-1]]) | (sign[order[1:]] != sign[order[:-1]])
            some = np.sort(order[fresh])
            passages, current, words = [], -1, []
            for t, s, n in zip(text[some].tolist(), at[some].tolist(), windows[some].tolist(), strict=True):
                if t != current:
                    current, words = t, rows.column(0)[t].as_py().encode().split()
                passages.append(b" ".join(words[s:s + n + length - 1]).decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[some].view(np.int64)), pa.array(sign[some].view(np.int64)),
                 pa.array(passages, pa.string())], ["anchor", "sign", "words"]
            )

    return memory.tidy(run)


class Automaton:
    """Suffix automaton of several strings; ``seen`` counts the occurrences of each state's strings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.seen = [-1], [0], [0]

    def _state(self, size: int, step: dict[int, int], link: int) -> int:
        self.next.append(step)
        self.link.append(link)
        self.size.append(size)
        self.seen.append(0)
        return len(self.size) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the strings of q that p reaches; q keeps the longer ones."""
        if self.size[p] + 1 == self.size[q]:
            return q
        clone = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, symbols: list[int], times: int) -> None:
        last = 0
        for c in symbols:
            q = self.next[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
            else:
                new, p = self._state(self.size[last] + 1, {}, 0), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, c, self.next[p][c])
                last = new
            self.seen[last] += times

    def count(self) -> None:
        """Occurrences of a string are also those of its suffixes."""
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            self.seen[self.link[state]] += self.seen[state]

    def repeated(self, symbols: list[int], length: int) -> list[int]:
        """Where strings of that length begin that the reference has more than once."""
        state, match, found = 0, 0, []
        for i, c in enumerate(symbols):
            while state and c not in self.next[state]:
                state = self.link[state]
                match = self.size[state]
            if c in self.next[state]:
                state, match = self.next[state][c], match + 1
            while state and self.size[self.link[state]] >= length:
                state = self.link[state]
            match = min(match, self.size[state])
            if match >= length and self.seen[state] > 1:
                found.append(i - length + 1)
        return found


def _matched(length: int):
    """Rows (anchor, signature, words, n) sorted by anchor: which windows of those with n = 1 repeat, as bits."""

    def shard(rows: list[tuple[int, int, str, int]]) -> pa.RecordBatch:
        numbers: dict[str, int] = {}
        symbols = [[numbers.setdefault(w, len(numbers)) for w in r[2].split(" ")] for r in rows]
        automaton = Automaton()
        for row, own in zip(rows, symbols, strict=True):
            automaton.add(own, row[3])
        automaton.count()
        out = [(r[0], r[1], sum(1 << at for at in automaton.repeated(own, length)))
               for r, own in zip(rows, symbols, strict=True) if r[3] == 1]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["anchor", "sign", "bits"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words > SHARD_WORDS and row[0] != held[-1][0]:
                    yield shard(held)
                    held, words = [], 0
                held.append(row)
                words += row[2].count(" ") + 1
        if held:
            yield shard(held)

    return memory.tidy(run)


def _digests(length: int):
    """Rows (anchor, signature, words, n): a row with a digest for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, sign, words, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words.split(" ")
                for at in range(len(words) - length + 1):
                    window = " ".join(words[at:at + length]).encode()
                    out.append((anchor, sign, at, hashlib.blake2b(window, digest_size=16).digest(), n))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)],
                ["anchor", "sign", "at", "digest", "n"],
            )

    return memory.tidy(run)


def _kept(length: int, names: list[str]):
    """Texts (column 0) without the words that marked windows (column 1: start, bits) cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, texts = [], [], []
            for text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.encode().split()
                sizes.append(len(words))
                own = []
                if marks:
                    change = np.zeros(len(words) + 1, np.int64)
                    start = np.array([m["start"] for m in marks], np.int64)
                    bits = np.array([m["bits"] for m in marks], np.int64)
                    for i in range(BLOCK):
                        at = start[bits >> i & 1 > 0] + i
                        np.add.at(change, at, 1)
                        np.add.at(change, at + length, -1)
                    gone = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
                    edges = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
                    own = [{"start": a, "length": b - a} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    words = [words[i] for i in np.flatnonzero(~gone[1:-1])]
                spans.append(own)
                texts.append(b" ".join(words).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.string()),
                 *batch.columns[2:]], names
            )

    return memory.tidy(run)


def _marks(texts: DataFrame, length: int, work: Work, hot: int, most_keys: int, most_bits: int) -> DataFrame:
    """key, marks: of every text with repeated windows, where they begin (start, bits of windows from there)."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bloom.SEGMENT_BITS
    while bits < min(most_bits, 16 * (size // (2 * length))):
        bits *= 2
    repeated = bloom.filter_of(texts.select("text").mapInArrow(_anchors(length), "anchor long"), bits)
    kinds = "key binary, start long, windows int, anchor long, sign long"
    places = texts.mapInArrow(_places(length, spark.sparkContext.broadcast(repeated)), kinds)
    places = work.table(
        places.groupBy("key", "start").agg(
            *[F.first(c).alias(c) for c in ("windows", "anchor", "sign")], F.count(F.lit(1)).alias("n")), "places"
    )
    signs = work.table(places.groupBy("anchor", "sign").agg(F.sum("n").alias("n")), "signs")
    anchors = signs.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("fewest"))
    mixed = work.table(anchors.where("kinds > 1 and fewest = 1").select("anchor", "kinds"), "mixed")
    count = mixed.count()
    out = "anchor long, sign long, words string"
    if count <= most_keys:
        enough = bloom.SEGMENT_BITS
        while enough < 32 * count:
            enough *= 2
        named = spark.sparkContext.broadcast(bloom.filter_of(mixed.select("anchor"), enough, 1))
        passages = texts.select("text").mapInArrow(_passages(length, named), out)
    else:
        wanted = places.join(mixed, "anchor", "left_semi").groupBy("key").agg(F.collect_list("start").alias("at"))
        once = texts.join(wanted, "key").select("text", "at")
        passages = once.mapInArrow(_passages(length, None), out)
    passages = passages.groupBy("anchor", "sign").agg(F.first("words").alias("words"))
    passages = passages.join(mixed, "anchor").join(signs, ["anchor", "sign"])
    passages = work.table(passages.select("anchor", "sign", "words", "n", "kinds"), "passages")
    few = passages.where(F.col("kinds") <= hot).drop("kinds")
    matched = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        _matched(length), "anchor long, sign long, bits long"
    )
    windows = passages.where(F.col("kinds") > hot).drop("kinds").mapInArrow(
        _digests(length), "anchor long, sign long, at int, digest binary, n long"
    )
    again = windows.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")
    counted = windows.where("n = 1").join(again, "digest").groupBy("anchor", "sign").agg(
        F.expr("bit_or(shiftleft(1L, at))").alias("bits")
    )
    partly = work.table(matched.where("bits != 0").unionByName(counted), "partly")
    marked = places.drop("n").join(signs, ["anchor", "sign"]).join(partly, ["anchor", "sign"], "left")
    full = F.expr("shiftleft(1L, windows) - 1")
    marked = marked.select("key", "start", F.when(F.col("n") > 1, full).otherwise(F.col("bits")).alias("bits"))
    marks = F.collect_list(F.struct("start", "bits")).alias("marks")
    return work.table(marked.where("bits is not null").groupBy("key").agg(marks), "marks")


def without_repeats(
    docs: DataFrame, text_col: str = "text", *, length: int = LENGTH, words_col: str = "n_words",
    spans_col: str = "removed", out_col: str = "kept",
    hot: int = HOT, most_keys: int = MOST_KEYS, most_bits: int = MOST_BITS,
) -> DataFrame:
    """The other columns and, of every whole text, its number of words, the maximal spans of words that
    are covered by windows which occur elsewhere too, and the words outside them joined by one space.

    Words are separated by ASCII white space and compared as they are. All occurrences go, those in the
    same text included; windows are judged on the input. A null or empty text has no words; texts of
    fewer than ``length`` words stay whole, as do all if there are no others. Repeated rows count as
    occurrences of each other. Very long texts are taken whole: a few dozen bytes for each word. No
    rows give no rows; a column called like one of the three is replaced. Rows without a
    repeat do not shuffle.
    """
    spark = docs.sparkSession
    work = Work(spark, "substrings")
    new = (words_col, spans_col, out_col)
    kept = [c for c in docs.columns if c not in (text_col, *new)]
    text = whole_text(text_col)
    key = F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)
    marks = _marks(docs.select(text.alias("text"), key.alias("key")), length, work, hot, most_keys, most_bits)
    named = bloom.named_by(marks.select(F.xxhash64("key").alias("h")))
    # names of its own for all columns, whatever the table calls them
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    rows = docs.select(text.alias("text"), key.alias("key"), *others).withColumn("may", named(F.xxhash64("key")))
    straight = rows.where("not may").withColumn("marks", F.lit(None).cast(marks.schema["marks"].dataType))
    joined = rows.where("may").join(marks, "key", "left")
    names = ["n", "spans", "kept", *[f"c{i}" for i in range(len(kept))]]
    kinds = "".join(f", c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    both = [
        x.select("text", "marks", *names[3:])
        .mapInArrow(_kept(length, names), f"n bigint, spans {SPANS}, kept string{kinds}")
        for x in (straight, joined)
    ]
    return both[0].unionByName(both[1]).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)],
        *[F.col(a).alias(b) for a, b in zip(names, new, strict=False)],
    )
