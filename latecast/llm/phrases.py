"""Collocations: phrases that occur often, mined by sampling with a negative border, and scored exactly.

A sample proposes phrases at a lowered threshold. A full pass counts the proposed ones and their negative
border, the phrases that were not proposed though all their parts were; single words are all counted, as
their only part is the empty phrase. A border phrase that proves frequent is a failure: phrases that have
such parts were not counted yet, so another pass counts these, until no failure is left. Every frequent phrase
has been counted then, as all its parts are frequent.

Passes count 64-bit hashes of language and words. A count comes with the bucket of one text that has the
phrase, so the last pass, which looks up the phrases' texts, finds each of them in that bucket's texts only.
Two phrases that share a hash would be counted as one: about one frequent phrase in 2^64 / d, where d is the
number of different phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latecast.llm import bloom, memory, pieces
from latecast.llm.shared import Work, whole_text

LEAST = 30
MOST_WORDS = 4
TOP = 2000
SAMPLE = 8  # one of so many rows
LOWERED = 0.8  # of the threshold that the sample's size would suggest
MOST_BITS = 1 << 29
CHUNK = 4 << 20  # bytes of text whose phrases are counted at once
MOST_HELD = 4 << 20  # hashes that a task holds before it hands them on
MOST_TEXTS = 1 << 19
PART_BYTES = 4 << 20  # of text, for each part that counts are dealt out by
MOST_TASKS = 1 << 16
NO_LANG = "und"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE, _BREAK = 32, 10
BUCKETS = 1 << 12  # of texts, by a hash of theirs
KINDS = (np.uint64, np.uint32, np.uint16)
COUNTS = "part long, size int, hashes binary, counts binary, homes binary"
HASHES = "size int, hash long, n long, home long"
TEXTS = "lang string, size int, hash long, phrase string, words long"


def byte_table() -> bytes:
    """A-Z become a-z, a tab a space, and every mark that ends a piece a line feed."""
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    table[9] = _SPACE
    for c in b".,;:!?\n\x0b\x0c\r":
        table[c] = _BREAK
    return bytes(table)


_TABLE = byte_table()


def _chunks(data: bytes) -> Iterator[tuple[int, int]]:
    """Limits of parts of about ``CHUNK`` bytes that end where a piece ends."""
    low = 0
    while low < len(data):
        high = low + CHUNK
        if high < len(data):
            cut = data.rfind(b"\n", low, high)
            cut = data.find(b"\n", high) if cut < 0 else cut
            high = len(data) if cut < 0 else cut + 1
        yield low, min(high, len(data))
        low = high


class _Words:
    """The words of one chunk: where they are, and the hashes of phrases that begin at each."""

    def __init__(self, block: bytes, texts: np.ndarray, salts: np.ndarray, buckets: np.ndarray) -> None:
        """``texts`` are the places where texts begin (the first at 0 or before), with salt and bucket of each."""
        self.block, self.buckets = block, buckets
        data = np.frombuffer(block, np.uint8)
        inside = (data != _SPACE) & (data != _BREAK)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.piece = np.searchsorted(np.flatnonzero(data == _BREAK), self.starts)
        self.text = np.searchsorted(texts, self.starts, side="right") - 1
        words = pieces.word_hashes(data, self.starts, self.ends - self.starts)
        self.hashes = [pieces.mixed(words ^ salts[self.text])] if len(words) else [words]

    def grams(self, size: int) -> np.ndarray:
        """Hashes of all places; ``whole`` says at which of them a phrase of that size begins."""
        while len(self.hashes) < size:
            m = len(self.hashes)
            last, first = self.hashes[-1], self.hashes[0]
            self.hashes.append(pieces.mixed(last[:-1] * _STEP + first[m:]) if len(last) else last)
        return self.hashes[size - 1]

    def whole(self, size: int) -> np.ndarray:
        return self.piece[size - 1:] == self.piece[:max(0, len(self.piece) - size + 1)]

    def home(self, at: np.ndarray) -> np.ndarray:
        return self.buckets[self.text[at]]

    def phrase(self, at: int, size: int) -> str:
        return b" ".join(self.block[self.starts[at]:self.ends[at + size - 1]].split()).decode()


def at_home(hashes: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """One hash of a phrase and the bucket of a text."""
    return pieces.mixed(hashes + (buckets.astype(np.uint64) + np.uint64(1)) * _STEP)


def _salt(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode(), np.uint8)
    return (pieces.word_hashes(data, np.array([0]), np.array([len(data)])) * _STEP)[0]


def _word_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Words, list[str]]]:
    """Chunks of all texts (column 1; language and bucket are 0 and 2), and the language of each of their texts."""
    known: dict[str, np.uint64] = {}
    for batch in batches:
        _, offsets = pieces.text_buffer(batch.column(1))
        for first, last in pieces.slices(batch, offsets, CHUNK):
            texts = [t.encode() for t in batch.column(1).slice(first, last - first).to_pylist()]
            langs = batch.column(0).slice(first, last - first).to_pylist()
            buckets = batch.column(2).slice(first, last - first).to_numpy(zero_copy_only=False).astype(np.uint16)
            starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
            for lang in set(langs) - known.keys():
                known[lang] = _salt(lang)
            salts = np.array([known[lang] for lang in langs], np.uint64)
            data = b"\n".join(texts).translate(_TABLE)
            for low, high in _chunks(data):
                found = _Words(data[low:high], starts - low, salts, buckets)
                if len(found.starts):
                    yield found, langs


class _Counts:
    """Hashes in order, how often each occurs, and the bucket of a text that has it."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray | None, homes: np.ndarray) -> None:
        """Equal hashes are added up; without ``counts`` each is there once."""
        order = np.argsort(hashes)
        ordered = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[:len(ordered)])
        self.hashes, self.homes = ordered[first], homes[order[first]]
        if counts is None:
            self.counts = np.diff(np.concatenate([first, [len(ordered)]]))
        else:
            self.counts = np.add.reduceat(counts[order], first) if len(first) else counts

    def __len__(self) -> int:
        return len(self.hashes)


def _merged(held: list[_Counts]) -> _Counts:
    if len(held) == 1:
        return held[0]
    join = lambda name: np.concatenate([getattr(x, name) for x in held])
    return _Counts(join("hashes"), join("counts"), join("homes"))


def _counted(sizes: range, shift: int, may=None, old=None):
    """Per task: counts by part of the hash space. Longer phrases count if ``may`` names both their parts
    of one word less, and ``old`` does not; without ``may`` all phrases count."""

    def handed(size: int, held: list[_Counts]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        found = _merged(held)
        held.clear()
        parts = (found.hashes >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(found), np.int64)
        names, first = np.unique(parts, return_index=True)
        limits = [*first.tolist(), len(found)]
        for i in range(0, len(names), 512):
            cut = list(zip(limits[i:i + 512], limits[i + 1:i + 513], strict=False))
            blobs = [pa.array([x[a:b].astype(kind).tobytes() for a, b in cut], pa.binary())
                     for x, kind in zip((found.hashes, found.counts, found.homes), KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[i:i + 512]), pa.array([size] * len(cut), pa.int32()), *blobs],
                ["part", "size", "hashes", "counts", "homes"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[_Counts]] = {size: [] for size in sizes}
        for words, _ in _word_chunks(batches):
            for size in range(1, sizes.stop):
                hashes, whole = words.grams(size), words.whole(size)
                if size in held:
                    at = np.flatnonzero(whole if size == 1 or may is None else whole & wanted)
                    if len(at):
                        held[size].append(_Counts(hashes[at], None, words.home(at)))
                if may is not None and size + 1 < sizes.stop:
                    named = bloom.has(may.value, hashes) & whole
                    wanted = named[:-1] & named[1:]
                    if old is not None:
                        known = bloom.has(old.value, hashes) & whole
                        wanted &= ~(known[:-1] & known[1:])
            while sum(len(x) for own in held.values() for x in own) > MOST_HELD:
                size = max(held, key=lambda s: sum(map(len, held[s])))
                yield from handed(size, held[size])
        for size in sizes:
            yield from handed(size, held[size])

    return memory.tidy(run)


def _frequent(least: int):
    """Rows sorted by size and part: sums of every hash, those of ``least`` and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def done() -> pa.RecordBatch:
            found = _merged(held)
            held.clear()
            some = found.counts >= least
            hashes, homes = found.hashes[some], found.homes[some]
            columns = [np.full(len(hashes), current[1], np.int32), hashes.view(np.int64), found.counts[some],
                       at_home(hashes, homes).view(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["size", "hash", "n", "home"])

        for batch in batches:
            for part, size, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current != (part, size):
                    if held:
                        yield done()
                    current = part, size
                arrays = [np.frombuffer(x, kind) for x, kind in zip(blobs, KINDS, strict=True)]
                held.append(_Counts(arrays[0], arrays[1].astype(np.int64), arrays[2]))
                if len(held) > 1 and sum(map(len, held)) > MOST_HELD:
                    held[:] = [_merged(held)]
        if held:
            yield done()

    return memory.tidy(run)


def _texts(named, most: int):
    """Per task: the texts of phrases whose hash the filter names together with the bucket of the text that
    they are in, and how many words each language has (size 0)."""

    def handed(held: dict) -> pa.RecordBatch:
        rows = list(held.values())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in
                   enumerate((pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64()))]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, ["lang", "size", "hash", "phrase", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list] = {}
        for words, langs in _word_chunks(batches):
            for text, n in enumerate(np.bincount(words.text, minlength=len(langs)).tolist()):
                if n:
                    held.setdefault(langs[text], [langs[text], 0, 0, "", 0])[4] += n
            for size in range(1, most + 1):
                hashes = words.grams(size)
                at = np.flatnonzero(words.whole(size))
                at = at[bloom.has(named.value, at_home(hashes[at], words.home(at)))]
                distinct, first = np.unique(hashes[at], return_index=True)
                for key, i in zip(distinct.view(np.int64).tolist(), at[first].tolist(), strict=True):
                    if (size, key) not in held:
                        held[size, key] = [langs[words.text[i]], size, key, words.phrase(i, size), 0]
                if len(held) > MOST_TEXTS:
                    yield handed(held)
        yield handed(held)

    return memory.tidy(run)


def phrase_counts(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, least: int = LEAST,
    most_words: int = MOST_WORDS, sample: int = SAMPLE, lowered: float = LOWERED, most_bits: int = MOST_BITS,
) -> DataFrame:
    """lang, size, phrase, n: every phrase of 1 to ``most_words`` words that a language has ``least`` times
    or more, overlaps counted, and one row of size 0 with the number of all its words.

    A-Z are lowered; pieces end at ``.,;:!?`` and line ends, and their words are separated by spaces and
    tabs. A null language is ``und``; a null or empty text has no words. Very long texts are counted in
    parts that end where a piece does. Repeated rows count each time; no rows give no rows; other
    columns, whatever their names, are not looked at. ``sample`` and ``lowered`` move work between passes and change no row.
    """
    spark = docs.sparkSession
    work = Work(spark, "phrases")
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), whole_text(text_col).alias("text"),
        F.pmod(F.xxhash64(whole_text(text_col)), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 << max(0, min(40, (size // PART_BYTES).bit_length()))
    shift = 65 - parts.bit_length()

    def passed(some: DataFrame, sizes: range, threshold: int, name: str, may=None, old=None) -> DataFrame:
        counted = some.mapInArrow(_counted(sizes, shift, may, old), COUNTS)
        tasks = max(1, min(MOST_TASKS, parts * len(sizes) // 16))
        dealt = counted.repartition(tasks, "size", "part").sortWithinPartitions("size", "part")
        return work.table(dealt.mapInArrow(_frequent(threshold), HASHES), name)

    drawn = rows.where(F.pmod(F.xxhash64("lang", "text", F.spark_partition_id()), F.lit(sample)) == 0)
    proposed = passed(drawn, range(1, most_words), max(2, int(lowered * least / sample)), "proposed")
    hashes = proposed.select("hash")
    bits = bloom.SEGMENT_BITS
    while bits < min(most_bits, 32 * hashes.count()):
        bits *= 2
    may, old, found = bloom.filter_of(hashes, bits, 1), None, []
    while True:
        shared = spark.sparkContext.broadcast(may)
        before = spark.sparkContext.broadcast(old) if old is not None else None
        sizes = range(2 if found else 1, most_words + 1)
        found.append(passed(rows, sizes, least, f"found-{len(found)}", shared, before))
        failed = found[-1].where(F.col("size") < most_words).where(~bloom.contains(spark, may)("hash"))
        failed = work.table(failed.select("hash"), f"failed-{len(found)}")
        if failed.isEmpty():
            break
        more = np.frombuffer(bloom.filter_of(failed, bits, 1), np.uint8)
        old, may = may, (np.frombuffer(may, np.uint8) | more).tobytes()
    frequent = found[0]
    for more in found[1:]:
        frequent = frequent.unionByName(more)
    homes, bits = frequent.select("home"), bloom.SEGMENT_BITS
    while bits < min(most_bits, 64 * homes.count()):
        bits *= 2
    named = spark.sparkContext.broadcast(bloom.filter_of(homes, bits, 1))
    texts = work.table(rows.mapInArrow(_texts(named, most_words), TEXTS), "texts")
    phrases = texts.where("size > 0").groupBy("size", "hash").agg(
        F.first("lang").alias("lang"), F.first("phrase").alias("phrase")
    )
    phrases = frequent.join(phrases, ["size", "hash"]).select("lang", "size", "phrase", "n")
    words = texts.where("size = 0").groupBy("lang").agg(F.sum("words").alias("n"))
    words = words.select("lang", F.lit(0).alias("size"), F.lit("").alias("phrase"), "n")
    counts = work.table(phrases.unionByName(words), "counts")
    for name in ("proposed", *(f"{kind}-{i}" for i in range(len(found) + 1) for kind in ("found", "failed")), "texts"):
        work.drop(name)
    return counts


def collocations(counts: DataFrame, *, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language, from ``phrase_counts``.

    ``a`` is the count of the phrase, ``l`` and ``r`` those of its parts at the cut with the lowest
    score 2,000,000 a / (l + r), rounded down (ties: the cut further left). A phrase goes if a longer
    frequent one that contains it has at least 80 per cent of its count. Ties are ranked by count, then
    by phrase. ``top=None`` ranks all. Products are decimals of 38 digits. No rows give no rows.
    """
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    phrases = counts.where("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"))
    parts = counts.where("size >= 1").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "*", F.expr("substring_index(phrase, ' ', k)").alias("left"),
        F.expr("substring_index(phrase, ' ', k - size)").alias("right"),
    )
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.withColumnsRenamed({"part": side, "f": name}), ["lang", side])
    cuts = cuts.withColumn("twice", F.lit(2_000_000).cast("decimal(8,0)") * exact("a")).withColumn(
        "both", exact("l") + exact("r")
    )
    cuts = cuts.withColumn("score", F.expr("twice div both"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest)
    inner = F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1),"
        " i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    )
    longer = phrases.where("size >= 3").select("lang", F.col("a").alias("longer"), F.explode(inner).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * exact("longer") < 80 * exact("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    words = counts.where("size = 0").select("lang", "n")
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a",
        F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"),
    )
