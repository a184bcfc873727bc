"""Near-duplicate documents by SetSketch registers, likelihood estimates and exact checks.

A document's set holds its distinct shingles of five words. Equal sets are one class, which one member
stands for from then on. A class has registers, truncated minima on an exponential scale, as many as the
threshold asks for; bands of equal registers are buckets. In a bucket every class is compared with one centre, not with
every other: pairs whose jointly estimated similarity is high enough are checked on full sets.

Buckets that still hold several components after that are gone through again. In buckets of bounded size
one matrix product counts what all members share, and only links between components leave the task. In
larger ones a member with many
shingles that are rare in the bucket must share some of them with whatever it is linked with, so its
pairs are found by these. Of the others, the members with the fewest shingles of their own are the next
centres: one first, then those outside the largest component, until no pair of different components is
left unseen; own shingles, which no other member has, bound the similarity of a pair beforehand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latecast.llm import bloom, memory, pieces
from latecast.llm.shared import Work, numbered, rows_in_batch, whole_text

SHINGLE = 5
THRESHOLD = 85  # per cent
REGISTERS = 64  # at 85 per cent; ``bands_of`` says how many bands other thresholds take
BAND = 4
MISSED = 1 / 130_000  # pairs at the threshold that share no band, at most
BASE = 1.001
RATE = 20.0
TOP = 65534
#: Pairs estimated so many standard deviations below the threshold are no links: 0.60 at 0.85, where
#: one deviation is 0.045, and 0.56 at 0.80.
SURE = 5.65
GROWTH = 8  # times as many centres in each further round,
AT_ONCE = 256  # or so many, if no more are left
SALT_ROWS = 256
SET_ROWS = 32  # sets of very long texts may follow each other
PART_ITEMS = 1 << 20  # shingles that one task counts at a time
EXACT_MEMBERS = 2048  # buckets of so many members, and no more shingles than that, are counted exactly
RARE = 3  # a shingle that so many members of a bucket have at most is rare there

_STEP = np.uint64(0x9E3779B97F4A7C15)


def bands_of(threshold: int) -> int:
    """How many bands a pair at the threshold (per cent) needs: 16 at 85, 23 at 80."""
    chance = min(threshold / 100, 0.99) ** BAND
    return math.ceil(math.log(MISSED) / math.log1p(-chance))


def least_estimate(threshold: int, size: int) -> float:
    """Pairs whose similarity is estimated lower from ``size`` registers are no links."""
    share = threshold / 100
    return share - SURE * math.sqrt(share * (1 - share) / size)


def hash_family(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of ``size`` registers."""
    random = np.random.default_rng(20240501)
    factors = random.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, random.integers(0, 1 << 63, size, dtype=np.uint64)


_FAMILY = hash_family(REGISTERS)


def shingle_sets(buffer: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    hashes, texts = [], []
    for block, starts, lengths, text in pieces.word_windows(buffer, offsets):
        lower = block | ((block >= 65) & (block <= 90)).astype(np.uint8) << 5
        hashes.append(pieces.word_hashes(lower, starts, lengths))
        texts.append(text)
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    text = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    limits = np.searchsorted(text, np.arange(len(offsets)))
    rolled = words.copy()
    for i in range(1, min(SHINGLE, len(words))):
        rolled[:len(words) - i] = rolled[:len(words) - i] * _STEP + words[i:]
    rolled = pieces.mixed(rolled)
    for low, high in zip(limits[:-1], limits[1:], strict=True):
        n = int(high - low)
        if n >= SHINGLE:
            yield np.unique(rolled[low:high - SHINGLE + 1])
        elif n:
            short = np.uint64(n)
            for word in words[low:high]:
                short = pieces.mixed(np.array([short]) * _STEP + word)[0]
            yield np.array([short])
        else:
            yield np.zeros(0, np.uint64)


def registers(items: np.ndarray, family: tuple[np.ndarray, np.ndarray] = _FAMILY) -> np.ndarray:
    """Truncated minima: floor(1 - log_b(h)) of the smallest exponential variate h of each register."""
    factors, shifts = family
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), 2048):
        part = items[i:i + 2048, None] * factors + shifts
        np.minimum(low, part.min(axis=0), out=low)
    uniform = (low.astype(np.float64) + 0.5) / 2.0**64
    h = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def fingerprint(items: np.ndarray) -> tuple[int, int]:
    """Two sums that are equal for equal sets."""
    first = pieces.mixed(items ^ _STEP).sum(dtype=np.uint64)
    second = pieces.mixed(items + _STEP).sum(dtype=np.uint64)
    return int(first.astype(np.int64)), int(second.astype(np.int64))


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Similarities of rows by maximum likelihood, from which registers are larger, smaller, equal.

    The sizes are known, so one unknown is left; the likelihood is concave in it, and the zero of its
    slope is found by halving.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = size_a / (size_a + size_b)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    top = high.copy()
    scale = (BASE - 1) / BASE
    chance = lambda x: -np.log1p(-np.maximum(x, 1e-12) * scale) / np.log(BASE)
    slope = lambda x: scale / (1 - np.maximum(x, 1e-12) * scale) / np.log(BASE)
    for _ in range(30):
        j = (low + high) / 2
        x, y = u - v * j, v - u * j
        px, py, dx, dy = chance(x), chance(y), slope(x), slope(y)
        rise = (same * (v * dx + u * dy) / np.maximum(1 - px - py, 1e-12)
                - more * v * dx / px - less * u * dy / py)
        low, high = np.where(rise > 0, j, low), np.where(rise > 0, high, j)
    return np.minimum((low + high) / 2, top)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = hash_family(size)
        for batch in batches:
            buffer, offsets = pieces.text_buffer(batch.column(1))
            for first, last in pieces.slices(batch, offsets):
                sizes, prints, sketches = [], [], []
                for items in shingle_sets(buffer, offsets[first:last + 1]):
                    sizes.append(len(items))
                    prints.append(fingerprint(items))
                    sketches.append(registers(items, family).tobytes() if len(items) else b"")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(sizes, pa.int64()),
                     pa.array([p[0] for p in prints], pa.int64()),
                     pa.array([p[1] for p in prints], pa.int64()), pa.array(sketches, pa.binary())],
                    ["id", "n", "node", "check", "registers"],
                )

    return memory.tidy(run)


def _signs(named: Broadcast):
    """Size and fingerprint of each text's set; null where the filter does not name the hash beside it."""

    def run(hashes: pa.Array, texts: pa.Array) -> pa.Array:
        may = bloom.has(named.value, hashes.to_numpy(zero_copy_only=False))
        chosen = texts.filter(pa.array(may))
        signs = []
        if len(chosen):
            buffer, offsets = pieces.text_buffer(chosen)
            for first, last in pieces.slices(pa.record_batch([chosen], ["text"]), offsets):
                signs += [(len(x), *fingerprint(x)) for x in shingle_sets(buffer, offsets[first:last + 1])]
        columns = np.zeros((3, len(may)), np.int64)
        columns[:, may] = np.array(signs, np.int64).reshape(-1, 3).T
        return pa.StructArray.from_arrays(
            [pa.array(x) for x in columns], ["n", "node", "check"], mask=pa.array(~may))

    return run


def _bands(bands: int):
    """Bucket keys of each class, one row a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            data = b"".join(batch.column(1).to_pylist())
            groups = np.frombuffer(data, "<u8").reshape(-1, bands)  # four 16-bit registers each
            keys = pieces.mixed(groups + (np.arange(bands, dtype=np.uint64) * _STEP)[None, :])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(nodes, bands))], ["key", "node"]
            )

    return memory.tidy(run)


def _sets(named: Broadcast):
    """The sets of the texts whose hash beside them the filter names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = bloom.has(named.value, batch.column(0).to_numpy())
            if not may.any():
                continue
            texts = batch.column(1).filter(pa.array(may))
            buffer, offsets = pieces.text_buffer(texts)
            for first, last in pieces.slices(pa.record_batch([texts], ["text"]), offsets):
                found = list(shingle_sets(buffer, offsets[first:last + 1]))
                prints = [fingerprint(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                     pa.array([x.tobytes() for x in found], pa.binary())],
                    ["node", "check", "items"],
                )

    return memory.tidy(run)


@memory.tidy
def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by centre: the centre's own set first, then the sets to hold against it."""
    centre = None
    for batch in batches:
        out = []
        columns = [batch.column(c) for c in ("a", "role", "b", "items")]
        for row in range(batch.num_rows):
            a, role, b, items = (c[row].as_py() for c in columns)
            items = np.frombuffer(items, np.uint64)
            if role == 0:
                centre = items
            else:
                both = len(np.intersect1d(centre, items, assume_unique=True))
                out.append((a, b, both, len(centre) + len(items) - both))
        rows = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in rows], ["a", "b", "both", "either"]
        )


def _missing(n: np.ndarray, least: np.ndarray, threshold: int) -> np.ndarray:
    """How many of its ``n`` shingles a set can lack in a linked set of a bucket whose smallest set has
    ``least``."""
    other = np.maximum(least, np.ceil(threshold * n / 100 - 1e-9))
    return np.floor(n - threshold / (100 + threshold) * (n + other) + 1e-9).astype(np.int64)


@memory.tidy
def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of (key, node, n, least, parts, label, items) cut into parts by shingle hash, one row a part."""
    names = ["key", "node", "n", "least", "parts", "label", "items"]
    for batch in batches:
        out = []
        for key, node, n, least, parts, label, data in zip(
            *(batch.column(c).to_pylist() for c in names), strict=True
        ):
            if parts < 2:
                out.append((key, 0, node, n, least, parts, label, data))
                continue
            found = np.frombuffer(data, np.uint64)
            part = (found >> np.uint64(32)) % np.uint64(parts)
            out += [
                (key, p, node, n, least, parts, label, found[part == p].tobytes()) for p in range(parts)
            ]
        rows = list(zip(*out, strict=True)) or [[]] * 8
        kinds = [pa.int64()] * 7 + [pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["key", "part", *names[1:]]
        )


def rare_items(
    sets: list[np.ndarray], n: np.ndarray, least: np.ndarray, threshold: int | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(own, rare, a, b, shared) of the sets of one bucket.

    ``own`` counts items that no other set has, ``rare`` those that ``RARE`` sets have at most; a and b
    are pairs of places that share so many rare items. With a threshold, pairs that share too few of
    them for a link of a set with more rare items than it can lack are left out.
    """
    size = len(sets)
    owner = np.repeat(np.arange(size), [len(x) for x in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    times = counts[inverse]
    own = np.bincount(owner, times == 1, minlength=size).astype(np.int64)
    rare = np.bincount(owner, times <= RARE, minlength=size).astype(np.int64)
    found = []
    for many in range(2, RARE + 1):
        some = np.flatnonzero(times == many)
        holders = owner[some[np.argsort(inverse[some], kind="stable")]].reshape(-1, many)
        found += [holders[:, i] * size + holders[:, j] for i in range(many) for j in range(i + 1, many)]
    pairs, shared = np.unique(np.concatenate(found), return_counts=True)
    a, b = pairs // size, pairs % size
    if threshold is not None:
        lacks = _missing(n, least, threshold)
        bound = np.where(rare > lacks, rare - lacks, 0)
        keep = (shared >= bound[a]) & (shared >= bound[b]) & ((bound[a] > 0) | (bound[b] > 0))
        a, b, shared = a[keep], b[keep], shared[keep]
    return own, rare, a, b, shared


def exact_links(
    sets: list[np.ndarray], labels: np.ndarray, threshold: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of sets of different labels that are similar enough, one pair for two labels."""
    size = len(sets)
    n = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(size), n)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.zeros((size, size), np.float32)
    place = np.cumsum(counts > 1) - 1  # items of one set only are shared with nobody
    some = counts[inverse] > 1
    rows, columns = owner[some], place[inverse[some]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for low in range(0, int(place[-1]) + 1, 4096):
        a, b = np.searchsorted(columns, [low, low + 4096])
        block = np.zeros((size, 4096), np.float32)
        block[rows[a:b], columns[a:b] - low] = 1
        common += block @ block.T
    both = common.astype(np.int64)
    either = n[:, None] + n[None, :] - both
    a, b = np.nonzero(np.triu(100 * both >= threshold * either, 1) & (labels[:, None] != labels[None, :]))
    low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
    _, first = np.unique(np.stack([low, high], axis=1), axis=0, return_index=True)
    return a[first], b[first]


def _rare_items(threshold: int):
    """Rows sorted by (key, part): per member (b null) its own and rare items, and pairs by rare ones.

    Of buckets that are counted exactly, links alone, marked by -1 own items.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def done() -> pa.RecordBatch:
            nodes = np.array([r[0] for r in rows])
            if rows[0][3] == 0:
                a, b = exact_links([r[5] for r in rows], np.array([r[4] for r in rows]), threshold)
                return pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (
                        np.full(len(a), group[0]), nodes[a], nodes[b], np.full(len(a), -1), np.zeros(len(a), int)
                    )], ["key", "a", "b", "own", "shared"])
            sizes, least = (np.array([r[i] for r in rows], np.float64) for i in (1, 2))
            whole = threshold if rows[0][3] == 1 else None  # parts are added up before they are judged
            own, rare, a, b, shared = rare_items([r[5] for r in rows], sizes, least, whole)
            members = len(rows)
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(members + len(a), group[0])),
                pa.array(np.concatenate([nodes, nodes[a]])),
                pa.array([None] * members + nodes[b].tolist(), pa.int64()),
                pa.array(np.concatenate([own, np.zeros(len(a), np.int64)])),
                pa.array(np.concatenate([rare, shared]).astype(np.int64)),
            ], ["key", "a", "b", "own", "shared"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (
                "key", "part", "node", "n", "least", "parts", "label", "items")]
            for key, part, node, n, least, parts, label, items in zip(*columns, strict=True):
                if (key, part) != group:
                    if group is not None:
                        yield done()
                    group, rows = (key, part), []
                rows.append((node, n, least, parts, label, np.frombuffer(items, np.uint64)))
        if group is not None:
            yield done()

    return memory.tidy(run)


def _likely(size: int):
    def run(a: pa.Array, b: pa.Array, size_a: pa.Array, size_b: pa.Array) -> pa.Array:
        read = lambda x: np.frombuffer(b"".join(x.to_pylist()), "<u2").reshape(-1, size)
        sizes = [x.to_numpy(zero_copy_only=False).astype(float) for x in (size_a, size_b)]
        return pa.array(estimate(read(a), read(b), *sizes))

    return run


class Links:
    """The classes of one corpus, and what is known of their links so far."""

    def __init__(self, docs: DataFrame, work: Work, threshold: int) -> None:
        self.docs, self.work, self.threshold = docs, work, threshold
        self.spark = docs.sparkSession
        self.bands = bands_of(threshold)
        self.size = self.bands * BAND
        rows = docs.select("id", "text").mapInArrow(
            _sketch(self.size), "id long, n long, node long, check long, registers binary"
        )
        self.sketches = work.table(rows, "sketches")
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "registers"))
        self.classes = work.table(
            self.sketches.where("n > 0").groupBy("node", "check", "n").agg(first.alias("first"))
            .select("node", "check", "n", F.col("first.id").alias("id"),
                    F.col("first.registers").alias("registers")), "classes",
        )
        self.rounds = 0
        self.edges = None

    def buckets(self) -> None:
        """Members of the buckets that hold several classes, each bucket's first centre, and the sets
        of all these classes, made from the texts that a filter of their ids names."""
        bands = self.classes.select("node", "registers").mapInArrow(_bands(self.bands), "key long, node long")
        bands = self.work.table(bands, "bands")
        shared = self.work.table(
            bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("centre"))
            .where("size > 1"), "shared",
        )
        self.members = self.work.table(bands.join(shared, "key"), "members")
        self.work.drop("bands")
        named = self.work.table(
            self.members.select("node").distinct().join(self.classes, "node").select("node", "check", "id"),
            "named",
        )
        key = F.xxhash64("id")
        wanted = self.spark.sparkContext.broadcast(bloom.names_of(named.select(key.alias("h"))))
        sets = self.docs.select(key.alias("h"), "text").mapInArrow(
            _sets(wanted), "node long, check long, items binary")
        with rows_in_batch(self.spark, SET_ROWS):
            self.sets = self.work.table(
                sets.join(named.select("node", "check"), ["node", "check"], "left_semi")
                .dropDuplicates(["node", "check"]).select("node", "items"), "sets",
            )

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and estimated similarity allow a link."""
        side = lambda x: self.classes.select(
            F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").where(
            100 * F.least("n_a", "n_b") >= self.threshold * F.greatest("n_a", "n_b")
        )
        similar = F.arrow_udf(_likely(self.size), "double")
        return both.withColumn("j", similar("r_a", "r_b", "n_a", "n_b")).where(
            F.col("j") >= least_estimate(self.threshold, self.size)
        ).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Links among written pairs, by the full sets of the classes that they name."""
        self.rounds += 1
        tag = str(self.rounds)
        sets = self.sets
        salts = F.ceil(F.col("uses") / SALT_ROWS)
        uses = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("uses"))
        salted = pairs.join(uses, "a").withColumn("salt", F.pmod(F.xxhash64("b"), salts))
        salted = self.work.table(salted.select("a", "b", "salt"), f"salted-{tag}")
        item = lambda x: sets.select(F.col("node").alias(x), "items")
        rows = salted.select("a", "salt").distinct().join(item("a"), "a").select(
            "a", "salt", F.lit(0).alias("role"), F.lit(0).cast("long").alias("b"), "items"
        ).unionByName(
            salted.join(item("b"), "b").select("a", "salt", F.lit(1).alias("role"), "b", "items")
        )
        checked = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(
            _overlaps, "a long, b long, both long, either long"
        )
        with rows_in_batch(self.spark, SET_ROWS):
            linked = self.work.table(
                checked.where(100 * F.col("both") >= self.threshold * F.col("either")).select("a", "b"),
                f"links-{tag}",
            )
        return linked

    def components(self) -> DataFrame:
        """(node, label) of all classes with a link: the smallest node number that can be reached."""
        both = self.edges.unionByName(self.edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = self.work.table(both.distinct(), f"both-{self.rounds}")
        labels = self.work.table(
            both.groupBy("a").agg(F.min("b").alias("m"))
            .select(F.col("a").alias("node"), F.least("a", "m").alias("label")),
            f"labels-{self.rounds}-0",
        )
        step = 0
        while True:
            step += 1
            near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(
                F.min("label").alias("near"))
            moved = labels.join(near.withColumnRenamed("a", "node"), "node").select(
                "node", "label", F.least("label", "near").alias("next"))
            jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
            moved = self.work.table(
                moved.join(jump, "next").select(
                    "node", F.least("next", "far").alias("label"),
                    (F.least("next", "far") != F.col("label")).alias("changed")),
                f"labels-{self.rounds}-{step}",
            )
            labels = moved.select("node", "label")
            if not moved.where("changed").limit(1).count():
                return labels

    def rare_shingles(self, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(members, pairs, links) of the buckets with several components.

        Buckets of bounded size are counted exactly: their links between components are there at once.
        In larger ones a member with more rare shingles than a linked set can lack shares some with it: its pairs are
        found by these alone. The others are the members (key, node, n, own, left); ``left`` is how many
        shingles a link of theirs can share at most.
        """
        rows = self.members.where("size > 2").select("key", "node").join(labels, "node", "left")
        rows = rows.withColumn("label", F.coalesce("label", "node"))
        mixed = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        mixed = self.work.table(mixed.where("low <> high").select("key"), "mixed")
        sized = self.work.table(
            rows.select("key", "node", "label").join(mixed, "key").join(
                self.classes.select("node", "n"), "node"),
            "sized",
        )
        parts = self.work.table(
            sized.groupBy("key").agg(
                F.when((F.count(F.lit(1)) <= EXACT_MEMBERS) & (F.sum("n") <= PART_ITEMS), 0)
                .otherwise(F.ceil(F.sum("n") / PART_ITEMS)).cast("long").alias("parts"),
                F.min("n").alias("least")),
            "parts",
        )
        cut = sized.join(parts, "key").join(self.sets, "node").select(
            "key", "node", "n", "least", "parts", "label", "items")
        counted = (
            cut.mapInArrow(
                _parted, "key long, part long, node long, n long, least long, parts long, label long, "
                "items binary")
            .repartition("key", "part").sortWithinPartitions("key", "part")
            .mapInArrow(_rare_items(self.threshold), "key long, a long, b long, own long, shared long")
        )
        with rows_in_batch(self.spark, SET_ROWS):
            counted = self.work.table(
                counted.groupBy("key", "a", "b").agg(
                    F.sum("own").alias("own"), F.sum("shared").alias("shared")), "counted",
            )
        t = self.threshold
        other = F.greatest(F.col("least").cast("double"), F.ceil(F.col("n") * (t / 100) - 1e-9))
        lacks = F.floor(F.col("n") - (F.col("n") + other) * (t / (100 + t)) + 1e-9)
        members = counted.where("b is null").select("key", F.col("a").alias("node"), "own", "shared").join(
            sized, ["key", "node"]).join(parts.select("key", "least"), "key")
        members = self.work.table(
            members.withColumn("bound", F.greatest(F.lit(0).cast("long"), F.col("shared") - lacks)), "judged")
        links = counted.where("own < 0").select("a", "b").distinct()
        bound = lambda x: members.select("key", F.col("node").alias(x), F.col("bound").alias(f"bound_{x}"))
        pairs = counted.where("b is not null and own >= 0").join(bound("a"), ["key", "a"]).join(bound("b"), ["key", "b"])
        pairs = pairs.where(
            "shared >= bound_a and shared >= bound_b and (bound_a > 0 or bound_b > 0)"
        ).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left = F.col("n") - F.col("own")
        common = members.where("bound = 0").withColumn("left", left).where(
            100 * F.col("left") >= t * (F.col("n") + F.greatest("left", "least") - F.col("left"))
        ).select("key", "node", "n", "own", "left")
        return (self.work.table(common, "common"), self.work.table(pairs, "rare-pairs"),
                self.work.table(links, "exact-links"))

    def further_pairs(self, candidates: DataFrame, labels: DataFrame, centres: int) -> tuple[DataFrame, int]:
        """Pairs of different components within buckets, and the most members outside the largest one.

        With one centre it is the member with the fewest own shingles; with more they are those with the
        fewest outside the bucket's largest component.
        """
        rows = candidates.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        rows = self.work.table(rows, f"tagged-{self.rounds}-{centres}")
        parts = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("part"))
        largest = parts.groupBy("key").agg(
            F.max(F.struct("part", "label")).alias("top"), F.sum("part").alias("all")
        ).withColumn("others", F.col("all") - F.col("top.part")).where("others > 0")
        open_ = self.work.table(
            largest.select("key", F.col("top.label").alias("main"), "others"), f"open-{self.rounds}-{centres}"
        )
        most = int(open_.agg(F.max("others")).first()[0] or 0)
        rows = rows.join(open_, "key")
        order = Window.partitionBy("key").orderBy("own", "node")
        chosen = (rows if centres == 1 else rows.where("label <> main")).withColumn(
            "place", F.row_number().over(order)).where(F.col("place") <= centres)
        centre = chosen.select("key", F.col("node").alias("a"), F.col("label").alias("label_a"),
                               F.col("n").alias("n_a"), F.col("left").alias("left_a"))
        common = F.least("left", "left_a")
        met = rows.join(centre, "key").where(
            (F.col("label") != F.col("label_a"))
            & (100 * common >= self.threshold * (F.col("n") + F.col("n_a") - common))
        )
        pairs = met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        return pairs.distinct(), most


def _linked(docs: DataFrame, id_col: str, text_col: str, threshold: int, work: Work) -> DataFrame:
    """Per row: id, n, node and check of its set, component, and ``first``: is its set the one that
    stands for the component? Without shingles the last two are null."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    links = Links(rows, work, threshold)
    links.buckets()
    first = links.members.where("node <> centre").select(
        F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    done = work.table(links.likely(first), "pairs-0")
    links.edges = links.verified(done)
    labels = links.components()
    candidates, by_rare, exact = links.rare_shingles(labels)
    if exact.limit(1).count():
        links.rounds += 1
        links.edges = links.edges.unionByName(exact)
        labels = links.components()
    centres, first_round = 1, True
    while True:
        pairs, most = links.further_pairs(candidates, labels, centres)
        if first_round:
            pairs = pairs.unionByName(by_rare).distinct()
        elif not most:
            break
        first_round = False
        known = done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        fresh = work.table(
            links.likely(pairs.join(known, ["a", "b"], "left_anti")), f"pairs-{links.rounds}-{centres}"
        )
        if fresh.limit(1).count():
            done = done.unionByName(fresh)
            links.edges = links.edges.unionByName(links.verified(fresh))
            labels = links.components()
        if most <= centres > 1 or not most:  # every pair of different components has been seen
            break
        centres = max(centres * GROWTH, min(most, AT_ONCE))
    named = links.classes.select("node", "check", "n", "id").join(labels, "node", "left")
    group = F.coalesce("label", "node")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node", "check", "n"))
    smallest = named.withColumn("label", group).groupBy("label").agg(least.alias("least"))
    same = [F.col(x) == F.col(f"least.{x}") for x in ("node", "check", "n")]
    classes = work.table(
        named.withColumn("label", group).join(smallest, "label").select(
            "node", "check", "n", F.col("least.id").alias("component"),
            (same[0] & same[1] & same[2]).alias("first")),
        "components",
    )
    return links.sketches.select("id", "n", "node", "check").join(classes, ["node", "check", "n"], "left")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: int = THRESHOLD
) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links), kept.

    Texts without words, null ones too, have no shingles and are linked with nothing. Repeated rows and
    equal texts are one class. A null id is nobody's component unless all ids of a component are null;
    only then, or alone without links, such a row is kept. ``kept`` compares ids alone, so all rows of a
    component that share its id are kept; ``without_near_copies`` takes one of them. Very long texts are
    taken whole. No rows give no rows. Other columns are not read. Two different sets are taken for equal if two 64-bit sums and
    their sizes agree, and a pair at the threshold shares no band once in more than 130,000 pairs.
    """
    out = _linked(docs, id_col, text_col, threshold, Work(docs.sparkSession, "near-dup"))
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def without_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: int = THRESHOLD
) -> DataFrame:
    """The rows that stay, with their columns: one row of each component and all without words.

    A component's row has its smallest id; only if all its ids are null, a row without id stays. What
    goes is named by id and set, so rows that share an id, a null one too, are judged by their own
    texts; of rows with the same id and set one stays. Only rows whose id a filter of the listed ids
    names shuffle. Very long texts are taken whole; no rows give no rows; columns may have any names.
    """
    plain, (id_, text) = numbered(docs, id_col, text_col)
    return _without_near_copies(plain, id_, text, threshold).toDF(*docs.columns)


def _without_near_copies(docs: DataFrame, id_col: str, text_col: str, threshold: int) -> DataFrame:
    work = Work(docs.sparkSession, "near-copies")
    key = ["id", "node", "check", "n"]
    rows = _linked(docs, id_col, text_col, threshold, work).where("n > 0")
    stays = F.col("first") & F.col("id").eqNullSafe(F.col("component"))
    listed = work.table(
        rows.groupBy(*key).agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("rows"))
        .where("not stays or rows > 1").select(*(F.col(x).alias(f"__{x}") for x in key), "stays"), "listed",
    )
    names = bloom.names_of(listed.select(F.xxhash64("__id").alias("h")))
    id_ = F.col(id_col).cast("long")
    straight = docs.where(~bloom.contains(docs.sparkSession, names)(F.xxhash64(id_)))
    # One function filters and signs: two in a row would be two workers a task, each with its memory. Optimised as
    # if it were not deterministic, it is not copied into the filter.
    named = docs.sparkSession.sparkContext.broadcast(names)
    sign = F.arrow_udf(_signs(named), "struct<n: long, node: long, check: long>").asNondeterministic()
    suspects = docs.withColumn("__set", sign(F.xxhash64(id_), whole_text(text_col))).where("__set is not null")
    match = id_.eqNullSafe(F.col("__id"))
    for x in ("node", "check", "n"):
        match &= F.col(f"__set.{x}") == F.col(f"__{x}")
    stay = straight.unionByName(suspects.join(listed, match, "left_anti").drop("__set"))
    if not listed.where("stays").limit(1).count():
        return stay
    again = suspects.join(listed.where("stays"), match, "left_semi")
    return stay.unionByName(again.dropDuplicates([id_col, "__set"]).drop("__set"))
