"""A two-bit counting Bloom filter built from sorted cell numbers, one segment at a time.

Every hash owns ``PROBES`` cells. A cell is kept when at least ``least`` rows hit it (one or two), so a
hash that occurs so often always has all its cells kept: the filter may name too many hashes, never too
few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latecast.llm import memory

PROBES = 2
SEGMENT_BITS = 1 << 19
AT_ONCE = 1 << 18
CELLS = "segment long, cells binary"
BITS = "segment long, bits binary"


def filter_bits(rows: int, bits_per_row: int, most: int) -> tuple[int, int]:
    """(bits of one filter, number of filters): filters over disjoint hash ranges stay below ``most``."""
    need = max(SEGMENT_BITS, rows * bits_per_row)
    rounds = -(-need // most)
    bits = SEGMENT_BITS
    while bits < -(-need // rounds):
        bits *= 2
    return bits, rounds


def cells_of(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cells of 64-bit hashes, one array for each probe."""
    h = (hashes if hashes.dtype == np.uint64 else hashes.astype(np.int64)).view(np.uint64)
    mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return [
        ((h * np.uint64(odd)) ^ (mixed >> np.uint64(29))) >> np.uint64(64 - bits.bit_length() + 1)
        for odd in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)[:PROBES]
    ]


def _cells(bits: int):
    """Per ``AT_ONCE`` hashes and segment, the sorted cells that are hit; a cell hit again is there twice."""

    def cells(held: list[np.ndarray]) -> pa.RecordBatch:
        cells, counts = np.unique(np.concatenate(cells_of(np.concatenate(held), bits)), return_counts=True)
        cells = np.repeat(cells, np.minimum(counts, 2)).astype(np.int64)
        names, starts = np.unique(cells // SEGMENT_BITS, return_index=True)
        within = (cells % SEGMENT_BITS).astype(np.uint32)
        parts = [p.tobytes() for p in np.split(within, starts[1:])] if len(names) else []
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array(parts, pa.binary())], ["segment", "cells"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size >= AT_ONCE:
                yield cells(held)
                held, size = [], 0
        if size:
            yield cells(held)

    return memory.tidy(run)


def _merged(least: int):
    """Rows sorted by segment: count each segment's cells, keep those hit often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hits = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int64()),
                 pa.array([np.packbits(hits >= least, bitorder="little").tobytes()], pa.binary())],
                ["segment", "bits"],
            )

        for batch in batches:
            for segment, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != current:
                    if current is not None:
                        yield done()
                    current, hits = segment, np.zeros(SEGMENT_BITS, np.uint8)
                cells = np.frombuffer(cells, np.uint32)
                hits[cells] += 1  # a cell that is there twice counts once here
                hits[cells[1:][cells[1:] == cells[:-1]]] += 1
                hits[cells] = np.minimum(hits[cells], 2)
        if current is not None:
            yield done()

    return memory.tidy(run)


def filter_of(hashes: DataFrame, bits: int, least: int = 2) -> bytes:
    """The filter of one hash column as ``bits / 8`` bytes; what the driver gets is no more than that."""
    segments = bits // SEGMENT_BITS
    rows = (
        hashes.mapInArrow(_cells(bits), CELLS)
        .repartition(max(1, min(segments, 200)), "segment")
        .sortWithinPartitions("segment")
        .mapInArrow(_merged(least), BITS)
        .collect()
    )
    out = bytearray(bits // 8)
    size = SEGMENT_BITS // 8
    for segment, packed in rows:
        out[segment * size:(segment + 1) * size] = packed
    return bytes(out)


def has(packed: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the filter."""
    table = np.frombuffer(packed, np.uint8)
    found = np.ones(len(hashes), bool)
    for cells in cells_of(hashes, 8 * len(packed)):
        found &= (table[(cells >> np.uint64(3)).astype(np.int64)]
                  >> (cells & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def contains(spark, packed: bytes):
    """A column function: may this hash be in the filter? Arrow arrays alone, so workers need no pandas for it."""
    shared = spark.sparkContext.broadcast(packed)

    def run(hashes: pa.Array) -> pa.Array:
        return pa.array(has(shared.value, hashes.to_numpy(zero_copy_only=False)))

    return F.arrow_udf(run, "boolean")


def names_of(keys: DataFrame, *, bits_per_row: int = 16, most_bits: int = 1 << 29) -> bytes:
    """The filter of the written ``keys``, 64-bit hashes.

    Beyond ``most_bits`` it does not grow: it names more rows wrongly, and callers check exactly.
    """
    bits = SEGMENT_BITS
    while bits < min(most_bits, keys.count() * bits_per_row):
        bits *= 2
    return filter_of(keys, bits, 1)


def named_by(keys: DataFrame, *, bits_per_row: int = 16, most_bits: int = 1 << 29):
    """A column function: may this 64-bit hash be one of the written ``keys``?"""
    return contains(keys.sparkSession, names_of(keys, bits_per_row=bits_per_row, most_bits=most_bits))
