"""Byte-level BPE by corpus-level merge replay, and decoding.

Each task is a corpus of its own: the distinct pretokens of its texts. An inverted index leads from a
range of ranks to the positions whose pairs have them; the ranges are applied in rank order, and only the
neighbours of merged pairs are looked up again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latecast.llm import memory, pieces
from latecast.llm.pieces import APOSTROPHE, DIGIT, LETTER, MARK, SPACE
from latecast.llm.shared import bound_batches

NONE = 1 << 30  # no rank
RANGES = 16
CUTS = pieces.cuts(
    *[(kind, SPACE) for kind in (LETTER, DIGIT, MARK, APOSTROPHE)],
    *[(LETTER, kind) for kind in (DIGIT, MARK, APOSTROPHE)],
    *[(DIGIT, kind) for kind in (LETTER, MARK, APOSTROPHE)],
    (MARK, LETTER), (MARK, DIGIT),
)


def read_ranks(data: bytes) -> dict[bytes, int]:
    lines = (line.split() for line in data.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in lines}


class Merges:
    """Replays all merges over a corpus of distinct words."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        pairs = [
            (ranks[token[:i]] << 32 | ranks[token[i:]], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        pairs.sort()
        self.pairs = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.made = np.array([r for _, r in pairs] or [NONE], np.int64)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        top = max(ranks.values(), default=0) + 1
        self.limits = [int(x) for x in np.unique(np.geomspace(256, max(top, 257), RANGES).astype(int))]
        self.limits[-1] = top

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of what neighbours make together."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.made[at], NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids, one word after the other, and how many each has: always its lowest rank first, at the leftmost place, until none is left.

        Ranks are gone through in ascending ranges. The index of a range holds the positions whose pair
        has such a rank; every word applies its lowest one, all words at once, until the range is empty.
        A merge that makes a still lower one possible puts that into the same index.
        """
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        rest = np.flatnonzero(whole < 0)
        data = np.frombuffer(b"".join([words[i] for i in rest]), np.uint8)
        lengths = np.fromiter((len(words[i]) for i in rest), np.int64, len(rest))
        ends = np.cumsum(lengths)
        size = len(data)
        owner = np.repeat(np.arange(len(rest)), lengths)
        symbol = self.bytes[data]
        after = np.arange(1, size + 1)
        before = np.arange(-1, size - 1)
        after[ends[lengths > 0] - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1
        pair = np.full(size, NONE)
        some = np.flatnonzero(after >= 0)
        pair[some] = self.rank(symbol[some], symbol[some + 1])
        for limit in self.limits:
            index = np.flatnonzero(pair < limit)
            while len(index):
                word = owner[index]
                firsts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                lowest = np.minimum.reduceat(pair[index] << 32 | index, firsts)
                at = lowest & 0xFFFFFFFF
                gone = after[at]
                following = after[gone]
                symbol[at] = lowest >> 32
                symbol[gone] = -1
                after[at] = following
                pair[gone] = pair[at] = NONE
                left = before[at]
                has = following >= 0
                p, q = at[has], following[has]
                before[q] = p
                pair[p] = self.rank(symbol[p], symbol[q])
                has = left >= 0
                p, q = left[has], at[has]
                pair[p] = self.rank(symbol[p], symbol[q])
                touched = np.concatenate([at, p])
                index = np.unique(np.concatenate([index, touched]))
                index = index[pair[index] < limit]
        left = np.flatnonzero(symbol >= 0)
        counts = np.ones(len(words), np.int64)
        counts[rest] = np.bincount(owner[left], minlength=len(rest))
        starts = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.int32)
        found = whole >= 0
        ids[starts[found]] = whole[found]
        ids[pieces.gather(starts[rest], counts[rest])] = symbol[left]
        return ids, counts


def _encoder(ranks: dict[bytes, int], pattern: str):
    """Pieces to ids: split by the pattern, replay the distinct words, join."""
    split, merges = regex.compile(pattern), Merges(ranks)

    def run(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        names: dict[bytes, int] = {}
        words, sizes = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = split.findall(text.decode())
            sizes[i] = len(found)
            for word in found:
                words.append(names.setdefault(word.encode(), len(names)))
        ids, counts = merges.replay(list(names))
        starts = np.cumsum(counts) - counts
        at = np.array(words, np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        lengths = np.bincount(owner, counts[at], minlength=len(texts)).astype(np.int64)
        return ids[pieces.gather(starts[at], counts[at])], lengths

    return run


def _decoder(ranks: dict[bytes, int]):
    """Ids of texts, one after the other, and how many each has, to the texts' bytes."""
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.cumsum(lengths) - lengths
    flat = np.frombuffer(b"".join(tokens), np.uint8)

    def run(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        n = lengths[ids]
        windows = [flat[pieces.gather(starts[ids[i:i + pieces.WINDOW]], n[i:i + pieces.WINDOW])]
                   for i in range(0, len(ids), pieces.WINDOW)]
        texts = np.concatenate(windows) if windows else np.zeros(0, np.uint8)
        total = np.concatenate([[0], np.cumsum(n)])
        limits = total[np.concatenate([[0], np.cumsum(counts)])]
        return pa.Array.from_buffers(
            pa.large_binary(), len(counts), [None, pa.py_buffer(limits), pa.py_buffer(texts)]
        ).cast(pa.binary())

    return run


def _encode(data: bytes, pattern: str, names: list[str], decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(data)
        table = pieces.PieceTable(_encoder(ranks, pattern), CUTS)
        back = _decoder(ranks) if decoded else None
        for batch in batches:
            buffer, offsets = pieces.text_buffer(batch.column(0))
            for first, last in pieces.slices(batch, offsets, pieces.WINDOW):
                parts, counts = table.encoded(buffer, offsets[first:last + 1])
                ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
                limits = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(limits), pa.array(ids))
                texts = [back(ids, counts)] if back else []
                others = [batch.column(i).slice(first, last - first) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([lists, *texts, *others], names)

    return memory.tidy(run)


def encode(
    docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "ids",
    decoded_col: str | None = None,
) -> DataFrame:
    """The other columns and the ids of every whole text; no special tokens. With ``decoded_col`` also the bytes
    decoded from these ids, by the same worker.

    ``vocabulary`` is a file of base64 tokens and ranks, read once by the driver (its size is fixed). A
    null or empty text has no ids. Very long texts are encoded in windows. Nothing is dropped, repeated
    rows stay, no rows give no rows; a column called like ``ids_col`` or ``decoded_col`` is replaced.
    """
    with open(vocabulary, "rb") as f:
        data = f.read()
    bound_batches(docs.sparkSession)
    new = [ids_col, *([decoded_col] if decoded_col else [])]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, *new)]
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias(ids_col), *kept)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    schema = f"`{ids_col}` array<int>" + (f", `{decoded_col}` binary" if decoded_col else "")
    names = [*new, *rows.columns[1:]]
    return rows.mapInArrow(_encode(data, pattern, names, bool(decoded_col)), schema + (f", {kinds}" if kinds else ""))


def _decode(data: bytes, names: list[str], ids_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = _decoder(read_ranks(data))
        for batch in batches:
            lists = batch.column(ids_at).fill_null([])
            counts = np.diff(lists.offsets.to_numpy())
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, back(ids, counts)], names)

    return memory.tidy(run)


def decode(
    encoded: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded"
) -> DataFrame:
    """All columns and the bytes that the ids stand for; no ids, or null, give no bytes. Null ids of rows do not
    matter; a column called like ``out_col`` is replaced; no rows give no rows."""
    with open(vocabulary, "rb") as f:
        data = f.read()
    bound_batches(encoded.sparkSession)
    rows = encoded.drop(out_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(
        _decode(data, [*rows.columns, out_col], rows.columns.index(ids_col)),
        f"{kinds}, `{out_col}` binary",
    )
