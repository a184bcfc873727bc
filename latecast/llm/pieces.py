"""Texts as id lists by encoding each distinct piece of them once.

A tokenizer splits text by a pattern before it merges anything. Texts are cut only where the pattern
itself must cut (between a letter and a full stop, say), so a piece's ids depend on nothing outside it.
Bytes are classified and cut with array operations; only pieces not met before reach the tokenizer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

OTHER, SPACE, LETTER, DIGIT, MARK, APOSTROPHE = range(6)
WINDOW = 1 << 20
KEY_BYTES = 32
MOST_KEPT = 1 << 18
SLOT_BITS = 20


def byte_classes() -> np.ndarray:
    """Class of each byte; bytes from 128 on are OTHER here, Latin-1 letters are found in pairs."""
    table = np.zeros(256, np.uint8)
    table[0x21:0x7F] = MARK
    table[[0x20, 9, 10, 11, 12, 13]] = SPACE
    table[ord("0"):ord("9") + 1] = DIGIT
    table[ord("A"):ord("Z") + 1] = LETTER
    table[ord("a"):ord("z") + 1] = LETTER
    table[ord("'")] = APOSTROPHE
    return table


def cuts(*pairs: tuple[int, int]) -> np.ndarray:
    """Where to cut, by class of the byte before and of the byte after."""
    table = np.zeros((6, 6), bool)
    for before, after in pairs:
        table[before, after] = True
    return table.ravel()


_CLASSES = byte_classes()


def classes_of(data: np.ndarray) -> np.ndarray:
    found = _CLASSES[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the two signs among the letters
    found[lead] = LETTER
    found[lead + 1] = LETTER
    return found


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def short_keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first ``KEY_BYTES`` bytes of runs as integers, and their lengths."""
    padded = np.concatenate([data, np.zeros(KEY_BYTES, np.uint8)])
    words = np.lib.stride_tricks.as_strided(
        padded[:8].view(np.uint64), (len(padded) - 7,), (1,), writeable=False
    )
    masks = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    keys = np.zeros((len(starts), KEY_BYTES // 8 + 1), np.uint64)
    for i in range(KEY_BYTES // 8):
        some = np.flatnonzero(lengths > 8 * i)
        if not len(some):
            break
        n = np.minimum(lengths[some] - 8 * i, 8)
        keys[some, i] = words[starts[some] + 8 * i] & masks[n]
    keys[:, -1] = lengths
    return keys


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly."""
    x = hashes.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes, whatever stands around it."""
    keys = short_keys(data, starts, lengths)
    out = np.zeros(len(starts), np.uint64)
    for i in range(keys.shape[1]):
        out = mixed(out ^ keys[:, i] ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64)))
    for i in np.flatnonzero(lengths > KEY_BYTES):
        out[i] = xxhash.xxh64_intdigest(data[starts[i]:starts[i] + lengths[i]].tobytes())
    return out


def word_windows(
    data: np.ndarray, offsets: np.ndarray, size: int = WINDOW
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of all texts, window by window: (bytes, starts, lengths, number of the text).

    Words are runs of bytes that are no ASCII white space; none is cut by a window's end.
    """
    low, end, step = int(offsets[0]), int(offsets[-1]), size
    while low < end:
        high = min(end, low + step)
        block = data[low:high]
        full = _CLASSES[block] != SPACE
        edge = np.zeros(len(block) + 1, bool)
        first = int(np.searchsorted(offsets, low, side="left"))
        last = int(np.searchsorted(offsets, high, side="right"))
        edge[offsets[first:last] - low] = True
        before = np.concatenate([[False], full[:-1]])
        after = np.concatenate([full[1:], [False]])
        starts = np.flatnonzero(full & (~before | edge[:-1]))
        ends = np.flatnonzero(full & (~after | edge[1:])) + 1
        if high < end and len(starts) and ends[-1] == len(block) and not edge[-1]:
            if len(starts) == 1 and starts[0] == 0:
                step *= 2
                continue
            high = low + int(starts[-1])
            starts, ends = starts[:-1], ends[:-1]
        step = size
        if len(starts):
            texts = np.searchsorted(offsets, starts + low, side="right") - 1
            yield block, starts, ends - starts, texts
        low = high


class PieceTable:
    """Distinct pieces of one task with their ids; forgotten when there are too many."""

    def __init__(
        self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], cut_table: np.ndarray, *,
        lower: bool = False, skip_space: bool = False,
    ) -> None:
        """``encode`` gives the ids of all pieces one after the other, and how many each has."""
        self.encode, self.cut_table, self.lower, self.skip_space = encode, cut_table, lower, skip_space
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.places = np.zeros(0, np.int64)  # of each hash in the arrays below
        self.keys = np.zeros((0, KEY_BYTES // 8 + 1), np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)  # the place that a hash's first bits had last

    def _add(self, texts: list[bytes]) -> np.ndarray:
        """Encode pieces and keep their ids; their places."""
        ids, lengths = self.encode(texts)
        first = len(self.starts)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        return np.arange(first, first + len(texts))

    def _places(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The place of every piece; a piece not met before is encoded."""
        if len(self.starts) > MOST_KEPT:
            self._forget()
        out = np.zeros(len(starts), np.int64)
        long = lengths > KEY_BYTES
        if long.any():
            which = np.flatnonzero(long)
            texts = [data[s:s + n].tobytes() for s, n in zip(starts[which], lengths[which], strict=True)]
            names = {t: i for i, t in enumerate(dict.fromkeys(texts))}
            keys = np.zeros((len(names), self.keys.shape[1]), np.uint64)
            places = self._add(list(names))
            self.keys = np.concatenate([self.keys, keys])
            out[which] = places[[names[t] for t in texts]]
            which = np.flatnonzero(~long)
            starts, lengths = starts[which], lengths[which]
        else:
            which = slice(None)
        if not len(starts):
            return out
        keys = short_keys(data, starts, lengths)
        hashes = np.zeros(len(starts), np.uint64)
        for i in range(keys.shape[1]):
            hashes = (hashes ^ keys[:, i]) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
            hashes ^= hashes >> np.uint64(32)
        slots = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        places = self.slots[slots].astype(np.int64)
        known = places >= 0
        if known.any():
            known &= (self.keys[places] == keys).all(axis=1)
        rest = np.flatnonzero(~known)
        if len(rest):
            places[rest] = self._looked_up(data, starts[rest], lengths[rest], keys[rest], hashes[rest])
            self.slots[slots[rest]] = places[rest]
        out[which] = places
        return out

    def _looked_up(
        self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray, hashes: np.ndarray
    ) -> np.ndarray:
        """Places by binary search over all hashes; what is not there is encoded."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if not (keys[first][inverse] == keys).all():  # two pieces share a hash: compare whole keys
            _, first, inverse = np.unique(keys, axis=0, return_index=True, return_inverse=True)
            inverse = inverse.ravel()
            distinct = hashes[first]
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        places = np.zeros(len(distinct), np.int64)
        places[known] = self.places[at[known]]
        known[known] = (self.keys[places[known]] == keys[first][known]).all(axis=1)
        new = np.flatnonzero(~known)
        if len(new):
            s, n = starts[first[new]], lengths[first[new]]
            places[new] = self._add([data[a:a + b].tobytes() for a, b in zip(s, n, strict=True)])
            self.keys = np.concatenate([self.keys, keys[first[new]]])
            order = np.argsort(np.concatenate([self.hashes, distinct[new]]), kind="stable")
            self.hashes = np.concatenate([self.hashes, distinct[new]])[order]
            self.places = np.concatenate([self.places, places[new]])[order]
        return places[inverse]

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of all texts, in parts one after the other, and the number of ids of each text.

        ``offsets`` are the texts' limits in ``data``. Work goes on in windows cut at piece limits, so a
        very long text needs no more memory than many short ones.
        """
        counts, parts = np.zeros(len(offsets) - 1, np.int64), []
        low, end, window = int(offsets[0]), int(offsets[-1]), WINDOW
        while low < end:
            high = min(end, low + window)
            block = data[low:high]
            if self.lower:
                block = block | ((block >= 65) & (block <= 90)).astype(np.uint8) << 5
            kinds = classes_of(block) if len(block) > 1 else _CLASSES[block]
            limits = self.cut_table[kinds[:-1] * np.uint8(6) + kinds[1:]]
            begins = np.concatenate([[True], limits])
            a, b = np.searchsorted(offsets, [low, high])
            begins[offsets[a:b] - low] = True
            starts = np.flatnonzero(begins)
            if high < end and not (a < b < len(offsets) and offsets[b] == high):
                if len(starts) == 1:
                    window *= 2
                    continue
                high = low + int(starts[-1])  # the last piece may go on
                starts = starts[:-1]
            window = WINDOW
            lengths = np.diff(np.concatenate([starts, [high - low]]))
            if self.skip_space:
                some = kinds[starts] != SPACE
                starts, lengths = starts[some], lengths[some]
            places = self._places(block, starts, lengths)
            n = self.lengths[places]
            parts.append(self.ids[gather(self.starts[places], n)])
            texts = np.searchsorted(offsets, starts + low, side="right") - 1
            counts += np.bincount(texts, n, minlength=len(counts)).astype(np.int64)
            low = high
        return parts, counts


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, and the texts' limits in them."""
    column = column.cast(pa.large_string())
    _, limits, data = column.buffers()
    offsets = np.frombuffer(limits, np.int64, len(column) + 1, 8 * column.offset)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def slices(batch: pa.RecordBatch, offsets: np.ndarray, most: int = 2 * WINDOW) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text, at least one row each."""
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(batch.num_rows, max(first + 1, last))
        yield first, last
        first = last
