"""Token ids in Simple-8b files: sorted by id, packed in 64-bit words, read back block by block.

A file is ``MAGIC``, 64-bit words, a footer, the footer's length (8 bytes) and ``MAGIC``. The top 4 bits
of a word select how many ids its low 60 bits hold. Selector 0 is the escape: one id of up to 60 bits
that no narrower word holds together with its neighbours. Every block of ``BLOCK`` ids begins a new
word; the footer has the blocks' first words, so that any block is found and decoded by itself, and
the documents' ids and numbers of tokens.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latecast.llm import files, memory, pieces, ranges
from latecast.llm.pieces import APOSTROPHE, DIGIT, LETTER, MARK, OTHER, SPACE
from latecast.llm.shared import Work, shared_folder, whole_text

MAGIC = b"S8BTOKEN"
BLOCK = 4096
#: By selector: bits of an id; a word holds 60 // bits of them.
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30])
HELD = 60 // BITS
_LIMITS = (1 << BITS[1:]).astype(np.uint64)
_NEEDS = np.append(np.arange(1, len(BITS)), len(BITS)).astype(np.int8)
RANGE_BYTES = 32 << 20
FILE_WORDS = 16 << 20
FLUSH = 256 * BLOCK
NO_ID = -(1 << 63)  # a null id in a file
MANIFEST = "shard int, part int, path string, docs long, ids long, bytes long"

_ANY = (SPACE, OTHER, LETTER, DIGIT, MARK, APOSTROPHE)
#: The vocabulary lower-cases, drops white space and takes digits one by one.
CUTS = pieces.cuts(
    *[(kind, SPACE) for kind in _ANY[1:]], *[(SPACE, kind) for kind in _ANY[1:]],
    *[(LETTER, kind) for kind in (DIGIT, MARK, APOSTROPHE)],
    *[(DIGIT, kind) for kind in (LETTER, DIGIT, MARK, APOSTROPHE)],
    (MARK, LETTER), (MARK, DIGIT),
)


def _choices(ids: np.ndarray) -> np.ndarray:
    """By place, the selector that holds the most ids from there on; a block's end cuts what it must hold.

    The largest needs of 1, 2, 3, ... ids from every place grow out of each other, one maximum a step.
    """
    size, most = len(ids), int(HELD.max())
    blocks = -(-size // BLOCK)
    needs = np.zeros((blocks, BLOCK + most), np.int8)  # nothing is needed past a block's end
    flat = np.zeros(blocks * BLOCK, np.int8)
    flat[:size] = _NEEDS[np.searchsorted(_LIMITS, ids, side="right")]  # each id's first selector that holds it
    needs[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    choice = np.zeros((blocks, BLOCK), np.int8)
    widest, reach = needs, 1
    for selector in range(len(BITS) - 1, 0, -1):  # the fewest ids first
        while reach < HELD[selector]:
            step = min(reach, int(HELD[selector]) - reach)
            widest = np.maximum(widest[:, :-step], widest[:, step:])
            reach += step
        choice[widest[:, :BLOCK] <= selector] = selector
    return choice.ravel()[:size]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of ids below 2**60, all blocks side by side."""
    size = len(ids)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ids = ids.astype(np.uint64)
    if int(ids.max()) >> 60:
        raise ValueError("an id needs more than 60 bits")
    ends = np.minimum((np.arange(size) // BLOCK + 1) * BLOCK, size)
    choice = _choices(ids)
    follow = np.minimum(np.arange(size) + HELD[choice], ends)
    at = np.arange(0, size, BLOCK)
    limit = ends[at]
    steps, owners = [], []
    blocks = np.arange(len(at))
    while len(at):
        steps.append(at)
        owners.append(blocks)
        at = follow[at]
        more = at < limit
        at, limit, blocks = at[more], limit[more], blocks[more]
    starts = np.sort(np.concatenate(steps))
    words = np.zeros(len(starts), np.uint64)
    selected = choice[starts]
    for selector in np.unique(selected):
        mine = np.flatnonzero(selected == selector)
        places = starts[mine][:, None] + np.arange(HELD[selector])
        values = np.where(places < ends[starts[mine]][:, None], ids[np.minimum(places, size - 1)], 0)
        shifts = (np.arange(HELD[selector]) * BITS[selector]).astype(np.uint64)
        words[mine] = np.bitwise_or.reduce(values.astype(np.uint64) << shifts, axis=1)
    words |= selected.astype(np.uint64) << np.uint64(60)
    return words, np.searchsorted(starts, np.arange(0, size, BLOCK))


def unpack(words: np.ndarray, firsts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` ids of consecutive blocks; ``firsts`` are the blocks' first words."""
    out = np.zeros(size, np.uint64)
    selected = (words >> np.uint64(60)).astype(np.int64)
    held = HELD[selected]
    block_ends = np.minimum((np.arange(len(firsts)) + 1) * BLOCK, size)
    lasts = np.concatenate([firsts[1:], [len(words)]]) - 1
    total = np.cumsum(held)
    base = np.repeat(
        np.arange(len(firsts)) * BLOCK - (total[firsts] - held[firsts]), lasts - firsts + 1
    )
    starts = total - held + base
    held = np.minimum(held, np.repeat(block_ends, lasts - firsts + 1) - starts)
    for selector in np.unique(selected):
        mine = np.flatnonzero(selected == selector)
        bits = np.uint64(BITS[selector])
        mask = np.uint64((1 << int(bits)) - 1)
        shifts = (np.arange(HELD[selector]) * BITS[selector]).astype(np.uint64)
        values = (words[mine][:, None] >> shifts) & mask
        inside = np.arange(HELD[selector]) < held[mine][:, None]
        places = starts[mine][:, None] + np.arange(HELD[selector])
        out[places[inside]] = values[inside]
    return out


class Writer:
    """One file: words go out as they are made, the footer at the end."""

    def __init__(self, folder: str, name: str) -> None:
        self.store, self.temporary, self.final = files.start(folder, name)
        self.out = self.store.open_output_stream(self.temporary, compression=None)
        self.out.write(MAGIC)
        self.docs, self.counts, self.firsts = [], [], []
        self.words = self.ids = self.waiting = 0
        self.pending: list[np.ndarray] = []

    def add(self, docs: np.ndarray, counts: np.ndarray, ids: list[np.ndarray]) -> None:
        self.docs.append(docs)
        self.counts.append(counts)
        self.pending += ids
        self.waiting += sum(map(len, ids))
        if self.waiting >= FLUSH:
            self.flush(last=False)

    def flush(self, *, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.int32)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for at in range(0, whole, FLUSH):
            words, firsts = pack(ids[at:min(whole, at + FLUSH)])
            self.out.write(words.astype("<u8").tobytes())
            self.firsts.append(firsts + self.words)
            self.words += len(words)
        self.ids += whole
        self.pending, self.waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> tuple[str, int, int, int]:
        self.flush(last=True)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        docs, counts, firsts = join(self.docs), join(self.counts), join(self.firsts)
        footer = b"".join(
            x.astype("<i8").tobytes()
            for x in (np.array([len(docs), self.ids, len(firsts), BLOCK]), docs, counts, firsts)
        )
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        files.commit(self.store, self.temporary, self.final)
        return self.final, len(docs), self.ids, 8 * self.words + len(footer) + 24


def _letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as they are, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _plain_words(vocabulary: str) -> bool:
    """Does the vocabulary take a word of Latin-1 letters, in lower case, as one byte-level word?"""
    file = json.loads(vocabulary)
    steps = [x["type"] for x in (file["normalizer"] or {}).get("normalizers", [])]
    cuts = [x["type"] for x in (file["pre_tokenizer"] or {}).get("pretokenizers", [])]
    return steps == ["NFC", "Replace", "Lowercase"] and cuts == ["Split", "ByteLevel"]


def _encoder(vocabulary: str):
    """Pieces to ids by the library: words of Latin-1 letters go to its model at once, all other
    pieces through its whole chain."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    model, plain = tokenizer.model, _plain_words(vocabulary)
    letters = {chr(b): c for b, c in _letters().items()}
    table = str.maketrans(letters)

    def word(text: str) -> list[int]:
        shown = text if text.isascii() else text.lower().encode().decode("latin-1").translate(table)
        return [x.id for x in model.tokenize(shown)]

    def run(pieces_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [x.decode() for x in pieces_]
        found: list = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if plain and text.isalpha() and max(text) < "\u0100":
                found[i] = word(text.lower())
            else:
                rest.append(i)
        for i, x in zip(rest, tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False),
                        strict=True):
            found[i] = x.ids
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(lengths.sum()))
        return flat, lengths

    return run


def _special_ids(vocabulary: str) -> dict[bytes, int]:
    """The strings that the library looks for in a text itself, and their ids."""
    found = json.loads(vocabulary)["added_tokens"]
    if any(x[flag] for x in found for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("special strings must stand for themselves in the text as it is")
    return {x["content"].encode(): x["id"] for x in found}


def _encoded(table: pieces.PieceTable, special: dict[bytes, int], buffer: np.ndarray, offsets: np.ndarray
             ) -> tuple[list[np.ndarray], np.ndarray]:
    """Ids of all texts and the number of each; special strings part a text and have one id each."""
    data = memoryview(buffer)
    pattern = re.compile(b"|".join(map(re.escape, sorted(special, key=len, reverse=True))))
    if not special or not pattern.search(data, int(offsets[0]), int(offsets[-1])):
        return table.encoded(buffer, offsets)
    limits, marks, owners = [int(offsets[0])], [], []
    for text, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for match in pattern.finditer(data, low, high):
            limits += [match.start(), match.end()]
            marks += [-1, special[match.group()]]
            owners += [text, text]
        limits.append(high)
        marks.append(-1)
        owners.append(text)
    parts, counts = table.encoded(buffer, np.array(limits, np.int64))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    marks = np.array(marks)
    ids = ids[np.repeat(marks < 0, counts)]
    counts[marks >= 0] = 0
    ids = np.insert(ids, np.cumsum(counts)[marks >= 0], marks[marks >= 0])
    counts[marks >= 0] = 1
    return [ids], np.bincount(owners, counts, minlength=len(offsets) - 1).astype(np.int64)


def _write(vocabulary: str, folder: str, end_id: int, special_as_text: bool = False):
    special = {} if special_as_text else _special_ids(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces.PieceTable(_encoder(vocabulary), CUTS, lower=True, skip_space=True)
        writer, shard, part, made = None, 0, 0, []

        def closed() -> None:
            made.append((shard, part, *writer.close()))

        for batch in batches:
            buffer, offsets = pieces.text_buffer(batch.column(1))
            docs = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            if batch.num_rows:
                shard = batch.column(2)[0].as_py()
            for first, last in pieces.slices(batch, offsets):
                if writer is None:
                    writer = Writer(folder, f"tokens-{shard:06d}-{part:04d}.s8b")
                parts, counts = _encoded(table, special, buffer, offsets[first:last + 1])
                ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
                ids = np.insert(ids, np.cumsum(counts), end_id)
                writer.add(docs[first:last], counts + 1, [ids])
                if writer.words >= FILE_WORDS:
                    closed()
                    writer, part = None, part + 1
        if writer is not None:
            closed()
        columns = list(zip(*made, strict=True)) if made else [[]] * 6
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["shard", "part", "path", "docs", "ids", "bytes"],
        )

    return memory.tidy(run)


def write_tokens(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 1, range_bytes: int = RANGE_BYTES, special_as_text: bool = False,
) -> DataFrame:
    """Write all texts in ascending id order; the manifest: shard, part, path, docs, ids, bytes, start.

    ``vocabulary`` is the tokenizer's file, read by the driver. A null or empty text has the end id
    only. Strings of special tokens get their ids, as the library gives them by default, or are ordinary
    text with ``special_as_text``. A null id is written as the smallest 64-bit integer and comes first. Rows that repeat an id
    follow each other, in the order of a digest of their texts. Very long texts are encoded in windows.
    No rows give an empty manifest. Other columns, whatever their names, are not read.
    """
    with open(vocabulary, encoding="utf-8") as f:
        data = f.read()
    work = Work(docs.sparkSession, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    rows = ranges.by_range(rows, "id", F.octet_length("text") + 8, range_bytes, F.col("text"))
    rows = rows.sortWithinPartitions(F.col("id").asc_nulls_first(), "__t", "text").select("id", "text", "__range")
    made = rows.mapInArrow(_write(data, f"{work.folder}/files", end_id, special_as_text), MANIFEST)
    return ranges.running_start(work.table(made, "manifest"), ["shard", "part"], "ids", "start")


def read_file(path: str, found) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(ids of documents, starts within the file, numbers of tokens, ids) in runs of documents."""
    with found.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 16)
        length, magic = int.from_bytes(f.read(8), "little"), f.read(8)
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        f.seek(size - 16 - length)
        footer = np.frombuffer(f.read(length), "<i8")
        n_docs, n_ids, n_blocks, _ = (int(x) for x in footer[:4])
        docs, counts, firsts = np.split(footer[4:], [n_docs, 2 * n_docs])
        n_words = (size - 16 - length - 8) // 8
        limits = np.append(firsts, n_words)
        ends = np.cumsum(counts)
        rest, done, doc, step = np.zeros(0, np.uint32), 0, 0, FLUSH // BLOCK
        for block in range(0, n_blocks, step):
            last = min(n_blocks, block + step)
            f.seek(8 + 8 * int(limits[block]))
            words = np.frombuffer(f.read(8 * int(limits[last] - limits[block])), "<u8")
            ids = unpack(words, firsts[block:last] - firsts[block], min(n_ids, last * BLOCK) - block * BLOCK)
            rest = np.concatenate([rest, ids.astype(np.uint32)])
            until = int(np.searchsorted(ends, done + len(rest), side="right"))
            if until > doc:
                used = int(ends[until - 1]) - done
                yield (docs[doc:until], ends[doc:until] - counts[doc:until], counts[doc:until], rest[:used])
                rest, done, doc = rest[used:], int(ends[until - 1]), until


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, _ = files.store(folder)
                for docs, starts, counts, ids in read_file(path, found):
                    limits = np.concatenate([[0], np.cumsum(counts)]) * 4
                    data = pa.Array.from_buffers(
                        pa.large_binary(), len(docs),
                        [None, pa.py_buffer(limits.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))],
                    )
                    step = 2000
                    for i in range(0, len(docs), step):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(docs[i:i + step]), pa.array(starts[i:i + step] + start),
                             pa.array(counts[i:i + step]), data[i:i + step].cast(pa.binary())],
                            ["id", "start", "n_tokens", "ids"],
                        )

    return memory.tidy(run)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Documents from their files: id, start, n_tokens, ids (unsigned 32-bit, little-endian)."""
    rows = ranges.by_file(manifest).select("path", "start")
    out = rows.mapInArrow(_read(shared_folder(manifest.sparkSession)), "id long, start long, n_tokens long, ids binary")
    id_ = F.when(F.col("id") != F.lit(NO_ID), F.col("id"))
    return out.select(id_.alias("id"), "start", "n_tokens", "ids")
