import base64
import random

import cases
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from latecast.llm import byte_bpe, pieces, token_file
from latecast.llm.shared import Work

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["'", "s", "re", " ", "  ", "\n", "é", "́", "\xa0", "1", "%", "A", "b", "ñ", "÷", "\x1f", "ll", "ß",
         "<|endoftext|>", "　", "_", "…", "İ", "Σ", "É", "\x00", "ing", "the", "\t", "😀", "日本"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = ["".join(rng.choices(PARTS, k=rng.randint(0, 60))) for _ in range(2000)]
    return [*(t or "" for _, t, _ in cases.TEXTS), *made, "ab" * 5000, " " * 3000, "é" * 2500]


def per_text(table, texts):
    buffer, offsets = pieces.text_buffer(pa.array(texts))
    parts, counts = table.encoded(buffer, offsets)
    ids = np.concatenate(parts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.fixture(scope="module")
def reference_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def reference_words():
    found = Tokenizer.from_file(WORD)
    found.encode_special_tokens = True
    return found


@pytest.mark.parametrize("window", [1 << 21, 1 << 10])
def test_bpe_as_the_library(texts, reference_bpe, monkeypatch, window):
    monkeypatch.setattr(pieces, "WINDOW", window)
    ranks = byte_bpe.read_ranks(open(BPE, "rb").read())
    table = pieces.PieceTable(byte_bpe._encoder(ranks, public_tokenizers.PATTERN), byte_bpe.CUTS)
    assert per_text(table, texts) == [reference_bpe.encode_ordinary(t) for t in texts]


def test_bpe_table_forgets(texts, reference_bpe, monkeypatch):
    monkeypatch.setattr(pieces, "WINDOW", 1 << 12)
    monkeypatch.setattr(pieces, "MOST_KEPT", 50)
    ranks = byte_bpe.read_ranks(open(BPE, "rb").read())
    table = pieces.PieceTable(byte_bpe._encoder(ranks, public_tokenizers.PATTERN), byte_bpe.CUTS)
    assert per_text(table, texts[:400]) == [reference_bpe.encode_ordinary(t) for t in texts[:400]]


def test_decoded_beside_the_ids(spark):
    """Encoding and decoding by one worker, columns of the same names included."""
    docs = cases.frame(spark).withColumnRenamed("hash", "decoded")
    one = byte_bpe.encode(docs, BPE, public_tokenizers.PATTERN, decoded_col="decoded")
    two = byte_bpe.decode(byte_bpe.encode(docs, BPE, public_tokenizers.PATTERN), BPE)
    assert sorted(one.columns) == sorted(two.columns)
    key = lambda df: sorted((str(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in df.collect())
    assert key(one) == key(two)
    assert sorted(t for _, _, t in key(one)) == sorted((t or "").encode() for _, t, _ in cases.TEXTS)


def test_bpe_encode_and_decode(spark, reference_bpe):
    docs = cases.frame(spark).withColumn("decoded", F.lit("old"))
    encoded = byte_bpe.encode(docs, BPE, public_tokenizers.PATTERN)
    rows = byte_bpe.decode(encoded, BPE).collect()
    want = sorted((str(i), reference_bpe.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in cases.TEXTS)
    assert sorted((str(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in rows) == want
    empty = cases.frame(spark, [])
    assert byte_bpe.decode(byte_bpe.encode(empty, BPE, public_tokenizers.PATTERN), BPE).count() == 0


@pytest.mark.parametrize("window", [1 << 21, 1 << 10])
def test_words_as_the_library(texts, reference_words, monkeypatch, window):
    monkeypatch.setattr(pieces, "WINDOW", window)
    table = pieces.PieceTable(
        token_file._encoder(open(WORD, encoding="utf-8").read()), token_file.CUTS, lower=True, skip_space=True
    )
    want = [x.ids for x in reference_words.encode_batch(texts, add_special_tokens=False)]
    assert per_text(table, texts) == want


@pytest.mark.parametrize("window", [1 << 21, 1 << 10])
def test_words_and_special_strings_as_the_library(texts, monkeypatch, window):
    """Held against an unmodified tokenizer: special strings in a text have their ids."""
    monkeypatch.setattr(pieces, "WINDOW", window)
    data = open(WORD, encoding="utf-8").read()
    table = pieces.PieceTable(token_file._encoder(data), token_file.CUTS, lower=True, skip_space=True)
    texts = [*texts, "<|startoftext|><|endoftext|>", "<<|endoftext|>>", "<|ENDOFTEXT|>", "<|endof", "text|>",
             "a<|endoftext|>" * 300, "", "É<|startoftext|>\u0301 x"]
    buffer, offsets = pieces.text_buffer(pa.array(texts))
    parts, counts = token_file._encoded(table, token_file._special_ids(data), buffer, offsets)
    got = np.split(np.concatenate(parts), np.cumsum(counts)[:-1])
    want = Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in got] == [x.ids for x in want]
    plain = ["one", "two three"]
    parts, counts = token_file._encoded(table, token_file._special_ids(data), *pieces.text_buffer(pa.array(plain)))
    assert np.concatenate(parts).tolist() == [
        i for x in Tokenizer.from_file(WORD).encode_batch(plain, add_special_tokens=False) for i in x.ids]


def test_files_hold_special_ids(spark):
    rows = [(1, "a<|endoftext|>b", "a"), (2, "<|endoftext|>", "a"), (3, "c", "a")]
    library, plain = Tokenizer.from_file(WORD), Tokenizer.from_file(WORD)
    plain.encode_special_tokens = True
    for as_text, tokenizer in ((False, library), (True, plain)):
        manifest = token_file.write_tokens(cases.frame(spark, rows), WORD, special_as_text=as_text)
        got = [np.frombuffer(r["ids"], "<u4").tolist() for r in token_file.read_tokens(manifest).orderBy("id").collect()]
        assert got == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for _, t, _ in rows]


@pytest.mark.parametrize("top", [2, 3, 300, 50000, 1 << 20, 1 << 31, 1 << 59])
def test_words_pack_and_unpack(top):
    rng = np.random.default_rng(top % 1000)
    for n in (0, 1, 5, 4095, 4096, 4097, 50000):
        ids = rng.integers(0, top, n).astype(np.uint64)
        ids[rng.random(n) < 0.3] = 0
        words, firsts = token_file.pack(ids)
        assert (token_file.unpack(words, firsts, n) == ids).all()
        if n > 2 * token_file.BLOCK:  # a block by itself
            part = token_file.unpack(words[firsts[1]:firsts[2]], np.zeros(1, np.int64), token_file.BLOCK)
            assert (part == ids[token_file.BLOCK:2 * token_file.BLOCK]).all()


def test_escape_holds_what_no_selector_does():
    words, _ = token_file.pack(np.array([1 << 59, 7], np.uint64))
    assert len(words) == 2 and int(words[0]) >> 60 == 0
    with pytest.raises(ValueError):
        token_file.pack(np.array([1 << 60], np.uint64))


@pytest.mark.parametrize("size", [64, 1 << 25])
def test_files_hold_documents_in_order(spark, reference_words, size):
    manifest = token_file.write_tokens(cases.frame(spark), WORD, range_bytes=size)
    assert manifest.count() > (1 if size == 64 else 0)
    rows = token_file.read_tokens(manifest).orderBy("start").collect()
    want, start = [], 0
    texts = sorted(cases.TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for i, t, _ in texts:
        ids = [*reference_words.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [(r["id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in rows] == want


def test_files_of_empty_table(spark):
    manifest = token_file.write_tokens(cases.frame(spark, []), WORD)
    assert manifest.count() == 0 and token_file.read_tokens(manifest).count() == 0


def test_files_roll(spark, monkeypatch):
    monkeypatch.setattr(token_file, "FILE_WORDS", 1)
    monkeypatch.setattr(token_file, "FLUSH", token_file.BLOCK)
    rows = [(i, cases.words(i, 3000), "a") for i in range(6)]
    made = token_file._write(open(WORD, encoding="utf-8").read(), Work(spark, "roll").folder, 1)
    batch = pa.record_batch({
        "id": [r[0] for r in rows], "text": [r[1] for r in rows], "r": pa.array([0] * 6, pa.int32())})
    one = [pa.RecordBatch.from_arrays([c.slice(i, 1) for c in batch.columns], batch.schema.names) for i in range(6)]
    files = next(iter(made(iter(one)))).to_pylist()
    assert len(files) > 1 and sum(f["docs"] for f in files) == 6
