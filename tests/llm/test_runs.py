import hashlib
import random
import zlib
from pathlib import Path

import cases
import numpy as np
import pytest

from latecast.llm import catalog, runs

SF = Path("/root/testdata/sf0.001")


def plain_runs(words, least=12):
    """Every stretch of every lag, and whether a smaller period fits it."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q) and not any(
                all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)
            ):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, found):
    gone = {x for start, length, period in found for x in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_texts(rng, most):
    for _ in range(rng.randrange(1, 5)):
        n, kinds = rng.randrange(most), rng.choice([1, 2, 3, 5])
        words = [rng.randrange(kinds) for _ in range(n)]
        kind = rng.randrange(4)
        if kind == 1 and n:
            p = rng.randrange(1, n + 1)
            words = [words[i % p] for i in range(n)]
        elif kind == 2:
            words = [i.bit_count() % 2 for i in range(n)]
        elif kind == 3:
            a, b = [0], [0, 1]
            while len(b) < n:
                a, b = b, b + a
            words = b[:n]
        yield words


def test_runs_against_brute_force():
    rng = random.Random(12)
    for _ in range(300):
        texts = list(random_texts(rng, 90))
        least = rng.choice([12, 12, 2, 3, 5, 7])
        flat = np.array([w for t in texts for w in t], np.int64)
        got = runs.runs_of(flat, np.array([len(t) for t in texts]), least)
        want = [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t, least)]
        assert [tuple(r) for r in got.tolist()] == want


def test_pairs_stay_in_proportion():
    """One word all over: two pairs for each word and octave, whatever the square would be."""
    level = runs.Level(np.zeros(1 << 16, np.uint64))
    s, k, lo = 16, 17, 32
    seeds = np.arange(0, (1 << 16) - k, s)
    assert len(seeds) * lo <= 2 << 16
    start, places, lag = runs._stretches(level, lo, 2 * lo - 1, lo)
    assert len(start) == lo and set(lag) == set(range(lo, 2 * lo))


def test_a_shared_hash_is_noticed(monkeypatch):
    real, calls = runs._stretches, []

    def wrong(level, lo, hi, least):
        calls.append(lo)
        if len(calls) == 1:
            return np.array([0]), np.array([20]), np.array([1])
        return real(level, lo, hi, least)

    monkeypatch.setattr(runs, "_stretches", wrong)
    assert len(runs.runs_of(np.arange(40), np.array([40]))) == 0 and len(calls) > 2


def test_awkward_rows(spark):
    rows = [*cases.TEXTS, (20, "la " * 5000, "a"), (21, "a b\tc\n" * 6, "a"), (21, "a b\tc\n" * 6, "a")]
    out = runs.periodic_runs(cases.frame(spark, rows))
    assert [c for c in out.columns if c not in ("n_words", "runs", "collapsed")] == [
        c for c in cases.frame(spark).columns if c != "text"]
    got = sorted((r["doc_id"] or -1, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])
                 for r in out.collect())
    want = []
    for i, text, _ in rows:
        words = cases.word_list(text)
        found = [(0, 5000, 1)] if i == 20 else plain_runs(words)
        want.append((i or -1, len(words), found, plain_collapsed(words, found)))
    assert got == sorted(want)
    assert runs.periodic_runs(cases.frame(spark, [])).count() == 0
    clash = cases.frame(spark, rows[:1]).withColumnsRenamed({"sha": "runs", "hash": "collapsed"})
    assert runs.periodic_runs(clash).collect()[0]["runs"] == []


@pytest.mark.skipif(not SF.exists(), reason="driver tables not there")
def test_query_against_brute_force(spark):
    docs = {r["doc_id"]: cases.word_list(r["text"])
            for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = catalog.op12_periodic_runs(spark, str(SF)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    planted = 0
    for r in got:
        words, h = docs[r["doc_id"]], zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        if n > 1200:  # the plain version is cubic at worst
            continue
        found = plain_runs(words)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        want = (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                hashlib.sha256(lines.encode()).hexdigest(),
                hashlib.sha256(plain_collapsed(words, found).encode()).hexdigest())
        assert want == tuple(r[c] for c in (
            "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))
    assert planted > 5
