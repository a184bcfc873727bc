import random
import re
from collections import Counter

import cases
import pytest

from latecast.llm import phrases

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_counts(rows, least, most=4):
    counts, words = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            found = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(found)
            for m in range(1, most + 1):
                for i in range(len(found) - m + 1):
                    counts[lang, tuple(found[i:i + m])] += 1
    return {k: n for k, n in counts.items() if n >= least}, {k: n for k, n in words.items() if n}


def plain_collocations(counts, words, top):
    scored = {}
    for (lang, p), a in counts.items():
        if len(p) > 1:
            score, _, left, right = min(
                (2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]],
                 counts[lang, p[k:]]) for k in range(1, len(p))
            )
            scored[lang, p] = (score, left, right)
    def covered(lang, p, a):
        return any(lang == other and len(q) > len(p) and 100 * b >= 80 * a
                   and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for (other, q), b in counts.items())
    out = set()
    for lang in words:
        kept = [(-s[0], -counts[lang, p], " ".join(p).encode(), s, p) for (x, p), s in scored.items()
                if x == lang and not covered(lang, p, counts[lang, p])]
        for rank, (_, _, name, s, p) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, name.decode(), counts[lang, p], s[1], s[2], words[lang], s[0]))
    return out


def random_rows(rng, n):
    vocabulary = ["la", "LE", "ñ", "x-y", "　", "é e", "'", "a", "b", "c"]
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 60)):
            parts.append(rng.choice(vocabulary[:rng.choice([2, 5, 10])]))
            parts.append(rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n", "\r\n", "\x0b", "! "]))
        yield i, "".join(parts), rng.choice(["en", "EN", None, "und", ""])


@pytest.mark.parametrize("sample", [2, 10**6])
def test_against_brute_force(spark, sample):
    """A sample that proposes next to nothing only means more passes."""
    rows = [*random_rows(random.Random(13), 120), (500, None, "en"), (501, "", "xx"), (502, "la le " * 2000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = phrases.phrase_counts(docs, least=9, sample=sample)
    counts, words = plain_counts(rows, 9)
    want = {(lang, len(p), " ".join(p), n) for (lang, p), n in counts.items()}
    assert {tuple(r) for r in got.collect()} == want | {(lang, 0, "", n) for lang, n in words.items()}
    for top in (5, 2000):
        best = phrases.collocations(got, top=top)
        assert {tuple(r) for r in best.collect()} == plain_collocations(counts, words, top)


def test_small_chunks_and_parts(spark, monkeypatch):
    rows = list(random_rows(random.Random(3), 60))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    monkeypatch.setattr(phrases, "CHUNK", 100)
    monkeypatch.setattr(phrases, "MOST_HELD", 50)
    monkeypatch.setattr(phrases, "MOST_TEXTS", 20)
    monkeypatch.setattr(phrases, "PART_BYTES", 64)
    counts, words = plain_counts(rows, 6)
    want = {(lang, len(p), " ".join(p), n) for (lang, p), n in counts.items()}
    got = phrases.phrase_counts(docs, least=6, sample=3)
    assert {tuple(r) for r in got.collect()} == want | {(lang, 0, "", n) for lang, n in words.items()}


def test_awkward_rows(spark):
    docs = cases.frame(spark)
    for frame in (docs, docs.withColumn("part", docs.n).withColumn("phrase", docs.text)):
        got = {tuple(r) for r in phrases.phrase_counts(frame, least=2).collect()}
        counts, words = plain_counts([(i, t, "en") for i, t, _ in cases.TEXTS], 2)
        assert got == {(g, len(p), " ".join(p), n) for (g, p), n in counts.items()} | {
            (g, 0, "", n) for g, n in words.items()}
    empty = phrases.phrase_counts(cases.frame(spark, []))
    assert empty.count() == 0 and phrases.collocations(empty).count() == 0


def test_products_past_64_bits(spark):
    big = 3 * 10**17
    rows = [("en", 0, "", 9 * big), ("en", 1, "a", big + 7), ("en", 1, "b", big + 1), ("en", 2, "a b", big),
            ("en", 1, "c", big), ("en", 3, "a b c", big * 79 // 100), ("en", 2, "b c", big * 79 // 100)]
    counts = spark.createDataFrame(rows, "lang string, size int, phrase string, n long")
    got = {r["phrase"]: tuple(r)[3:] for r in phrases.collocations(counts).collect()}
    assert got["a b"] == (big, big + 7, big + 1, 9 * big, 2_000_000 * big // (2 * big + 8))
    a = big * 79 // 100
    cuts = [(2_000_000 * a // (big + 7 + a), 1, big + 7, a), (2_000_000 * a // (2 * big), 2, big, big)]
    score, _, left, right = min(cuts)
    assert got["a b c"] == (a, left, right, 9 * big, score) and "b c" not in got
