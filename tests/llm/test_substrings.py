import random
from collections import Counter

import cases
import numpy as np
import pytest

from latecast.llm import substrings


def plain(rows, length):
    """Per row: number of words, spans removed, text kept."""
    split = [cases.word_list(text) for _, text, *_ in rows]
    windows = Counter(tuple(w[i:i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for words in split:
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            if windows[tuple(words[i:i + length])] > 1:
                gone[i:i + length] = [True] * length
        spans, i = [], 0
        while i < len(words):
            j = i
            while j < len(words) and gone[j]:
                j += 1
            if j > i:
                spans.append((i, j - i))
            i = max(j, i + 1)
        out.append((len(words), spans, " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


def found(df):
    return sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_words"],
                   [tuple(s) for s in r["removed"]], r["kept"]) for r in df.collect())


def wanted(rows, length):
    return sorted((-1 if r[0] is None else r[0], *p) for r, p in zip(rows, plain(rows, length), strict=True))


def random_rows(rng, n, length):
    """Texts of few words, of shared passages with other words around them, and near copies."""
    passages = [[f"p{rng.randrange(40)}" for _ in range(length + rng.randrange(3 * length))] for _ in range(6)]
    texts = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.randrange(4)
            if kind == 0:
                words += rng.choice(passages)
            elif kind == 1:
                words += [f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(2 * length))]
            elif kind == 2:
                words += [rng.choice("ab") for _ in range(rng.randrange(length))]
            elif texts:
                copy = rng.choice(texts).split()
                if copy:
                    copy[rng.randrange(len(copy))] = "edit"
                words += copy[:6 * length]
        texts.append(" ".join(words))
        yield i, texts[-1], "a"


@pytest.mark.parametrize("length, how", [
    (35, {}), (35, {"hot": 1}), (35, {"most_keys": 0}), (4, {}), (7, {"hot": 2, "most_keys": 0}), (2, {"hot": 1}),
    (80, {}), (12, {"most_bits": 1}),
])
def test_against_brute_force(spark, monkeypatch, length, how):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 300)
    monkeypatch.setattr(substrings, "WINDOW", 2000)
    rows = [*cases.TEXTS, *((100 + i, t, s) for i, t, s in random_rows(random.Random(length), 60, length))]
    docs = cases.frame(spark, rows).repartition(3)
    got = substrings.without_repeats(docs, length=length, **how)
    assert found(got) == wanted(rows, length)


def test_other_columns_and_empty_tables(spark):
    docs = cases.frame(spark)
    out = substrings.without_repeats(docs)
    assert out.columns == [*(c for c in docs.columns if c != "text"), "n_words", "removed", "kept"]
    assert out.schema["source"].dataType == docs.schema["source"].dataType
    clash = docs.withColumnsRenamed({"sha": "key", "hash": "marks", "j": "may", "spans": "c0", "key": "removed"})
    again = substrings.without_repeats(clash)
    assert found(again) == found(out) == wanted(cases.TEXTS, 35)
    assert {r["marks"] for r in again.collect()} == {"h"} and {r["c0"] for r in again.collect()} == {"sp"}
    assert substrings.without_repeats(cases.frame(spark, [])).count() == 0
    assert found(substrings.without_repeats(cases.frame(spark, [(1, None, "a")]))) == [(1, 0, [], "")]


def test_automaton_counts_and_matches():
    rng = random.Random(5)
    for _ in range(300):
        length = rng.randrange(1, 6)
        strings = [([rng.randrange(3) for _ in range(rng.randrange(length, 15))], rng.randrange(1, 4))
                   for _ in range(rng.randrange(1, 8))]
        automaton = substrings.Automaton()
        for s, n in strings:
            automaton.add(s, n)
        automaton.count()
        seen = Counter()
        for s, n in strings:
            for i in range(len(s) - length + 1):
                seen[tuple(s[i:i + length])] += n
        for s, _ in strings:
            assert automaton.repeated(s, length) == [
                i for i in range(len(s) - length + 1) if seen[tuple(s[i:i + length])] > 1]


def test_equal_windows_share_their_anchor():
    """Whatever stands around a window, its segment has the same anchor."""
    rng = np.random.default_rng(1)
    window = rng.integers(0, 2**63, 35, dtype=np.uint64)
    anchors = set()
    for _ in range(50):
        words = np.concatenate([rng.integers(0, 2**63, rng.integers(0, 60), dtype=np.uint64), window,
                                rng.integers(0, 2**63, rng.integers(0, 60), dtype=np.uint64)])
        at = int(np.flatnonzero(words == window[0])[0])
        start, windows, anchor, _ = substrings._segments(words, np.zeros(len(words), np.int64), 35)
        assert windows.sum() == len(words) - 34 and windows.max() <= substrings.BLOCK
        anchors.add(int(anchor[np.searchsorted(start, at, side="right") - 1]))
    assert len(anchors) == 1
