import hashlib
import random

import cases
import pytest
from pyspark.util import PythonEvalType

from latecast.llm import bloom, exact_dedup, near_dup


def plain_groups(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(cases.normalised(t), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        used = False
        for i in sorted(ids, key=lambda x: (x is None, x or 0)):
            kept = i == keep and not used
            used |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups(spark):
    got = exact_dedup.exact_groups(cases.frame(spark)).collect()
    assert sorted(map(tuple, got), key=str) == plain_groups(cases.TEXTS)


def test_exact_groups_over_hash_ranges(spark):
    """Filters too small for all hashes: ranges of hashes with a filter each, the same groups."""
    rows = [(i, f"text {i % 70}", "a") for i in range(200)]
    got = exact_dedup.exact_groups(
        cases.frame(spark, rows), bits_per_row=16 << 9, most_bits=bloom.SEGMENT_BITS
    ).collect()
    assert sorted(map(tuple, got), key=str) == plain_groups(rows)


def test_exact_empty_table(spark):
    assert exact_dedup.exact_groups(cases.frame(spark, [])).count() == 0


def test_rows_that_stay(spark):
    docs = cases.frame(spark)
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    want = sorted((r[0] for r in plain_groups(cases.TEXTS) if r[3]), key=str)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == want


def plain_components(rows, threshold=85):
    sets = [(i, cases.shingles(t)) for i, t, _ in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                parent[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            smallest[find(k)] = min(i, smallest.get(find(k), i))
    return sorted(
        ((i, len(s), (i if not s else smallest.get(find(k)))) for k, (i, s) in enumerate(sets)), key=str
    )


def got_components(df):
    return sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_near_groups(spark):
    got = near_dup.near_groups(cases.frame(spark))
    assert got_components(got) == plain_components(cases.TEXTS)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got.collect())


@pytest.mark.parametrize("edits,exact,part", [(8, 2048, 1 << 20), (26, 2048, 1 << 20), (26, 0, 1 << 20), (26, 0, 4000)])
def test_near_groups_of_many_edited_copies(spark, monkeypatch, edits, exact, part):
    """One large group whose members differ from each other: chains of links must not break, whether
    its bucket is counted exactly, goes by rare shingles, or is cut into parts."""
    monkeypatch.setattr(near_dup, "EXACT_MEMBERS", exact)
    monkeypatch.setattr(near_dup, "PART_ITEMS", part)
    rng = random.Random(edits)
    base = [f"w{rng.randrange(10**6)}" for _ in range(240)]
    rows = []
    for i in range(90):
        text = list(base)
        for at in rng.sample(range(240), rng.randrange(edits // 4)):
            text[at] = f"e{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(text), "a"))
    rows += [(2000 + i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(50)), "b") for i in range(10)]
    assert got_components(near_dup.near_groups(cases.frame(spark, rows))) == plain_components(rows)


def test_near_empty_tables(spark):
    assert near_dup.near_groups(cases.frame(spark, [])).count() == 0
    blank = cases.frame(spark, [(1, None, "a"), (2, "", "a"), (3, " ", None)])
    assert got_components(near_dup.near_groups(blank)) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_near_rows_that_stay(spark):
    docs = cases.frame(spark, [r for r in cases.TEXTS if r[0] is not None])
    kept = near_dup.without_near_copies(docs)
    assert kept.columns == docs.columns
    want = sorted(i for i, _, c in plain_components([r for r in cases.TEXTS if r[0] is not None]) if i == c)
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_near_rows_that_stay_are_judged_by_their_own_text(spark):
    """Null ids, ids with two texts and repeated rows: one row of every component, all rows without words."""
    one, two = cases.words(20, 80), " ".join(f"only{i}" for i in range(30))
    rows = [
        *cases.TEXTS, (None, cases.words(1, 60), "a"), (None, None, "a"), (None, "", "b"),
        (10, two, "a"), (None, one, "a"), (None, one + " x", "b"), (None, one, "c"),
        (30, " ".join(f"again{i}" for i in range(9)), "a"), (30, " ".join(f"again{i}" for i in range(9)), "a"),
    ]
    numbered = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    component = {k: c for k, _, c in plain_components(numbered)}
    groups = {}
    for k, (i, _, _) in enumerate(rows):
        groups.setdefault(component[k], []).append(i)
    want = [min((i for i in ids if i is not None), default=None) for ids in groups.values()]
    kept = near_dup.without_near_copies(cases.frame(spark, rows)).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == sorted(want, key=str)
    texts = {(i, t): component[k] for k, (i, t, _) in enumerate(rows) if cases.shingles(t)}
    worded = [texts[r["doc_id"], r["text"]] for r in kept if cases.shingles(r["text"])]
    assert len(worded) == len(set(worded)) and set(worded) == set(texts.values())


def python_steps(df, capsys):
    """The most Python steps that follow each other in one stage, and the plan's text."""
    capsys.readouterr()
    df.explain()
    text = capsys.readouterr().out
    most, above = 0, []
    for line in text.splitlines():
        name = line.lstrip(" :+-*0123456789()")
        depth = len(line) - len(name)
        above = [x for x in above if x[0] < depth]
        before = above[-1][1] if above else 0
        steps = 0 if "Exchange" in name.split(" ")[0] else before + name.startswith(
            ("MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython", "PythonMapInArrow"))
        most = max(most, steps)
        above.append((depth, steps))
    return most, text


def test_a_task_of_near_dedup_has_one_worker(spark, monkeypatch, capsys):
    """No stage has two Python steps, which would be two workers a task, and filters are no pandas functions."""
    plans, write = {}, near_dup.Work.table

    def table(self, df, name):
        plans[name] = python_steps(df, capsys)
        return write(self, df, name)

    monkeypatch.setattr(near_dup.Work, "table", table)
    rows = cases.TEXTS + [(100 + i, cases.words(7, 300) + " end" * (i // 2), "a") for i in range(6)]
    out = near_dup.without_near_copies(cases.frame(spark, rows), threshold=80)
    plans["result"] = python_steps(out, capsys)
    assert out.count() < len(rows)
    assert {name for name, (steps, _) in plans.items() if steps} >= {"sketches", "bands", "sets", "result"}
    assert {name: steps for name, (steps, _) in plans.items() if steps > 1} == {}
    assert bloom.contains(spark, bytes(1)).evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF


def test_shingles_of_a_batch_of_few_words():
    import pyarrow as pa

    from latecast.llm import pieces

    for n in range(7):
        text = " ".join("abcdefg"[:n])
        found = list(near_dup.shingle_sets(*pieces.text_buffer(pa.array([text]))))
        assert [len(x) for x in found] == [len(cases.shingles(text))]


def test_estimates_follow_similarity():
    import numpy as np

    rng = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.9):
        found = []
        for _ in range(40):
            both = rng.integers(0, 1 << 63, int(1000 * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, int(500 * (1 - share)), dtype=np.uint64)]))
                    for _ in range(2))
            regs = [near_dup.registers(x)[None] for x in (a, b)]
            found.append(float(near_dup.estimate(*regs, np.array([float(len(a))]), np.array([float(len(b))]))[0]))
        assert abs(np.mean(found) - share) < 0.05


def test_registers_merge():
    import numpy as np

    items = np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64)
    parts = [near_dup.registers(items[i::3]) for i in range(3)]
    assert (np.maximum.reduce(parts) == near_dup.registers(items)).all()


def test_bands_and_least_estimate_follow_the_threshold():
    for threshold in (50, 80, 85, 95):
        share, bands = threshold / 100, near_dup.bands_of(threshold)
        assert (1 - share**near_dup.BAND) ** bands <= near_dup.MISSED < (1 - share**near_dup.BAND) ** (bands - 1)
        size = bands * near_dup.BAND
        assert share - near_dup.least_estimate(threshold, size) > 5 * (share * (1 - share) / size) ** 0.5
    assert near_dup.bands_of(near_dup.THRESHOLD) * near_dup.BAND == near_dup.REGISTERS
