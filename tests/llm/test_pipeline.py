import random
from pathlib import Path

import cases
import pytest
from test_exact_and_near import plain_components

import corpus_pipeline
from latecast.llm import exact_dedup, mixing, near_dup

SF = Path("/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "near dedup", "mixing", "byte-level BPE"]


def test_stages_on_awkward_rows(spark):
    docs = cases.frame(spark).select(*COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == COLUMNS, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    name, stage = corpus_pipeline.STAGES[-1]
    rows = stage(spark, docs, "").collect()
    assert len(rows) == docs.count() and all(len(r["ids"]) == r["n_tokens"] for r in rows)
    empty = cases.frame(spark, []).select(*COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name


@pytest.mark.skipif(not SF.exists(), reason="driver tables not there")
def test_run_equals_its_operators(spark):
    """Every stage held against the plain result of its operator on what came before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.good_documents(spark, docs, "").cache()
    exact = {r["id"] for r in exact_dedup.exact_groups(good).where("kept").collect()}
    one = corpus_pipeline.without_exact_copies(spark, good, "").cache()
    assert {r["doc_id"] for r in one.collect()} == exact
    near = {r["id"] for r in near_dup.near_groups(one, threshold=corpus_pipeline.NEAR_THRESHOLD).where("kept").collect()}
    two = corpus_pipeline.without_near_copies(spark, one, "").cache()
    assert {r["doc_id"] for r in two.collect()} == near
    taken = {r["id"]: r["taken"] for r in mixing.mix(two).collect()}
    words = {}
    for r in corpus_pipeline.mixed(spark, two, "").collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(cases.word_list(r["text"]))
    assert {i: words.get(i, 0) for i in taken} == taken
    final = corpus_pipeline.run(spark, str(SF)).collect()
    got = {}
    for r in final:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(cases.word_list(r["text"]))
    assert got == words


def test_near_dedup_links_from_four_fifths(spark):
    """Copies with scattered edits from below 0.80 to above 0.85, held against brute force at 0.80."""
    rng = random.Random(8)
    rows, between = [], 0
    for group in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        copy = list(base)
        for at in rng.sample(range(200), 2 + group % 4):
            copy[at] = f"e{rng.randrange(10**6)}"
        rows += [(2 * group, " ".join(base), "a"), (2 * group + 1, " ".join(copy), "b")]
        a, b = (cases.shingles(t) for _, t, _ in rows[-2:])
        between += 80 <= 100 * len(a & b) / len(a | b) < 85
    assert between > 10
    want = [i for i, _, component in plain_components(rows, 80) if i == component]
    assert len(want) < len([i for i, _, component in plain_components(rows, 85) if i == component])
    out = corpus_pipeline.without_near_copies(spark, cases.frame(spark, rows).select(*COLUMNS), "")
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(want)
