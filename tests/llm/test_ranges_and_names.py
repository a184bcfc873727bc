import random
from collections import Counter, defaultdict

import cases
import pytest
from pyspark.sql import functions as F

from latecast.llm import exact_dedup, line_dedup, near_dup, ranges


def placed(spark, ids, target=20, texts=None):
    rows = [(i, texts[n] if texts else f"t{n}", 7) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id long, text string, k int").repartition(4)
    out = ranges.by_range(df, "id", F.lit(1), target, F.col("text"))
    found = out.withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r["id"] is not None, r["id"], r["text"], r["k"]) for r in found if r["id"] is not None) == sorted(
        (True, i, t, k) for i, t, k in rows if i is not None)
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("name, ids", [
    ("even", list(range(2000))),
    ("outlier", [*range(1999), 10**15]),
    ("clusters", [c * 10**14 + i for c in range(4) for i in range(500)]),
    ("huge span", [-(2**63), *range(1998), 2**63 - 1]),
    ("nulls", [None] * 1500 + list(range(500))),
    ("one id", [7] * 2000),
    ("one id among others", [*range(300), *[5000] * 1500, *range(10**9, 10**9 + 200)]),
])
def test_ranges_stay_near_their_target(spark, name, ids):
    found = placed(spark, ids)
    sizes = Counter(r["__range"] for r in found)
    assert max(sizes.values()) <= 3 * 20 and len(sizes) >= 2000 / 60
    assert set(sizes) == set(range(max(sizes) + 1))
    low = lambda i: -(2**64) if i is None else i
    limits = defaultdict(list)
    for r in found:
        limits[r["__range"]].append(low(r["id"]))
    ends = [(min(limits[k]), max(limits[k])) for k in sorted(limits)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    again = placed(spark, list(reversed(ids)), texts=[f"t{len(ids) - 1 - n}" for n in range(len(ids))])
    assert {(r["id"], r["text"], r["__range"]) for r in again} == {(r["id"], r["text"], r["__range"]) for r in found}


def test_equal_rows_and_no_rows(spark):
    found = placed(spark, [3] * 200, texts=["same"] * 200)
    assert {r["__range"] for r in found} == {0}
    empty = spark.createDataFrame([], "id long, text string")
    assert ranges.by_range(empty, "id", F.lit(1), 5, F.col("text")).count() == 0


NAMES = ["__sha", "__sha2", "__may", "__id", "__hits", "__text", "__none", "__n", "__set", "__node", "c0"]


def test_columns_that_operators_use_themselves(spark):
    docs = cases.frame(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")][:len(NAMES)]
    clash = docs.withColumnsRenamed(dict(zip(others, NAMES, strict=True)))
    key = lambda rows: Counter((r["doc_id"], r["text"], r["source"]) for r in rows)
    for run in (exact_dedup.without_copies, near_dup.without_near_copies, line_dedup.without_boilerplate):
        plain, out = run(docs), run(clash)
        assert out.columns[:len(clash.columns)] == clash.columns
        rows = out.collect()
        assert key(rows) == key(plain.collect()) and all(r["__sha"] == "en" for r in rows)
        assert run(clash.limit(0)).count() == 0


def test_hash_ranges_are_read_once_each(spark):
    """Beyond one filter: the same groups, whatever the number of ranges."""
    rng = random.Random(6)
    rows = [(i, f"text {rng.randrange(400)}", "a") for i in range(1500)] + cases.TEXTS
    docs = cases.frame(spark, rows)
    whole = exact_dedup.exact_groups(docs)
    cut = exact_dedup.exact_groups(docs, bits_per_row=4096, most_bits=1 << 21)
    assert cut.exceptAll(whole).isEmpty() and whole.exceptAll(cut).isEmpty()
