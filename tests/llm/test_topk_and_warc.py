import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latecast.llm import topk, warc


def plain_topk(rows, queries, k=20, scale=64):
    good = [(i, np.floor(np.array(v, float) * scale)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if not queries(q):
            continue
        width = max((len(w) for _, w in good), default=0)
        fill = lambda x: np.pad(x, (0, width - len(x)))
        scores = sorted((-int(fill(v) @ fill(w)), i) for i, w in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def run_topk(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, "r") for i, v in rows], "vec_id long, embedding array<double>, role int, id string")
    found = topk.top_k(df, df.where("vec_id % 5 = 0"), **options)
    return sorted(map(tuple, found.collect()))


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "RUN", 64)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(0, 0.2, 24) * (3 if i % 9 == 0 else 1)).tolist()) for i in range(500)]
    rows += [(500 + i, rows[7][1]) for i in range(60)]  # a large group of equal vectors: ties
    rows += [(900, None), (905, []), (910, [float("nan")] * 24), (915, [None, 1.0]), (920, [float("inf")]),
             (925, [0.5, -0.5]), (None, [1.0]), (930, [0.0] * 24)]
    assert run_topk(spark, rows) == plain_topk(rows, lambda q: q % 5 == 0)


def test_topk_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (5, [2.0, 1.0]), (6, [0.1, 0.1])]
    assert run_topk(spark, rows) == plain_topk(rows, lambda q: q % 5 == 0)
    assert run_topk(spark, [(0, [1.0])]) == []
    assert run_topk(spark, []) == []


def test_topk_wide_numbers(spark):
    rows = [(i, [float(10**6 * (i + 1)), -3.25 * i, 1e-9]) for i in range(12)]
    assert run_topk(spark, rows, k=3) == plain_topk(rows, lambda q: q % 5 == 0, k=3)
    with pytest.raises(Exception, match="64 bits"):
        run_topk(spark, [(0, [1e18]), (1, [1e18])])


def test_topk_stops_only_on_proof():
    rng = np.random.default_rng(4)
    for _ in range(20):
        vectors = (rng.standard_t(2, (300, 16)) * 8).astype(np.int64)
        queries = (rng.standard_t(2, (10, 16)) * 8).astype(np.int64)
        ids, own = np.arange(300), np.arange(1000, 1010)
        who, what, score = topk.best_of_run(queries, own, vectors, ids, 5, np.full(10, -np.inf))
        keep = topk.best_k(who, what, score, 5)
        exact = queries @ vectors.T
        for q in range(10):
            want = sorted(range(300), key=lambda i: (-exact[q, i], i))[:5]
            assert what[keep][who[keep] == q].tolist() == want


PAGES = "page_id long, url string, html string, id long, digest string, refers long, is_page string"
BIG = "<p>" + "same page " * 20 + "</p>"


def page_rows():
    rng = random.Random(1)
    rows = [(i, f"http://a.example/{i}", f"<html>{rng.random()}{'é' * (i % 300)}</html>") for i in range(60)]
    rows += [(100 + i, f"http://b.example/x y\r\n{i}", BIG) for i in range(30)]
    rows += [(200, None, None), (201, "", ""), (202, "http://c", "small"), (203, "http://c", "small"),
             (None, "http://n", BIG), (150, "http://d", BIG), (150, "http://d", BIG), (5, "http://e", "y" * 200000)]
    return rows


def plain_pages(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        again = len(body) >= 100 and i != first.get(h or "")
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response",
                    first.get(h or "") if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(1 << 24, 1 << 27), (2000, 500)])
def test_warc_round_trip(spark, sizes):
    rows = page_rows()
    df = spark.createDataFrame([(*r, 0, "d", 0, "p") for r in rows], PAGES)
    manifest = warc.write_warc(df, range_bytes=sizes[0], file_bytes=sizes[1])
    files = manifest.orderBy("shard", "part").collect()
    got = warc.read_warc(manifest).collect()
    found = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got]
    assert sorted(found, key=str) == plain_pages(rows)
    bodies = sorted(bytes(r["payload"]) for r in got if r["record_type"] == "response")
    kept = [p for p, r in zip(sorted(rows, key=str), sorted(rows, key=str))]
    assert all(r["payload"] is None for r in got if r["record_type"] == "revisit") and kept
    texts = {(h or "").encode() for _, _, h in rows}
    assert set(bodies) == texts
    ids = []
    for f in files:
        data = gzip.open(f["path"].removeprefix("file:")).read().decode()
        assert data.startswith("WARC/1.1\r\n") and data.endswith("\r\n\r\n")
        ids += [x.split("\r\n")[0] for x in data.split("X-Page-Id: ")[1:]]
    numbers = [int(x) for x in ids if x]
    assert numbers == sorted(numbers) and len(ids) == len(rows)
    if sizes[1] == 500:
        assert len(files) > 20
        again = warc.write_warc(df.repartition(7), range_bytes=sizes[0], file_bytes=sizes[1])
        both = zip(files, again.orderBy("shard", "part").collect(), strict=True)
        for a, b in both:
            one, two = (open(x["path"].removeprefix("file:"), "rb").read() for x in (a, b))
            assert one == two and a["path"].rsplit("/")[-1] == b["path"].rsplit("/")[-1]


def test_warc_empty_and_damaged(spark):
    df = spark.createDataFrame([], PAGES)
    manifest = warc.write_warc(df)
    assert manifest.count() == 0 and warc.read_warc(manifest).count() == 0
    raw = gzip.decompress(warc.record(1, "http://a", b"x" * 200, None))
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw.replace(b"xxx", b"xyx", 1))
    df = spark.createDataFrame([(1, "u", BIG, 0, "d", 0, "p")], PAGES)
    path = warc.write_warc(df).select(F.col("path")).first()[0]
    assert not [p for p in __import__("os").listdir(path.rsplit("/", 1)[0]) if p.startswith(".") and "crc" not in p]
