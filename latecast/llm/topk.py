"""Exact top-k inner products by an impact-ordered index, score at a time.

Every component is a posting; its impact is its absolute value. Each run of candidate vectors is an
index whose posting segments hold one level of impacts, the highest first. A segment is added to the
scores of all queries of a block together. After a segment, what is left can change a score by a known
bound at most; when that proves that only few vectors can still be among the best, these are scored
exactly and the other segments are left out. Without a proof all segments are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latecast.llm import memory

from latecast.llm.shared import bound_batches

RUN = 4096
QUERY_BLOCK = 1 << 11
CANDIDATE_BLOCK = 1 << 17
LEAST_BLOCKS = 8
LEVELS = 4
FEW = 8  # rescoring pays when so many times k vectors are left on average
BEST = "query_id long, vec_id long, score long"


def _kind(queries: np.ndarray, most: int) -> type:
    """The cheapest number type that holds every partial sum exactly."""
    bound = int(np.abs(queries).sum(axis=1).max(initial=0)) * most
    if bound >= 1 << 62:
        raise ValueError("scores need more than 64 bits")
    return np.float32 if bound < 1 << 23 else np.float64 if bound < 1 << 52 else np.int64


def _segments(vectors: np.ndarray) -> list[int]:
    """Lower limits of the impact levels, descending; the last takes the rest."""
    top = int(np.abs(vectors).max(initial=0))
    limits = [max(1, top >> i) for i in range(1, LEVELS)]
    return list(dict.fromkeys(limits)) + [0]


def best_of_run(
    queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int,
    floor: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector id, exact score) of all vectors that can be among a query's ``k`` best here.

    ``floor`` has each query's k-th best score so far: what is below it is of no use.
    """
    kind = _kind(queries, int(np.abs(vectors).max(initial=0)))
    q = queries.astype(kind)
    norm = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    size = np.abs(vectors)
    scores = np.zeros((len(queries), len(vectors)), kind)
    upper = None
    for limit in _segments(vectors):
        inside = size >= limit if upper is None else (size >= limit) & (size < upper)
        scores += q @ np.where(inside, vectors, 0).astype(kind).T
        upper = limit
        left = np.where(size < limit, vectors, 0).astype(np.float64)
        by_dimension = np.abs(queries) @ np.abs(left).max(axis=0, initial=0)
        by_norm = norm[:, None] * np.sqrt((left**2).sum(axis=1))[None, :]
        slack = np.ceil(np.minimum(by_dimension[:, None], by_norm) * (1 + 1e-9)).astype(kind)
        low = scores - slack
        low[own[:, None] == ids[None, :]] = -np.inf if kind is not np.int64 else np.iinfo(np.int64).min
        need = floor
        if len(vectors) > k:
            need = np.maximum(need, np.partition(low, len(vectors) - k, axis=1)[:, -k])
        may = scores + slack >= need[:, None]
        may &= own[:, None] != ids[None, :]
        if limit == 0 or may.sum() <= FEW * k * len(queries):
            break
    who, what = np.nonzero(may)
    exact = np.empty(len(who), np.int64)
    if limit == 0:
        exact[:] = scores[who, what]
    else:
        for i in range(0, len(who), 1 << 17):
            a, b = who[i:i + (1 << 17)], what[i:i + (1 << 17)]
            exact[i:i + (1 << 17)] = (queries[a] * vectors[b]).sum(axis=1)
    return who, ids[what], exact


def best_k(who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's best: highest score first, then smallest id."""
    order = np.lexsort((ids, -scores, who))
    sorted_ = who[order]
    firsts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    rank = np.arange(len(order)) - np.repeat(firsts, np.diff(np.append(firsts, len(order))))
    return order[rank < k]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors, shorter ones filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values):
        rows = np.repeat(np.arange(len(column)), lengths)
        starts = np.cumsum(lengths) - lengths
        out[rows, np.arange(len(values)) - np.repeat(starts, lengths)] = values
    return out


def _search(k: int, width: int):
    """Rows of one pair of blocks: its queries first, then candidates as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, names = [], []
        queries = own = floor = None
        best = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            role = batch.column("role").to_numpy()
            some = batch.slice(0, int((role == 0).sum()))
            if some.num_rows:
                asked.append(_matrix(some.column("v"), width))
                names.append(some.column("id").to_numpy())
            rest = batch.slice(some.num_rows)
            if not rest.num_rows or not asked:
                continue
            if queries is None:
                queries, own = np.concatenate(asked), np.concatenate(names)
                floor = np.full(len(queries), -np.inf)
            for at in range(0, rest.num_rows, RUN):
                part = rest.slice(at, RUN)
                vectors, ids = _matrix(part.column("v"), width), part.column("id").to_numpy()
                for first in range(0, len(queries), 512):
                    block = slice(first, first + 512)
                    who, what, score = best_of_run(
                        queries[block], own[block], vectors, ids, k, floor[block]
                    )
                    best = [np.concatenate(x) for x in zip(best, (who + first, what, score), strict=True)]
                keep = best_k(*best, k)
                best = [x[keep] for x in best]
                found = np.bincount(best[0], minlength=len(queries))
                worst = np.full(len(queries), np.inf)
                np.minimum.at(worst, best[0], best[2])
                floor = np.where(found >= k, worst, -np.inf)
        if queries is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[best[0]]), pa.array(best[1]), pa.array(best[2])],
                ["query_id", "vec_id", "score"],
            )

    return memory.tidy(run)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v) with v = floor(scale * x); vectors that are null, or hold a null or no finite number, go."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where(good)
    return rows.select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"),
    )


def top_k(
    vectors: DataFrame, queries: DataFrame, *, k: int = 20, scale: int = 64,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Each query's ``k`` best vectors: query_id, rank, vec_id, score; ties to the smaller id.

    A query's own id is no candidate of it. Vectors that are null, hold null or non-finite components,
    or have no id take no part; a shorter vector counts as filled up with zeros, an empty one scores 0.
    Rows that repeat an id are candidates each, and equal queries are answered once. Empty tables give
    no rows. Scores beyond 64 bits raise an error.
    """
    bound_batches(vectors.sparkSession)
    rows = quantised(vectors, id_col, vector_col, scale)
    asked = quantised(queries, id_col, vector_col, scale).distinct()
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n_asked, asked_width = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = max(LEAST_BLOCKS, -(-n // CANDIDATE_BLOCK))
    asked_blocks = max(1, -(-n_asked // QUERY_BLOCK))
    at = lambda m, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    pairs = asked.select(
        "*", F.lit(0).alias("role"), at(asked_blocks, 1).alias("a"), all_of(blocks).alias("b")
    ).unionByName(
        rows.select("*", F.lit(1).alias("role"), all_of(asked_blocks).alias("a"), at(blocks, 2).alias("b"))
    )
    pair = F.col("a") * blocks + F.col("b")
    dealt = pairs.repartitionById(blocks * asked_blocks, pair).sortWithinPartitions("role")
    found = dealt.select("role", "id", "v").mapInArrow(
        _search(k, max(1, width or 0, asked_width or 0)), BEST
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
