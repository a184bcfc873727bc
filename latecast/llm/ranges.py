"""Deterministic range partitions: limits from exact sums over equal steps of the key, no sampling.

A step that weighs more than a range should is cut into steps of its own, of the span its keys really
have, and so on; one key that is still too heavy is cut by a digest of its rows.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latecast.llm.shared import Work

STEPS = 1 << 14
MOST_RANGES = 1 << 14
FINER = 16  # steps of a heavy step, for each range that it weighs
NONE, ALL = 0, 1  # the first cells: rows without key, all others


def _descend(rows: DataFrame, splits: list[list[tuple]]) -> DataFrame:
    """Rows (k, t, ...) with ``cell``, the smallest step they fall into. A split lists (cell, by key, low, width, base)."""
    rows = rows.withColumn("cell", F.when(F.col("k").isNull(), NONE).otherwise(ALL).cast("long"))
    for split in splits:
        table = rows.sparkSession.createDataFrame(
            split, "cell long, by_key boolean, low long, width long, base long"
        )
        rows = rows.join(F.broadcast(table), "cell", "left")
        # Halves of doubles do not overflow; beyond 2^53 they are inexact, but keep the order.
        far = F.floor((F.col("k").cast("double") - F.col("low").cast("double")) / F.col("width").cast("double"))
        near = F.expr("(k - low) div width")
        at = F.when(F.col("by_key") & (F.col("cell") == ALL), far).when(F.col("by_key"), near).otherwise(
            F.expr("(t - low) div width")
        )
        rows = rows.withColumn("cell", F.coalesce(F.col("base") + at.cast("long"), F.col("cell")))
        rows = rows.drop("by_key", "low", "width", "base")
    return rows


def _cut(light: DataFrame, target: int) -> tuple[list[list[tuple]], list[tuple[int, int]]]:
    """Splits down to steps of ``target`` weight, as far as keys and digests differ; the steps that are left
    in order, with their weights."""
    splits, left, paths, fresh, base = [], [], {NONE: (0,), ALL: (1,)}, {NONE, ALL}, 2
    spans: list[tuple[int, int, int]] = []  # (cell, its first child, how many there may be)
    while fresh:
        found = _descend(light, splits).where(F.col("cell") >= min(fresh)).groupBy("cell").agg(
            F.sum("w").alias("w"), F.min("k").alias("k0"), F.max("k").alias("k1"),
            F.min("t").alias("t0"), F.max("t").alias("t1"),
        ).collect()
        split, again = [], set()
        for cell, w, k0, k1, t0, t1 in found:
            if cell not in paths:  # a child: its place below the cell that was cut
                parent, first, _ = spans[bisect_right(spans, cell, key=lambda x: x[1]) - 1]
                paths[cell] = (*paths[parent], cell - first)
            by_key = k0 is not None and k1 > k0
            low, high = (k0, k1) if by_key else (t0, t1)
            if high == low or (w <= target and cell != ALL):
                left.append((paths[cell], cell, w))
                continue
            steps = STEPS if cell == ALL else min(STEPS, FINER * -(-w // target))
            width = (high - low) // steps + 1
            split.append((cell, by_key, low, width, base))
            again.add((cell, base, steps + 2))
            base += steps + 2
        spans = sorted(again, key=lambda x: x[1])
        if split:
            splits.append(split)
        fresh = {first for _, first, _ in again}
    return splits, [(cell, w) for _, cell, w in sorted(left)]


def by_range(df: DataFrame, key: str, weight: Column, target: int, tie: Column | None = None) -> DataFrame:
    """Repartition by ranges of an integer key, of about ``target`` weight each, sorted by key inside, rows
    of one key by a digest of ``tie``.

    The same rows give the same ranges. The tables of steps that are broadcast have ``STEPS`` rows, and
    ``FINER`` for each range. A null key comes first. Rows that are equal in key and ``tie`` stay in one
    range, which may be larger for it; that costs time and no memory, as rows are sorted on disk and read
    as a stream. Beyond ``MOST_RANGES`` ranges the ranges grow instead. Adds the column ``__range``.
    """
    digest = F.lit(0).cast("long") if tie is None else F.shiftrightunsigned(F.xxhash64(tie), 1)
    work = Work(df.sparkSession, "ranges")
    light = work.table(
        df.select(F.col(key).cast("long").alias("k"), digest.alias("t"), weight.cast("long").alias("w")), "light"
    )
    total = light.agg(F.sum("w")).first()[0] or 0
    target = max(target, -(-total // MOST_RANGES))
    splits, cells = _cut(light, target)
    work.drop()
    limits, done, first = [], 0, None
    for at, (_, w) in enumerate(cells):
        if first is None or done // target != first:
            first = done // target
            limits.append(at)
        done += w
    rows = df.withColumns({"__k": F.col(key).cast("long"), "__t": digest})
    count = max(1, len(limits))
    if count == 1:
        found = rows.withColumn("__range", F.lit(0))
    else:
        table = df.sparkSession.createDataFrame(
            [(cell, bisect_right(limits, at) - 1) for at, (cell, _) in enumerate(cells)], "cell long, __range int"
        )
        named = rows.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                            F.col("__k").alias("k"), F.col("__t").alias("t"))
        placed = _descend(named, splits).join(F.broadcast(table), "cell")
        found = placed.select("row.*", F.col("k").alias("__k"), F.col("t").alias("__t"), "__range")
    return found.repartitionById(count, F.col("__range")).sortWithinPartitions(
        F.col("__k").asc_nulls_first(), "__t"
    ).drop("__k")


def running_start(df: DataFrame, order: list[str], size: str, name: str) -> DataFrame:
    """Add the sum of ``size`` over all rows before; for tables with a row per file."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))


def by_file(manifest: DataFrame, most: int = 4096) -> DataFrame:
    """A manifest (shard, part, ...) dealt out so that files are read side by side.

    Its rows are so small that adaptive execution would put them all into one task.
    """
    tasks = max(1, min(most, manifest.count()))
    return manifest.repartitionById(tasks, (F.col("shard") + F.col("part")) % tasks)
