"""Joins on the series key, for any number of key columns and with NULL keys kept."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A per-series table of scalars of up to so many bytes may be broadcast.
BROADCAST_BYTES = 32 << 20
BYTES_PER_COLUMN = 32


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL equals NULL, since NULL is a series like any other."""
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns]
    )
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    )
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def attach(df: DataFrame, scalars: DataFrame, series_cols: Sequence[str]) -> DataFrame:
    """Put the per-series scalars beside every row.

    Without series the scalars are one row and become a scalar subquery. With series it is an
    equi-join; adaptive execution broadcasts the scalars when they turn out small.
    """
    if series_cols:
        return join_on(df, scalars, series_cols)
    row = scalars.select(F.struct(*scalars.columns).alias("s")).scalar()
    return df.select("*", *[row[c].alias(c) for c in scalars.columns])


def attach_sized(df: DataFrame, scalars: DataFrame, series_cols: Sequence[str]) -> DataFrame:
    """``attach`` for a row-level ``df`` that should not be shuffled.

    The scalars are counted first, by a job that reads their columns only. Up to BROADCAST_BYTES they
    are broadcast, so the line list stays where it is; beyond that it is a shuffled join with adaptive
    skew splitting.
    """
    if not series_cols:
        return attach(df, scalars, series_cols)
    if scalars.count() * len(scalars.columns) * BYTES_PER_COLUMN <= BROADCAST_BYTES:
        scalars = F.broadcast(scalars)
    return join_on(df, scalars, series_cols)


def beside(df: DataFrame, series_cols: Sequence[str], **aggregates: Column) -> DataFrame:
    """Per-series aggregates of ``df`` beside its own rows, as a window over the series.

    Only for tables whose rows per series are bounded by calendar, age classes and draws, whatever
    the size of the line list: a series is one group of one task here. Unlike a join with its own
    aggregate this does not double the plan, and later groupings by series need no shuffle.
    """
    series = Window.partitionBy(*series_cols) if series_cols else Window.partitionBy(F.lit(0))
    return df.withColumns({name: column.over(series) for name, column in aggregates.items()})
