"""Releases kept as changes: a row for each count of a key and the releases it stood in, not one for every release.

Cumulative snapshots repeat every row in every release though few counts change. A change is valid from the release
that first shows a count until the release that shows another one, or none; NULL while it still stands.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latecast.operators.keys import join_on


def release_days(snapshots: DataFrame) -> DataFrame:
    """(data, at): the release days and their numbers from 1; a row for each release."""
    days = snapshots.select(F.col("data").cast("date").alias("data")).distinct()
    return days.withColumn("at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("data")))


def release_changes(snapshots: DataFrame, event_col: str, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """Snapshots (data, event, series, n) -> (series, event, n, valid_from, valid_until).

    Rows of a key in one release are added up. A release that leaves a key out ends its count.
    """
    keys = [*series_cols, event_col]
    days = release_days(snapshots)
    counts = snapshots.groupBy(*keys, F.col("data").cast("date").alias("data")).agg(F.sum("n").alias("n"))
    placed = join_on(counts, days, ["data"])
    order = Window.partitionBy(*keys).orderBy("at")
    same = F.col("n").eqNullSafe(F.lag("n").over(order)) & (F.lag("at").over(order) == F.col("at") - 1)
    islands = placed.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn(
        "_island", F.sum("_new").over(order)
    )
    spans = islands.groupBy(*keys, "_island").agg(
        F.first("n").alias("n"), F.min("data").alias("valid_from"), (F.max("at") + 1).alias("_end")
    )
    ends = days.select(F.col("at").alias("_end"), F.col("data").alias("valid_until"))
    return spans.join(ends, "_end", "left").select(*keys, "n", "valid_from", "valid_until")


def release_of(changes: DataFrame, day: dt.date | str) -> DataFrame:
    """One release rebuilt: the rows (data, series, event, n) that stood on that day, by a filter on the dates."""
    at = F.lit(day).cast("date")
    stands = (F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at))
    if "from_month" in changes.columns:
        changes = changes.filter(F.col("from_month").cast("string") <= F.lit(str(day)[:7])).drop("from_month")
    rest = [c for c in changes.columns if c not in ("valid_from", "valid_until")]
    return changes.filter(stands).select(at.alias("data"), *rest)


def releases_between(
    changes: DataFrame, days: DataFrame, *, since: dt.date | str | None = None, until: dt.date | str | None = None
) -> DataFrame:
    """All releases of a range rebuilt: snapshots again. ``days`` are the release days (data, at)."""
    if until is not None:
        days = days.filter(F.col("data") <= F.lit(until).cast("date"))
        changes = changes.filter(F.col("valid_from") <= F.lit(until).cast("date"))
    if since is not None:
        days = days.filter(F.col("data") >= F.lit(since).cast("date"))
        changes = changes.filter(F.col("valid_until").isNull() | (F.col("valid_until") > F.lit(since).cast("date")))
    listed = days.agg(F.sort_array(F.collect_list("data")).alias("_days"))
    rest = [c for c in changes.columns if c not in ("valid_from", "valid_until", "from_month")]
    inside = lambda d: (d >= F.col("valid_from")) & (
        F.col("valid_until").isNull() | (d < F.col("valid_until")))
    return changes.withColumn("_days", listed.scalar()).select(
        F.explode(F.filter("_days", inside)).alias("data"), *rest
    )


def write_changes(changes: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Changes in folders by the month from which they are valid: a release reads only its past."""
    stored = changes.withColumn("from_month", F.date_format("valid_from", "yyyy-MM"))
    stored.repartition("from_month").write.mode(mode).partitionBy("from_month").parquet(path)
