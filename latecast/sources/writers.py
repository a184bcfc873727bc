"""Stored tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_result(
    df: DataFrame, path: str, *, series_cols: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Parquet, in folders by series if asked: right for few, large series."""
    df.write.mode(mode).partitionBy(*series_cols).parquet(path)


def month_of(day: str) -> Column:
    return F.date_format(day, "yyyy-MM")


def within_reports(
    days: DataFrame, *, as_of: dt.date | str | None = None, since: dt.date | str | None = None
) -> DataFrame:
    """Rows (report, report_month, ...) whose report day is within the bounds; folders of other months are skipped."""
    month = F.col("report_month").cast("string")
    if since is not None:
        days = days.filter(month >= F.lit(str(since)[:7])).filter(F.col("report") >= F.lit(since).cast("date"))
    if as_of is not None:
        days = days.filter(month <= F.lit(str(as_of)[:7])).filter(F.col("report") <= F.lit(as_of).cast("date"))
    return days


def write_day_counts(days: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Day counts in folders by report month, so that an as-of view reads only its past."""
    stored = days.withColumn("report_month", month_of("report"))
    stored.write.mode(mode).partitionBy("report_month").parquet(path)


def read_day_counts(
    spark: SparkSession, path: str, *, as_of: str | None = None, since: str | None = None
) -> DataFrame:
    """Stored day counts; ``as_of`` and ``since`` bound the report days, and skip folders of others."""
    return within_reports(spark.read.parquet(path), as_of=as_of, since=since).drop("report_month")
