"""Epidemic curves, as-of views, and the comparison of a view with what was known later."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latecast.functions import weeks
from latecast.operators.keys import join_on
from latecast.operators.weekly import WeekRule, weekly_counts


def as_of(df: DataFrame, date_report: str, day: dt.date | str) -> DataFrame:
    """The line list as it stood on ``day``; a partitioned store prunes by report date."""
    return df.filter(F.col(date_report).cast("date") <= F.lit(day).cast("date"))


def epi_curve(triangle: DataFrame, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """Observed cases per week of a triangle; 0 where no cell is known yet."""
    return triangle.groupBy(*series_cols, "dt_event").agg(
        F.coalesce(F.sum("Y"), F.lit(0)).alias("observed")
    )


def weekly_tally(
    days: DataFrame, *, series_cols: Sequence[str] = (), rule: WeekRule = WeekRule()
) -> DataFrame:
    """Cases per onset week, all delays."""
    return (
        weekly_counts(days, series_cols=series_cols, rule=rule)
        .groupBy(*series_cols, F.col("onset_week").alias("dt_event"))
        .agg(F.sum("n").alias("n"))
    )


def daily_tally(
    df: DataFrame, date_onset: str, *, before_year: int | None = None, series_cols: Sequence[str] = ()
) -> DataFrame:
    """Cases per onset day, optionally only for years before ``before_year``."""
    days = df.select(*series_cols, F.col(date_onset).cast("date").alias("date_onset"))
    if before_year is not None:
        days = days.filter(F.year("date_onset") < before_year)
    return days.groupBy(*series_cols, "date_onset").agg(F.count(F.lit(1)).alias("n"))


def sunday_tally(
    df: DataFrame, date_onset: str, last_onset: dt.date | str, *, series_cols: Sequence[str] = ()
) -> DataFrame:
    """Cases per Sunday week of onset, from everything known now, up to ``last_onset``."""
    onset = F.col(date_onset).cast("date")
    return (
        df.filter(onset <= F.lit(last_onset).cast("date"))
        .groupBy(*series_cols, weeks.sunday_of(onset).alias("dt_event"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def truth_beside(
    view: DataFrame, truth: DataFrame, *, series_cols: Sequence[str] = ()
) -> DataFrame:
    """Weekly counts of an early view beside the later ones."""
    keys = [*series_cols, "dt_event"]
    return join_on(
        truth.withColumnRenamed("n", "later"), view.withColumnRenamed("n", "then"), keys, "left"
    ).withColumn("then", F.coalesce("then", F.lit(0)))


def phase(df: DataFrame, last_time: int | str) -> DataFrame:
    """Tells nowcast weeks from forecast weeks; ``last_time`` is the last onset week's number."""
    limit = F.col(last_time) if isinstance(last_time, str) else F.lit(last_time)
    return df.withColumn(
        "phase", F.when(F.col("Time") <= limit, "nowcast").otherwise("forecast")
    )
