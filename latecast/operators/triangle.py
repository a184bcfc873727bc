"""Delay triangles: dense (week, delay[, age class]) counts with NULL where nothing can be known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latecast.functions import weeks
from latecast.operators.keys import beside, join_on
from latecast.operators.weekly import WeekRule, weekly_counts

D_MAX = 15
WINDOW = 30


def windowed_cells(
    cells: DataFrame, *, d_max: int, window: int, series_cols: Sequence[str] = ()
) -> DataFrame:
    """The cells the model sees: the last ``window`` + 1 onset weeks, delays up to ``d_max``."""
    return (
        beside(cells, series_cols, _last_week=F.max("onset_week"))
        .filter(F.col("onset_week") >= F.date_sub("_last_week", 7 * window))
        .filter(F.col("delay") <= d_max)
        .drop("_last_week")
    )


def delay_triangle(
    days: DataFrame,
    *,
    d_max: int = D_MAX,
    window: int = WINDOW,
    series_cols: Sequence[str] = (),
    rule: WeekRule = WeekRule(),
) -> DataFrame:
    """Day counts -> dense triangle (series, dt_event, Time, delay[, age_class], Y).

    Time counts weeks from 1. Y is NULL where Time + delay passes the last onset week, 0 where a
    knowable cell has no rows. ``rule.horizon`` weeks of NULL cells follow the last onset week.

    The known cells of a series, at most (window + 1) x (d_max + 1) x classes, are gathered, laid
    over an empty grid and added up: no join, and no shuffle after the one by series.
    """
    cells = windowed_cells(
        weekly_counts(days, series_cols=series_cols, rule=rule),
        d_max=d_max, window=window, series_cols=series_cols,
    )
    by_age = "age_class" in days.columns
    age = ["age_class"] if by_age else []
    first, last = F.col("_first_week"), F.col("_last_week")
    gathered = (
        cells.groupBy(*series_cols)
        .agg(
            F.min("onset_week").alias("_first_week"),
            F.max("onset_week").alias("_last_week"),
            F.collect_set("age_class" if by_age else F.lit(0)).alias("_classes"),
            F.collect_list(F.struct("onset_week", "delay", *age, "n")).alias("_cells"),
        )
        .filter(first.isNotNull())
        .withColumn("_last_time", weeks.weeks_between(last, first) + 1)
    )

    def cell(time, delay, age_class, n):
        parts = [time.alias("Time"), delay.alias("delay")]
        if by_age:
            parts.append(age_class.alias("age_class"))
        return F.struct(*parts, n.alias("n"))

    known = F.transform(
        "_cells",
        lambda c: cell(
            weeks.weeks_between(c["onset_week"], first) + 1, c["delay"],
            c["age_class"] if by_age else None, c["n"],
        ),
    )
    empty = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.col("_last_time") + rule.horizon),
            lambda t: F.flatten(
                F.transform(
                    F.sequence(F.lit(0), F.lit(d_max)),
                    lambda d: F.transform(
                        "_classes", lambda a: cell(t, d, a, F.lit(0).cast("long"))
                    ),
                )
            ),
        )
    )
    filled = (
        gathered.select(
            *series_cols, "_first_week", "_last_time", F.explode(F.concat(known, empty)).alias("c")
        )
        .select(*series_cols, "_first_week", "_last_time", "c.*")
        .groupBy(*series_cols, "_first_week", "_last_time", "Time", "delay", *age)
        .agg(F.sum("n").alias("n"))
    )
    knowable = F.col("Time") + F.col("delay") <= F.col("_last_time")
    return filled.select(
        *series_cols,
        weeks.add_weeks(first, F.col("Time") - 1).alias("dt_event"),
        "Time",
        "delay",
        *age,
        F.when(knowable, F.col("n")).alias("Y"),
    )


def integer_week_triangle(
    df: DataFrame,
    week_col: str,
    delay_col: str,
    *,
    this_week: int,
    d_max: int,
    window: int,
    series_cols: Sequence[str] = (),
    first_week: int | None = None,
) -> DataFrame:
    """Triangle over running week numbers 1..``this_week``; delays outside 0..``d_max`` drop out.

    The calendar runs from ``first_week`` (default: the first week of the window) to this week.
    """
    start = this_week - window + 1 if first_week is None else first_week
    week, delay = F.col(week_col).cast("int"), F.col(delay_col).cast("int")
    counts = (
        df.select(*series_cols, week.alias("Date"), delay.alias("delay"))
        .filter(F.col("Date").between(max(1, this_week - window + 1), this_week))
        .filter(F.col("delay").between(0, d_max))
        .groupBy(*series_cols, "Date", "delay")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bounds = counts.groupBy(*series_cols).agg(
        F.least(F.min(F.when(F.col("n") > 0, F.col("Date"))), F.lit(start)).alias("_first")
    )
    grid = (
        bounds.filter(F.col("_first").isNotNull())
        .withColumn("Date", F.explode(F.sequence(F.col("_first"), F.lit(this_week))))
        .withColumn("delay", F.explode(F.sequence(F.lit(0), F.lit(d_max))))
    )
    knowable = F.col("Date") + F.col("delay") <= this_week
    return join_on(grid, counts, [*series_cols, "Date", "delay"], "left").select(
        *series_cols,
        "Date",
        (F.col("Date") - F.col("_first") + 1).alias("Time"),
        "delay",
        F.concat_ws(" ", F.col("Date") - F.col("_first") + 1, "delay").alias("cell"),
        F.when(knowable, F.coalesce(F.col("n"), F.lit(0))).alias("Y"),
    )


def recent(df: DataFrame, days_back: int, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """Rows whose ``dt_event`` lies within ``days_back`` days of the last one of their series."""
    return (
        beside(df, series_cols, _last_event=F.max("dt_event"))
        .filter(F.col("dt_event") >= F.date_sub("_last_event", days_back))
        .drop("_last_event")
    )


def triangle_wide(triangle: DataFrame, d_max: int, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """One row per week, one column ``d0``.. per delay."""
    return (
        triangle.filter(F.col("delay") <= d_max)
        .withColumn("delay", F.concat(F.lit("d"), F.col("delay")))
        .groupBy(*series_cols, "dt_event")
        .pivot("delay", [f"d{d}" for d in range(d_max + 1)])
        .agg(F.first("Y"))
    )


def triangle_long(wide: DataFrame, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """Back from one column per delay to one row per (week, delay)."""
    keys = [*series_cols, "dt_event"]
    long = wide.unpivot(keys, [c for c in wide.columns if c not in keys], "delay", "Y")
    return long.withColumn("delay", F.substring("delay", 2, 9).cast("int"))


def observed_from_first_unknown(
    triangle: DataFrame, *, series_cols: Sequence[str] = ()
) -> DataFrame:
    """What is already reported in the weeks that the nowcast will complete."""
    unknown = F.max(F.col("Y").isNull()).alias("_unknown")
    weekly = triangle.groupBy(*series_cols, "Time", "dt_event").agg(
        F.coalesce(F.sum("Y"), F.lit(0)).alias("observed"), unknown
    )
    start = F.min(F.when(F.col("_unknown"), F.col("Time")))
    return (
        beside(weekly, series_cols, _start=start)
        .filter(F.col("Time") >= F.col("_start"))
        .drop("_start", "_unknown")
    )


def zero_case_strata(triangle: DataFrame, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """Age classes in which nothing has been observed at all."""
    total = triangle.groupBy(*series_cols, "age_class").agg(
        F.coalesce(F.sum("Y"), F.lit(0)).alias("observed")
    )
    return total.filter(F.col("observed") == 0).drop("observed")
