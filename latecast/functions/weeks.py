"""Week arithmetic as Column expressions. Weekdays count from 0 = Sunday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SATURDAY = 6


def weekday(day: Column) -> Column:
    return F.dayofweek(day) - 1


def week_start(day: Column, first_weekday: Column | int) -> Column:
    """First day of the week holding ``day`` when weeks begin on ``first_weekday``."""
    if isinstance(first_weekday, int):
        first_weekday = F.lit(first_weekday)
    return F.date_sub(day, F.pmod(weekday(day) - first_weekday, F.lit(7)))


def sunday_of(day: Column) -> Column:
    return week_start(day, 0)


def first_weekday(last_report: Column, use_epiweek: bool) -> Column:
    """Weeks start on Sunday, or on the day after the weekday of the last report."""
    if use_epiweek:
        return F.lit(0)
    return F.pmod(weekday(last_report) + 1, F.lit(7))


def report_cutoff(
    last_report: Column,
    trim_weeks: int,
    horizon: int,
    use_epiweek: bool,
    keep_complete_week: bool,
) -> Column:
    """Last report date that takes part.

    A running epiweek is left out. So is the week ending on a Saturday report, although it is
    complete, unless ``keep_complete_week``.
    """
    open_days = weekday(last_report) + 1
    if use_epiweek and keep_complete_week:
        unfinished = F.when(weekday(last_report) == SATURDAY, 0).otherwise(open_days)
    elif use_epiweek:
        unfinished = open_days
    elif keep_complete_week:
        unfinished = F.lit(0)
    else:
        unfinished = F.when(weekday(last_report) == SATURDAY, open_days).otherwise(0)
    return F.date_sub(F.date_add(last_report, 7 * (horizon - trim_weeks)), unfinished)


def weeks_between(later: Column, earlier: Column) -> Column:
    return (F.datediff(later, earlier) / 7).cast("int")


def add_weeks(day: Column, weeks: Column | int) -> Column:
    return F.date_add(day, weeks * 7)


def week_sequence(first: Column, last: Column) -> Column:
    return F.sequence(first, last, F.expr("interval 7 days"))


def epiyear(day: Column) -> Column:
    """CDC epidemiological year: the year of the week's Wednesday."""
    return F.year(F.date_add(sunday_of(day), 3))


def epiweek(day: Column) -> Column:
    """CDC epidemiological week number (Spark's ``weekofyear`` is the ISO one)."""
    midweek = F.date_add(sunday_of(day), 3)
    return (F.floor((F.dayofyear(midweek) - 1) / 7) + 1).cast("int")
