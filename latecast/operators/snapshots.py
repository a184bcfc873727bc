"""Release snapshots: cumulative counts per (release day, event day), as published.

Input columns: ``data`` (release), the event date under its own name, ``n`` (cumulative count), and
any series columns such as ``age_class``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latecast.functions import weeks
from latecast.functions.strata import age_class_digit
from latecast.operators.keys import attach


def require_release(snapshots: DataFrame, release: dt.date | str) -> None:
    """Fails unless ``release`` is one of the release days."""
    day = F.col("data").cast("date") == F.lit(release).cast("date")
    if snapshots.filter(day).limit(1).isEmpty():
        raise ValueError(f"{release} is not a release day of these snapshots")


def up_to_release(snapshots: DataFrame, release: dt.date | str | None) -> DataFrame:
    if release is None:
        return snapshots
    require_release(snapshots, release)
    return snapshots.filter(F.col("data").cast("date") <= F.lit(release).cast("date"))


def current_release(
    snapshots: DataFrame,
    event_col: str,
    *,
    release: dt.date | str | None = None,
    epiweek: bool = True,
    by_age: bool = False,
) -> DataFrame:
    """The latest (or the named) release, optionally added up per epidemiological week."""
    if release is not None:
        require_release(snapshots, release)
        rows = snapshots.filter(F.col("data").cast("date") == F.lit(release).cast("date"))
    else:
        latest = snapshots.agg(F.max(F.col("data").cast("date")).alias("_latest"))
        rows = (
            attach(snapshots, latest, ())
            .filter(F.col("data").cast("date") == F.col("_latest"))
            .drop("_latest")
        )
    event = F.col(event_col).cast("date")
    age = [age_class_digit(F.col("age_class")).alias("fx_etaria")] if by_age else []
    if not epiweek:
        return rows.select(F.col("data").cast("date").alias("data"), event.alias("dt_event"), *age, "n")
    return (
        rows.groupBy(
            weeks.sunday_of(event).alias("dt_event"),
            weeks.epiweek(event).alias("dt_event_ew"),
            weeks.epiyear(event).alias("dt_event_ey"),
            *age,
        )
        .agg(F.sum("n").alias("n"))
    )


def _increments(counts: DataFrame, series_cols: Sequence[str]) -> DataFrame:
    """Cumulative counts per (event week, delay) -> what each delay added."""
    order = Window.partitionBy(*series_cols, "dt_event").orderBy("delay")
    before = F.lag("n").over(order)
    return counts.withColumns(
        {
            "Y": F.col("n") - F.coalesce(before, F.lit(0)),
            "left_truncated": before.isNull() & (F.col("delay") > 0),
        }
    )


def _released(snapshots: DataFrame, event_col: str, series_cols: Sequence[str]) -> DataFrame:
    return (
        snapshots.groupBy(
            *series_cols,
            F.col("data").cast("date").alias("dt_release"),
            weeks.sunday_of(F.col(event_col).cast("date")).alias("dt_event"),
        )
        .agg(F.sum("n").alias("n"))
    )


def snapshot_increments(
    snapshots: DataFrame, event_col: str, *, series_cols: Sequence[str] = ()
) -> DataFrame:
    """Weekly increments (dt_event, dt_release, delay, n, Y) between releases.

    Of several releases in a week the smallest count stands. The first release that knows an event
    week books its whole count at its own delay; such rows are marked ``left_truncated``.
    """
    weekly = (
        _released(snapshots, event_col, series_cols)
        .withColumn("dt_release", weeks.sunday_of(F.col("dt_release")))
        .groupBy(*series_cols, "dt_release", "dt_event")
        .agg(F.min("n").alias("n"))
        .withColumn("delay", weeks.weeks_between(F.col("dt_release"), F.col("dt_event")))
    )
    return _increments(weekly, series_cols)


def _sum_if_known() -> Column:
    """Sum that is unknown as soon as one part is."""
    return F.when(F.count("Y") == F.count(F.lit(1)), F.sum("Y"))


def _not_negative() -> Column:
    return F.when(F.col("Y").isNotNull(), F.greatest(F.col("Y"), F.lit(0)))


def _merge_first_delays(cells: DataFrame, series_cols: Sequence[str]) -> DataFrame:
    """Every event counts as at least one week late."""
    return (
        cells.withColumn("delay", F.greatest("delay", F.lit(1)))
        .groupBy(*series_cols, "dt_event", "Time", "delay")
        .agg(_sum_if_known().alias("Y"))
    )


def snapshot_triangle(
    snapshots: DataFrame,
    event_col: str,
    d_max: int,
    *,
    window: int | None = None,
    horizon: int = 0,
    release: dt.date | str | None = None,
    series_cols: Sequence[str] = (),
) -> DataFrame:
    """Delay triangle from weekly releases; the calendar ends at the last release week."""
    steps = snapshot_increments(
        up_to_release(snapshots, release), event_col, series_cols=series_cols
    )
    first, last = F.min("dt_release"), F.max("dt_release")
    if window is not None:
        first = F.greatest(first, F.date_sub(last, 7 * window))
    known = F.when(F.col("delay").between(0, d_max), F.struct("dt_event", "delay", "Y"))
    gathered = (
        steps.groupBy(*series_cols)
        .agg(first.alias("_first"), last.alias("_last"), F.collect_list(known).alias("_known"))
        .filter(F.col("_first").isNotNull())
        .withColumn("_until", weeks.add_weeks(F.col("_last"), horizon))
    )
    unknown = F.lit(None).cast("long")
    empty = _grid(
        F.col("_until"), range(d_max + 1), lambda day, d: [
            day.alias("dt_event"), d.alias("delay"), unknown.alias("Y")
        ],
    )
    cells = (
        gathered.withColumn("_c", F.explode(F.concat("_known", empty)))
        .select(*series_cols, "_first", "_last", "_until", "_c.*")
        .filter(F.col("dt_event").between(F.col("_first"), F.col("_until")))
        .groupBy(*series_cols, "_first", "_last", "dt_event", "delay")
        .agg(F.max("Y").alias("Y"))
    )
    knowable = weeks.weeks_between(F.col("_last"), F.col("dt_event")) >= F.col("delay")
    cells = cells.withColumn(
        "Y", F.when(F.col("Y").isNull() & knowable, F.lit(0)).otherwise(F.col("Y"))
    ).withColumns({"Y": _not_negative(), "Time": _time()})
    return _merge_first_delays(cells, series_cols)


def _grid(until: Column, delays: range, cell) -> Column:
    """Array of a cell for every week from ``_first`` to ``until`` and every delay."""
    return F.flatten(
        F.transform(
            weeks.week_sequence(F.col("_first"), until),
            lambda day: F.transform(
                F.sequence(F.lit(delays.start), F.lit(delays.stop - 1)),
                lambda d: F.struct(*cell(day, d)),
            ),
        )
    )


def _time() -> Column:
    return weeks.weeks_between(F.col("dt_event"), F.col("_first")) + 1


def snapshot_triangle_full_weeks(
    snapshots: DataFrame,
    event_col: str,
    d_max: int,
    *,
    window: int | None = None,
    horizon: int = 0,
    release: dt.date | str | None = None,
    series_cols: Sequence[str] = (),
) -> DataFrame:
    """Delay triangle from releases on any weekday; the calendar ends at the last full week.

    Delays are whole weeks rounded down. Per (event week, delay) the first row wins, in the order
    observed, unknown, zero. The last full week is that of all series together, the first one that
    of each series.
    """
    rows = up_to_release(snapshots, release)
    released = _released(rows, event_col, series_cols)
    exact = released.withColumn(
        "delay", F.datediff("dt_release", "dt_event") / 7
    )
    steps = _increments(exact, series_cols)
    last = rows.agg(F.max(F.col("data").cast("date")).alias("_day")).select(
        F.date_sub(weeks.sunday_of(F.col("_day")), 7).alias("_last")
    )
    first = F.min(weeks.sunday_of(F.col("dt_release"))).alias("_first")
    floored = F.floor("delay").cast("int")
    columns = ["dt_event", "delay", "_rank", "_exact", "Y"]
    observed = F.struct(
        "dt_event", floored.alias("delay"), F.lit(1).alias("_rank"),
        F.col("delay").alias("_exact"), "Y",
    )
    gathered = attach(
        steps.groupBy(*series_cols).agg(
            first, F.collect_list(F.when(floored.between(0, d_max), observed)).alias("_known")
        ),
        last, (),
    )
    if window is not None:
        gathered = gathered.withColumn(
            "_first", F.greatest("_first", F.date_sub("_last", 7 * window))
        )

    def fill(day: Column, d: Column) -> list[Column]:
        unknown = weeks.add_weeks(day, d) > F.col("_last")
        values = [
            day, d, F.when(unknown, 2).otherwise(3), d.cast("double"),
            F.when(~unknown, F.lit(0).cast("long")),
        ]
        return [value.alias(name) for value, name in zip(values, columns)]

    empty = _grid(weeks.add_weeks(F.col("_last"), horizon), range(1, d_max + 1), fill)
    inside = F.filter(
        "_known", lambda c: c["dt_event"].between(F.col("_first"), F.col("_last"))
    )
    cells = (
        gathered.filter(F.col("_first") <= F.col("_last"))
        .select(*series_cols, "_first", F.explode(F.concat(inside, empty)).alias("_c"))
        .select(*series_cols, "_first", "_c.*")
        .groupBy(*series_cols, "_first", "dt_event", "delay")
        .agg(F.min_by("Y", F.struct("_rank", "_exact")).alias("Y"))
        .withColumns({"Y": _not_negative(), "Time": _time()})
    )
    return _merge_first_delays(cells, series_cols)
