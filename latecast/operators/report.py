"""Parts of the weekly situation report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latecast.functions.stats import half_even
from latecast.functions import weeks
from latecast.operators.keys import attach, beside, join_on
from latecast.operators.summary import cap_upper_limits, report_summary
from latecast.operators.trend import trends

# Weeks of a trend -> how many weeks back it is computed.
TREND_WINDOWS = {3: 8, 6: 16}


def _group(series_cols: Sequence[str]) -> list:
    """Window partition of weekly tables, whose rows per series are calendar weeks."""
    return list(series_cols) or [F.lit(0)]


def report_table(
    summary: DataFrame, observed: DataFrame, *, series_cols: Sequence[str] = (), cut: int = 2
) -> DataFrame:
    """Estimates beside what is reported, for every week of ``observed`` (dt_event, n) or ``summary``.

    Weeks ahead have no count. ``full_estimate`` is the median where there is one, else the reported
    count. ``n_cut`` leaves out the ``cut`` weeks that are still filling up; ``rolling_average`` is
    centred over three.
    """
    keys = [*series_cols, "dt_event"]
    both = observed.unionByName(summary, allowMissingColumns=True).groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in [*observed.columns, *summary.columns] if c not in keys]
    )
    counted = F.max(F.when(F.col("n").isNotNull(), F.col("dt_event")))
    rows = beside(both, series_cols, _last=counted).withColumns(
        {
            "full_estimate": F.coalesce(F.col("Median"), F.col("n").cast("double")),
            "n_cut": F.when(
                F.col("dt_event") <= F.date_sub("_last", 7 * cut), F.col("n").cast("double")
            ),
        }
    )
    return rolling_average(rows, "full_estimate", series_cols=series_cols).drop("_last")


def fill_calendar(observed: DataFrame, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """Weekly counts with the empty weeks between first and last put in as 0."""
    order = Window.partitionBy(*_group(series_cols)).orderBy("dt_event")
    last_of_gap = F.coalesce(F.date_sub(F.lead("dt_event").over(order), 7), F.col("dt_event"))
    spans = observed.withColumn("_until", last_of_gap)
    return spans.select(
        *series_cols, "n",
        F.posexplode(weeks.week_sequence(F.col("dt_event"), F.col("_until"))).alias(
            "_pos", "dt_event"
        ),
    ).select(
        *series_cols, "dt_event", F.when(F.col("_pos") == 0, F.col("n")).otherwise(0).alias("n")
    )


def rolling_average(df: DataFrame, value: str, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """Centred three-week mean, rounded half to even; NULL at both ends."""
    frame = Window.partitionBy(*_group(series_cols)).orderBy("dt_event").rowsBetween(-1, 1)
    mean = F.when(F.count(F.lit(1)).over(frame) == 3, F.avg(value).over(frame))
    full = F.count(value).over(frame) == 3
    return df.withColumn("rolling_average", half_even(F.when(full, mean)))


def splice_history(
    drawn: DataFrame,
    observed: DataFrame,
    *,
    series_cols: Sequence[str] = (),
    weeks_back: int | None = None,
) -> DataFrame:
    """Draws preceded by the settled weeks, repeated for every draw number in use.

    History ends strictly before the first drawn week of its series. ``weeks_back`` keeps only
    that many weeks before the last drawn one, for callers that look no further.
    """
    start = F.lit(None).cast("date") if weeks_back is None else F.date_sub(
        F.max("dt_event"), 7 * weeks_back
    )
    bounds = drawn.groupBy(*series_cols).agg(
        F.min("dt_event").alias("_start"), F.max("draw").alias("_draws"), start.alias("_from")
    )
    history = (
        attach(observed, bounds, series_cols)
        .filter(F.col("dt_event") < F.col("_start"))
        .filter(F.col("_from").isNull() | (F.col("dt_event") >= F.col("_from")))
        .select(
            *series_cols, "dt_event", F.col("n").cast("long").alias("Y"),
            F.explode(F.sequence(F.lit(1), F.col("_draws"))).alias("draw"),
        )
    )
    columns = [*series_cols, "draw", "dt_event", "Y"]
    return history.select(*columns).unionByName(drawn.select(*columns))


def rolling_trends(
    spliced: DataFrame, *, series_cols: Sequence[str] = ()
) -> DataFrame:
    """Three- and six-week trends at the last 9 and 17 weeks."""
    scores = trends(spliced, TREND_WINDOWS, series_cols=series_cols)

    def of(window: int):
        return F.max(F.when(F.col("window") == window, F.col("score")))

    return scores.groupBy(*series_cols, F.col("end_week").alias("dt_event")).agg(
        of(6).alias("trend_6w"), of(3).alias("trend_3w")
    )


def dispersion_check(
    summary: DataFrame, *, limit: float = 20, series_cols: Sequence[str] = ()
) -> DataFrame:
    """Per series: is the upper limit of the last week below ``limit`` times median plus one?"""
    calm = F.col("LS") / (F.col("Median") + 1) < limit
    return (
        beside(summary, series_cols, _last=F.max("dt_event"))
        .filter(F.col("dt_event") == F.col("_last"))
        .groupBy(*series_cols)
        .agg(F.bool_and(calm).alias("consistent"))
    )


def bridge_row(report: DataFrame, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """Lets the estimate start at the last reported point: the week before the first estimate gets
    its reported count as median. Weeks after the last estimate are dropped."""
    order = Window.partitionBy(*_group(series_cols)).orderBy("dt_event")
    last = F.max(F.when(F.col("Median").isNotNull(), F.col("dt_event")))
    before = F.col("Median").isNull() & F.lead("Median").over(order).isNotNull()
    median = F.when(before, F.col("n").cast("double")).otherwise(F.col("Median"))
    return (
        beside(report, series_cols, _last=last)
        .withColumn("Median", median)
        .filter(F.col("dt_event") <= F.col("_last"))
        .drop("_last")
    )


def situation_report(
    drawn: DataFrame, observed: DataFrame, *, series_cols: Sequence[str] = (), cap: bool = False
) -> DataFrame:
    """The whole report from weekly draws (draw, dt_event, Y) and weekly counts (dt_event, n)."""
    keys = [*series_cols, "dt_event"]
    summary = report_summary(drawn, keys=keys)
    if cap:
        summary = cap_upper_limits(summary)
    weekly = fill_calendar(observed, series_cols=series_cols)
    table = report_table(summary, weekly, series_cols=series_cols)
    # So far back do the trends look from the last drawn week.
    reach = max(window + rolling for window, rolling in TREND_WINDOWS.items())
    spliced = splice_history(drawn, weekly, series_cols=series_cols, weeks_back=reach)
    scores = rolling_trends(spliced, series_cols=series_cols)
    return join_on(table, scores, keys, "left")
