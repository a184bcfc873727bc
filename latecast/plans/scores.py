"""Proper scores of nowcasts as they would have been on many days, against what was reported later.

All days are estimated in one job: the day is one more key of the series. A day count belongs to every day
from its report on; what lies before a day's window only keeps its report, which sets the cut-off.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latecast.functions.stats import LIMITS, quantiles
from latecast.operators import draws, model, triangle, weekly
from latecast.operators.keys import join_on
from latecast.operators.model import ModelSpec
from latecast.operators.weekly import WeekRule


def as_of_views(
    days: DataFrame, as_of: Sequence[dt.date | str], *, window: int, series_cols: Sequence[str] = ()
) -> DataFrame:
    """The day counts (onset, report, n, ...) as known on each of the days, with the column ``as_of``.

    Onsets that cannot fall into the window any more become NULL and are added up: with the week of the
    cut-off and a running one on either side, that is ``window`` + 3 weeks before the day, or before the last report.
    """
    if not as_of:
        raise ValueError("at least one day is needed")
    listed = F.array(*[F.lit(day).cast("date") for day in as_of])
    seen = days.withColumn("as_of", F.explode(F.filter(listed, lambda a: a >= F.col("report"))))
    last = seen.groupBy(*series_cols, "as_of").agg(
        F.max(F.when(F.col("onset") <= F.col("as_of"), F.col("onset"))).alias("_last")
    )
    both = join_on(seen, last, [*series_cols, "as_of"])
    old = F.col("onset") < F.date_sub("_last", 7 * (window + 3))
    both = both.withColumn("onset", F.when(~old, F.col("onset")))
    keys = [c for c in both.columns if c not in ("n", "_last")]
    return both.groupBy(*keys).agg(F.sum("n").alias("n"))


def crps(values: Column, truth: Column) -> Column:
    """Continuous ranked probability score of sorted whole draws: E|X - y| - E|X - X'| / 2, from whole sums."""
    n = F.size(values).cast("long")
    off = F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + F.abs(x - truth))
    apart = F.aggregate(
        F.transform(values, lambda x, i: (2 * (i.cast("long") + 1) - n - 1) * x), F.lit(0).cast("long"),
        lambda s, x: s + x,
    )
    return off / n - apart / (n * n)


def interval_score(low: Column, high: Column, truth: Column, level: float) -> Column:
    """Width, and 2 / (1 - level) times how far the truth lies outside."""
    outside = F.greatest(F.lit(0.0), low - truth) + F.greatest(F.lit(0.0), truth - high)
    return high - low + outside * (2 / (1 - level))


def later_counts(weeks_: DataFrame, days: DataFrame, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """The listed weeks (series, dt_event, ...) with ``later``: all cases of their seven days known now."""
    per_day = days.groupBy(*series_cols, "onset").agg(F.sum("n").alias("n"))
    each = weeks_.withColumn("onset", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(6)), lambda d: F.date_add("dt_event", d)
    )))
    return join_on(each, per_day, [*series_cols, "onset"], "left").groupBy(*weeks_.columns).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("later")
    )


def score_weeks(
    df: DataFrame,
    date_onset: str,
    date_report: str,
    as_of: Sequence[dt.date | str],
    *,
    series_cols: Sequence[str] = (),
    d_max: int = triangle.D_MAX,
    window: int = triangle.WINDOW,
    rule: WeekRule = WeekRule(),
    specs: Mapping[str, ModelSpec] | None = None,
) -> DataFrame:
    """One row per (series, as_of, setting, dt_event): back (weeks before the last estimated one), later, crps,
    interval_95, interval_50, covered_95, covered_50.

    ``specs`` names the settings to compare (default: one, ``default``). A day without any report gives no
    rows for that series.
    """
    keys = [*series_cols, "as_of"]
    days = weekly.day_counts(df, date_onset, date_report, series_cols=series_cols)
    views = as_of_views(days, as_of, window=window, series_cols=series_cols)
    table = triangle.delay_triangle(views, d_max=d_max, window=window, series_cols=keys, rule=rule)

    def sorted_draws(name: str, spec: ModelSpec) -> DataFrame:
        fitted = model.fit_delay_model(table, spec, series_cols=keys)
        drawn = draws.trajectories(fitted, spec, series_cols=keys)
        return drawn.groupBy(*keys, F.lit(name).alias("setting"), "dt_event").agg(
            F.sort_array(F.collect_list("Y")).alias("_ys"), quantiles(F.col("Y"), LIMITS).alias("_q")
        )

    all_draws = reduce(
        DataFrame.unionByName,
        [sorted_draws(name, spec) for name, spec in (specs or {"default": ModelSpec()}).items()],
    )
    later = later_counts(all_draws.select(*keys, "dt_event").distinct(), days, series_cols=series_cols)
    q = dict(zip(LIMITS, (F.col("_q")[i] for i in range(len(LIMITS)))))
    y = F.col("later")
    last = later.groupBy(*keys).agg(F.max("dt_event").alias("_last"))
    rows = join_on(join_on(all_draws, later, [*keys, "dt_event"]), last, keys)
    return rows.select(
        *keys, "setting", "dt_event",
        F.floor(F.datediff("_last", "dt_event") / 7).cast("int").alias("back"), "later",
        crps(F.col("_ys"), y).alias("crps"),
        interval_score(q["LI"], q["LS"], y, 0.95).alias("interval_95"),
        interval_score(q["LIb"], q["LSb"], y, 0.5).alias("interval_50"),
        y.between(q["LI"], q["LS"]).alias("covered_95"),
        y.between(q["LIb"], q["LSb"]).alias("covered_50"),
    )


def mean_scores(scored: DataFrame, by: Sequence[str] = ("setting", "as_of")) -> DataFrame:
    """Mean scores and shares covered of ``score_weeks``, per group."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("weeks"),
        *[F.avg(c).alias(c) for c in ("crps", "interval_95", "interval_50")],
        share("covered_95"), share("covered_50"),
    )
