"""The operational report: nowcast, retry where it is too uncertain, trends; and backtests."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latecast.operators import curves, draws, model, report, summary, triangle, weekly
from latecast.operators.keys import attach, join_on
from latecast.operators.model import ModelSpec
from latecast.operators.weekly import WeekRule
from latecast.plans.checkpoints import checkpointed
from latecast.plans.nowcast import nowcast

# The operational defaults.
REPORT_D_MAX = 10
REPORT_WINDOW = 40
MAX_TRIALS = 3
MIN_D_MAX = 4


def adaptive_draws(
    days: DataFrame,
    *,
    series_cols: Sequence[str] = (),
    d_max: int = REPORT_D_MAX,
    window: int = REPORT_WINDOW,
    rule: WeekRule = WeekRule(),
    spec: ModelSpec = ModelSpec(),
    limit: float = 20,
    max_trials: int = MAX_TRIALS,
    min_d_max: int = MIN_D_MAX,
) -> DataFrame:
    """Trajectories (series, d_max, consistent, draw, Time, dt_event, Y), estimated again with a
    shorter maximum delay and window for those series whose last week is too uncertain.

    ``window`` is a number of weeks here. At most ``max_trials`` rounds; each round's draws are
    checkpointed and the next one sees only the series that failed. ``consistent`` is false for a
    series that was still too uncertain in the last round.
    """
    if "age_class" in days.columns:
        raise ValueError("the report works on series without age classes")
    accepted, trial, held = [], 1, days.is_cached
    stored = days = days.persist(StorageLevel.MEMORY_AND_DISK)
    while True:
        table = triangle.delay_triangle(
            days, d_max=d_max, window=window - 1, series_cols=series_cols, rule=rule
        )
        posterior = model.fit_delay_model(table, spec, series_cols=series_cols)
        drawn = checkpointed(draws.trajectories(posterior, spec, series_cols=series_cols))
        drawn = drawn.withColumn("d_max", F.lit(d_max))
        limits = summary.report_summary(drawn, keys=[*series_cols, "dt_event"])
        check = checkpointed(
            report.dispersion_check(limits, limit=limit, series_cols=series_cols)
        )
        check = check.withColumn("consistent", F.coalesce("consistent", F.lit(False)))
        drawn = attach(drawn, check, series_cols)
        failed = check.filter(~F.col("consistent"))
        last_round = trial == max_trials or d_max - 2 < min_d_max
        if last_round or failed.isEmpty():
            accepted.append(drawn)
            break
        if not series_cols:
            days_left = days
        else:
            failed = failed.select(*series_cols)
            accepted.append(join_on(drawn, failed, series_cols, "left_anti"))
            days_left = join_on(days, failed, series_cols, "left_semi")
        days, trial, d_max = days_left, trial + 1, d_max - 2
        window = round(2.25 * d_max) - 1
    if not held:
        stored.unpersist()
    return reduce(DataFrame.unionByName, accepted)


def situation_report(
    days: DataFrame,
    *,
    series_cols: Sequence[str] = (),
    rule: WeekRule = WeekRule(),
    cap: bool = False,
    **fit_options,
) -> DataFrame:
    """One row per series and week: reported, estimated with limits, rolling mean, trends."""
    held = days.is_cached
    days = days.persist(StorageLevel.MEMORY_AND_DISK)
    drawn = adaptive_draws(days, series_cols=series_cols, rule=rule, **fit_options)
    observed = checkpointed(curves.weekly_tally(days, series_cols=series_cols, rule=rule))
    if not held:
        days.unpersist()
    return report.situation_report(drawn, observed, series_cols=series_cols, cap=cap)


def backtest(
    df: DataFrame,
    date_onset: str,
    date_report: str,
    as_of: dt.date | str,
    *,
    series_cols: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Nowcast as it would have been on ``as_of``, beside what was reported in the end.

    Truth is counted in the weeks of the nowcast, from all reports known now.
    """
    view = curves.as_of(df, date_report, as_of)
    result = nowcast(view, date_onset, date_report, series_cols=series_cols, **options)
    keys = [*series_cols, "dt_event"]
    estimates = result.total
    days = weekly.day_counts(df, date_onset, date_report, series_cols=series_cols)
    starts = estimates.select(
        *series_cols, "dt_event", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("_d")
    ).withColumn("onset", F.date_add("dt_event", F.col("_d"))).drop("_d")
    per_day = days.groupBy(*series_cols, "onset").agg(F.sum("n").alias("n"))
    truth = (
        join_on(starts, per_day, [*series_cols, "onset"], "left")
        .groupBy(*keys)
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("later"))
    )
    seen = curves.epi_curve(result.triangle, series_cols=series_cols)
    return join_on(join_on(estimates, seen, keys, "left"), truth, keys, "left").withColumn(
        "covered", F.col("later").between(F.col("LI"), F.col("LS"))
    )
