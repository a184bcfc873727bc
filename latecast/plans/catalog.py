"""Every operator as a query over the driver tables: name -> (spark, sf_dir) -> DataFrame.

Computed doubles are rounded here, so that engines which add up in another order agree.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latecast.functions import strata, text, weeks
from latecast.operators import (
    curves, draws, model, releases, report, snapshots, summary, trend, triangle, weekly,
)
from latecast.operators.keys import attach, join_on
from latecast.operators.model import ModelSpec
from latecast.operators.weekly import WeekRule
from latecast.plans import checkpoints, scores, situation, tables
from latecast.plans.nowcast import nowcast
from latecast.sources import readers
from latecast.sources.store import DayCountStore

Query = Callable[[SparkSession, str], DataFrame]

SERIES = ["series"]
SERIES_AGE = ["series", "age_class"]
RELEASE = "2001-06-18"
CUSTOM_BINS = (18, 30, 45, 65)
TOTAL_BINS = (*range(0, 81, 10), 130)
WEEK_ZERO = "1999-12-26"
THIS_WEEK = 77


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    # Adding 0 turns a negative zero into a plain one.
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in doubles})


def _days(spark, sf, *, age=None, series=(), bins="10 years") -> DataFrame:
    return weekly.day_counts(
        tables.line_list_as_of(spark, sf), "onset", "report", age, bins=bins, series_cols=series
    )


def _triangle(spark, sf, *, age=None, series=(), rule=WeekRule()) -> DataFrame:
    return triangle.delay_triangle(
        _days(spark, sf, age=age, series=series), series_cols=series, rule=rule
    )


def _weekly_rows(spark, sf, age=None, **options) -> DataFrame:
    return weekly.weekly_line_list(
        tables.line_list(spark, sf), "onset", "report", age, **options
    )


def weekly_line_list(spark, sf):
    return _weekly_rows(spark, sf, "age")


def weekly_line_list_epiweek(spark, sf):
    return _weekly_rows(spark, sf, series_cols=SERIES, rule=WeekRule(use_epiweek=True))


def weekly_line_list_trim_k(spark, sf):
    return _weekly_rows(spark, sf, "age", series_cols=SERIES, rule=WeekRule(trim=9, horizon=1))


def _age_binning(spark, sf, bins) -> DataFrame:
    rows = _weekly_rows(spark, sf, "age", bins=bins)
    return rows.groupBy("age_class").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "label", strata.age_label(F.col("age_class"), bins)
    )


def age_binning_si_pni(spark, sf):
    return _age_binning(spark, sf, "SI-PNI")


def age_binning_10y(spark, sf):
    return _age_binning(spark, sf, "10 years")


def age_binning_5y(spark, sf):
    return _age_binning(spark, sf, "5 years")


def age_binning_custom(spark, sf):
    return _age_binning(spark, sf, CUSTOM_BINS)


def delay_triangle(spark, sf):
    return _triangle(spark, sf).orderBy("Time", "delay")


def delay_triangle_by_age(spark, sf):
    return _triangle(spark, sf, age="age").orderBy("Time", "delay", "age_class")


def delay_triangle_by_series(spark, sf):
    return _triangle(spark, sf, series=SERIES)


def delay_triangle_epiweek(spark, sf):
    return _triangle(spark, sf, age="age", series=SERIES, rule=WeekRule(use_epiweek=True))


def delay_triangle_forecast_k(spark, sf):
    return _triangle(spark, sf, series=SERIES, rule=WeekRule(horizon=2))


def _wide(spark, sf) -> DataFrame:
    return triangle.triangle_wide(
        triangle.recent(_triangle(spark, sf, series=SERIES), 84, series_cols=SERIES),
        10, series_cols=SERIES,
    )


def triangle_wide(spark, sf):
    return _wide(spark, sf)


def triangle_long(spark, sf):
    return triangle.triangle_long(_wide(spark, sf), series_cols=SERIES)


def integer_week_triangle(spark, sf):
    onset, seen = weeks.sunday_of(F.col("onset")), weeks.sunday_of(F.col("report"))
    rows = tables.line_list(spark, sf).select(
        "series",
        weeks.weeks_between(onset, F.lit(WEEK_ZERO).cast("date")).alias("week"),
        weeks.weeks_between(seen, onset).alias("late"),
    )
    return triangle.integer_week_triangle(
        rows, "week", "late", this_week=THIS_WEEK, d_max=10, window=40, series_cols=SERIES
    )


def observed_by_week_from_tmin(spark, sf):
    return triangle.observed_from_first_unknown(
        _triangle(spark, sf, series=SERIES), series_cols=SERIES
    )


def latest_weeks(spark, sf):
    observed = triangle.observed_from_first_unknown(_triangle(spark, sf))
    return observed.orderBy(F.col("dt_event").desc()).limit(6)


def epi_curve(spark, sf):
    return curves.epi_curve(
        _triangle(spark, sf, series=SERIES, rule=WeekRule(horizon=1)), series_cols=SERIES
    )


def weekly_tally(spark, sf):
    days = weekly.day_counts(
        tables.line_list(spark, sf), "onset", "report", series_cols=SERIES
    )
    return curves.weekly_tally(days, series_cols=SERIES)


def weekly_tally_shipdate(spark, sf):
    """Shipping dates lie before half of the orders: the stress case for negative delays."""
    days = weekly.day_counts(tables.line_items(spark, sf), "o_orderdate", "l_shipdate")
    return curves.weekly_tally(days, rule=WeekRule(use_epiweek=True))


def stored_tally(spark, sf):
    """Day counts stored in three increments, compacted in between, and read as known on a day."""
    days = weekly.day_counts(tables.line_list(spark, sf), "onset", "report", series_cols=SERIES)
    part = F.pmod(F.datediff("report", "onset"), F.lit(3))
    store = DayCountStore(spark, checkpoints.new_folder(spark, "day-counts"))
    for i in range(3):
        store.append(days.filter(part == i))
        if i == 1:
            store.compact()
    tally = checkpoints.checkpointed(
        curves.weekly_tally(store.read(as_of=tables.AS_OF), series_cols=SERIES)
    )
    store.drop()
    return tally


def daily_tally(spark, sf):
    return curves.daily_tally(
        tables.line_list(spark, sf), "onset", before_year=2001, series_cols=SERIES
    )


def as_of_epi_curve(spark, sf):
    return curves.weekly_tally(_days(spark, sf, series=SERIES), series_cols=SERIES)


def truth_vs_as_of(spark, sf):
    then = curves.weekly_tally(
        _days(spark, sf, series=SERIES), series_cols=SERIES, rule=WeekRule(use_epiweek=True)
    )
    later = curves.sunday_tally(
        tables.line_list(spark, sf), "onset", tables.AS_OF, series_cols=SERIES
    )
    return curves.truth_beside(then, later, series_cols=SERIES)


def latest_release(spark, sf):
    return snapshots.current_release(tables.snapshots(spark, sf), "dt_sin_pri", epiweek=False)


def named_release_epiweek(spark, sf):
    return snapshots.current_release(tables.snapshots(spark, sf), "dt_sin_pri", release=RELEASE)


def release_by_age(spark, sf):
    return snapshots.current_release(
        tables.snapshots(spark, sf, by_age=True), "dt_sin_pri", by_age=True
    )


def snapshot_increments(spark, sf):
    return snapshots.snapshot_increments(tables.snapshots(spark, sf), "dt_sin_pri")


def snapshot_triangle(spark, sf):
    return snapshots.snapshot_triangle(
        tables.snapshots(spark, sf), "dt_sin_pri", 15, window=30, horizon=2, release=RELEASE
    )


def _from_changes(spark, sf, use) -> DataFrame:
    """What ``use`` makes of the releases stored as changes, and of the release days."""
    published = tables.snapshots(spark, sf)
    folder = checkpoints.new_folder(spark, "releases")
    releases.write_changes(releases.release_changes(published, "dt_sin_pri"), folder)
    result = checkpoints.checkpointed(use(spark.read.parquet(folder), releases.release_days(published)))
    checkpoints.delete_folder(spark, folder)
    return result


def snapshot_triangle_from_changes(spark, sf):
    """The triangle from releases that were kept as changes and rebuilt."""
    return _from_changes(spark, sf, lambda changes, days: snapshots.snapshot_triangle(
        releases.releases_between(changes, days, until=RELEASE),
        "dt_sin_pri", 15, window=30, horizon=2, release=RELEASE,
    ))


def release_from_changes(spark, sf):
    """One release rebuilt by a filter on stored changes."""
    return _from_changes(spark, sf, lambda changes, _: snapshots.current_release(
        releases.release_of(changes, RELEASE), "dt_sin_pri", release=RELEASE
    ))


def snapshot_triangle_floor(spark, sf):
    return snapshots.snapshot_triangle_full_weeks(
        tables.snapshots(spark, sf), "dt_sin_pri", 12, horizon=1, release=RELEASE
    )


def snapshot_triangle_by_age(spark, sf):
    counts = readers.clean_age_counts(tables.snapshots(spark, sf, by_age=True))
    return snapshots.snapshot_triangle_full_weeks(
        counts, "dt_sin_pri", 12, window=30, release=RELEASE, series_cols=["age_class"]
    )


def clean_age_counts(spark, sf):
    counts = readers.clean_age_counts(tables.snapshots(spark, sf, by_age=True))
    return counts.groupBy("data", "age_class").agg(F.sum("n").alias("n"))


def normalise_text(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    return documents.select("doc_id", text.search_form(F.col("text")).alias("search_form"))


def prepare_raw_extract(spark, sf):
    return readers.prepare_extract(readers.union_extracts(tables.raw_extracts(spark, sf)))


def summary_total(spark, sf):
    drawn = tables.formula_draws(spark, sf, by_age=True)
    return _rounded(summary.total_summary(drawn, series_cols=SERIES))


def summary_by_age(spark, sf):
    drawn = tables.formula_draws(spark, sf, by_age=True)
    return _rounded(summary.weekly_summary(drawn, series_cols=SERIES, by=["age_class"]))


def _formula_report(spark, sf) -> DataFrame:
    return summary.report_summary(
        tables.formula_draws(spark, sf), keys=["series", "Time", "dt_event"]
    )


def summary_9q(spark, sf):
    return _rounded(_formula_report(spark, sf))


def total_samples(spark, sf):
    return summary.total_samples(
        tables.formula_draws(spark, sf, by_age=True), series_cols=SERIES
    )


def trend_score(spark, sf):
    return _rounded(trend.trend(tables.formula_draws(spark, sf), series_cols=SERIES), 9)


def trend_score_by_age(spark, sf):
    drawn = tables.formula_draws(spark, sf, by_age=True)
    return _rounded(trend.trend(drawn, window=4, series_cols=SERIES_AGE), 9)


def trend_score_single_draw(spark, sf):
    drawn = tables.formula_draws(spark, sf, draws=1)
    return _rounded(trend.trend(drawn, window=5, series_cols=SERIES), 9)


def rolling_trend_3w(spark, sf):
    drawn = tables.formula_draws(spark, sf)
    return _rounded(trend.trend(drawn, window=3, rolling=8, series_cols=SERIES), 9)


def rolling_trend_6w(spark, sf):
    drawn = tables.formula_draws(spark, sf)
    return _rounded(trend.trend(drawn, window=6, rolling=16, series_cols=SERIES), 9)


def totals_with_history(spark, sf):
    drawn = tables.formula_draws(spark, sf, by_age=True, bins=TOTAL_BINS).drop("series")
    current = (
        weekly.weekly_counts(_days(spark, sf, age="age", bins=TOTAL_BINS))
        .groupBy(F.col("onset_week").alias("dt_event"), "age_class")
        .agg(F.sum("n").alias("n"))
    )
    return _rounded(summary.totals_with_history(drawn, current, 15))


def window_total(spark, sf):
    return _rounded(summary.window_total(tables.formula_draws(spark, sf), series_cols=SERIES))


def _reported(spark, sf) -> DataFrame:
    return report.fill_calendar(
        curves.weekly_tally(_days(spark, sf, series=SERIES), series_cols=SERIES),
        series_cols=SERIES,
    )


def _formula_table(spark, sf) -> DataFrame:
    estimates = _formula_report(spark, sf).drop("Time")
    return report.report_table(estimates, _reported(spark, sf), series_cols=SERIES)


def report_table(spark, sf):
    return _rounded(_formula_table(spark, sf))


def situation_table(spark, sf):
    drawn = tables.formula_draws(spark, sf)
    observed = curves.weekly_tally(_days(spark, sf, series=SERIES), series_cols=SERIES)
    return _rounded(report.situation_report(drawn, observed, series_cols=SERIES, cap=True))


def rolling_average(spark, sf):
    return _rounded(report.rolling_average(_reported(spark, sf), "n", series_cols=SERIES))


def upper_limit_cap(spark, sf):
    return _rounded(summary.cap_upper_limits(_formula_report(spark, sf)))


def bridge_row(spark, sf):
    table = _formula_table(spark, sf).select("series", "dt_event", "n", "Median", "LI", "LS")
    return _rounded(report.bridge_row(table, series_cols=SERIES))


def history_splice(spark, sf):
    drawn = tables.formula_draws(spark, sf)
    return report.splice_history(drawn, _reported(spark, sf), series_cols=SERIES)


def dispersion_check(spark, sf):
    return report.dispersion_check(_formula_report(spark, sf), limit=2, series_cols=SERIES)


def zero_case_strata(spark, sf):
    """Draws of age classes without a single known case, set to 0."""
    days = _days(spark, sf, age="age", series=SERIES, bins="5 years")
    table = triangle.delay_triangle(days, series_cols=SERIES)
    zero = triangle.zero_case_strata(table, series_cols=SERIES)
    drawn = tables.formula_draws(spark, sf, by_age=True, bins="5 years")
    return draws.blank_zero_strata(drawn, zero, series_cols=SERIES)


def phase_label(spark, sf):
    table = _triangle(spark, sf, rule=WeekRule(horizon=2))
    last = table.filter(F.col("Y").isNotNull()).agg(F.max("Time").alias("last_time"))
    rows = table.groupBy("Time", "dt_event").agg(F.count("Y").alias("known"))
    return curves.phase(attach(rows, last, ()), "last_time").drop("last_time")


def _nowcast(spark, sf, age=None, **options):
    options.setdefault("bins", "10 years")
    return nowcast(tables.line_list_as_of(spark, sf), "onset", "report", age, **options)


def nowcast_total(spark, sf):
    return _rounded(_nowcast(spark, sf).total)


def nowcast_by_age(spark, sf):
    return _rounded(_nowcast(spark, sf, "age").age)


def nowcast_pruned(spark, sf):
    """The nowcast of all series, reading only what the window needs."""
    return _rounded(_nowcast(spark, sf, series_cols=SERIES, prune=True).total)


def nowcast_blank_strata(spark, sf):
    """Classes of five years, some without any known case: their draws are 0."""
    run = _nowcast(spark, sf, "age", bins="5 years", series_cols=SERIES, blank_zero_strata=True)
    return _rounded(run.age)


def nowcast_by_series(spark, sf):
    return _rounded(_nowcast(spark, sf, series_cols=SERIES).total)


def nowcast_many_series(spark, sf):
    rows = tables.line_list_by_nation(spark, sf)
    return _rounded(nowcast(rows, "onset", "report", series_cols=["nation", "series"]).total)


def delay_triangle_many_series(spark, sf):
    keys = ["nation", "series"]
    days = weekly.day_counts(
        tables.line_list_by_nation(spark, sf), "onset", "report", series_cols=keys
    )
    return triangle.delay_triangle(days, series_cols=keys)


def forecast_k(spark, sf):
    return _rounded(_nowcast(spark, sf, series_cols=SERIES, horizon=2).total)


TREND = ModelSpec(time_effect="trend")


def forecast_trend(spark, sf):
    """Three weeks ahead, which go on with each series' growth."""
    return _rounded(_nowcast(spark, sf, series_cols=SERIES, horizon=3, spec=TREND).total)


def growth_table(spark, sf):
    """Shares, levels and growth of every series."""
    return _rounded(_nowcast(spark, sf, series_cols=SERIES, horizon=3, spec=TREND).output)


ESTIMATED = ModelSpec(level_shape=None, prior_cases=None)


def nowcast_estimated_priors(spark, sf):
    """Classes of every series, with shape and shrinkage from the data."""
    return _rounded(_nowcast(spark, sf, "age", series_cols=SERIES, spec=ESTIMATED).age)


def estimated_priors(spark, sf):
    """The two numbers."""
    table = _nowcast(spark, sf, "age", series_cols=SERIES).triangle
    prior = model.estimated_prior(table, series_cols=SERIES)
    return _rounded(prior.crossJoin(model.estimated_shape(table, series_cols=SERIES)))


def nowcast_zero_inflated(spark, sf):
    """Narrow classes of every series, with weeks in which nothing can happen."""
    spec = ModelSpec(zero_inflation=True)
    return _rounded(_nowcast(spark, sf, "age", bins="5 years", series_cols=SERIES, spec=spec).age)


def zero_shares(spark, sf):
    """How many of a class's weeks are such weeks."""
    run = _nowcast(spark, sf, "age", bins="5 years", series_cols=SERIES, spec=ModelSpec(zero_inflation=True))
    return _rounded(run.fitted.groupBy(*SERIES_AGE).agg(F.max("off").alias("off")))


AS_OF_DAYS = [dt.date.fromisoformat(tables.AS_OF) - dt.timedelta(14 * i) for i in range(10)]
SETTINGS = {"level": ModelSpec(), "trend": TREND}


def _scores(spark, sf, specs=None) -> DataFrame:
    return scores.score_weeks(
        tables.line_list(spark, sf), "onset", "report", AS_OF_DAYS, series_cols=SERIES, specs=specs
    )


def score_weeks(spark, sf):
    """Scores of every week as estimated on ten days."""
    return _rounded(_scores(spark, sf))


def score_by_as_of(spark, sf):
    """Mean scores of two settings on ten days."""
    return _rounded(scores.mean_scores(_scores(spark, sf, SETTINGS)))


def score_by_age_of_week(spark, sf):
    """The same by how old the estimated week was."""
    return _rounded(scores.mean_scores(_scores(spark, sf, SETTINGS), ["setting", "back"]))


def nowcast_window_total(spark, sf):
    """Summary of the whole window."""
    run = _nowcast(spark, sf, series_cols=SERIES)
    return _rounded(summary.window_total(run.trajectories, series_cols=SERIES))


def nowcast_long_level(spark, sf):
    """Levels from nine weeks instead of three."""
    spec = ModelSpec(level_weeks=8, level_shape=2.0, draws=200)
    return _rounded(_nowcast(spark, sf, series_cols=SERIES, spec=spec).total)


def trajectories(spark, sf):
    return _nowcast(spark, sf, series_cols=SERIES).trajectories


def trajectories_by_age(spark, sf):
    return _nowcast(spark, sf, "age").trajectories


def _trajectory_checks(run, keys) -> DataFrame:
    """What must hold for any draws: every week is there, drawn 1000 times, and no draw is below
    what is already reported."""
    known = triangle.observed_from_first_unknown(run.triangle, series_cols=keys)
    both = join_on(run.trajectories, known.drop("dt_event"), [*keys, "Time"])
    return both.groupBy(*keys, "Time", "dt_event").agg(
        F.max("observed").alias("observed"),
        F.countDistinct("draw").alias("draws"),
        F.bool_and(F.col("Y") >= F.col("observed")).alias("never_below"),
    )


def trajectory_checks(spark, sf):
    return _trajectory_checks(_nowcast(spark, sf, series_cols=SERIES, horizon=2), SERIES)


def trajectory_checks_by_age(spark, sf):
    return _trajectory_checks(_nowcast(spark, sf, "age"), ["age_class"])


def fit_table(spark, sf):
    return _rounded(_nowcast(spark, sf, series_cols=SERIES).output)


def nowcast_trend(spark, sf):
    run = _nowcast(spark, sf, series_cols=SERIES)
    return _rounded(trend.trend(run.trajectories, series_cols=SERIES), 9)


def nowcast_snapshots(spark, sf):
    """From release snapshots instead of a line list."""
    table = snapshots.snapshot_triangle_full_weeks(
        readers.clean_age_counts(tables.snapshots(spark, sf, by_age=True)),
        "dt_sin_pri", 10, window=30, release=RELEASE, series_cols=["age_class"],
    )
    keys = ["group"]
    table = table.withColumnRenamed("age_class", "group")
    fitted = model.fit_delay_model(table, ModelSpec(), series_cols=keys)
    drawn = draws.trajectories(fitted, ModelSpec(), series_cols=keys)
    return _rounded(summary.weekly_summary(drawn, series_cols=keys))


def situation_table_forecast(spark, sf):
    """The report with two weeks ahead: formula draws go on after the last onset week."""
    drawn = tables.formula_draws(spark, sf)
    last = drawn.groupBy("series").agg(F.max("dt_event").alias("_last"), F.max("Time").alias("_time"))
    ahead = join_on(drawn, last, SERIES).filter(F.col("dt_event") > F.date_sub("_last", 14)).select(
        "series", "draw", (F.col("Time") + 2).alias("Time"), F.date_add("dt_event", 14).alias("dt_event"), "Y"
    )
    observed = curves.weekly_tally(_days(spark, sf, series=SERIES), series_cols=SERIES)
    return _rounded(
        report.situation_report(drawn.unionByName(ahead), observed, series_cols=SERIES, cap=True)
    )


def adaptive_dmax(spark, sf):
    drawn = situation.adaptive_draws(_days(spark, sf, series=SERIES), series_cols=SERIES)
    keys = ["series", "d_max", "consistent", "Time", "dt_event"]
    return _rounded(summary.report_summary(drawn, keys=keys))


def situation_report(spark, sf):
    return _rounded(
        situation.situation_report(_days(spark, sf, series=SERIES), series_cols=SERIES)
    )


def backtest(spark, sf):
    return _rounded(
        situation.backtest(
            tables.line_list(spark, sf), "onset", "report", tables.AS_OF, series_cols=SERIES
        )
    )


CHECKED: list[Query] = [
    weekly_line_list, weekly_line_list_epiweek, weekly_line_list_trim_k,
    age_binning_si_pni, age_binning_10y, age_binning_5y, age_binning_custom,
    delay_triangle, delay_triangle_by_age, delay_triangle_by_series, delay_triangle_epiweek,
    delay_triangle_forecast_k, delay_triangle_many_series, triangle_wide, triangle_long,
    integer_week_triangle, observed_by_week_from_tmin, latest_weeks,
    epi_curve, weekly_tally, weekly_tally_shipdate, stored_tally, daily_tally, as_of_epi_curve, truth_vs_as_of,
    latest_release, named_release_epiweek, release_by_age,
    snapshot_increments, snapshot_triangle, snapshot_triangle_from_changes, release_from_changes,
    snapshot_triangle_floor, snapshot_triangle_by_age,
    clean_age_counts, normalise_text, prepare_raw_extract,
    summary_total, summary_by_age, summary_9q, total_samples,
    trend_score, trend_score_by_age, trend_score_single_draw, rolling_trend_3w, rolling_trend_6w,
    totals_with_history, window_total,
    report_table, situation_table, rolling_average, upper_limit_cap, bridge_row, history_splice,
    dispersion_check, zero_case_strata, phase_label,
    trajectory_checks, trajectory_checks_by_age, situation_table_forecast,
    nowcast_total, nowcast_by_age, nowcast_by_series, nowcast_many_series, nowcast_pruned, nowcast_blank_strata, forecast_k,
    forecast_trend, growth_table, score_weeks, score_by_as_of, score_by_age_of_week,
    nowcast_estimated_priors, estimated_priors, nowcast_zero_inflated, zero_shares,
    nowcast_window_total, nowcast_long_level, trajectories, trajectories_by_age, nowcast_trend, fit_table,
]
#: Chains of several jobs; the tests check their properties.
CHAINED: list[Query] = [nowcast_snapshots, adaptive_dmax, situation_report, backtest]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in [*CHECKED, *CHAINED]}
