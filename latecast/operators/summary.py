"""Summaries of trajectories: quantiles per week, totals, caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latecast.functions.stats import LIMITS, REPORT_LIMITS, half_even, named, quantiles
from latecast.functions.strata import total_label
from latecast.operators.keys import beside, join_on


def weekly_summary(
    drawn: DataFrame, *, series_cols: Sequence[str] = (), by: Sequence[str] = ()
) -> DataFrame:
    """Median, 95 % and 50 % limits per week over draws that are already one value per week."""
    keys = [*series_cols, "Time", "dt_event", *by]
    limits = drawn.groupBy(*keys).agg(quantiles(F.col("Y"), LIMITS).alias("q"))
    return limits.select(*keys, *named(F.col("q"), LIMITS))


def total_samples(drawn: DataFrame, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """One value per (week, draw): age classes added up."""
    return drawn.groupBy(*series_cols, "Time", "dt_event", "draw").agg(
        F.coalesce(F.sum("Y"), F.lit(0)).alias("Y")
    )


def total_summary(drawn: DataFrame, *, series_cols: Sequence[str] = ()) -> DataFrame:
    return weekly_summary(total_samples(drawn, series_cols=series_cols), series_cols=series_cols)


def report_summary(
    samples: DataFrame, *, keys: Sequence[str], value: str = "Y"
) -> DataFrame:
    """Nine quantiles per key, rounded half to even; a missing median counts as 0."""
    limits = samples.groupBy(*keys).agg(quantiles(F.col(value), REPORT_LIMITS).alias("q"))
    rounded = [
        half_even(c).alias(name)
        for c, name in zip(named(F.col("q"), REPORT_LIMITS), REPORT_LIMITS)
    ]
    return limits.select(*keys, *rounded).fillna(0, ["Median"])


def cap_upper_limits(report: DataFrame, *, above: float = 30, times_median: float = 3) -> DataFrame:
    """Upper limits over ``above`` are held to a multiple of the median."""

    def capped(name: str) -> Column:
        limit = F.col(name)
        return F.when(limit > above, F.least(times_median * F.col("Median"), limit)).otherwise(limit)

    return report.withColumns({"LS": capped("LS"), "IC90S": capped("IC90S")})


def window_total(drawn: DataFrame, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """Limits of the sum over all weeks of a draw."""
    wanted = {k: LIMITS[k] for k in ("Median", "LI", "LS")}
    per_draw = drawn.groupBy(*series_cols, "draw").agg(F.sum("Y").alias("Total"))
    limits = per_draw.groupBy(*series_cols).agg(quantiles(F.col("Total"), wanted).alias("q"))
    return limits.select(*series_cols, *named(F.col("q"), wanted))


def totals_with_history(
    drawn: DataFrame, current: DataFrame, d_max: int, *, series_cols: Sequence[str] = ()
) -> DataFrame:
    """Mean and 95 % limits of all cases ever, in total (class 99) and per age class.

    ``current`` holds known counts (dt_event, age_class, n); its weeks up to ``d_max`` weeks before
    the last one are settled and added to the drawn weeks.
    """
    settled = (
        beside(current, series_cols, _last=F.max("dt_event"))
        .filter(F.col("dt_event") <= F.date_sub("_last", 7 * d_max))
        .drop("_last")
    )
    history = _per_class_and_total(settled, [*series_cols], F.sum("n").alias("n"))
    per_draw = _per_class_and_total(drawn, [*series_cols, "draw"], F.sum("Y").alias("Y"))
    limits = per_draw.groupBy(*series_cols, "age_class").agg(
        F.avg("Y").alias("mean"), quantiles(F.col("Y"), {"LI": 0.025, "LS": 0.975}).alias("q")
    )
    n = F.coalesce(F.col("n"), F.lit(0))
    return join_on(limits, history, [*series_cols, "age_class"], "left").select(
        *series_cols,
        "age_class",
        total_label(F.col("age_class")).alias("fx_etaria"),
        (F.col("mean") + n).alias("Mean"),
        (F.col("q")[0] + n).alias("LI"),
        (F.col("q")[1] + n).alias("LS"),
    )


def _per_class_and_total(df: DataFrame, keys: list[str], measure: Column) -> DataFrame:
    """Aggregate per age class and, as class 99, over all of them in the same pass."""
    columns = [F.col(k) for k in keys]
    sets = [[*columns, F.col("age_class")], columns]
    grouped = df.groupingSets(sets, *columns, F.col("age_class")).agg(
        measure, F.grouping(F.col("age_class")).alias("_all")
    )
    return grouped.withColumn(
        "age_class", F.when(F.col("_all") == 1, 99).otherwise(F.col("age_class"))
    ).drop("_all")
