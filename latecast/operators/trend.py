"""Trend scores: is the corrected curve rising or falling?"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latecast.functions.stats import TREND_LIMITS, named, quantiles, t_half_width, trend_score
from latecast.operators.keys import beside


def trend(
    drawn: DataFrame,
    *,
    window: int = 3,
    end_week: dt.date | str | None = None,
    rolling: int = 0,
    series_cols: Sequence[str] = (),
) -> DataFrame:
    """Score 1, 0.5, 0, -0.5, -1 or NULL per series and end week (falling is negative).

    ``drawn``: (draw, dt_event, Y), one value per draw and week; sum age classes first or list
    them in ``series_cols``. A window of ``window`` weeks ends at ``end_week`` (default: the last
    week) and, with ``rolling``, at each of that many weeks before it. Each draw is divided by its
    own value at the window's first week when that is positive; a window that would start at a
    missing week starts at the first of all weeks. With several draws the limits are quantiles of
    the slopes per draw, with one draw confidence limits of its regression line.
    """
    scored = trends(drawn, {window: rolling}, end_week=end_week, series_cols=series_cols)
    return scored.drop("window")


def trends(
    drawn: DataFrame,
    windows: dict[int, int],
    *,
    end_week: dt.date | str | None = None,
    series_cols: Sequence[str] = (),
) -> DataFrame:
    """Several window lengths in one pass: ``windows`` maps a length to its ``rolling``."""
    if min(windows) < 2:
        raise ValueError("a window must be at least 2 weeks")
    last = F.max("dt_event" if end_week is None else F.lit(end_week).cast("date"))

    def windows_of(length: int, rolling: int) -> Column:
        span = 7 * (length - 1)

        def window_of(end: Column) -> Column:
            base = F.date_sub(end, span)
            known = F.array_contains("_days", base)
            start = F.when(known, base).otherwise(F.array_min("_days"))
            return F.struct(F.lit(length).alias("window"), end.alias("end"), start.alias("base"))

        ends = F.array(F.col("_end"))
        if rolling:
            ends = F.filter(
                "_days", lambda d: d.between(F.date_sub("_end", 7 * rolling), F.col("_end"))
            )
        return F.transform(ends, window_of)

    # Windows belong to a series, so they are made once per series and week, not per draw.
    calendar = drawn.groupBy(*series_cols, "dt_event").agg(
        F.collect_list(F.struct("draw", "Y")).alias("_draws")
    )
    day = F.col("dt_event")
    points = (
        beside(calendar, series_cols, _days=F.collect_set("dt_event"), _end=last)
        .withColumn("_w", F.concat(*[windows_of(n, r) for n, r in windows.items()]))
        .withColumn(
            "_w", F.explode(F.filter("_w", lambda w: day.between(w["base"], w["end"])))
        )
        .select(
            *series_cols, "dt_event",
            F.col("_w.window").alias("window"),
            F.col("_w.end").alias("end_week"),
            F.col("_w.base").alias("base_week"),
            F.explode("_draws").alias("_d"),
        )
        .select(*series_cols, "dt_event", "window", "end_week", "base_week", "_d.*")
    )
    return _score(points, [*series_cols, "window", "end_week"])


def _score(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least squares from plain sums: with whole counts they are exact, so a flat line has slope 0
    whatever the order of rows. A slope is linear in the values, so dividing the slope replaces the
    join that would divide every value by its draw's base value."""
    x, y = F.datediff("dt_event", "base_week").cast("double"), F.col("Y").cast("double")
    sums = points.filter(F.col("Y").isNotNull()).groupBy(*keys, "draw").agg(
        F.max(F.when(F.col("dt_event") == F.col("base_week"), y)).alias("base"),
        F.count(F.lit(1)).alias("k"),
        F.sum(x).alias("x"), F.sum(y).alias("y"),
        F.sum(x * x).alias("x2"), F.sum(y * y).alias("y2"), F.sum(x * y).alias("xy"),
    )
    k = F.col("k")
    lines = sums.select(
        *keys,
        F.when(F.col("base") > 0, F.col("base")).otherwise(1.0).alias("unit"),
        (k - 2).alias("freedom"),
        F.nullif(k * F.col("x2") - F.col("x") * F.col("x"), F.lit(0.0)).alias("sxx"),
        (k * F.col("y2") - F.col("y") * F.col("y")).alias("syy"),
        (k * F.col("xy") - F.col("x") * F.col("y")).alias("sxy"),
    )
    left_over = F.greatest(
        F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0)
    )
    variance = left_over / F.nullif(F.greatest("freedom", F.lit(0)), F.lit(0)) / F.col("sxx")
    lines = lines.select(
        *keys,
        (F.col("sxy") / F.col("sxx") / F.col("unit")).alias("slope"),
        (F.sqrt(variance) / F.col("unit")).alias("error"),
        "freedom",
    )
    limits = lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("draws"),
        quantiles(F.col("slope"), TREND_LIMITS).alias("q"),
        F.max("slope").alias("slope"),
        F.max("error").alias("error"),
        F.max("freedom").alias("freedom"),
    )
    wide = t_half_width(0.9, F.col("freedom")) * F.col("error")
    narrow = t_half_width(0.5, F.col("freedom")) * F.col("error")
    one_line = F.array(
        F.col("slope") - wide, F.col("slope") - narrow, F.col("slope") + narrow,
        F.col("slope") + wide,
    )
    chosen = limits.select(
        *keys, "draws", F.when(F.col("draws") == 1, one_line).otherwise(F.col("q")).alias("q")
    )
    return chosen.select(*keys, "draws", *named(F.col("q"), TREND_LIMITS)).withColumn(
        "score", trend_score(F.col("LI"), F.col("Q1"), F.col("Q3"), F.col("LS"))
    )
