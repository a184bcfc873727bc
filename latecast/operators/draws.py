"""Predictive draws of what is not reported yet: column expressions on normal scores made from digests.

The number of events still to be reported is negative binomial. Its distribution is laid out on steps of
a sixteenth of its standard deviation (single counts while that is below 32) from 10 standard deviations
below the mean to 20 above; a draw is the count at which the running sum passes its uniform.

One draw is one state of the world for all weeks and classes of a series. Its score in a week is a sum of
independent normal scores, weighted by their shares in the variance: one of the series, for the hazards
that all weeks use; a moving sum of weekly ones, for levels that come from the same reports; and one of
its own. The uniform is the normal distribution function of that score, so each week keeps its own limits.
Uniforms below ``zero_chance`` are draws in which nothing more comes; the others are spread over the rest.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latecast.operators.keys import beside, join_on
from latecast.operators.model import ModelSpec

STEPS_PER_SD, BELOW, ABOVE, EXTRA = 16, 10, 20, 20
DIGITS = 13  # hexadecimal digits of a digest that make a uniform: 52 bits
GUIDE = 64


def log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back by the recurrence; for positive x."""
    z = x + 8
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - F.log(product)


def _text(spec: ModelSpec, *parts: Column) -> Column:
    return F.concat_ws("|", F.lit(str(spec.seed)), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])


def _score(digest: Column) -> Column:
    """A standard normal number (Box and Muller's) from the halves of a digest: the same wherever it is computed."""
    size = float(16**DIGITS)
    half = lambda at: F.conv(F.substring(digest, at, DIGITS), 16, 10).cast("double")
    return F.sqrt(-2 * F.log((half(1) + 1) / size)) * F.cos(half(1 + DIGITS) / size * (2 * math.pi))


def normal_cdf(z: Column) -> Column:
    """The normal distribution function, to 1e-7."""
    # The usual rational approximation.
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = tail * 0.3989422804014327 * F.exp(-z * z / 2)
    return F.when(z < 0, tail).otherwise(1 - tail)


def _scores(spec: ModelSpec, series: list[Column], stratum: list[Column]) -> Column:
    """The scores of all draws of a row, with Time, ahead, level_part and delay_part."""
    draws = F.sequence(F.lit(1), F.lit(spec.draws))
    time, n = F.col("Time"), F.col("ahead") + (spec.level_weeks + 1)

    def drawn(*parts: Column) -> Column:
        return F.transform(F.transform(draws, lambda d: F.md5(_text(spec, *parts, d).cast("binary"))), _score)

    def moving(keys: list[Column]) -> Column:
        weeks = lambda d: F.transform(
            F.sequence(time - n + 1, time), lambda w: F.md5(_text(spec, F.lit("level"), *keys, w, d).cast("binary"))
        )
        total = lambda d: F.aggregate(weeks(d), F.lit(0.0), lambda s, x: s + _score(x))
        return F.transform(draws, lambda d: total(d) / F.sqrt(n))

    own, delays, levels = drawn(*stratum, time), drawn(F.lit("delay"), *series), moving(stratum)
    if len(stratum) > len(series) and spec.class_share:
        mine = math.sqrt(1 - spec.class_share)
        levels = F.zip_with(levels, moving(series), lambda a, b: a * mine + b * math.sqrt(spec.class_share))
    by_level, by_delay = F.sqrt("level_part"), F.sqrt("delay_part")
    alone = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("level_part") - F.col("delay_part")))
    shared = F.zip_with(levels, delays, lambda a, b: a * by_level + b * by_delay)
    return F.zip_with(own, shared, lambda a, b: a * alone + b)


def _distribution(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with ``low``, ``step`` and ``sums``, the running sums of the chances of the steps."""
    mean, shape = F.col("remaining"), F.col("shape")
    sd = F.sqrt(mean + mean * mean / shape)
    step = F.greatest(F.lit(1.0), F.floor(sd / STEPS_PER_SD).cast("double"))
    low = F.greatest(F.lit(0.0), F.floor(mean - BELOW * sd).cast("double"))
    count = F.ceil((mean + ABOVE * sd - F.col("low")) / F.col("step")) + EXTRA
    steps = rows.withColumns({"step": step, "low": low}).withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    )
    at = F.col("low") + F.col("i") * F.col("step") + (F.col("step") - 1) / 2
    chance = F.exp(
        log_gamma(at + shape) - log_gamma(shape) - log_gamma(at + 1)
        + shape * F.log(shape / (shape + mean)) + at * F.log(mean / (shape + mean))
    ) * F.col("step")
    order = Window.partitionBy(*keys, "Time").orderBy("i")
    sums = steps.withColumn("sum", F.sum(chance).over(order))
    return sums.groupBy(*keys, "Time").agg(
        F.first("low").alias("low"), F.first("step").alias("step"),
        F.sort_array(F.collect_list("sum")).alias("sums"),
    )


def trajectories(
    fitted: DataFrame, spec: ModelSpec = ModelSpec(), *, series_cols: Sequence[str] = (), by_age: bool = False
) -> DataFrame:
    """Completed weekly counts per draw: (series, draw, Time, dt_event[, age_class], Y).

    Starts at a series' first unfinished week. A draw is never below what is reported.
    """
    keys = [*series_cols, *(["age_class"] if "age_class" in fitted.columns else [])]
    start = F.min(F.when(F.col("unfinished"), F.col("Time")))
    rows = beside(fitted, keys, _start=start).filter(F.col("Time") >= F.col("_start")).drop("_start")
    open_ = rows.filter((F.col("remaining") > 0) & F.col("unfinished"))
    laid = _distribution(open_.select(*keys, "Time", "remaining", "shape"), keys)
    for name, value in (("ahead", 0), ("level_part", 0.0), ("delay_part", 0.0), ("zero_chance", 0.0)):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value))
    both = join_on(rows, laid, [*keys, "Time"], "left")
    named = [F.col(k) for k in keys]
    drawn = both.withColumn("u", F.transform(
        F.when(F.col("sums").isNull(), F.array_repeat(F.lit(0.0), spec.draws)).otherwise(
            _scores(spec, named[:len(series_cols)], named)),
        lambda z: (normal_cdf(z) - F.col("zero_chance")) / (1 - F.col("zero_chance")) * F.element_at("sums", -1),
    ))
    # Where a guide of equal steps of the running sums says to begin, so that a draw looks at few of them.
    guide = F.transform(F.sequence(F.lit(0), F.lit(GUIDE)), lambda k: F.size(
        F.filter("sums", lambda s: s < F.element_at("sums", -1) * k / GUIDE)
    ))
    drawn = drawn.withColumn("guide", guide)
    step_of = lambda u: F.greatest(F.lit(0), F.least(
        F.floor(u / F.element_at("sums", -1) * GUIDE).cast("int"), F.lit(GUIDE - 1)
    ))
    first = lambda u: F.greatest(F.get("guide", step_of(u)) - 1, F.lit(0))
    last = lambda u: F.get("guide", step_of(u) + 1) + 1
    place = lambda u: first(u) + F.size(F.filter(
        F.slice("sums", first(u) + 1, last(u) - first(u)), lambda s: s <= u
    ))
    drawn = drawn.withColumn("place", F.transform("u", place))
    before = lambda p: F.when(p == 0, 0.0).otherwise(F.get("sums", p - 1))
    part = lambda u, p: (u - before(p)) / (F.get("sums", p) - before(p))
    more = F.zip_with("u", "place", lambda u, p: F.when(u < 0, F.lit(0).cast("long")).otherwise((
        F.col("low") + p * F.col("step") + F.floor(part(u, p) * F.col("step"))
    ).cast("long")))
    counts = drawn.select(
        *keys, "Time", "dt_event", "observed",
        F.posexplode(F.when(F.col("sums").isNull(), F.array_repeat(F.lit(0).cast("long"), spec.draws)).otherwise(more))
        .alias("at", "more"),
    ).withColumns({"draw": F.col("at") + 1, "Y": F.col("observed") + F.col("more")})
    age = ["age_class"] if by_age else []
    columns = [*series_cols, "draw", "Time", "dt_event", *age]
    if len(keys) > len(series_cols) and not by_age:
        return counts.groupBy(*columns).agg(F.sum("Y").alias("Y"))
    return counts.select(*columns, "Y")


def blank_zero_strata(
    drawn: DataFrame, zero_strata: DataFrame, *, series_cols: Sequence[str] = ()
) -> DataFrame:
    """Sets draws of the listed age classes to 0: nothing was ever seen there."""
    marked = join_on(
        drawn, zero_strata.withColumn("_zero", F.lit(True)), [*series_cols, "age_class"], "left"
    )
    return marked.withColumn("Y", F.when(F.col("_zero"), F.lit(0)).otherwise(F.col("Y"))).drop(
        "_zero"
    )
