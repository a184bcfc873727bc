"""Level, reporting shares and spread of every series, from sums over its delay triangle.

Everything is an aggregate or a window over the triangle's cells, whose number depends on window, delays
and classes and never on the size of the line list. A stratum is a series, or an age class of one.

* Share of a delay: the hazard of being reported at delay d, given that it is by then, is the sum of the
  known cells at d over the sum of what was known by d in the same weeks. An age class's hazard is pulled
  to that of all classes of its series, as if it had seen ``prior_cases`` more cases.
* Level of a week: counts over shares of the week and the ``level_weeks`` before it (and a tenth of a week
  with half a case per week) are the prior mean, with a gamma shape of ``level_shape``; the week's own
  reports then move it, the more the larger its reported share is. Weeks ahead keep the last prior mean,
  and their shape falls by one part for each week.
  With ``time_effect="trend"`` a week's level also follows the growth of the weeks before it: the slope of a
  line through the logarithms of counts over shares, older weeks discounted by ``discount`` a week, pulled to
  no growth as if that were known to ``SLOPE_SD``. Earlier weeks are brought forward by it, weeks ahead
  go on with it, less by ``damping`` each week, and its variance adds to theirs.
* With ``zero_inflation`` a stratum has weeks in which nothing can happen. Their share is found by
  expectation-maximisation over its weeks without a case: each is such a week the more likely, the less
  its level explains a zero. Levels are those of the other weeks then, and ``zero_chance`` is the chance
  that a week without a case so far stays without.
* Spread: the excess of squared residuals over the Poisson's, as a share of the squared mean.
* With ``level_shape=None`` or ``prior_cases=None`` these two come from the data, by moments over all series and
  classes: how far settled weeks lie from the mean of the weeks before them, beyond Poisson noise, and how
  far the hazards of classes lie from those of their series, beyond binomial noise.
* What several weeks share: the hazards are the same for all of them, and the levels of neighbouring weeks come
  from the same reports. ``level_part`` and ``delay_part`` are the shares of these two in the variance of what
  is missing; draws use them to move together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latecast.operators.keys import attach, join_on

PSEUDO_WEEKS, PSEUDO_CASES = 0.1, 0.05
TIME_EFFECTS = ("level", "trend")
EM_ROUNDS, MOST_ZEROS = 40, 0.95
SHAPES = (0.5, 500.0)  # estimates stay between these two
PRIORS = (1.0, 1000.0)
SLOPE_SD = 0.15  # of a week's growth, beforehand
WEEK_CASES = 20.0  # a week says no more about growth than so many cases


@dataclass(frozen=True)
class ModelSpec:
    """Options of the estimate; see the module's text. ``class_share`` is how much of the error of their
    levels the age classes of a series have in common."""

    level_weeks: int = 2
    level_shape: float | None = 5.0
    prior_cases: float | None = 10.0
    class_share: float = 0.5
    time_effect: str = "level"
    zero_inflation: bool = False
    discount: float = 0.8
    damping: float = 0.9
    draws: int = 1000
    seed: int = 1

    def __post_init__(self) -> None:
        if self.level_weeks < 0:
            raise ValueError("level_weeks must be 0 or more")
        if any(x is not None and not x > 0 for x in (self.level_shape, self.prior_cases)):
            raise ValueError("level_shape and prior_cases must be positive, or None to be estimated")
        if self.time_effect not in TIME_EFFECTS:
            raise ValueError(f"time_effect must be one of {', '.join(TIME_EFFECTS)}")
        if not (0 < self.discount < 1 and 0 < self.damping < 1):
            raise ValueError("discount and damping must be between 0 and 1")
        if not 0 <= self.class_share <= 1:
            raise ValueError("class_share must be between 0 and 1")
        if self.draws < 1:
            raise ValueError("draws must be positive")


def _strata(triangle: DataFrame, series_cols: Sequence[str]) -> list[str]:
    return [*series_cols, *(["age_class"] if "age_class" in triangle.columns else [])]


def _seen(triangle: DataFrame, series_cols: Sequence[str]) -> DataFrame:
    """(stratum, delay): cases at the delay (num) and by it (den), of the stratum and of its series (_num, _den)."""
    keys = _strata(triangle, series_cols)
    so_far = Window.partitionBy(*keys, "Time").orderBy("delay")
    cells = triangle.withColumn("_by", F.when(F.col("Y").isNotNull(), F.sum("Y").over(so_far)))
    own = cells.groupBy(*keys, "delay").agg(
        F.coalesce(F.sum("Y"), F.lit(0)).alias("num"), F.coalesce(F.sum("_by"), F.lit(0)).alias("den")
    )
    together = Window.partitionBy(*series_cols, "delay")
    return own.withColumns({"_num": F.sum("num").over(together), "_den": F.sum("den").over(together)})


def _between(value: Column, limits: tuple[float, float]) -> Column:
    return F.greatest(F.lit(limits[0]), F.least(F.lit(limits[1]), value))


def estimated_prior(triangle: DataFrame, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """One row, prior_cases: what makes the classes' hazards scatter about their series' as they do.

    Beta-binomial moments: of n cases a squared deviation is expected to be n h (1 - h) (1 + (n - 1) / (c + 1)).
    Without classes that differ, or without cases, it is the upper limit.
    """
    cells = _seen(triangle, series_cols).where("delay > 0 and den > 1 and _num > 0 and _num < _den")
    pooled = F.col("_num") / F.col("_den")
    binomial = pooled * (1 - pooled)
    off = F.col("num") / F.col("den") - pooled
    sums = cells.agg(
        F.sum(F.col("den") * off * off).alias("a"), F.sum(binomial).alias("b"),
        F.sum(binomial * (F.col("den") - 1)).alias("c"),
    )
    rho = (F.col("a") - F.col("b")) / F.col("c")
    return sums.select(
        F.when(rho > 0, _between(1 / rho - 1, PRIORS)).otherwise(PRIORS[1]).alias("prior_cases")
    )


def estimated_shape(
    triangle: DataFrame, spec: ModelSpec = ModelSpec(), *, series_cols: Sequence[str] = ()
) -> DataFrame:
    """One row, level_shape: how settled weeks scatter about the mean of the ``level_weeks`` + 1 before them.

    The squared deviation is expected to be m + m / weeks + m^2 / shape. Weeks count if they and those
    before them are known to the last delay. Without such weeks, or excess, it is the upper limit.
    """
    keys = _strata(triangle, series_cols)
    weekly = triangle.groupBy(*keys, "Time").agg(
        F.coalesce(F.sum("Y"), F.lit(0)).alias("y"), F.max(F.col("Y").isNull()).alias("open")
    )
    n = spec.level_weeks + 1
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("Time").rowsBetween(-n, -1)
    weekly = weekly.withColumns({"m": F.avg("y").over(before), "_n": F.count(F.lit(1)).over(before)})
    settled = weekly.where(~F.col("open") & (F.col("_n") == n))
    m = F.col("m")
    sums = settled.agg(
        F.sum((F.col("y") - m) * (F.col("y") - m) - m - m / n).alias("a"), F.sum(m * m).alias("b")
    )
    return sums.select(F.when(
        F.col("a") > 0, _between(F.col("b") / F.col("a"), SHAPES)
    ).otherwise(SHAPES[1]).alias("level_shape"))


def delay_hazards(
    triangle: DataFrame, spec: ModelSpec = ModelSpec(), *, series_cols: Sequence[str] = ()
) -> DataFrame:
    """(stratum, delay, hazard, seen): the chance of being reported at a delay, given not later, and the
    cases that say so."""
    keys = _strata(triangle, series_cols)
    prior = F.lit(spec.prior_cases)
    if spec.prior_cases is None:
        prior = estimated_prior(triangle, series_cols=series_cols).scalar()
    pooled = _seen(triangle, series_cols).withColumn("prior", prior)
    all_classes = F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")).otherwise(0.0)
    hazard = (F.col("num") + F.col("prior") * all_classes) / (F.col("den") + F.col("prior"))
    return pooled.select(*keys, "delay", hazard.alias("hazard"), (F.col("den") + F.col("prior")).alias("seen"))


def _shares(hazards: DataFrame, keys: list[str]) -> DataFrame:
    """Per stratum, as arrays by delay: ``by`` (share reported by it), ``at`` (at it), and ``loose``, the variance
    of the logarithm of ``by``, from the binomial variances of the hazards after it."""
    listed = hazards.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("delay", "hazard", "seen"))).alias("h")
    )
    size = F.size("h")
    by = F.transform(
        "h",
        lambda _, d: F.aggregate(
            F.slice("h", d + 2, size - d - 1), F.lit(1.0), lambda product, h: product * (1 - h["hazard"])
        ),
    )
    odds = lambda h: F.when(h["hazard"] < 1, h["hazard"] / (1 - h["hazard"]) / h["seen"]).otherwise(0.0)
    loose = F.transform(
        "h",
        lambda _, d: F.aggregate(F.slice("h", d + 2, size - d - 1), F.lit(0.0), lambda total, h: total + odds(h)),
    )
    shares = listed.select(*keys, by.alias("by"), loose.alias("loose"))
    at = F.transform("by", lambda x, d: F.when(d == 0, x).otherwise(x - F.get("by", d - 1)))
    return shares.select(*keys, "by", at.alias("at"), "loose")


def _square_sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda total, x: total + x * x)


def growth(
    weekly: DataFrame, spec: ModelSpec = ModelSpec(), *, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, Time, slope, slope_var): a stratum's growth a week as far as each week knows.

    ``weekly`` has Time, observed and share. One pass over a stratum's sorted weeks carries five discounted
    sums; ages of weeks count from the current one, so they shift by one at each step.
    """
    sums = [f"s{i}" for i in range(5)]  # weights; times age; times squared age; values; values times age
    state = F.struct(
        *[F.lit(0.0).alias(n) for n in sums],
        F.array().cast("array<struct<Time:int,slope:double,slope_var:double>>").alias("out"),
    )
    kappa = 1 / SLOPE_SD**2

    def step(s: Column, week: Column) -> Column:
        seen = week["observed"] + week["share"]
        w = F.when(week["share"] > 0, seen / (1 + seen / WEEK_CASES)).otherwise(0.0)
        x = F.when(week["share"] > 0, F.log(week["observed"] / week["share"] + 0.5)).otherwise(0.0)
        d = spec.discount
        s0, s1 = s["s0"] * d + w, (s["s1"] - s["s0"]) * d
        s2 = (s["s2"] - 2 * s["s1"] + s["s0"]) * d
        x0, x1 = s["s3"] * d + w * x, (s["s4"] - s["s3"]) * d
        det = s0 * (s2 + kappa) - s1 * s1
        found = F.struct(
            week["Time"].alias("Time"),
            F.when(s0 > 0, (s0 * x1 - s1 * x0) / det).otherwise(0.0).alias("slope"),
            F.when(s0 > 0, s0 / det).otherwise(1 / kappa).alias("slope_var"),
        )
        return F.struct(
            *[v.alias(n) for n, v in zip(sums, (s0, s1, s2, x0, x1))], F.array_append(s["out"], found).alias("out")
        )

    weeks = F.sort_array(F.collect_list(F.struct(F.col("Time").cast("int").alias("Time"), "observed", "share")))
    listed = weekly.groupBy(*keys).agg(weeks.alias("weeks"))
    return listed.select(*keys, F.inline(F.aggregate("weeks", state, step, lambda s: s["out"])))


def zero_share(weekly: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, off): the share of a stratum's weeks in which nothing can happen.

    ``weekly`` has observed, share, prior (the level, such weeks included) and _k (its shape). A week that can have
    cases has none so far with chance (k / (k + share x level)) ^ k.
    """
    seen = F.col("share") > 0
    zeros = F.sort_array(F.collect_list(F.when(
        seen & (F.col("observed") == 0), F.struct((F.col("prior") * F.col("share")).alias("m"), F.col("_k").alias("k"))
    )))
    listed = weekly.groupBy(*keys).agg(F.count(F.when(seen, 1)).alias("n"), zeros.alias("zeros"))
    chance = lambda off, z: off / (
        off + (1 - off) * F.pow(z["k"] / (z["k"] + z["m"] / (1 - off)), z["k"]))
    step = lambda off: F.least(F.lit(MOST_ZEROS), F.aggregate(
        "zeros", F.lit(0.0), lambda total, z: total + chance(off, z)) / F.col("n"))
    rounds = F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), F.lit(0.5), lambda off, _: step(off))
    return listed.select(*keys, F.when(F.size("zeros") > 0, rounds).otherwise(0.0).alias("off"))


def fit_delay_model(
    triangle: DataFrame, spec: ModelSpec = ModelSpec(), *, series_cols: Sequence[str] = ()
) -> DataFrame:
    """One row per stratum and week: Time, dt_event, unfinished, observed, level, remaining, shape, ahead,
    level_part, delay_part, slope, zero_chance, off.

    ``level`` is the expected final count, ``remaining`` the expected number of events not reported yet;
    their number is negative binomial with that mean and ``shape``. The parts are shares of its variance.
    ``ahead`` counts weeks after the last one with reports; ``slope`` is the growth a week, 0 without trend;
    ``off`` is the stratum's share of weeks in which nothing can happen, 0 without zero inflation.
    """
    keys = _strata(triangle, series_cols)
    shares = _shares(delay_hazards(triangle, spec, series_cols=series_cols), keys)
    weekly = triangle.groupBy(*keys, "Time", "dt_event").agg(
        F.coalesce(F.sum("Y"), F.lit(0)).alias("observed"),
        F.max(F.when(F.col("Y").isNotNull(), F.col("delay"))).alias("known"),
        F.max(F.col("Y").isNull()).alias("unfinished"),
        F.array_agg(F.when(F.col("Y").isNotNull(), F.struct("delay", "Y"))).alias("cells"),
    )
    rows = attach(weekly, shares, keys)
    share = F.when(F.col("known").isNull(), 0.0).otherwise(F.get("by", F.col("known")))
    past = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("Time")
    near = past.rowsBetween(-spec.level_weeks, 0)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    known = F.col("known").isNotNull()
    rows = rows.withColumn("share", share).withColumn("ahead", F.greatest(
        F.lit(0), F.col("Time") - F.max(F.when(known, F.col("Time"))).over(whole)
    ))
    if spec.time_effect == "trend":
        rows = join_on(rows, growth(rows, spec, keys=keys), [*keys, "Time"])
        rows = rows.withColumns({
            c: F.last(F.when(known, F.col(c)), ignorenulls=True).over(past) for c in ("slope", "slope_var")
        })
        on = F.lit(spec.damping) * (1 - F.pow(F.lit(spec.damping), F.col("ahead"))) / (1 - spec.damping)
        back = lambda c, j: F.lag(c, j, 0).over(past)
        lags = range(spec.level_weeks + 1)
        cases = sum((back("observed", j) for j in lags[1:]), F.col("observed"))
        shares_ = sum((back("share", j) * F.exp(F.col("slope") * -j) for j in lags[1:]), F.col("share"))
        mean = (cases + PSEUDO_CASES) / (shares_ + PSEUDO_WEEKS)
    else:
        on, rows = F.lit(0.0), rows.withColumns({"slope": F.lit(0.0), "slope_var": F.lit(0.0)})
        mean = (F.sum("observed").over(near) + PSEUDO_CASES) / (F.sum("share").over(near) + PSEUDO_WEEKS)
    rows = rows.withColumn("on", on).withColumn("mean", F.when(known, mean)).withColumn(
        "prior", F.last("mean", ignorenulls=True).over(past) * F.exp(F.col("slope") * F.col("on"))
    )
    shape = F.lit(spec.level_shape)
    if spec.level_shape is None:
        shape = estimated_shape(triangle, spec, series_cols=series_cols).scalar()
    rows, k = rows.withColumn("_k", shape), F.col("_k")
    rows = attach(rows, zero_share(rows, keys=keys), keys) if spec.zero_inflation else rows.withColumn("off", F.lit(0.0))
    rows = rows.withColumn("prior", F.col("prior") / (1 - F.col("off")))
    stays = F.pow(k / (k + F.col("share") * F.col("prior")), k)
    rows = rows.withColumn("zero_chance", F.when(
        (F.col("observed") == 0) & (F.col("off") > 0), F.col("off") / (F.col("off") + (1 - F.col("off")) * stays)
    ).otherwise(0.0))
    # Spread: residuals of the known cells about the week's own count dealt out by the shares.
    expected = lambda c: F.when(
        F.col("share") > 0, F.col("observed") * F.get("at", c["delay"]) / F.col("share")
    ).otherwise(0.0)
    excess = F.aggregate(
        "cells", F.lit(0.0), lambda s, c: s + (c["Y"] - expected(c)) * (c["Y"] - expected(c)) - expected(c)
    )
    square = F.aggregate("cells", F.lit(0.0), lambda s, c: s + expected(c) * expected(c))
    rows = rows.withColumns({"_excess": excess, "_square": square})
    total, squares = F.sum("_excess").over(whole), F.sum("_square").over(whole)
    spread = F.when(squares > 0, F.greatest(F.lit(0.0), total / squares)).otherwise(0.0)
    count = F.coalesce(F.col("known") + 1, F.lit(0))
    rows = rows.withColumns({
        "spread": spread,
        "_seen": F.when(F.col("share") > 0, _square_sum(F.slice("at", 1, count)) / F.col("share") / F.col("share")).otherwise(0.0),
        "_left": F.when(
            F.col("share") < 1,
            _square_sum(F.slice("at", count + 1, F.size("at") - count)) / (1 - F.col("share")) / (1 - F.col("share")),
        ).otherwise(0.0),
        "_loose": F.when(
            (F.col("share") > 0) & (F.col("share") < 1),
            F.get("loose", F.col("known")) / (1 - F.col("share")) / (1 - F.col("share")),
        ).otherwise(0.0),
    })
    prior, own = F.col("prior"), F.col("share") * F.col("prior")
    weight = own / (1 + F.col("spread") * own * F.col("_seen"))
    level = F.when(F.col("share") > 0, (k * prior + weight * F.col("observed") / F.col("share")) / (k + weight)).otherwise(prior)
    certain = F.col("observed") / (1 + F.col("spread") * F.col("observed") * F.col("_seen"))
    of_level = 1 / (k / (1 + F.col("ahead")) + certain) + F.col("on") * F.col("on") * F.col("slope_var")
    rows = rows.withColumns({"level": level, "_level": of_level}).withColumns({
        "remaining": F.col("level") * (1 - F.col("share")),
        "shape": 1 / (F.col("_level") + F.col("spread") * F.col("_left") + F.col("_loose")),
    })
    variance = 1 / F.col("shape") + 1 / F.col("remaining")
    part = lambda c: F.when(F.col("remaining") > 0, F.col(c) / variance).otherwise(0.0)
    return rows.select(
        *keys, "Time", "dt_event", "unfinished", "observed", "level", "remaining", "shape", "ahead",
        part("_level").alias("level_part"), part("_loose").alias("delay_part"), "slope", "zero_chance", "off",
    )


def fit_table(
    triangle: DataFrame, spec: ModelSpec = ModelSpec(), *, series_cols: Sequence[str] = ()
) -> DataFrame:
    """The estimates in long form (stratum, term, index, value): share by delay, level by week, and with a
    trend the growth by week."""
    keys = _strata(triangle, series_cols)
    shares = _shares(delay_hazards(triangle, spec, series_cols=series_cols), keys).select(
        *keys, F.lit("delay").alias("term"), F.posexplode("at").alias("index", "value")
    )
    fitted = fit_delay_model(triangle, spec, series_cols=series_cols)
    terms = {"time": "level"} | ({"slope": "slope"} if spec.time_effect == "trend" else {})
    listed = F.explode(F.array(*[
        F.struct(F.lit(term).alias("term"), F.col(c).alias("value")) for term, c in terms.items()
    ])).alias("t")
    levels = fitted.select(*keys, "Time", listed).select(*keys, "t.term", F.col("Time").alias("index"), "t.value")
    return shares.unionByName(levels)
