import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latecast.operators import draws, model, summary, triangle
from latecast.operators.model import ModelSpec

WEEKS, DELAYS, START = 25, 8, dt.date(2020, 1, 2)


def _complete(rng, level=3.0, size=8.0, keep=1.0):
    """All counts of one series, as (week, delay), from known parameters."""
    wave = np.cumsum(rng.normal(0, 0.15, WEEKS))
    by_delay = -0.45 * np.arange(DELAYS) + rng.normal(0, 0.1, DELAYS)
    mean = np.exp(level + wave[:, None] - wave.mean() + by_delay[None, :])
    return rng.poisson(rng.gamma(size, mean / size)) * (rng.random(mean.shape) < keep)


def _rows(y, horizon=0, **more):
    """Triangle rows with the unknown cells set to NULL."""
    out = []
    for t in range(1, WEEKS + horizon + 1):
        for d in range(DELAYS):
            known = t + d <= WEEKS
            out.append({
                **more, "dt_event": START + dt.timedelta(7 * (t - 1)), "Time": t, "delay": d,
                "Y": int(y[t - 1, d]) if known else None,
            })
    return out


def _frame(spark, rows):
    schema = "dt_event date, Time int, delay int, Y long"
    if "age_class" in rows[0]:
        schema = "age_class int, " + schema
    if "series" in rows[0]:
        schema = "series string, " + schema
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def test_log_gamma(spark):
    x = [1e-3, 0.4, 1.0, 2.5, 7.99, 8.0, 31.2, 1e4, 3e9]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select(draws.log_gamma(F.col("x")))
    assert [r[0] for r in rows.collect()] == pytest.approx([math.lgamma(v) for v in x], rel=1e-9, abs=1e-7)


@pytest.mark.parametrize("mean,shape", [(0.02, 4.0), (0.7, 0.6), (12.0, 3.0), (900.0, 40.0), (2e6, 5e3)])
def test_draws_follow_their_distribution(spark, mean, shape):
    """Quantiles of many draws against sums of the exact chances (or the normal law, where sd is large)."""
    fitted = spark.createDataFrame(
        [(1, START, True, 0, mean, mean, shape)],
        "Time int, dt_event date, unfinished boolean, observed long, level double, remaining double, shape double",
    )
    got = np.sort([r["Y"] for r in draws.trajectories(fitted, ModelSpec(draws=20000)).collect()])
    sd = math.sqrt(mean + mean * mean / shape)
    assert abs(got.mean() - mean) < 5 * sd / math.sqrt(20000)
    assert 0.9 < (got.std() + 1e-9) / sd < 1.1
    if mean < 1e4:
        k = np.arange(int(mean + 25 * sd) + 10)
        logs = np.array([math.lgamma(i + shape) - math.lgamma(shape) - math.lgamma(i + 1) for i in k])
        chance = np.exp(logs + shape * math.log(shape / (shape + mean)) + k * math.log(mean / (shape + mean)))
        share = np.searchsorted(got, k, side="right") / len(got)
        assert np.abs(share - np.cumsum(chance)).max() < 0.02


@pytest.fixture(scope="module")
def simulated(spark):
    rng = np.random.default_rng(11)
    truth, rows = {}, []
    for i in range(60):
        name = f"s{i}" if i else None
        y = _complete(rng, level=rng.uniform(1.5, 5))
        truth[name] = y.sum(axis=1)
        rows += _rows(y, series=name)
    return _frame(spark, rows).persist(), truth


@pytest.fixture(scope="module")
def drawn(simulated):
    table, _ = simulated
    fitted = model.fit_delay_model(table, series_cols=["series"])
    return draws.trajectories(fitted, series_cols=["series"]).persist()


def test_coverage(simulated, drawn):
    _, truth = simulated
    limits = summary.weekly_summary(drawn, series_cols=["series"]).toPandas()
    limits["truth"] = [
        truth[None if pd.isna(s) else s][t - 1] for s, t in zip(limits["series"], limits["Time"])
    ]
    assert len(limits) == 60 * (DELAYS - 1)
    # The last weeks are the uncertain ones; earlier ones are whole numbers close to certain.
    late = limits[limits["Time"] > WEEKS - 4]
    inside = late["truth"].between(late["LI"], late["LS"]).mean()
    middle = late["truth"].between(late["LIb"], late["LSb"]).mean()
    assert 0.90 <= inside <= 0.995
    assert 0.42 <= middle <= 0.66
    assert (limits["LI"] <= limits["LIb"]).all() and (limits["LIb"] <= limits["Median"]).all()
    assert (limits["Median"] <= limits["LSb"]).all() and (limits["LSb"] <= limits["LS"]).all()


def test_coverage_of_window_totals(spark):
    """Sums over several weeks need the weeks' dependence: limits from independent weeks are too narrow."""
    rng = np.random.default_rng(5)
    truth, rows = {}, []
    for i in range(300):
        y = _complete(rng, level=rng.uniform(1.5, 5))
        truth[f"s{i}"] = y.sum(axis=1)
        rows += _rows(y, series=f"s{i}")
    spec = ModelSpec(draws=400)
    fitted = model.fit_delay_model(_frame(spark, rows), spec, series_cols=["series"]).persist()
    alone = fitted.withColumns({"level_part": F.lit(0.0), "delay_part": F.lit(0.0)})
    inside = {}
    for name, table in (("together", fitted), ("alone", alone)):
        paths = draws.trajectories(table, spec, series_cols=["series"]).persist()
        for weeks in (3, 6):
            late = paths.filter(F.col("Time") > WEEKS - weeks)
            limits = summary.window_total(late, series_cols=["series"]).toPandas()
            real = np.array([truth[s][WEEKS - weeks:].sum() for s in limits["series"]])
            inside[name, weeks] = ((limits["LI"] <= real) & (real <= limits["LS"])).mean()
    for weeks in (3, 6):
        assert 0.90 <= inside["together", weeks] <= 0.99
        assert inside["alone", weeks] < inside["together", weeks] - 0.03


def test_weeks_of_a_draw_move_together(drawn):
    last = drawn.filter(F.col("Time") > WEEKS - 3)
    wide = last.groupBy("series", "draw").pivot("Time").agg(F.first("Y")).toPandas()
    found = []
    for _, paths in wide.groupby("series"):
        rank = paths.drop(columns=["series", "draw"]).rank().corr().to_numpy()
        found.append((rank[2, 1], rank[1, 0], rank[2, 0]))
    near, earlier, far = np.median(found, axis=0)
    assert near > 0.2 and earlier > 0.15 and far < near


def test_scores_are_normal(spark):
    """Whatever the parts, a score is standard normal, and correlations are those of the parts."""
    rows = spark.createDataFrame(
        [(t, 0, a, d) for t in (5, 6, 9) for a, d in ((0.0, 0.0), (0.6, 0.3), (0.0, 1.0), (1.0, 0.0))],
        "Time int, ahead int, level_part double, delay_part double",
    ).withColumn("z", draws._scores(ModelSpec(draws=4000), [F.lit("s")], [F.lit("s")]))
    z = {(r["Time"], r["level_part"], r["delay_part"]): np.array(r["z"]) for r in rows.collect()}
    for x in z.values():
        assert abs(x.mean()) < 0.06 and abs(x.std() - 1) < 0.05
    corr = lambda a, b: np.corrcoef(a, b)[0, 1]
    assert abs(corr(z[5, 0.0, 0.0], z[6, 0.0, 0.0])) < 0.06
    assert corr(z[5, 0.0, 1.0], z[9, 0.0, 1.0]) > 0.999
    assert abs(corr(z[5, 1.0, 0.0], z[6, 1.0, 0.0]) - 2 / 3) < 0.05
    assert abs(corr(z[5, 1.0, 0.0], z[9, 1.0, 0.0])) < 0.06
    assert abs(corr(z[5, 0.6, 0.3], z[6, 0.6, 0.3]) - (0.6 * 2 / 3 + 0.3)) < 0.05
    cdf = spark.createDataFrame([(x,) for x in (-8.0, -2.5, -0.3, 0.0, 0.7, 1.96, 6.0)], "x double")
    got = [r[0] for r in cdf.select(draws.normal_cdf(F.col("x"))).collect()]
    want = [0.5 * math.erfc(-x / math.sqrt(2)) for x in (-8.0, -2.5, -0.3, 0.0, 0.7, 1.96, 6.0)]
    assert got == pytest.approx(want, abs=1e-7)


def test_draws_are_whole_and_never_below_what_is_known(simulated, drawn):
    table, _ = simulated
    known = triangle.observed_from_first_unknown(table, series_cols=["series"])
    both = drawn.join(
        known.withColumnRenamed("series", "s").drop("dt_event").withColumnRenamed("Time", "t"),
        F.col("series").eqNullSafe(F.col("s")) & (F.col("Time") == F.col("t")),
    )
    assert both.count() == drawn.count() == 60 * 1000 * (DELAYS - 1)
    assert both.filter("Y < observed").isEmpty()
    per_series = drawn.groupBy("series").agg(F.countDistinct("draw"), F.max("draw"), F.min("draw"))
    assert {tuple(r)[1:] for r in per_series.collect()} == {(1000, 1000, 1)}


def test_draws_do_not_depend_on_partitions(simulated, drawn):
    table, _ = simulated
    some = table.filter("series in ('s1', 's2', 's7')")
    again = draws.trajectories(
        model.fit_delay_model(some.repartition(13), series_cols=["series"]),
        series_cols=["series"],
    )
    before = drawn.filter("series in ('s1', 's2', 's7')")
    assert again.exceptAll(before).isEmpty() and before.exceptAll(again).isEmpty()
    other = ModelSpec(seed=2)
    fitted = model.fit_delay_model(some, other, series_cols=["series"])
    assert not draws.trajectories(fitted, other, series_cols=["series"]).exceptAll(before).isEmpty()


def test_median_is_near_the_development_factors(simulated, drawn):
    """Chain-ladder growth factors estimate the same multiplicative mean."""
    table, _ = simulated
    medians = summary.weekly_summary(drawn, series_cols=["series"]).toPandas()
    cells = table.toPandas()
    ratios = []
    for name in ("s3", "s5", "s9", "s20", "s33"):
        grid = cells[cells["series"] == name].pivot(index="Time", columns="delay", values="Y").to_numpy()
        total = np.nancumsum(grid, axis=1)
        growth = [1.0]
        for d in range(DELAYS - 1):
            settled = slice(0, WEEKS - d - 1)
            growth.append(total[settled, d + 1].sum() / max(total[settled, d].sum(), 1))
        for t in range(WEEKS - 3, WEEKS):
            seen = WEEKS - t - 1
            guess = total[t, seen] * np.prod(growth[seen + 1 :])
            row = medians[(medians["series"] == name) & (medians["Time"] == t + 1)]
            ratios.append(row["Median"].iloc[0] / max(guess, 1))
    assert 0.75 < np.median(ratios) < 1.33


def test_shrinkage_is_recovered(spark):
    """Hazards of classes drawn about those of their series: the estimate comes back near their concentration."""
    rng = np.random.default_rng(21)
    found = {}
    for cases in (8.0, 80.0):
        rows = []
        for name in ("a", "b", None):
            pooled = rng.uniform(0.2, 0.5, DELAYS - 1)
            for c in range(1, 11):
                hazard = np.concatenate([[1.0], rng.beta(pooled * cases, (1 - pooled) * cases)])
                by = np.concatenate([np.cumprod((1 - hazard)[:0:-1])[::-1], [1.0]])
                share = np.diff(np.concatenate([[0.0], by]))
                y = rng.poisson(60 * share, (WEEKS, DELAYS))
                rows += _rows(y, series=name, age_class=c)
        table = _frame(spark, rows)
        found[cases] = model.estimated_prior(table, series_cols=["series"]).first()[0]
        assert cases / 1.6 < found[cases] < cases * 1.6
    fixed = ModelSpec(prior_cases=found[80.0])
    free = ModelSpec(prior_cases=None)
    a, b = (model.delay_hazards(table, x, series_cols=["series"]).collect() for x in (fixed, free))
    key = lambda r: (str(r["series"]), r["age_class"], r["delay"])
    assert [r["hazard"] for r in sorted(a, key=key)] == pytest.approx([r["hazard"] for r in sorted(b, key=key)])


def test_shape_is_recovered(spark):
    """Levels drawn about a mean: a week and the mean of three others scatter like 4/3 of its variance."""
    rng = np.random.default_rng(22)
    for shape in (2.0, 12.0):
        rows = []
        for i in range(60):
            level = rng.gamma(shape, 40 / shape, WEEKS)
            y = np.zeros((WEEKS, DELAYS), int)
            y[:, 0] = rng.poisson(level)
            rows += _rows(y, series=f"s{i}")
        table = _frame(spark, rows)
        got = model.estimated_shape(table, series_cols=["series"]).first()[0]
        assert shape * 0.75 / 1.25 < got < shape * 0.75 * 1.25
    spec = ModelSpec(level_shape=None, prior_cases=None)
    fitted = model.fit_delay_model(table, spec, series_cols=["series"])
    same = model.fit_delay_model(table, ModelSpec(
        level_shape=got, prior_cases=model.estimated_prior(table, series_cols=["series"]).first()[0]
    ), series_cols=["series"])
    pick = lambda df: [r[0] for r in df.orderBy("series", "Time").select("shape").collect()]
    assert pick(fitted) == pytest.approx(pick(same))


def test_priors_without_anything_to_learn_from(spark):
    empty = _frame(spark, _rows(np.zeros((WEEKS, DELAYS), int), series="x"))
    for table in (empty, empty.limit(0)):
        assert model.estimated_prior(table, series_cols=["series"]).first()[0] == model.PRIORS[1]
        assert model.estimated_shape(table, series_cols=["series"]).first()[0] == model.SHAPES[1]


def test_share_of_weeks_without_anything_is_recovered(spark):
    rng = np.random.default_rng(31)
    share = np.exp(-0.45 * np.arange(DELAYS))
    for off, level in ((0.3, 4.0), (0.0, 4.0), (0.6, 30.0)):
        rows, truth = [], {}
        for i in range(80):
            on = rng.random(WEEKS) >= off
            mean = level * on[:, None] * share / share.sum()
            y = rng.poisson(mean)
            truth[f"s{i}"] = y.sum(axis=1)
            rows += _rows(y, series=f"s{i}")
        spec = ModelSpec(draws=300, zero_inflation=True, level_weeks=8, level_shape=20.0)
        fitted = model.fit_delay_model(_frame(spark, rows), spec, series_cols=["series"]).persist()
        found = fitted.groupBy("series").agg(F.max("off").alias("off")).agg(F.avg("off")).first()[0]
        assert abs(found - off) < 0.08
        assert fitted.filter("observed > 0 and zero_chance > 0").isEmpty()
        paths = draws.trajectories(fitted, spec, series_cols=["series"])
        last = paths.filter(F.col("Time") == WEEKS)
        zeros = last.agg(F.avg((F.col("Y") == 0).cast("double"))).first()[0]
        real = np.array([t[WEEKS - 1] for t in truth.values()])
        assert abs(zeros - (real == 0).mean()) < 0.13
        mean = last.agg(F.avg("Y")).first()[0]
        assert 0.7 < mean / real.mean() < 1.4


def _plain_growth(observed, share, discount=0.8):
    """Weighted least squares of each week's past, written out."""
    out = []
    for t in range(len(observed)):
        a = np.arange(-t, 1)
        seen = observed[:t + 1] + share[:t + 1]
        w = np.where(share[:t + 1] > 0, seen / (1 + seen / 20), 0) * discount ** -a
        x = np.log(np.where(share[:t + 1] > 0, observed[:t + 1] / np.maximum(share[:t + 1], 1e-9), 0) + 0.5)
        left = np.array([[w.sum(), (w * a).sum()], [(w * a).sum(), (w * a * a).sum() + 1 / 0.15**2]])
        out.append(np.linalg.solve(left, [(w * x).sum(), (w * a * x).sum()])[1])
    return out


def test_growth_is_weighted_least_squares(spark):
    rng = np.random.default_rng(2)
    for name in ("a", None):
        observed, share = rng.poisson(20, 18), np.concatenate([np.ones(12), np.linspace(0.9, 0, 6)])
        rows = [(name, t + 1, int(y), float(p)) for t, (y, p) in enumerate(zip(observed, share))]
        weekly = spark.createDataFrame(rows, "series string, Time int, observed long, share double")
        got = model.growth(weekly.repartition(4), keys=["series"]).orderBy("Time").collect()
        assert [r["slope"] for r in got] == pytest.approx(_plain_growth(observed, share), abs=1e-9)
        assert all(r["slope_var"] <= 0.15**2 + 1e-12 for r in got) and {r["series"] for r in got} == {name}
    empty = spark.createDataFrame([("z", t, 0, 0.0) for t in (1, 2)], weekly.schema)
    assert [r["slope"] for r in model.growth(empty, keys=["series"]).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("rate", [0.12, -0.1])
def test_forecast_follows_the_trend(spark, rate):
    """Four weeks ahead of series that rise or fall steadily: the trend goes on, the mean level does not."""
    rng = np.random.default_rng(3)
    truth, rows = {}, []
    for i in range(60):
        weeks = np.arange(WEEKS + 4)
        share = np.exp(-0.45 * np.arange(DELAYS))
        mean = 60 * np.exp(rate * (weeks - WEEKS / 2))[:, None] * share / share.sum()
        y = rng.poisson(rng.gamma(20, mean / 20))
        truth[f"s{i}"] = y.sum(axis=1)
        rows += _rows(np.concatenate([y]), horizon=4, series=f"s{i}")
    table = _frame(spark, rows)
    error = {}
    for effect in ("level", "trend"):
        spec = ModelSpec(draws=300, time_effect=effect, level_shape=40.0)
        paths = draws.trajectories(
            model.fit_delay_model(table, spec, series_cols=["series"]), spec, series_cols=["series"])
        limits = summary.weekly_summary(paths, series_cols=["series"]).filter(F.col("Time") > WEEKS).toPandas()
        real = np.array([truth[s][t - 1] for s, t in zip(limits["series"], limits["Time"])])
        error[effect] = np.median(np.abs(np.log(limits["Median"] + 0.5) - np.log(real + 0.5)))
        inside = ((limits["LI"] <= real) & (real <= limits["LS"])).mean()
        if effect == "trend":
            assert inside >= 0.93
            assert abs(np.median(np.log(limits["Median"] + 0.5) - np.log(real + 0.5))) < 0.15
    assert error["trend"] < 0.7 * error["level"]


def test_forecast_widens(spark):
    y = _complete(np.random.default_rng(4), level=4)
    fitted = model.fit_delay_model(_frame(spark, _rows(y, horizon=4)))
    limits = summary.weekly_summary(draws.trajectories(fitted)).orderBy("Time").toPandas()
    assert list(limits["Time"]) == list(range(WEEKS - DELAYS + 2, WEEKS + 5))
    assert limits["dt_event"].iloc[-1] == START + dt.timedelta(7 * (WEEKS + 3))
    width = (np.log1p(limits["LS"]) - np.log1p(limits["LI"])).tail(5).to_numpy()
    assert (np.diff(width) > 0).all()


@pytest.fixture(scope="module")
def aged(spark):
    rng = np.random.default_rng(8)
    rows, truth = [], {}
    for a, level in ((1, 3.0), (4, 1.5), (7, 4.0)):
        y = _complete(rng, level=level)
        truth[a] = y.sum(axis=1)
        rows += _rows(y, age_class=a)
    rows += _rows(np.zeros((WEEKS, DELAYS)), age_class=9)
    return _frame(spark, rows), truth


def test_age_classes(aged):
    table, truth = aged
    fitted = model.fit_delay_model(table).persist()
    paths = draws.trajectories(fitted, by_age=True).persist()
    by_age = summary.weekly_summary(paths, by=["age_class"]).toPandas()
    assert set(by_age["age_class"]) == {1, 4, 7, 9}
    empty = by_age[by_age["age_class"] == 9]
    assert (empty["Median"] == 0).all()
    for a, total in truth.items():
        mine = by_age[by_age["age_class"] == a].sort_values("Time")
        inside = [lo <= total[t - 1] <= hi for t, lo, hi in zip(mine["Time"], mine["LI"], mine["LS"])]
        assert sum(inside) >= len(inside) - 1
    zero = triangle.zero_case_strata(table)
    assert [r["age_class"] for r in zero.collect()] == [9]
    blank = draws.blank_zero_strata(paths, zero)
    assert blank.filter("age_class = 9 and Y <> 0").isEmpty()
    assert blank.filter("age_class <> 9").exceptAll(paths.filter("age_class <> 9")).isEmpty()

    # Classes of a series share part of their levels' error, so their sum is wider than without.
    def spread(share):
        alike = ModelSpec(class_share=share)
        sums = summary.total_samples(draws.trajectories(model.fit_delay_model(table, alike), alike, by_age=True))
        last = sums.filter(F.col("Time") == WEEKS).agg(F.stddev("Y")).first()[0]
        return last

    assert spread(1.0) > 1.1 * spread(0.0)

    terms = model.fit_table(table).toPandas()
    assert set(terms["term"]) == {"time", "delay"}
    shares = terms[terms["term"] == "delay"].groupby("age_class")["value"].sum()
    assert shares.to_numpy() == pytest.approx(np.ones(4), abs=1e-9)
    levels = terms[terms["term"] == "time"].groupby("age_class")["value"].mean()
    assert levels[7] > levels[1] > levels[4] > levels[9]


@pytest.mark.parametrize("level", [-2.0, -0.5, 0.5])
def test_intervals_of_low_levels(spark, level):
    """Few counts: limits hold the truth and stay near it."""
    rng = np.random.default_rng(17)
    truth, rows = {}, []
    for i in range(80):
        y = _complete(rng, level=level)
        truth[f"s{i}"] = y.sum(axis=1)
        rows += _rows(y, series=f"s{i}")
    fitted = model.fit_delay_model(_frame(spark, rows), ModelSpec(draws=400), series_cols=["series"])
    paths = draws.trajectories(fitted, ModelSpec(draws=400), series_cols=["series"])
    limits = summary.weekly_summary(paths, series_cols=["series"]).toPandas()
    late = limits[limits["Time"] > WEEKS - 4]
    real = np.array([truth[s][t - 1] for s, t in zip(late["series"], late["Time"])])
    assert ((late["LI"] <= real) & (real <= late["LS"])).mean() >= 0.93
    assert (late["LS"] - late["LI"]).mean() <= 8 * math.exp(level) * 2.5 + 3
    assert late["LS"].max() <= 40 * (real.max() + 1)


def test_options_are_checked():
    with pytest.raises(ValueError, match="level_weeks"):
        ModelSpec(level_weeks=-1)
    with pytest.raises(ValueError, match="prior_cases"):
        ModelSpec(prior_cases=0)
    with pytest.raises(ValueError, match="time_effect"):
        ModelSpec(time_effect="iid")
    with pytest.raises(ValueError, match="discount"):
        ModelSpec(discount=1.0)
    with pytest.raises(ValueError, match="class_share"):
        ModelSpec(class_share=1.5)
    with pytest.raises(ValueError, match="draws"):
        ModelSpec(draws=0)


def test_sparse_series(spark):
    """One case in all, and a triangle with nothing but zeros."""
    y = np.zeros((WEEKS, DELAYS), dtype=int)
    rows = _rows(y, series="none")
    y[3, 1] = 1
    rows += _rows(y, series="one")
    fitted = model.fit_delay_model(_frame(spark, rows), series_cols=["series"])
    limits = summary.weekly_summary(
        draws.trajectories(fitted, series_cols=["series"]), series_cols=["series"]
    ).toPandas()
    assert limits["LS"].max() <= 3
