import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latecast import nowcast
from latecast.operators import curves, triangle, weekly
from latecast.operators.model import ModelSpec
from latecast.operators.weekly import WeekRule
from latecast.plans import scores

DAYS = [dt.date(2020, 7, 1), dt.date(2020, 7, 19), dt.date(2020, 8, 5)]


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(2)
    rows = []
    for name, size, first in (("big", 30, 0), (None, 5, 0), ("late", 8, 170)):
        for day in range(first, 260):
            for _ in range(rng.randrange(size)):
                onset = dt.date(2020, 1, 5) + dt.timedelta(day)
                rows.append((name, onset, onset + dt.timedelta(int(rng.expovariate(1 / 12)))))
    rows.append(("big", None, dt.date(2020, 7, 18)))
    return spark.createDataFrame(rows, "region string, onset date, report date").persist()


@pytest.mark.parametrize("rule", [WeekRule(), WeekRule(use_epiweek=True, horizon=1)])
def test_views_give_the_triangles_of_each_day(cases, rule):
    options = dict(d_max=6, window=10, rule=rule)
    days = weekly.day_counts(cases, "onset", "report", series_cols=["region"])
    views = scores.as_of_views(days, DAYS, window=10, series_cols=["region"])
    together = triangle.delay_triangle(views, series_cols=["region", "as_of"], **options).persist()
    assert views.filter("as_of = date'2020-08-05'").count() < days.filter("report <= date'2020-08-05'").count()
    for day in DAYS:
        view = curves.as_of(cases, "report", day)
        alone = triangle.delay_triangle(
            weekly.day_counts(view, "onset", "report", series_cols=["region"]), series_cols=["region"], **options)
        mine = together.filter(F.col("as_of") == F.lit(day)).drop("as_of").select(*alone.columns)
        assert mine.exceptAll(alone).isEmpty() and alone.exceptAll(mine).isEmpty()


def test_scores_of_known_draws(spark):
    rng = np.random.default_rng(4)
    rows = [(sorted(int(v) for v in rng.poisson(9, 40)), int(y)) for y in (0, 7, 9, 30)] + [([5], 5), ([3], 8)]
    table = spark.createDataFrame(rows, "ys array<long>, y long")
    got = [r[0] for r in table.select(scores.crps(F.col("ys"), F.col("y"))).collect()]
    for (ys, y), value in zip(rows, got, strict=True):
        x = np.array(ys)
        plain = np.abs(x - y).mean() - np.abs(x[:, None] - x[None, :]).mean() / 2
        assert value == pytest.approx(plain, abs=1e-9)
    inside = spark.createDataFrame([(2.0, 6.0, 4), (2.0, 6.0, 1), (2.0, 6.0, 9)], "a double, b double, y long")
    wide = [r[0] for r in inside.select(scores.interval_score(F.col("a"), F.col("b"), F.col("y"), 0.5)).collect()]
    assert wide == [4.0, 8.0, 16.0]


def test_scores_of_single_days_are_the_same(cases):
    """All days in one job against a nowcast of one day, and the truth counted by hand."""
    spec = ModelSpec(draws=200)
    scored = scores.score_weeks(
        cases, "onset", "report", DAYS, series_cols=["region"], d_max=6, window=10, specs={"a": spec, "b": spec}
    ).persist()
    rows = scored.collect()
    assert {r["setting"] for r in rows} == {"a", "b"}
    per = {(r["setting"], r["region"], r["as_of"], r["dt_event"]): r for r in rows}
    assert len(per) == len(rows) and {r["as_of"] for r in rows if r["region"] == "late"} == set(DAYS)
    all_cases = [(r["region"], r["onset"]) for r in cases.collect() if r["onset"]]
    for (name, region, _, week), r in per.items():
        assert r["later"] == sum(
            region == g and week <= d < week + dt.timedelta(7) for g, d in all_cases)
        if name == "a":
            other = per["b", region, r["as_of"], week]
            assert (r["crps"], r["interval_95"]) == (other["crps"], other["interval_95"])
    run = nowcast(curves.as_of(cases, "report", DAYS[1]), "onset", "report", series_cols=["region"],
                  d_max=6, window=10, spec=spec)
    weeks_alone = {(r["region"], r["dt_event"]) for r in run.total.collect()}
    assert weeks_alone == {(g, w) for n, g, d, w in per if d == DAYS[1] and n == "a"}
    assert min(r["back"] for r in rows) == 0 and max(r["back"] for r in rows) == 5
    means = scores.mean_scores(scored, ["setting", "back"]).collect()
    assert len(means) == 12 and all(0 <= r["covered_95"] <= 1 and r["crps"] >= 0 for r in means)


def test_better_draws_have_better_scores(cases):
    """A shape that pretends to know the level costs more than one that does not."""
    specs = {"fair": ModelSpec(draws=200), "sure": ModelSpec(draws=200, level_shape=1e6, level_weeks=12)}
    scored = scores.score_weeks(
        cases.filter("region = 'big'"), "onset", "report", DAYS, d_max=6, window=20, specs=specs)
    means = {r["setting"]: r for r in scores.mean_scores(scored.filter("back < 4"), ["setting"]).collect()}
    assert means["fair"]["covered_95"] >= means["sure"]["covered_95"]


def test_no_days(cases):
    days = weekly.day_counts(cases, "onset", "report")
    with pytest.raises(ValueError, match="day"):
        scores.as_of_views(days, [], window=10)
    early = scores.score_weeks(cases, "onset", "report", [dt.date(2019, 1, 1)])
    assert early.count() == 0
