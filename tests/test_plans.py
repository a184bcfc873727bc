import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from latecast import nowcast
from latecast.operators import curves, report, triangle, weekly
from latecast.operators.model import ModelSpec
from latecast.operators.weekly import WeekRule
from latecast.plans import situation
from latecast.plans.nowcast import nowcast_days


@pytest.fixture(scope="module")
def line_list(spark):
    rng = random.Random(1)
    start = dt.date(2020, 1, 5)
    rows = []
    for name, size in (("big", 40), ("small", 6)):
        for day in range(260):
            for _ in range(rng.randrange(size)):
                late = int(rng.expovariate(1 / 12))
                onset = start + dt.timedelta(day)
                rows.append((name, onset, onset + dt.timedelta(late), float(rng.randrange(100))))
    return spark.createDataFrame(rows, "region string, onset date, report date, age double").persist()


@pytest.fixture(scope="module")
def view(line_list):
    return curves.as_of(line_list, "report", "2020-08-05").persist()


def test_bundle(view):
    run = nowcast(view, "onset", "report", d_max=8, window=20, draws=200)
    total = run.total.orderBy("Time").collect()
    assert len(total) == 8 and run.age is None
    assert total[-1]["dt_event"] == dt.date(2020, 7, 30)
    assert run.trajectories.count() == 8 * 200
    assert run.data.columns == ["dt_event", "Time", "delay", "Y"]
    assert run.output.filter("term = 'time'").count() == 21


def test_pruned_rows_give_the_same_triangle(spark, line_list, tmp_path):
    """Old rows are left out by filters that the scan gets; a report of an old case keeps its say."""
    odd = spark.createDataFrame(
        [("small", dt.date(2020, 1, 6), dt.date(2020, 12, 30), 1.0)], line_list.schema
    )
    line_list.unionByName(odd).repartition(3).write.parquet(str(tmp_path / "cases"))
    rows = spark.read.parquet(str(tmp_path / "cases"))
    for rule in (WeekRule(), WeekRule(trim=3), WeekRule(horizon=1, use_epiweek=True)):
        options = dict(window=10, series_cols=["region"], rule=rule)
        few = weekly.recent_rows(rows, "onset", "report", **options)
        assert few.count() < rows.count() / 2
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [Or(GreaterThanOrEqual(onset" in plan
        tables = [
            triangle.delay_triangle(
                weekly.day_counts(x, "onset", "report", series_cols=["region"]), d_max=6, **options
            ) for x in (rows, few)
        ]
        assert tables[0].exceptAll(tables[1]).isEmpty() and tables[1].exceptAll(tables[0]).isEmpty()


def test_report_keeps_weeks_ahead(view):
    days = weekly.day_counts(view, "onset", "report", series_cols=["region"])
    rule = WeekRule(horizon=2)
    table = situation.situation_report(
        days, series_cols=["region"], d_max=6, window=20, rule=rule, spec=ModelSpec(draws=50)
    ).persist()
    last = table.filter("n is not null").groupBy("region").agg(F.max("dt_event").alias("last"))
    ahead = table.join(last, "region").filter("dt_event > last")
    assert ahead.count() == 4 and ahead.filter("Median is null").isEmpty()


def test_series_and_ages(view):
    run = nowcast(
        view, "onset", "report", "age", bins=(0, 50, 100), series_cols=["region"], d_max=6,
        window=15, horizon=1, draws=100,
    )
    assert run.total.count() == 2 * 7
    assert run.age.count() == 2 * 7 * 2
    assert {r[0] for r in run.age.select("age_label").distinct().collect()} == {"0 - 49", "50+"}
    assert "age_label" in run.trajectories.columns
    assert run.total.columns == ["region", "Time", "dt_event", "Median", "LI", "LS", "LIb", "LSb"]


def test_many_series_give_what_each_gives_alone(view):
    options = dict(d_max=6, window=15, draws=50)
    together = nowcast(view, "onset", "report", series_cols=["region"], **options).trajectories
    alone = nowcast(
        view.filter("region = 'small'"), "onset", "report", series_cols=["region"], **options
    ).trajectories
    mine = together.filter("region = 'small'")
    assert mine.exceptAll(alone).isEmpty() and alone.exceptAll(mine).isEmpty()


def test_arguments_are_checked_before_any_job(view):
    with pytest.raises(ValueError, match="backcasting"):
        nowcast(view, "onset", "report", horizon=-1)
    with pytest.raises(ValueError, match="not in the data"):
        nowcast(view, "onset", "seen")
    with pytest.raises(ValueError, match="not in the data"):
        nowcast(view, "onset", "report", "years")
    with pytest.raises(ValueError, match="unknown age bins"):
        nowcast(view, "onset", "report", "age", bins="decades")
    with pytest.raises(ValueError, match="positive"):
        nowcast(view, "onset", "report", d_max=0)


def test_backtest_covers_the_truth(line_list):
    rows = situation.backtest(
        line_list, "onset", "report", "2020-08-05", series_cols=["region"], d_max=8, window=20
    ).collect()
    assert len(rows) == 16
    assert all(r["later"] >= r["observed"] for r in rows)
    assert sum(r["covered"] for r in rows) >= 13


def test_report_is_refitted_only_where_needed(view, monkeypatch):
    days = weekly.day_counts(view, "onset", "report", series_cols=["region"])
    spec = ModelSpec(draws=100)
    calm = situation.adaptive_draws(days, series_cols=["region"], d_max=8, window=20, spec=spec)
    assert {r[0] for r in calm.select("d_max").distinct().collect()} == {8}

    def only_big_passes(summary, *, limit, series_cols):
        return summary.groupBy("region").agg(F.lit(True).alias("_")).select(
            "region", (F.col("region") == "big").alias("consistent")
        )

    monkeypatch.setattr(report, "dispersion_check", only_big_passes)
    mixed = situation.adaptive_draws(days, series_cols=["region"], d_max=8, window=20, spec=spec)
    ends = {tuple(r) for r in mixed.select("region", "d_max").distinct().collect()}
    assert ends == {("big", 8), ("small", 4)}
    first = calm.filter("region = 'big'")
    assert mixed.filter("region = 'big'").exceptAll(first).isEmpty()


def test_situation_report(view):
    days = weekly.day_counts(view, "onset", "report", series_cols=["region"])
    table = situation.situation_report(
        days, series_cols=["region"], d_max=6, window=20, spec=ModelSpec(draws=100), cap=True
    ).persist()
    weeks = curves.weekly_tally(days, series_cols=["region"]).count()
    assert table.count() == weeks
    assert table.filter("Median is not null").count() == 12
    assert table.filter("trend_3w is not null").count() > 0
    assert table.filter("Median is not null and full_estimate <> Median").isEmpty()


def test_streaming_feed_equals_batch(spark, view, tmp_path):
    from latecast.streaming import feed

    path = tmp_path / "arrivals"
    for i, part in enumerate(view.randomSplit([0.5, 0.3, 0.2], seed=3)):
        part.coalesce(1).write.mode("append").parquet(str(path))
    stream = spark.readStream.schema(view.schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    store = str(tmp_path / "days")
    query = feed.store_arrivals(
        stream, "onset", "report", store, str(tmp_path / "state"), series_cols=["region"]
    )
    query.awaitTermination(180)
    assert query.exception() is None
    days = feed.read_arrivals(spark, store, series_cols=["region"])
    want = weekly.day_counts(view, "onset", "report", series_cols=["region"])
    assert days.exceptAll(want).isEmpty() and want.exceptAll(days).isEmpty()
    run = nowcast_days(days, series_cols=["region"], d_max=6, window=15, spec=ModelSpec(draws=20))
    assert run.total.count() == 12


def test_rule_passes_through(view):
    days = weekly.day_counts(view, "onset", "report")
    run = nowcast_days(days, d_max=5, window=10, rule=WeekRule(use_epiweek=True),
                       spec=ModelSpec(draws=20))
    assert run.total.filter("dayofweek(dt_event) <> 1").isEmpty()
