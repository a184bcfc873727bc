import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from latecast.operators import curves, triangle, weekly
from latecast.operators.weekly import WeekRule
from latecast.plans import tables


def _line_list(spark, rows, schema="onset string, report string, age double, series string"):
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame(rows, schema)
    dates = {n: F.to_date(n) for n in ("onset", "report")}
    return df.withColumns(dates).select(*names)


def test_weekly_rows(cases):
    rows = weekly.weekly_line_list(cases, "onset", "report").collect()
    got = sorted((r["onset"].isoformat(), r["report"].isoformat(), r["Delay"]) for r in rows)
    assert got == [
        ("2020-05-28", "2020-05-28", 0), ("2020-05-28", "2020-06-04", 1),
        ("2020-06-04", "2020-06-04", 0), ("2020-06-04", "2020-06-04", 0),
        ("2020-06-04", "2020-06-11", 1), ("2020-06-11", "2020-06-11", 0),
    ]


def test_weekly_counts_equal_counted_rows(cases):
    rows = weekly.weekly_line_list(cases, "onset", "report")
    want = {
        (r["onset"], r["Delay"]): r["count"]
        for r in rows.groupBy("onset", "Delay").count().collect()
    }
    counts = weekly.weekly_counts(weekly.day_counts(cases, "onset", "report")).collect()
    assert {(r["onset_week"], r["delay"]): r["n"] for r in counts} == want


def test_triangle_of_the_edge_rows(cases):
    days = weekly.day_counts(cases, "onset", "report")
    table = triangle.delay_triangle(days, d_max=2, rule=WeekRule(horizon=1)).collect()
    got = {(r["Time"], r["delay"]): r["Y"] for r in table}
    n = None
    want = [[1, 1, 0], [2, 1, n], [1, n, n], [n, n, n]]
    assert got == {(t + 1, d): y for t, row in enumerate(want) for d, y in enumerate(row)}
    starts = {r["Time"]: r["dt_event"].isoformat() for r in table}
    assert starts == {1: "2020-05-28", 2: "2020-06-04", 3: "2020-06-11", 4: "2020-06-18"}


def test_cells_past_the_last_onset_week_are_unknown(spark):
    """The last reports belong to earlier weeks: their cells turn unknown."""
    rows = [("2020-06-01", "2020-06-01"), ("2020-06-01", "2020-06-17"), ("2020-06-08", "2020-06-17")]
    days = weekly.day_counts(_line_list(spark, rows, "onset string, report string"), "onset", "report")
    got = {(r["Time"], r["delay"]): r["Y"] for r in triangle.delay_triangle(days, d_max=3).collect()}
    assert got[(1, 0)] == 1 and got[(1, 1)] == 0
    assert got[(1, 2)] is None and got[(2, 1)] is None and got[(2, 0)] == 0


def test_week_without_cases_is_filled(spark):
    rows = [("2020-06-03", "2020-06-04"), ("2020-06-24", "2020-06-24")]
    days = weekly.day_counts(_line_list(spark, rows, "onset string, report string"), "onset", "report")
    table = triangle.delay_triangle(days, d_max=1).collect()
    assert sorted({r["Time"] for r in table}) == [1, 2, 3, 4]
    assert {r["Y"] for r in table if r["Time"] in (2, 3)} == {0}


def test_complete_week_on_request(spark):
    rows = [("2020-06-30", "2020-07-04"), ("2020-06-23", "2020-06-24")]
    df = _line_list(spark, rows, "onset string, report string")
    assert weekly.weekly_line_list(df, "onset", "report").count() == 1
    rule = WeekRule(keep_complete_week=True)
    assert weekly.weekly_line_list(df, "onset", "report", rule=rule).count() == 2


def test_validation(cases):
    with pytest.raises(ValueError, match="backcasting"):
        WeekRule(horizon=-1)
    with pytest.raises(ValueError, match="not in the data"):
        weekly.day_counts(cases, "onset", "seen")
    with pytest.raises(ValueError, match="not in the data"):
        weekly.weekly_line_list(cases, "onset", "report", "age")


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(5)
    start = dt.date(2020, 1, 1)
    rows = []
    for _ in range(6000):
        # One series holds most of the rows, one has no name.
        series = rng.choices(["a", "b", None], [8, 2, 1])[0]
        onset = start + dt.timedelta(rng.randrange(250))
        report = onset + dt.timedelta(rng.randrange(-3, 70))
        rows.append(
            (
                onset.isoformat() if rng.random() > 0.02 else None,
                report.isoformat() if rng.random() > 0.02 else None,
                float(rng.randrange(-2, 140)), series,
            )
        )
    return _line_list(spark, rows).filter("report is null or report <= date'2020-09-01'").persist()


@pytest.mark.parametrize(
    "rule", [WeekRule(), WeekRule(trim=2), WeekRule(horizon=3), WeekRule(use_epiweek=True)]
)
def test_properties(many, rule):
    days = weekly.day_counts(many, "onset", "report", series_cols=["series"])
    table = triangle.delay_triangle(
        days, d_max=6, window=20, series_cols=["series"], rule=rule
    ).toPandas()
    cells = triangle.windowed_cells(
        weekly.weekly_counts(days, series_cols=["series"], rule=rule),
        d_max=6, window=20, series_cols=["series"],
    ).toPandas()
    assert table["series"].nunique(dropna=False) == 3
    for name, group in table.groupby("series", dropna=False):
        known = group[group["Y"].notna()]
        last = known["Time"].max()
        assert len(group) == (last + rule.horizon) * 7
        assert (group["Y"].isna() == (group["Time"] + group["delay"] > last)).all()
        mine = cells[cells["series"].isna() if name is None or name != name else cells["series"] == name]
        first = mine["onset_week"].min()
        seen = mine[
            [(w - first).days // 7 + 1 + d <= last for w, d in zip(mine["onset_week"], mine["delay"])]
        ]
        assert known["Y"].sum() == seen["n"].sum()


def test_series_together_equal_one_by_one(many):
    days = weekly.day_counts(many, "onset", "report", "age", bins=(0, 18, 65), series_cols=["series"])
    together = triangle.delay_triangle(days, d_max=5, series_cols=["series"])
    for name in ("a", "b", None):
        mine = F.col("series").eqNullSafe(F.lit(name))
        alone = weekly.day_counts(
            many.filter(mine), "onset", "report", "age", bins=(0, 18, 65)
        )
        want = triangle.delay_triangle(alone, d_max=5)
        got = together.filter(mine).select(*want.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_wide_and_long_again(many):
    days = weekly.day_counts(many, "onset", "report")
    table = triangle.delay_triangle(days, d_max=4, window=10)
    long = triangle.triangle_long(triangle.triangle_wide(table, 4))
    want = table.select("dt_event", "delay", "Y")
    assert long.exceptAll(want).isEmpty() and want.exceptAll(long).isEmpty()


def test_curves(many):
    days = weekly.day_counts(many, "onset", "report")
    table = triangle.delay_triangle(days, d_max=4, window=10, rule=WeekRule(horizon=2))
    curve = {r["dt_event"]: r["observed"] for r in curves.epi_curve(table).collect()}
    assert len(curve) == 13 and list(sorted(curve.items()))[-1][1] == 0
    then = curves.as_of(many, "report", "2020-06-01")
    assert then.agg(F.max("report")).first()[0] <= dt.date(2020, 6, 1)
    daily = curves.daily_tally(many, "onset", before_year=2020)
    assert daily.isEmpty()


@pytest.mark.parametrize("keys", [[], ["series"]])
@pytest.mark.parametrize("age", [None, "age"])
def test_day_counts_are_read_once(spark, tmp_path, keys, age):
    """The scalars of a series come from the same shuffled counts as its cells."""
    rows = [("2020-06-01", "2020-06-02", 1.0, "a"), ("2020-06-01", "2020-06-19", 1.0, None)]
    _line_list(spark, rows).coalesce(1).write.parquet(str(tmp_path / "cases"))
    cases = spark.read.parquet(str(tmp_path / "cases"))
    days = weekly.day_counts(cases, "onset", "report", age, series_cols=keys)
    table = triangle.delay_triangle(days, series_cols=keys)
    spark.sparkContext.setJobGroup(str(tmp_path), "reads")
    try:
        assert table.count() > 0
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert _records_read(spark, str(tmp_path)) == len(rows)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def _records_read(spark, group):
    """Rows that the stages of one job group have scanned."""
    context = spark.sparkContext
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    done = [s for s in stages if tracker.getStageInfo(s) and tracker.getStageInfo(s).numCompletedTasks]
    return sum(store.lastStageAttempt(s).inputRecords() for s in done)


@pytest.mark.parametrize(
    "as_of, rule, first, last, weeks, rows, cells",
    [
        ("2001-06-20", WeekRule(), "2000-11-16", "2001-06-14", 31, 4656, 225),
        ("2001-06-20", WeekRule(horizon=2), "2000-11-16", "2001-06-14", 31, 4656, 225),
        ("2001-06-20", WeekRule(trim=2), "2000-11-02", "2001-05-31", 31, 4692, 226),
        ("2001-06-20", WeekRule(use_epiweek=True), "2000-11-12", "2001-06-10", 31, 4667, 229),
        ("2001-06-20", WeekRule(horizon=1, use_epiweek=True), "2000-11-19", "2001-06-17", 31, 4585,
         229),
        ("2001-06-23", WeekRule(), "2000-11-12", "2001-06-10", 31, 4667, 229),
        ("2001-06-23", WeekRule(horizon=1), "2000-11-19", "2001-06-17", 31, 4651, 229),
    ],
)
def test_values_computed_beforehand(spark, as_of, rule, first, last, weeks, rows, cells):
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("driver tables not there")
    view = curves.as_of(tables.line_list(spark, str(folder)), "report", as_of)
    table = triangle.delay_triangle(weekly.day_counts(view, "onset", "report"), rule=rule)
    known = F.col("Y").isNotNull()
    got = table.agg(
        F.min("dt_event"), F.max(F.when(known, F.col("dt_event"))),
        F.max(F.when(known, F.col("Time"))), F.sum("Y"), F.count_if(F.col("Y") > 0),
        F.max(F.when(F.col("Y") > 0, F.col("delay"))), F.count(F.lit(1)), F.count_if(~known),
    ).first()
    size, unknown = (weeks + rule.horizon) * 16, 120 + 16 * rule.horizon
    want = (dt.date.fromisoformat(first), dt.date.fromisoformat(last), weeks, rows, cells, 8, size,
            unknown)
    assert tuple(got) == want
