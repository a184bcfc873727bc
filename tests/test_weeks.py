import datetime as dt

import pytest
from pyspark.sql import functions as F

from latecast.functions import strata, text, weeks
from latecast.functions.stats import half_even, t_half_width, t_quantile


def _step_by_step(day, last_weekday, epiweek):
    """Week start by walking back to the day after the last record's weekday (or to Sunday)."""
    wanted = 0 if epiweek else (last_weekday + 1) % 7
    while (day.weekday() + 1) % 7 != wanted:
        day -= dt.timedelta(1)
    return day


@pytest.mark.parametrize("epiweek", [False, True])
def test_week_start_against_walking_back(spark, epiweek):
    first = dt.date(2019, 1, 1)
    days = spark.range(800).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("d"))
    lasts = [dt.date(2020, 5, 3) + dt.timedelta(i) for i in range(7)]
    columns = [
        weeks.week_start(F.col("d"), weeks.first_weekday(F.lit(x), epiweek)).alias(f"w{i}")
        for i, x in enumerate(lasts)
    ]
    for row in days.select("d", *columns).collect():
        for i, x in enumerate(lasts):
            assert row[f"w{i}"] == _step_by_step(row["d"], (x.weekday() + 1) % 7, epiweek)


def _cutoff(spark, last, **options):
    rule = dict(trim_weeks=0, horizon=0, use_epiweek=False, keep_complete_week=False) | options
    column = weeks.report_cutoff(F.lit(dt.date.fromisoformat(last)), **rule)
    return spark.range(1).select(column.alias("c")).first()["c"].isoformat()


def test_cutoff(spark):
    assert _cutoff(spark, "2020-06-17") == "2020-06-17"
    assert _cutoff(spark, "2020-06-17", trim_weeks=2) == "2020-06-03"
    assert _cutoff(spark, "2020-06-17", horizon=1) == "2020-06-24"
    assert _cutoff(spark, "2020-06-17", use_epiweek=True) == "2020-06-13"
    # A Saturday ends a complete week, which is dropped all the same unless asked for.
    assert _cutoff(spark, "2020-07-04") == "2020-06-27"
    assert _cutoff(spark, "2020-07-04", keep_complete_week=True) == "2020-07-04"
    assert _cutoff(spark, "2020-07-04", use_epiweek=True) == "2020-06-27"
    assert _cutoff(spark, "2020-07-04", use_epiweek=True, keep_complete_week=True) == "2020-07-04"


def test_epiweek(spark):
    days = ["2020-12-31", "2021-01-02", "2021-01-03", "2016-01-01", "2017-01-01"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("d"))
    got = df.select(weeks.epiyear(F.col("d")), weeks.epiweek(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(2020, 53), (2020, 53), (2021, 1), (2015, 52), (2017, 1)]


def test_age_classes(spark):
    ages = [-1.0, 0.0, 4.9, 5.0, 90.0, 129.0, 130.0, None]
    df = spark.createDataFrame([(a,) for a in ages], "a double")
    code = strata.interval_code(F.col("a"), strata.age_limits("SI-PNI"))
    got = [r[0] for r in df.select(code).collect()]
    assert got == [None, 1, 1, 2, 11, 11, None, None]
    label = strata.age_label(F.lit(11), "SI-PNI")
    assert spark.range(1).select(label).first()[0] == "90+"
    assert [len(v) - 1 for v in strata.AGE_PRESETS.values()] == [11, 10, 19]


def test_unknown_bins():
    with pytest.raises(ValueError, match="unknown age bins"):
        strata.age_limits("2 years")
    assert strata.age_limits(None) == strata.AGE_PRESETS["SI-PNI"]


def test_text(spark):
    df = spark.createDataFrame([("São José, às 10h! R$5+ç.",)], "t string")
    assert df.select(text.search_form(F.col("t"))).first()[0] == "SÃO JOSE  ÀS 10H  R$5+C "


def test_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(half_even(F.col("x"))).collect()] == [2.0, 4.0, 0.0]


def test_student_limits(spark):
    assert t_quantile(0.9, 1) == pytest.approx(6.313751514675, rel=1e-9)
    assert t_quantile(0.5, 4) == pytest.approx(0.740697084, rel=1e-8)
    assert t_quantile(0.9, 30) == pytest.approx(1.697260887, rel=1e-8)
    df = spark.createDataFrame([(0,), (1,), (120,), (121,), (500,)], "k int")
    got = [r[0] for r in df.select(t_half_width(0.9, F.col("k"))).collect()]
    assert got[0] is None
    assert got[1:3] == [t_quantile(0.9, 1), t_quantile(0.9, 120)]
    assert got[3] == pytest.approx(t_quantile(0.9, 121), rel=1e-8)
    assert got[4] == pytest.approx(t_quantile(0.9, 500), rel=1e-9)
