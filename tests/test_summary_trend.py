import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from latecast.operators import report, summary, trend

DAY = dt.date(2020, 6, 4)


def _draws(spark, values):
    """{draw: [value per week]} -> trajectories."""
    rows = [
        (d, i + 1, DAY + dt.timedelta(7 * i), y)
        for d, line in values.items() for i, y in enumerate(line) if y is not None
    ]
    return spark.createDataFrame(rows, "draw int, Time int, dt_event date, Y long")


def test_quantiles(spark):
    drawn = _draws(spark, {i: [y] for i, y in enumerate([3, 1, 10, 7, 22, 5, 8])})
    row = summary.weekly_summary(drawn).first()
    assert [row[c] for c in ("Median", "LI", "LIb", "LSb")] == [7, 1.3, 4, 9]
    assert row["LS"] == pytest.approx(20.2)


def test_total_adds_classes_within_a_draw(spark):
    drawn = spark.createDataFrame(
        [(d, 1, DAY, a, 10 * d + a) for d in (1, 2, 3) for a in (1, 2)],
        "draw int, Time int, dt_event date, age_class int, Y long",
    )
    assert summary.total_summary(drawn).first()["Median"] == 43
    by_age = summary.weekly_summary(drawn, by=["age_class"]).orderBy("age_class").collect()
    assert [r["Median"] for r in by_age] == [21, 22]
    assert summary.window_total(drawn).first()["Median"] == 43


def test_report_quantiles_are_rounded_and_capped(spark):
    drawn = _draws(spark, {1: [2, 10], 2: [3, 200]})
    rows = summary.report_summary(drawn, keys=["dt_event"])
    first = rows.orderBy("dt_event").first()
    assert first["Median"] == 2  # 2.5, half to even
    capped = summary.cap_upper_limits(rows).orderBy("dt_event").collect()
    assert capped[0]["LS"] == 3 and capped[0]["IC90S"] == 3
    assert capped[1]["Median"] == 105 and capped[1]["LS"] == 195


def test_totals_with_history(spark):
    drawn = spark.createDataFrame(
        [(d, DAY, a, d * a) for d in (1, 2) for a in (1, 2)],
        "draw int, dt_event date, age_class int, Y long",
    )
    current = spark.createDataFrame(
        [(DAY - dt.timedelta(14), 1, 100), (DAY - dt.timedelta(7), 1, 9), (DAY, 1, 7)],
        "dt_event date, age_class int, n long",
    )
    rows = {r["age_class"]: r for r in summary.totals_with_history(drawn, current, 1).collect()}
    assert rows[99]["Mean"] == 109 + 4.5 and rows[99]["fx_etaria"] == "Total"
    assert rows[1]["Mean"] == 109 + 1.5 and rows[2]["Mean"] == 3


def test_trend_levels(spark):
    def score(values, **options):
        return trend.trend(_draws(spark, values), **options).first()["score"]

    assert score({i: [10, 12 + i, 15 + i] for i in range(9)}) == 1
    assert score({i: [30, 20 - i, 9] for i in range(9)}) == -1
    assert score({i: [10, 10, 10] for i in range(9)}) is None  # limits are exactly 0
    assert score({i: [10, 10, 10 + i - 4] for i in range(9)}) == 0
    assert score({1: [5], 2: [6]}) is None  # one week has no slope
    assert score({1: [1, 2, 4, 9]}, window=4) == 1


def _by_hand(values, window, end):
    """Slopes per draw of the window ending at week ``end``, divided by the base value."""
    weeks = [i for i in range(len(next(iter(values.values())))) if values[1][i] is not None]
    base = end - window + 1
    if base not in weeks:
        base = min(weeks)
    used = [i for i in weeks if base <= i <= end]
    out = []
    for line in values.values():
        y = np.array([line[i] for i in used], dtype=float)
        if line[base] > 0:
            y = y / line[base]
        out.append(np.polyfit(7.0 * np.array(used), y, 1)[0])
    return np.quantile(out, [0.05, 0.25, 0.75, 0.95])


@pytest.mark.parametrize("gap", [False, True])
def test_slopes_against_numpy(spark, gap):
    rng = np.random.default_rng(3)
    values = {d: [int(x) for x in rng.poisson(20, 8)] for d in range(1, 30)}
    values[2][4] = values[2][5] = 0  # a base value of 0 is not divided by
    if gap:
        for line in values.values():
            line[4] = None
    rows = trend.trend(_draws(spark, values), window=3, rolling=3).collect()
    assert len(rows) == (3 if gap else 4)
    for r in rows:
        end = (r["end_week"] - DAY).days // 7
        want = _by_hand(values, 3, end)
        assert [r[c] for c in ("LI", "Q1", "Q3", "LS")] == pytest.approx(list(want), abs=1e-12)


def test_single_line_uses_confidence_limits(spark):
    y = np.array([10.0, 13, 15, 22, 21])
    row = trend.trend(_draws(spark, {1: [int(v) for v in y]}), window=5).first()
    x, norm = 7.0 * np.arange(5), y / 10
    slope, level = np.polyfit(x, norm, 1)
    error = np.sqrt(((norm - level - slope * x) ** 2).sum() / 3 / ((x - x.mean()) ** 2).sum())
    assert row["LI"] == pytest.approx(slope - 2.353363434801822 * error)
    assert row["Q3"] == pytest.approx(slope + 0.764892328404345 * error)
    assert row["score"] == 1 and row["draws"] == 1


def test_trend_per_series_and_named_end(spark):
    up = _draws(spark, {i: [10, 12 + i, 15 + i, 1] for i in range(5)})
    both = up.withColumn("s", F.lit("up")).unionByName(
        up.withColumns({"s": F.lit(None).cast("string"), "Y": 40 - F.col("Y")})
    )
    end = DAY + dt.timedelta(14)
    rows = trend.trend(both, series_cols=["s"], end_week=end).collect()
    assert {r["s"]: r["score"] for r in rows} == {"up": 1, None: -1}


def _observed(spark, counts):
    rows = [(DAY + dt.timedelta(7 * i), n) for i, n in enumerate(counts) if n is not None]
    return spark.createDataFrame(rows, "dt_event date, n long")


def test_report_table(spark):
    observed = report.fill_calendar(_observed(spark, [4, None, 6, 3]))
    estimates = report.report_summary(
        _draws(spark, {1: [None, None, 8, 9], 2: [None, None, 8, 9]}), keys=["dt_event"]
    )
    rows = report.report_table(estimates, observed).orderBy("dt_event").collect()
    assert [r["n"] for r in rows] == [4, 0, 6, 3]
    assert [r["full_estimate"] for r in rows] == [4, 0, 8, 9]
    assert [r["n_cut"] for r in rows] == [4, 0, None, None]
    assert [r["rolling_average"] for r in rows] == [None, 4, 6, None]


def test_splice_has_no_overlap(spark):
    drawn = _draws(spark, {1: [None, None, 8, 9], 2: [None, None, 7, 9]})
    rows = report.splice_history(drawn, _observed(spark, [4, 5, 6, 3])).collect()
    got = sorted((r["draw"], (r["dt_event"] - DAY).days // 7, r["Y"]) for r in rows)
    assert got == [(1, 0, 4), (1, 1, 5), (1, 2, 8), (1, 3, 9),
                   (2, 0, 4), (2, 1, 5), (2, 2, 7), (2, 3, 9)]
    assert report.splice_history(drawn, _observed(spark, [4, 5, 6, 3]), weeks_back=2).count() == 6


def test_bridge(spark):
    table = spark.createDataFrame(
        [(DAY + dt.timedelta(7 * i), n, m) for i, (n, m) in
         enumerate([(4, None), (5, None), (3, 7.0), (1, 8.0), (0, None)])],
        "dt_event date, n long, Median double",
    )
    rows = report.bridge_row(table).orderBy("dt_event").collect()
    assert [r["Median"] for r in rows] == [None, 5, 7, 8]


def test_dispersion(spark):
    wild = _draws(spark, {1: [5, 0], 2: [5, 0], 3: [5, 900]})
    limits = report.report_summary(wild, keys=["dt_event"])
    assert report.dispersion_check(limits).first()["consistent"] is False
    assert report.dispersion_check(limits, limit=900).first()["consistent"] is True
