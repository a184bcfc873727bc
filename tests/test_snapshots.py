import pytest
from pyspark.sql import functions as F

from latecast.operators import snapshots


def _releases(spark, rows, extra=""):
    schema = "data string, dt string, n long" + extra
    return spark.createDataFrame(rows, schema).withColumns(
        {"data": F.to_date("data"), "dt": F.to_date("dt")}
    )


@pytest.fixture(scope="module")
def three(spark):
    """One event week, seen by three releases (Mondays); the count falls at the end."""
    return _releases(spark, [
        ("2020-06-08", "2020-06-08", 3), ("2020-06-08", "2020-06-10", 2),
        ("2020-06-15", "2020-06-08", 6), ("2020-06-15", "2020-06-10", 3),
        ("2020-06-22", "2020-06-08", 5), ("2020-06-22", "2020-06-10", 3),
    ])


def test_increments(three):
    rows = snapshots.snapshot_increments(three, "dt").orderBy("delay").collect()
    assert [(r["delay"], r["n"], r["Y"], r["left_truncated"]) for r in rows] == [
        (0, 5, 5, False), (1, 9, 4, False), (2, 8, -1, False),
    ]


def test_triangle_clips_and_merges(three):
    rows = snapshots.snapshot_triangle(three, "dt", 3).collect()
    got = {(r["Time"], r["delay"]): r["Y"] for r in rows}
    n = None
    assert got == {
        (1, 1): 9, (1, 2): 0, (1, 3): n, (2, 1): 0, (2, 2): n, (2, 3): n,
        (3, 1): n, (3, 2): n, (3, 3): n,
    }


def test_left_truncation(spark):
    late = _releases(spark, [("2020-06-22", "2020-06-08", 8), ("2020-06-29", "2020-06-08", 9)])
    rows = snapshots.snapshot_increments(late, "dt").orderBy("delay").collect()
    assert [(r["delay"], r["Y"], r["left_truncated"]) for r in rows] == [(2, 8, True), (3, 1, False)]


def test_smallest_release_of_a_week_stands(spark):
    daily = _releases(spark, [
        ("2020-06-08", "2020-06-07", 4), ("2020-06-10", "2020-06-07", 6),
        ("2020-06-15", "2020-06-07", 7),
    ])
    rows = snapshots.snapshot_increments(daily, "dt").orderBy("delay").collect()
    assert [(r["delay"], r["Y"]) for r in rows] == [(0, 4), (1, 3)]


def test_release_must_exist(three):
    with pytest.raises(ValueError, match="not a release day"):
        snapshots.snapshot_triangle(three, "dt", 3, release="2020-06-09")
    with pytest.raises(ValueError, match="not a release day"):
        snapshots.current_release(three, "dt", release="2020-06-09")
    early = snapshots.snapshot_triangle(three, "dt", 3, release="2020-06-15")
    assert early.agg(F.max("Time")).first()[0] == 2


def test_current_release(three):
    latest = snapshots.current_release(three, "dt").collect()
    assert [tuple(r)[1:] for r in latest] == [(24, 2020, 8)]
    named = snapshots.current_release(three, "dt", release="2020-06-15", epiweek=False).collect()
    assert sorted(r["n"] for r in named) == [3, 6]


def test_full_weeks(spark, three):
    """Last release Monday 06-22: the last full week starts 06-14."""
    rows = snapshots.snapshot_triangle_full_weeks(three, "dt", 3, horizon=1).collect()
    got = {(r["dt_event"].isoformat(), r["delay"]): r["Y"] for r in rows}
    n = None
    # Observed rows win over the unknown wedge, also past the last full week.
    assert got == {
        ("2020-06-07", 1): 9, ("2020-06-07", 2): 0, ("2020-06-07", 3): n,
        ("2020-06-14", 1): n, ("2020-06-14", 2): n, ("2020-06-14", 3): n,
        ("2020-06-21", 1): n, ("2020-06-21", 2): n, ("2020-06-21", 3): n,
    }


def test_full_weeks_by_class_share_the_calendar_end(spark):
    rows = [("2020-06-08", "2020-06-08", 3, "x"), ("2020-06-29", "2020-06-08", 4, "x"),
            ("2020-06-08", "2020-06-08", 2, "y")]
    table = snapshots.snapshot_triangle_full_weeks(
        _releases(spark, rows, ", age_class string"), "dt", 2, series_cols=["age_class"]
    )
    ends = {r[0]: r[1].isoformat() for r in table.groupBy("age_class").agg(F.max("dt_event")).collect()}
    assert ends == {"x": "2020-06-21", "y": "2020-06-21"}
