import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from latecast.operators import releases, snapshots

DAYS = [dt.date(2020, 1, 6) + dt.timedelta(7 * i) for i in range(12)]


@pytest.fixture(scope="module")
def published(spark):
    """Counts that grow, stand still, are corrected down, or are left out of some releases."""
    rng = random.Random(3)
    rows = []
    for age in ("1", "2", None):
        for e in range(30):
            event, n = dt.date(2020, 1, 1) + dt.timedelta(3 * e), 0
            for day in DAYS:
                n = max(0, n + rng.choice([0, 0, 0, 0, 2, 5, -1]))
                if day >= event and rng.random() > 0.1:
                    rows.append((age, day, event, n))
    return spark.createDataFrame(rows, "age_class string, data date, dt_sin_pri date, n long").persist()


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_every_release_is_rebuilt(published):
    changes = releases.release_changes(published, "dt_sin_pri", series_cols=["age_class"]).persist()
    assert changes.count() < 0.6 * published.count()
    for day in DAYS:
        assert same(releases.release_of(changes, day), published.filter(F.col("data") == F.lit(day)))
    assert releases.release_of(changes, "2019-12-30").isEmpty()
    days = releases.release_days(published)
    assert same(releases.releases_between(changes, days), published)
    some = published.filter((F.col("data") >= F.lit(DAYS[3])) & (F.col("data") <= F.lit(DAYS[8])))
    assert same(releases.releases_between(changes, days, since=DAYS[3], until=DAYS[8]), some)
    overlap = changes.alias("a").join(changes.alias("b"), F.expr(
        "a.age_class <=> b.age_class and a.dt_sin_pri = b.dt_sin_pri and a.valid_from < b.valid_from"
        " and (a.valid_until is null or a.valid_until > b.valid_from)"))
    assert overlap.isEmpty()


def test_triangle_from_changes(published):
    changes = releases.release_changes(published, "dt_sin_pri", series_cols=["age_class"])
    again = releases.releases_between(changes, releases.release_days(published))
    options = dict(window=6, series_cols=["age_class"])
    assert same(snapshots.snapshot_triangle(again, "dt_sin_pri", 5, **options),
                snapshots.snapshot_triangle(published, "dt_sin_pri", 5, **options))


def test_stored_changes_skip_folders(spark, published, tmp_path):
    changes = releases.release_changes(published, "dt_sin_pri", series_cols=["age_class"])
    releases.write_changes(changes, str(tmp_path / "changes"))
    stored = spark.read.parquet(str(tmp_path / "changes"))
    back = releases.release_of(stored, "2020-02-03")
    assert same(back, published.filter("data = date'2020-02-03'"))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(from_month" in plan


def test_no_snapshots(published):
    empty = releases.release_changes(published.limit(0), "dt_sin_pri", series_cols=["age_class"])
    assert empty.isEmpty() and releases.release_of(empty, DAYS[0]).isEmpty()
