import datetime as dt

import pytest
from pyspark.sql import functions as F

from latecast.operators import curves, weekly
from latecast.sources import readers, writers
from latecast.sources.store import DayCountStore

HEADER = "EXTRA;NU_IDADE_N;TP_IDADE;DT_SIN_PRI;DT_DIGITA;CLASSI_FIN;EVOLUCAO;CO_MUN_RES\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("extracts")
    (path / "a.csv").write_text(HEADER + "x;34;3;01/02/2021;09/02/2021;5;1;310620\n"
                                "x;7;2;31/02/2021;10/02/2021;5;;310620\n")
    (path / "b.csv").write_text(HEADER + "x;80;3;05/01/2022;06/01/2022;4;2;310620\n"
                                "x;9;4;05/01/2022;06/01/2022;4;2;310620\n"
                                "x;20;3;05/01/2022;06/01/2022;4;2;999999\n")
    return path


def test_extracts(spark, folder):
    parts = [
        readers.read_delimited(spark, str(folder / f), readers.RAW_COLUMNS, delimiter=";")
        for f in ("a.csv", "b.csv")
    ]
    raw = readers.union_extracts(parts)
    assert raw.count() == 5 and "EXTRA" not in raw.columns
    rows = readers.prepare_extract(raw, region="310620").orderBy("DT_DIGITA").collect()
    assert [(r["Idade"], r["fx_etaria"], r["DT_SIN_PRI"]) for r in rows] == [
        (34, "30 - 49", dt.date(2021, 2, 1)), (0, "0 - 4", None),
        (80, "80 +", dt.date(2022, 1, 5)),
    ]
    assert "TP_IDADE" not in rows[0]
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "EXTRA" not in plan.split("ReadSchema")[1][:300]


def test_missing_column(spark, folder):
    with pytest.raises(ValueError, match="not in"):
        readers.read_delimited(spark, str(folder / "a.csv"), "AGE int", delimiter=";")


def test_age_counts(spark):
    df = spark.createDataFrame([("age_0", 1), ("age_1", 2), ("age_NA", 9)], "age_class string, n long")
    rows = readers.clean_age_counts(df).groupBy("age_class").agg(F.sum("n")).collect()
    assert [tuple(r) for r in rows] == [("age_1", 3)]


def test_stored_day_counts(spark, cases, tmp_path):
    days = weekly.day_counts(cases, "onset", "report")
    path = str(tmp_path / "days")
    writers.write_day_counts(days, path)
    back = readers.read_line_list(spark, path).drop("report_month")
    assert back.exceptAll(days).isEmpty() and days.exceptAll(back).isEmpty()
    then = writers.read_day_counts(spark, path, as_of="2020-06-09")
    want = days.filter("report <= date'2020-06-09'")
    assert then.exceptAll(want).isEmpty() and want.exceptAll(then).isEmpty()
    assert "PartitionFilters: [isnotnull(report_month" in (
        then._jdf.queryExecution().executedPlan().toString()
    )


def test_store_of_day_counts(spark, cases, tmp_path):
    """Increments, corrections and compaction give the counts as if they had come at once."""
    days = weekly.day_counts(cases, "onset", "report").persist()
    kept = DayCountStore(spark, str(tmp_path / "store"))
    assert kept.version() == 0 and kept.batches() == []
    with pytest.raises(ValueError, match="nothing"):
        kept.read()
    early, late = days.filter("report <= date'2020-06-10'"), days.filter("report > date'2020-06-10'")
    assert kept.append(early) == 1 and kept.append(late) == 2 and len(kept.batches()) == 2
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert same(kept.read(), days) and same(kept.read(version=1), early)
    twice = days.filter("onset = date'2020-06-09'")
    kept.append(twice)
    doubled = days.withColumn("n", F.when(F.col("onset") == F.lit("2020-06-09"), 2 * F.col("n")).otherwise(F.col("n")))
    assert same(kept.read(), doubled)
    kept.append(twice.withColumn("n", -F.col("n")))
    assert same(kept.read(), days)
    kept.append(twice.withColumn("n", -F.col("n")))
    assert kept.read().filter("onset = date'2020-06-09'").isEmpty()
    kept.append(twice)
    assert kept.compact() == 7 and len(kept.batches()) == 1 and same(kept.read(), days)
    assert same(kept.read(version=2), days) and same(kept.read(version=1), early)
    with pytest.raises(ValueError, match="version 99"):
        kept.read(version=99)
    then = kept.read(as_of="2020-06-09", since="2020-06-02")
    assert same(then, days.filter("report between date'2020-06-02' and date'2020-06-09'"))
    assert "PartitionFilters: [isnotnull(report_month" in then._jdf.queryExecution().executedPlan().toString()


def test_store_ignores_what_a_failed_writer_left(spark, cases, tmp_path):
    days = weekly.day_counts(cases, "onset", "report")
    kept = DayCountStore(spark, str(tmp_path / "store"))
    kept.append(days)
    days.withColumn("report_month", F.lit("2020-06")).write.partitionBy("report_month").parquet(
        str(tmp_path / "store/data/batch=left-behind"))
    assert kept.read().agg(F.sum("n")).first()[0] == days.agg(F.sum("n")).first()[0]
    kept.drop()
    assert kept.version() == 0 and not (tmp_path / "store").exists()


def test_write_by_series(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "series string, n long")
    writers.write_result(df, str(tmp_path / "r"), series_cols=["series"])
    assert sorted(p.name for p in (tmp_path / "r").glob("series=*")) == ["series=a", "series=b"]


def test_truth_beside(spark, cases):
    then = curves.weekly_tally(weekly.day_counts(cases, "onset", "report"))
    truth = curves.sunday_tally(cases, "onset", "2020-06-30")
    assert truth.agg(F.sum("n")).first()[0] == 8
    rows = curves.truth_beside(then, truth).collect()
    assert all(r["then"] == 0 for r in rows)  # Thursday weeks never meet Sunday weeks


def test_files_with_columns_in_another_order(spark, tmp_path):
    """Every file is read by its own header; a file without a wanted column is an error."""
    for i, text in enumerate(("x,y\n1,2\n", "y,x\n20,10\n", "z,y,x\n0,200,100\n")):
        (tmp_path / f"{i}.csv").write_text(text)
    got = readers.read_delimited(spark, str(tmp_path), "x int, y int").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (10, 20), (100, 200)]
    (tmp_path / "3.csv").write_text("x\n1\n")
    with pytest.raises(ValueError, match="columns not in"):
        readers.read_delimited(spark, str(tmp_path), "x int, y int")
