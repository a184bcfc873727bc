"""Line lists and release tables from files, and day counts to files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latecast.functions import strata

RAW_COLUMNS = (
    "NU_IDADE_N int, TP_IDADE int, DT_SIN_PRI string, DT_DIGITA string, CLASSI_FIN string, "
    "EVOLUCAO string, CO_MUN_RES string"
)
AGE_COUNT_COLUMNS = "data date, dt_sin_pri date, age_class string, n long"


def read_line_list(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A stored line list (Parquet)."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.parquet(*paths)


def read_delimited(
    spark: SparkSession, path: str, schema: str, *, delimiter: str = ",", columns: Sequence[str] = ()
) -> DataFrame:
    """Delimited text, every file with a header of its own. Columns are found by name in each file,
    and only those of ``schema`` (or ``columns`` of it) are parsed. Files with the same header are one
    read. Compression follows the file suffix; Spark reads gzip, bzip2 and zstandard, and plain or
    bzip2 files can be split between tasks.
    """
    wanted = spark.createDataFrame([], schema).schema
    names = list(columns) or wanted.names
    options = {"header": True, "sep": delimiter, "inferSchema": False}
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file in sorted(spark.read.csv(path, **options).inputFiles()):
        by_header.setdefault(tuple(spark.read.csv(file, **options).columns), []).append(file)
    parts = []
    for header, files in by_header.items():
        missing = [n for n in names if n not in header]
        if missing:
            raise ValueError(f"columns not in {files[0]}: {missing}")
        parts.append(spark.read.csv(files, **options).select(
            *[F.expr(f"try_cast(`{n}` AS {wanted[n].dataType.simpleString()})").alias(n) for n in names]
        ))
    return reduce(DataFrame.unionByName, parts)


def union_extracts(extracts: Sequence[DataFrame]) -> DataFrame:
    """Yearly extracts one below the other, matched by column name."""
    columns = extracts[0].columns
    return reduce(DataFrame.unionByName, [e.select(*columns) for e in extracts])


def prepare_extract(
    raw: DataFrame, *, region: str | None = None, region_col: str = "CO_MUN_RES"
) -> DataFrame:
    """Raw extract -> line list: ages in years with their bracket, dates parsed, one region.

    Records whose age unit is beyond years are dropped; unreadable dates become NULL.
    """
    rows = raw.filter(F.col("TP_IDADE") < strata.AGE_UNIT_YEARS + 1)
    if region is not None:
        rows = rows.filter(F.col(region_col) == region)
    age = strata.age_in_years(F.col("NU_IDADE_N"), F.col("TP_IDADE")).cast("double")
    rows = rows.withColumns({"Idade": age}).withColumns(
        {
            "fx_etaria": strata.interval_label(
                F.col("Idade"), strata.EXTRACT_LIMITS, strata.EXTRACT_LABELS
            ),
            "DT_SIN_PRI": day_month_year("DT_SIN_PRI"),
            "DT_DIGITA": day_month_year("DT_DIGITA"),
        }
    )
    return rows.drop("TP_IDADE", "NU_IDADE_N")


def day_month_year(column: str) -> Column:
    return F.try_to_date(F.col(column), "dd/MM/yyyy")


def clean_age_counts(counts: DataFrame) -> DataFrame:
    """Drops counts of unknown age and puts the youngest class into the next one."""
    age = F.col("age_class")
    return counts.filter(age != "age_NA").withColumn(
        "age_class", F.when(age == "age_0", "age_1").otherwise(age)
    )
