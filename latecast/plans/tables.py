"""Line lists, release snapshots and formula draws derived from the order tables.

A line item is a case: onset is the order date, it is reported ``l_quantity`` days later, its age
is ``l_partkey`` modulo 100 and the order priority is its series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latecast.functions import weeks
from latecast.operators import triangle, weekly
from latecast.operators.curves import as_of
from latecast.operators.keys import attach, join_on
from latecast.operators.model import ModelSpec

AS_OF = "2001-06-20"
FORMULA_DRAWS = ModelSpec().draws


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def line_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    onset = F.col("o_orderdate").cast("date")
    return line_items(spark, sf_dir).select(
        onset.alias("onset"),
        F.date_add(onset, F.col("l_quantity").cast("int")).alias("report"),
        (F.col("l_partkey") % 100).cast("int").alias("age"),
        F.col("o_orderpriority").alias("series"),
    )


def line_list_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_of(line_list(spark, sf_dir), "report", AS_OF)


def line_list_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The as-of line list in many series: order priority within the customer's nation."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    onset = F.col("o_orderdate").cast("date")
    rows = (
        line_items(spark, sf_dir)
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            onset.alias("onset"),
            F.date_add(onset, F.col("l_quantity").cast("int")).alias("report"),
            F.col("n_name").alias("nation"),
            F.col("o_orderpriority").alias("series"),
        )
    )
    return as_of(rows, "report", AS_OF)


def formula_draws(
    spark: SparkSession, sf_dir: str, *, by_age: bool = False, draws: int = FORMULA_DRAWS,
    bins="10 years",
) -> DataFrame:
    """Stand-in trajectories that any engine can compute: known counts plus a formula."""
    days = weekly.day_counts(
        line_list_as_of(spark, sf_dir), "onset", "report", "age" if by_age else None,
        bins=bins, series_cols=["series"],
    )
    table = triangle.delay_triangle(days, series_cols=["series"])
    keys = ["series", "age_class"] if by_age else ["series"]
    known = triangle.observed_from_first_unknown(table, series_cols=keys)
    wobble = F.col("draw") * 31 + F.col("Time") * 17
    if by_age:
        wobble = wobble + F.col("age_class") * 7
    return known.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).select(
        *keys, "draw", "Time", "dt_event", (F.col("observed") + wobble % 11).alias("Y")
    )


def snapshots(spark: SparkSession, sf_dir: str, *, by_age: bool = False) -> DataFrame:
    """Every Monday: all cases reported so far, per event day (per Wednesday of the event week
    when ``by_age``). Cases on line 7 have no known age."""
    onset = F.col("o_orderdate").cast("date")
    report = F.date_add(onset, F.col("l_quantity").cast("int"))
    age = F.when(F.col("l_linenumber") == 7, "age_NA").otherwise(
        F.concat(F.lit("age_"), F.floor(F.col("l_partkey") % 100 / 10).cast("string"))
    )
    event = F.date_add(weeks.sunday_of(onset), 3) if by_age else onset
    keys = ["dt_sin_pri", *(["age_class"] if by_age else [])]
    new = (
        line_items(spark, sf_dir)
        .select(
            event.alias("dt_sin_pri"),
            F.date_add(report, F.pmod(1 - weeks.weekday(report), F.lit(7))).alias("data"),
            *([age.alias("age_class")] if by_age else []),
        )
        .groupBy(*keys, "data")
        .agg(F.count(F.lit(1)).alias("new"))
    )
    last = new.agg(F.max("data").alias("_last"))
    listed = attach(new.groupBy(*keys).agg(F.min("data").alias("_first")), last, ()).select(
        *keys,
        F.explode(F.sequence("_first", "_last", F.expr("interval 7 days"))).alias("data"),
    )
    so_far = Window.partitionBy(*keys).orderBy("data")
    return join_on(listed, new, [*keys, "data"], "left").select(
        *keys, "data", F.sum(F.coalesce("new", F.lit(0))).over(so_far).alias("n")
    )


def raw_extracts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The line items as three extracts by year, with text dates, some of them unreadable."""
    onset = F.col("o_orderdate").cast("date")
    report = F.date_add(onset, F.col("l_quantity").cast("int"))
    unreadable = F.col("l_suppkey") % 10 == 0
    rows = line_items(spark, sf_dir).select(
        F.year("o_orderdate").alias("year"),
        (F.col("l_partkey") % 100).cast("int").alias("NU_IDADE_N"),
        (F.col("l_linenumber") % 4 + 1).alias("TP_IDADE"),
        F.date_format(onset, "dd/MM/yyyy").alias("DT_SIN_PRI"),
        F.when(unreadable, "--").otherwise(F.date_format(report, "dd/MM/yyyy")).alias("DT_DIGITA"),
        F.col("l_returnflag").alias("CLASSI_FIN"),
        F.col("l_linestatus").alias("EVOLUCAO"),
        F.col("o_orderpriority").alias("CO_MUN_RES"),
    )
    year = F.col("year")
    parts = [year < 1998, year.between(1998, 1999), year > 1999]
    return [rows.filter(p).drop("year") for p in parts]
