"""Keeps the day counts of an arriving line list, for nowcasts on a schedule.

Arrivals are counted by raw dates. The weekday on which weeks start may change with every new last
report; raw dates never need restating for that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from latecast.operators import weekly


def store_arrivals(
    stream: DataFrame,
    date_onset: str,
    date_report: str,
    path: str,
    checkpoint: str,
    age_col: str | None = None,
    *,
    bins: str | Sequence[float] | None = "SI-PNI",
    series_cols: Sequence[str] = (),
) -> StreamingQuery:
    """Writes the day counts of each micro-batch to its own folder and stops at the end of input.

    A batch that runs again after a failure overwrites its own folder, so nothing counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        days = weekly.day_counts(
            batch, date_onset, date_report, age_col, bins=bins, series_cols=series_cols
        )
        days.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_arrivals(
    spark: SparkSession, path: str, *, series_cols: Sequence[str] = ()
) -> DataFrame:
    """All batches added up: the same day counts as one batch run over everything."""
    stored = spark.read.parquet(path)
    age = ["age_class"] if "age_class" in stored.columns else []
    return stored.groupBy(*series_cols, "onset", "report", *age).agg(F.sum("n").alias("n"))
