"""A table of day counts that grows by increments: late reports come as new folders, views read their past only.

``data`` has a folder for each batch, with folders by report month in it; ``manifest`` has, for each version,
the batches that make it up. A batch counts from the moment its version is written, so readers never see half of
one, and what a failed writer left behind is no part of any version. There is one writer at a time.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latecast.sources.writers import month_of, within_reports


class DayCountStore:
    """Day counts (keys, onset, report, n) below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return where.getFileSystem(conf).exists(where)

    def version(self) -> int:
        """The last version, 0 while there is none."""
        if not self._exists("manifest"):
            return 0
        return self.spark.read.parquet(f"{self.path}/manifest").agg(F.max("version")).first()[0] or 0

    def batches(self, version: int | None = None) -> list[str]:
        """The folders of a version, the last one by default; a row for each batch since it was compacted."""
        version = self.version() if version is None else version
        if not version:
            return []
        rows = self.spark.read.parquet(f"{self.path}/manifest").filter(F.col("version") == version)
        found = [r["batch"] for r in rows.select("batch").collect()]
        if not found:
            raise ValueError(f"there is no version {version}")
        return sorted(found)

    def _write(self, days: DataFrame, live: list[str]) -> int:
        batch, version = f"b-{uuid.uuid4().hex}", self.version() + 1
        stored = days.withColumn("report_month", month_of("report")).repartition("report_month")
        stored.write.partitionBy("report_month").parquet(f"{self.path}/data/batch={batch}")
        rows = self.spark.createDataFrame([(b,) for b in [*live, batch]], "batch string").coalesce(1)
        rows.write.parquet(f"{self.path}/manifest/version={version}")
        return version

    def append(self, days: DataFrame) -> int:
        """Add counts: new days, late reports of old ones, or corrections with a negative count. The new version."""
        return self._write(days, self.batches())

    def compact(self) -> int:
        """Write the last version as one batch, counts of equal keys added up. Earlier versions stay readable."""
        return self._write(self.read(), [])

    def read(
        self, *, as_of: dt.date | str | None = None, since: dt.date | str | None = None, version: int | None = None
    ) -> DataFrame:
        """Day counts of a version, one row a key; ``as_of`` and ``since`` bound the report days and skip the
        folders of other months. Keys whose counts add up to 0 are left out."""
        live = self.batches(version)
        if not live:
            raise ValueError(f"nothing is stored in {self.path}")
        data = f"{self.path}/data"
        days = self.spark.read.option("basePath", data).parquet(*[f"{data}/batch={b}" for b in live])
        days = within_reports(days, as_of=as_of, since=since).drop("report_month", "batch")
        keys = [c for c in days.columns if c != "n"]
        return days.groupBy(*keys).agg(F.sum("n").alias("n")).filter(F.col("n") != 0)

    def drop(self) -> None:
        """Delete everything."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
