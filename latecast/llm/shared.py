"""Where intermediate tables go, and columns that several operators derive alike."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else one of a local session's own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="latecast-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder if urlparse(folder).scheme else f"file://{folder}"


#: Bounds of what goes to a Python worker at once, where the session does not set its own.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def bound_batches(spark: SparkSession) -> None:
    """Texts are long: ten thousand rows in a batch, the usual setting, would be far too much."""
    own = spark.conf.getAll
    for key, value in BATCHES.items():
        if key not in own:
            spark.conf.set(key, value)


@contextmanager
def rows_in_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Fewer rows in a batch while tables of large rows are written."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Work:
    """One run's tables and files, all below one new subfolder of the shared folder.

    Results are lazy and read these tables, so they stay until ``drop``, or until ``drop_since`` after
    a result has been written elsewhere.
    """

    made: list[Work] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        bound_batches(spark)
        self.made.append(self)
        self.folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write once and read back: later steps never repeat the work above, whoever is lost."""
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def partitioned(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """The same, in a folder for each value of a column, so that reading one value reads its rows only."""
        df.write.mode("overwrite").partitionBy(column).parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def appended(self, parts: Iterable[DataFrame], name: str) -> DataFrame:
        """One table of several results, written one after the other."""
        schema = None
        for part in parts:
            part.write.mode("append").parquet(f"{self.folder}/{name}")
            schema = part.schema
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str = "") -> None:
        """Delete one table, or all this run has written."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_since(mark: int) -> None:
    """Delete what runs have written since ``len(Work.made)`` was ``mark``."""
    for work in Work.made[mark:]:
        work.drop()
    del Work.made[mark:]


def numbered(docs: DataFrame, *named: str) -> tuple[DataFrame, list[str]]:
    """The same rows with columns c0, c1, ..., which clash with no name that an operator uses itself, and
    the new names of the given columns."""
    lower = [c.lower() for c in docs.columns]
    return docs.toDF(*[f"c{i}" for i in range(len(lower))]), [f"c{lower.index(c.lower())}" for c in named]


def whole_text(column: str | Column) -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def normalised(column: str | Column) -> Column:
    """Every run of ASCII white space becomes one space."""
    return F.regexp_replace(whole_text(column), SPACE, " ")


def word_count(column: str | Column) -> Column:
    return F.regexp_count(whole_text(column), F.lit(WORD)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
