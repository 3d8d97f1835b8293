"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word everywhere in this package: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where a session of one process names none (tests), a temporary folder is set
    for the session; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kelpline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Most rows and bytes of one Arrow batch of texts.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold BATCH_ROWS rows and BATCH_BYTES bytes at most (and a row over).

    Smaller limits that the session has already are kept. Batches of 10,000
    texts, Spark's own limit, make JVM and Python workers hold many copies of
    tens of MB, which neither gives back. The settings stay, as results are lazy.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key := f"spark.sql.execution.arrow.{name}").removesuffix("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what came
    before. Unlike a checkpointed RDD, the table keeps its size statistics.
    """
    path = f"{shared_dir(df.sparkSession)}/kelpline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """Intermediate tables of one operator in the shared folder, deleted together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/kelpline-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a table that is written and read back."""
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")

    def drop(self) -> None:
        """Deletes the tables; nothing that still reads them may be left."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def words_in(text) -> F.Column:
    """Number of words in a text column; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
