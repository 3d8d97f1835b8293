"""Running streams to their end, and tables that streams keep up to date."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.sources.shared import shared_dir


def replay(spark: SparkSession, path: str, schema, files_a_batch: int | None = None) -> DataFrame:
    """The Parquet files at ``path`` as a stream, in order of their time of change."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    if own.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(own).isFile():  # a stream follows folders
        return reader.option("pathGlobFilter", own.getName()).parquet(own.getParent().toString())
    return reader.parquet(path)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there; its output as a table in the shared folder.

    ``append``: all batches; ``complete``: the last.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")
        last.append(epoch)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{root}/out/epoch={last[-1]}")
    return spark.read.schema(stream.schema).parquet(*(f"{root}/out/epoch={e}" for e in sorted(set(last))))


def latest_state(stream: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The newest values of each key, as an aggregation with state."""
    return stream.groupBy(*by).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("s")).select(*by, "s.*")


def deduplicated(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Each key once, where its copies arrive within the delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


class UpsertTable:
    """A table that micro-batches update: of each key the latest row, one folder a version.

    The state is in the folder alone: versions are numbered by batch and count
    once they are complete, so a stream that stops, fails or starts again goes
    on from the last one. A batch that runs again finds its version, or writes
    it anew from the one before it. All but the last two versions are deleted.
    """

    def __init__(self, spark: SparkSession, key: str, order: list[str], root: str | None = None):
        self.spark, self.key, self.order = spark, key, order
        self.root = root or f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        path, fs = self._path("")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        own = sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())
        return [v for v in own if fs.exists(self._path(f"v{v}/_SUCCESS")[0])]

    def read(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.root}/v{found[-1]}") if found else None

    def apply(self, batch: DataFrame, epoch: int) -> None:
        found = self.versions()
        if epoch in found:
            return
        earlier = [v for v in found if v < epoch]
        both = self.spark.read.parquet(f"{self.root}/v{earlier[-1]}").unionByName(batch) if earlier else batch
        columns = [c for c in both.columns if c != self.key]
        merged = both.groupBy(self.key).agg(F.max_by(F.struct(*columns), F.struct(*self.order)).alias("s")).select(self.key, "s.*")
        merged.write.mode("overwrite").parquet(f"{self.root}/v{epoch}")
        for v in earlier[:-1]:
            path, fs = self._path(f"v{v}")
            fs.delete(path, True)

    def follow(self, stream: DataFrame, interval: str | None = None):
        """Keeps the table up to date with a stream.

        With ``interval``, at most one version per interval: values in between
        are overwritten unseen, as a conflating sink does.
        """
        writer = stream.writeStream.option("checkpointLocation", f"{self.root}/state").foreachBatch(self.apply)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def batched(stream: DataFrame, act: Callable[[DataFrame, int], None], interval: str, checkpoint: str):
    """Calls ``act`` with what has gathered in each interval: debounced reports."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(act).start()
