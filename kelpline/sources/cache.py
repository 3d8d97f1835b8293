"""Results kept by what they were computed from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from kelpline.sources.shared import shared_dir


def spec_key(spec: dict, length: int = 16) -> str:
    """The first digits of the SHA-256 of a specification as compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:length]


def cached(spark: SparkSession, spec: dict, build: Callable[[], DataFrame], root: str | None = None) -> DataFrame:
    """The result kept for ``spec``; what is missing, unfinished or unreadable is built anew."""
    path = f"{root or shared_dir(spark)}/cache/{spec_key(spec)}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        try:
            return spark.read.parquet(path)
        except PySparkException:
            pass
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
