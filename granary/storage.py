"""Durable intermediate tables in the folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, a temporary folder of our own on a local master, and an
    error on a cluster, whose executors would each write to a disk of their own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="granary-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: later stages start from the files, whichever executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released() -> Iterator[None]:
    """Delete on leaving what was written inside; for jobs whose results are written before."""
    held = len(_written)
    try:
        yield
    finally:
        release(held)


def release(kept: int = 0) -> None:
    """Delete the intermediate tables written so far, but for the first ``kept``; frames that still read them become
    invalid."""
    while len(_written) > kept:
        spark, path = _written.pop()
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
