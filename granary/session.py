"""Spark sessions that can run this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where it lies, if it isn't installed beside them. On a cluster
    without a shared file system install it on the nodes or pass it with ``--py-files``."""
    root = str(Path(__file__).resolve().parents[1])
    held = spark.sparkContext.environment
    paths = held.get("PYTHONPATH", "").split(os.pathsep) if held.get("PYTHONPATH") else []
    if root not in paths:
        held["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that tests and benchmarks use."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
    } | conf
    return reachable(SparkSession.builder.master(f"local[{cores}]").config(map=settings).getOrCreate())
