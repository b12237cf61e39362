"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import gc
import time

from pyspark.sql import SparkSession

from ..functions.ranking import cut, shared_folder

__all__ = ["cut", "release", "remove", "shared_folder"]


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle and checkpoint files of finished phases: it does so once their handles are collected.

    Twice, since handles may hold others; Spark's cleaner works beside the driver and is given a moment."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that an operator wrote to the shared folder and that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
