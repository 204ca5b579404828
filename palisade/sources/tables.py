"""Parquet tables, spread over the cores where a small table lies in fewer files than there are cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes a core up to which a table is small: dealing it anew costs less than leaving cores idle.
SMALL = 64 << 20


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table at path. One of fewer files than cores, and of at most SMALL bytes a core, is dealt over the cores; any other is read as it lies."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL * cores else df


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); in a local session without one, in a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="palisade-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
