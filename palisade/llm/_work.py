"""Session helpers: the shared folder, lineage cuts and batch sizes."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows that Arrow hands to a Python worker at once; texts can be long.
BATCH_ROWS = 1000
COLLECT_EVERY = 5.0


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset in a local session (tests), an own one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="palisade-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_collected = 0.0


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, where any executor can read it again."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    del df
    collect_garbage(out.sparkSession)
    return out


def collect_garbage(spark: SparkSession) -> None:
    """After a result is written: executors delete the shuffle files behind it when the driver's JVM has collected their handles, which a
    driver with little to do may not do for hours; so it is asked to, at most every COLLECT_EVERY seconds."""
    global _collected
    if time.monotonic() - _collected > COLLECT_EVERY:
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small unless the session already has smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: What this worker keeps between tasks, by operator, and how to let it go.
_KEPT: dict[str, Callable[[], object]] = {}


def keep(operator: str, release: Callable[[], object]) -> None:
    _KEPT[operator] = release


def _let_go(operator: str) -> None:
    for name in [k for k in _KEPT if k != operator]:
        _KEPT.pop(name)()


def _tidy() -> None:
    """Hand freed memory back to the system, so that a worker that waits for its next task does not hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(work: Callable[[Iterator], Iterator], operator: str = "") -> Callable[[Iterator], Iterator]:
    """work for mapInArrow, in a worker that lets go what other operators keep, and of freed memory in the end."""

    def run(batches):
        from palisade.llm import _work  # this function travels by value; the module is the worker's own

        _work._let_go(operator)
        try:
            yield from work(batches)
        finally:
            _work._tidy()

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of at most n keys, chosen by the keys' hash: the same keys whatever the partitioning. n bounds the broadcast."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(n)
    return df.join(F.broadcast(ids), key, "left_semi")


def hot_join(left: DataFrame, right: DataFrame, key: str, by: str, total: int, how: str = "left") -> DataFrame:
    """left joined by key with right, which has a row for each key and in n the number of left's `total` rows that have it.

    A key with more rows than a quarter of a partition's share is split by the hash of left's column `by`, and right's row of it sent to
    each split. There are at most 4 * partitions such keys, so their list is broadcast. Rows of left without a key are split too.
    """
    fair = 4 * partitions(left.sparkSession)
    hot = F.broadcast(right.where(F.col("n") * fair > total).select(key, F.ceil(F.col("n") * fair / max(total, 1)).cast("int").alias("splits_")))
    deal = F.pmod(F.xxhash64(by), F.when(F.col(key).isNull(), F.lit(fair)).otherwise(F.coalesce("splits_", F.lit(1))))
    dealt = left.join(hot, key, "left").withColumn("split_", deal.cast("int")).drop("splits_")
    copies = right.join(hot, key, "left").withColumn("split_", F.explode(F.sequence(F.lit(0), F.coalesce("splits_", F.lit(1)) - 1))).drop("splits_", "n")
    return dealt.join(copies, [key, "split_"], how).drop("split_")
