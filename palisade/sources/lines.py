"""Line-delimited sources and sinks, batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed value: largest record, in bytes.
MOST_BYTES = 10 * 1024 * 1024


def framed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines less one carriage return at their end; fits marks those within the largest record size."""
    bare = F.when(F.col(value).endswith("\r"), F.expr(f"left({value}, length({value}) - 1)")).otherwise(F.col(value))
    return lines.withColumn(value, bare).withColumn("fits", F.coalesce(F.octet_length(value) <= MOST_BYTES, F.lit(True)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, value, fits) of text files whose lines end in a line feed; an oversized line is marked, and process_lines and scan block it unseen."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return framed(lines).select(F.monotonically_increasing_id().alias("line_id"), "value", "fits")


def write_lines(df: DataFrame, path: str, value: str = "out") -> None:
    df.select(F.col(value).alias("value")).write.mode("append").option("lineSep", "\n").text(path)
