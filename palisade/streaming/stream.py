"""The same work over streams: files of lines in; verdicts, routed lines, counters and audit events out. All of it is stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade.operators.detect import Allow, scan
from palisade.operators.records import Routing, counters, process_lines
from palisade.sources import audit
from palisade.sources.lines import framed


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """(value, file, fits) of the lines of files as they come; at most files_per_trigger files a batch."""
    lines = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).format("text").load(path)
    return framed(lines.select("value", F.col("_metadata.file_path").alias("file")))


def scan_stream(lines: DataFrame, sensitivity: str = "medium", allow: Allow = Allow()) -> DataFrame:
    """Each line's matches, score and verdict, in append mode; a line that does not fit blocks unseen."""
    return scan(lines, "value", sensitivity, allow)


def route_stream(lines: DataFrame, how: Routing) -> DataFrame:
    """Each line routed, in append mode, with the counters observed under the name counters."""
    routed = process_lines(lines, how)
    first, *rest = counters()
    return routed.observe("counters", first, *rest)


def write_lines(routed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Routed lines as text; run to the end of what is there. Lines of a file may come in several part files."""
    return routed.select(F.col("out").alias("value")).writeStream.format("text").option("lineSep", "\n").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_ordered(lines: DataFrame, how: Routing, path: str, checkpoint: str) -> StreamingQuery:
    """Lines routed and written with their file and line_id, which ascends with the place in the file; run to the end of what is there.

    A batch is written to a folder of its own, whole or anew, so a batch that is run again leaves nothing twice.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        numbered = batch.withColumn("line_id", F.monotonically_increasing_id())
        process_lines(numbered, how).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={epoch}")

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(query: StreamingQuery) -> dict[str, int]:
    """Sums of the counters that a query's batches have observed so far."""
    total: dict[str, int] = {}
    for progress in query.recentProgress:
        seen = progress.observedMetrics.get("counters")
        for k, v in (seen.asDict() if seen is not None else {}).items():
            total[k] = total.get(k, 0) + (v or 0)
    return total


def write_audit(scanned: DataFrame, path: str, checkpoint: str, sensitivity: str = "medium", mode: str = "warn", tool_name: str = "stream") -> StreamingQuery:
    """Append blocking lines' events to the log; run to the end of what is there."""

    def each(batch: DataFrame, _epoch: int) -> None:
        audit.append(audit.events(batch, F.current_timestamp(), F.lit(tool_name), sensitivity, mode), path)

    return scanned.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
