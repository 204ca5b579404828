"""The audit log: metadata-only events, appended as JSON lines and queried newest first. No matched text is ever written."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.functions.text import fixed_point, sha_prefix

MATCHES = "array<struct<pattern_id:string,category:string,severity:string,offset:bigint,text_len:bigint,text_sha256:string>>"
SCHEMA = f"ts timestamp, tool_name string, sensitivity string, mode string, verdict string, score double, num_matches bigint, redacted boolean, matches {MATCHES}"
REQUIRED = ("ts", "tool_name", "sensitivity", "mode", "verdict", "score", "num_matches", "redacted")


def match_records(matches: Column) -> Column:
    """Matches without their text."""
    return F.transform(
        matches,
        lambda m: F.struct(
            m["pattern_id"].alias("pattern_id"), m["category"].alias("category"), m["severity"].alias("severity"), m["offset"].alias("offset"),
            F.octet_length(m["text"]).cast("long").alias("text_len"), sha_prefix(m["text"]).alias("text_sha256"),
        ),
    )


def events(scanned: DataFrame, ts: Column, tool_name: Column, sensitivity: str, mode: str) -> DataFrame:
    """Audit events of blocking rows of scan()."""
    return scanned.where("verdict = 'block'").select(
        ts.alias("ts"), tool_name.alias("tool_name"), F.lit(sensitivity).alias("sensitivity"), F.lit(mode).alias("mode"), "verdict", "score",
        F.size("matches").cast("long").alias("num_matches"), F.lit(mode == "block").alias("redacted"), match_records(F.col("matches")).alias("matches"),
    )


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed events with file and position; lines that lack a required field are skipped, a missing path is empty."""
    try:
        lines = spark.read.schema(SCHEMA).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA + ", file string, position bigint")
    lines = lines.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("position"))
    return lines.where(" and ".join(f"{c} is not null" for c in REQUIRED)).withColumn("matches", F.coalesce("matches", F.array().cast(MATCHES)))


def query(log: DataFrame, since: Column | None = None, verdict: str | None = None, tool: str | None = None, limit: int | None = None, order: tuple[str, ...] = ("file", "position")) -> DataFrame:
    """Events that meet all conditions, newest (last in order) first; limit becomes a top-k."""
    if limit is not None and limit < 1:
        raise ValueError("limit is 1 or more")
    out = log
    if since is not None:
        out = out.where(F.col("ts") >= since)
    if verdict is not None:
        out = out.where(F.col("verdict") == verdict)
    if tool is not None:
        out = out.where(F.col("tool_name").contains(tool))
    out = out.orderBy(*[F.desc(c) for c in order])
    return out if limit is None else out.limit(limit)


def _cell(text: Column, width: int) -> Column:
    """text filled up with spaces; a longer one stays whole."""
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


#: What stands above table_lines, and instead of them where there are none.
TABLE_HEAD = [f"{'ts':<25} {'verdict':<7} {'score':<6} {'matches':<7} tool_name", "-" * 100]
NO_EVENTS = "(no matching events)"


def table_lines(log: DataFrame) -> DataFrame:
    """log with a fixed-width line for each event."""
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    cells = [_cell(ts, 25), _cell(F.col("verdict"), 7), _cell(fixed_point(F.col("score"), 1), 6), _cell(F.col("num_matches").cast("string"), 7), F.col("tool_name")]
    return log.withColumn("line", F.concat_ws(" ", *cells))


def detail_lines(log: DataFrame) -> DataFrame:
    """log with lines, an array: the event and each of its matches, without matched text."""
    micros = F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1_000_000))
    six = F.lpad(micros.cast("string"), 6, "0")
    fraction = F.when(micros == 0, "").when(micros % 1000 == 0, F.concat(F.lit("."), F.left(six, F.lit(3)))).otherwise(F.concat(F.lit("."), six))
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    head = F.array(
        text("Event ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), fraction, "+00:00"),
        text("  tool:        ", F.col("tool_name")),
        text("  verdict:     ", F.col("verdict"), "  (mode=", F.col("mode"), " sensitivity=", F.col("sensitivity"), ")"),
        text("  score:       ", fixed_point(F.col("score"), 2), " across ", F.col("num_matches"), " matches"),
        text("  redacted:    ", F.col("redacted")),
    )
    one = lambda m, i: F.array(
        text("  match[", i, "]:    ", m["pattern_id"], " (", m["category"], "/", m["severity"], ")"),
        text("               offset=", m["offset"], " text_len=", m["text_len"], " sha256=", m["text_sha256"]),
        text("               \u2192 explain ", m["pattern_id"]),
    )
    return log.withColumn("lines", F.concat(head, F.flatten(F.transform("matches", one))))
