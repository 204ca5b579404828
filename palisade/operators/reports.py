"""Text reports: lines for matches, answers about detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.catalogue import patterns_df, rationale_df
from palisade.functions.text import quoted, sha_prefix, shorten


def _head(m: Column) -> list[Column]:
    return [F.lit("  "), m["pattern_id"], F.lit(" ["), m["category"], F.lit("/"), m["severity"], F.lit("]")]


def safe_line(m: Column) -> Column:
    """A match without its text: only what cannot carry a payload."""
    return F.concat(*_head(m), F.lit(" offset="), m["offset"].cast("string"), F.lit(" len="), F.octet_length(m["text"]).cast("string"), F.lit(" sha256="), sha_prefix(m["text"]))


def raw_line(m: Column, most: int = 80) -> Column:
    """A match with its text, quoted and cut to `most` bytes; for opted-in debugging only."""
    return F.concat(*_head(m), F.lit(": "), quoted(shorten(m["text"], most)))


def explain(ids: DataFrame, key: str = "pattern_id") -> DataFrame:
    """(key, known, line, pattern, rationale) for every row of ids; an unknown or null id is answered as such. The catalogue (55 rows) is broadcast."""
    spark = ids.sparkSession
    p = patterns_df(spark).join(F.broadcast(rationale_df(spark)), "category", "left").withColumnRenamed("pattern_id", "id_")
    j = ids.join(F.broadcast(p), F.col(key) == F.col("id_"), "left")
    known = F.col("id_").isNotNull()
    line = F.when(known, F.concat("id_", F.lit("  "), "category", F.lit("  "), "severity", F.lit("  "), "pattern_type", F.lit(" match"))).otherwise(F.concat(F.lit("unknown pattern_id "), quoted(F.coalesce(F.col(key), F.lit("")))))
    return j.select(key, known.alias("known"), line.alias("line"), F.col("value").alias("pattern"), "rationale")
