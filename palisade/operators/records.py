"""JSON records: strings to scan, recursive compression, routing of lines and hook envelopes.

Python is used where nested JSON of any shape must be walked in order or rewritten with its key order; all else is JVM expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from palisade.functions.catalogue import THRESHOLDS
from palisade.functions.text import fixed_point, strip_invisible
from palisade.operators.detect import Allow, blocks, keep_disallowed, let, match_array, once, score, verdict
from palisade.operators.reports import raw_line, safe_line

# Shortest string that is not scanned, message fields, depth that parsing allows, error code.
SHORT, MESSAGE_FIELDS, DEPTH, ERROR_CODE = 3, ("messages", "history", "results", "items", "entries"), 128, -32001
CONTENT_FIELDS = ("content", "text", "body", "message", "description", "caption")
BLOCKED = "request blocked: its result looks like a prompt injection"
OVERSIZED = "message blocked: it is larger than a record may be"


# as types, for reading a type's text takes a session, which a Python worker has not
_TEXT, _TEXTS, _LONG = T.StringType(), T.ArrayType(T.StringType()), T.LongType()
_COMPRESSED = T.StructType([T.StructField("out", _TEXT), T.StructField("original_size", _LONG), T.StructField("compressed_size", _LONG)])
_OPENED = T.StructType([T.StructField("id", _TEXT), T.StructField("strings", _TEXTS), T.StructField("rewritten", _TEXT)])
_ENVELOPE = T.StructType([T.StructField("problem", _TEXT), T.StructField("tool_name", _TEXT), T.StructField("strings", _TEXTS)])


@dataclass(frozen=True)
class Compression:
    """Limits of 0 are off."""

    max_content_length: int = 0
    strip_fields: tuple[str, ...] = ()
    content_fields: tuple[str, ...] = ()
    max_messages: int = 0
    max_array_items: int = 0


def _constant(name: str):
    raise ValueError(name)


def parse(raw: str):
    """The value of strict JSON, else ValueError: no NaN or Infinity, no lone surrogates, at most DEPTH levels."""
    try:
        value = json.loads(raw, parse_constant=_constant)
    except RecursionError as e:
        raise ValueError("too deep") from e
    todo = [(value, 1)]
    while todo:
        v, depth = todo.pop()
        if depth > DEPTH:
            raise ValueError("too deep")
        if isinstance(v, dict):
            todo += [(x, depth + 1) for x in v.values()]
            todo += [(k, depth) for k in v]
        elif isinstance(v, list):
            todo += [(x, depth + 1) for x in v]
        elif isinstance(v, str) and not v.isascii():
            v.encode()
    return value


def dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def walk(value) -> Iterator[str]:
    """Strings of more than SHORT bytes in reading order, each key before its value."""
    if isinstance(value, str):
        if len(value.encode()) > SHORT:
            yield value
    elif isinstance(value, dict):
        for k, v in value.items():
            if len(k.encode()) > SHORT:
                yield k
            yield from walk(v)
    elif isinstance(value, list):
        for v in value:
            yield from walk(v)


@F.pandas_udf(_TEXTS)
def extract_strings(docs: pd.Series) -> pd.Series:
    """The strings of a JSON document in order; none if it does not parse."""

    def one(raw):
        try:
            return list(walk(parse(raw))) if raw is not None else []
        except ValueError:
            return []

    return docs.map(one)


def _cut(s: str, most: int) -> str:
    return s.encode()[:most].decode("utf-8", "ignore")


def _rewrite(value, name: str, c: Compression):
    if isinstance(value, dict):
        return {k: _rewrite(v, k, c) for k, v in value.items() if k not in c.strip_fields}
    if isinstance(value, list):
        if c.max_messages and name in MESSAGE_FIELDS:
            value = value[-c.max_messages :]
        if c.max_array_items:
            value = value[-c.max_array_items :]
        return [_rewrite(v, "", c) for v in value]
    if isinstance(value, str):
        if len(value) > 1 and value[0] in "{[":
            try:
                return dump(_rewrite(parse(value), "", c))
            except ValueError:
                pass
        size = len(value.encode())
        if c.max_content_length and name in c.content_fields and size > c.max_content_length:
            kept = _cut(value, c.max_content_length)
            return f"{kept}...[truncated {size - len(kept.encode())} chars]"
    return value


def compress_text(raw: str, c: Compression) -> str:
    try:
        return dump(_rewrite(parse(raw), "", c))
    except ValueError:
        return raw


def compressor(c: Compression):
    """A column function: JSON text -> struct(out, original_size, compressed_size); what does not parse stays as it is."""

    @F.pandas_udf(_COMPRESSED)
    def compress(docs: pd.Series) -> pd.DataFrame:
        out = docs.map(lambda x: compress_text(x, c) if x is not None else None)
        size = lambda s: s.map(lambda x: len(x.encode()) if x is not None else 0).astype("int64")
        return pd.DataFrame({"out": out, "original_size": size(docs), "compressed_size": size(out)})

    return compress


@dataclass(frozen=True)
class Routing:
    sensitivity: str = "medium"
    action: str = "warn"
    allow: Allow = field(default_factory=Allow)
    compression: Compression = field(default_factory=Compression)
    scan_only: bool = False
    compress_only: bool = False

    def __post_init__(self):
        if self.scan_only and self.compress_only:
            raise ValueError("scan_only and compress_only exclude each other")


def opener(how: Routing):
    """A column function: a line -> struct(id, strings, rewritten); a null where the line is no object or has no result.

    strings are those of the result, to be scanned; rewritten is the line with its result compressed in place, key order kept.
    """

    def one(raw):
        try:
            v = parse(raw) if raw and raw[0] == "{" else None
        except ValueError:
            v = None
        if not isinstance(v, dict) or "result" not in v:
            return None, None, None
        strings = [] if how.compress_only else list(walk(v["result"]))
        if not how.scan_only:
            v["result"] = _rewrite(v["result"], "", how.compression)
        return dump(v["id"]) if "id" in v else None, strings, dump(v)

    @F.pandas_udf(_OPENED)
    def open_(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in lines], columns=["id", "strings", "rewritten"], dtype=object)

    return open_


def process_lines(lines: DataFrame, how: Routing, value: str = "value") -> DataFrame:
    """lines with out, route and blocking; route is passthrough, blocked, rewritten or oversized. Row by row: no shuffle, batch or stream.

    A line that does not start with {, does not parse or has no result passes byte for byte. Scanning comes before
    compression, so what compression cuts off is scanned as well. blocking counts blocking strings. A line whose column fits
    (see sources.lines) is false is not opened: an error takes its place, whatever the action.
    """
    fits = F.col("fits") if "fits" in lines.columns else F.lit(True)
    kept = [F.col(f"`{c}`") for c in lines.columns]
    m = lines.select(*kept, opener(how)(F.when(fits, F.col(value))).alias("m_"))
    per_string = F.filter("m_.strings", lambda s: blocks(s, how.sensitivity, how.allow))
    m = once(m, "blocking", F.when(F.col("m_.strings").isNull(), 0).otherwise(F.size(per_string)).cast("long"))
    handled, error = F.col("m_.rewritten").isNotNull(), lambda text: f'{{"jsonrpc":"2.0","error":{{"code":{ERROR_CODE},"message":"{text}"}}'
    blocked = handled & (F.col("blocking") > 0) & F.lit(how.action == "block")
    with_id = F.concat(F.lit(error(BLOCKED)), F.coalesce(F.concat(F.lit(',"id":'), F.col("m_.id")), F.lit("")), F.lit("}"))
    route = F.when(~fits, "oversized").when(~handled, "passthrough").when(blocked, "blocked").otherwise("rewritten")
    out = F.when(~fits, F.lit(error(OVERSIZED) + "}")).when(~handled, F.col(value)).when(blocked, with_id).otherwise(F.col("m_.rewritten"))
    return m.select(*kept, out.alias("out"), route.alias("route"), "blocking").drop("fits")


def counters(value: str = "value") -> list[Column]:
    """Aggregates of processed lines: total, processed, bytes in and out, warnings, blocks; for agg() or observe()."""
    n = lambda c: F.count(F.when(c, 1))
    size = lambda c: F.coalesce(F.sum(F.octet_length(c).cast("long")), F.lit(0))
    strings = F.coalesce(F.sum("blocking"), F.lit(0))
    return [F.count(F.lit(1)).alias("total"), n(F.col("route").isin("blocked", "rewritten")).alias("processed"), size(value).alias("bytes_in"), size("out").alias("bytes_out"), strings.alias("warnings"), strings.alias("blocks"), n(F.col("route") == "oversized").alias("oversized")]


def line_stats(processed: DataFrame, value: str = "value") -> DataFrame:
    """Counters of processed lines and the share of bytes saved."""
    g = processed.agg(*counters(value))
    return g.withColumn("saved_percent", F.when(F.col("bytes_in") > 0, (F.col("bytes_in") - F.col("bytes_out")) / F.col("bytes_in") * 100))


@F.pandas_udf(_ENVELOPE)
def open_envelope(envelopes: pd.Series) -> pd.DataFrame:
    """What is wrong with an envelope, if anything; its tool; the strings of its response, then those of its input (null without either)."""

    def one(raw):
        try:
            v = parse(raw or "")
        except ValueError as e:
            return f"not JSON: {type(e).__name__}", None, None
        if not isinstance(v, dict):
            return "not an object", None, None
        tool = v.get("tool_name", "")
        if not isinstance(tool, str):
            return "tool_name is not a string", None, None
        parts = [v[k] for k in ("tool_response", "tool_input") if v.get(k) is not None]
        return None, tool, [s for p in parts for s in walk(p)] if parts else None

    return pd.DataFrame([one(x) for x in envelopes], columns=["problem", "tool_name", "strings"], dtype=object)


def bad_envelopes(envelopes: DataFrame, key: str = "envelope_id", value: str = "value") -> DataFrame:
    """(key, problem) of envelopes that cannot be read; hook() gives no row for them."""
    return envelopes.select(key, open_envelope(F.col(value))["problem"].alias("problem")).where("problem is not null")


def hook(envelopes: DataFrame, sensitivity: str = "medium", mode: str = "warn", allow: Allow = Allow(), key: str = "envelope_id", value: str = "value", excerpts: bool = False) -> DataFrame:
    """(key, tool_name, num_matches, score, verdict, redacted, redaction, headline, report) of blocking hook envelopes; passing ones give no row.

    Strings of the response come before those of the input, and one verdict covers both, row by row. redaction is set in block mode.
    report has a line for each match, without matched text unless excerpts are asked for.
    """
    if sensitivity not in THRESHOLDS:
        raise ValueError(f"sensitivity {sensitivity!r} is not low, medium or high")
    if mode not in ("warn", "block"):
        raise ValueError(f"mode {mode!r} is neither warn nor block")
    e = envelopes.select(key, open_envelope(F.col(value)).alias("e")).select(key, "e.tool_name", "e.strings").where("strings is not null")
    e = once(e, "matches", F.flatten(F.transform("strings", lambda s: let(strip_invisible(s), lambda c: keep_disallowed(match_array(c), allow)))))
    e = once(e.drop("strings"), "score", score(F.col("matches")))
    e = e.withColumn("verdict", verdict(F.col("matches"), F.col("score"), sensitivity)).where("verdict = 'block'")
    n, tenths = F.size("matches").cast("long"), fixed_point(F.col("score"), 1)
    notice = F.concat(F.lit("[redacted: possible prompt injection (score="), tenths, F.lit(", "), n.cast("string"), F.lit(" pattern matches)]"))
    slot = F.when(F.col("tool_name").startswith("mcp__"), F.lit("updatedMCPToolOutput")).otherwise(F.lit("updatedToolOutput"))
    body = F.concat(F.lit('{"hookSpecificOutput":{"hookEventName":"PostToolUse","'), slot, F.lit('":"'), notice, F.lit('"}}'))
    redacted = F.lit(mode == "block")
    label = "BLOCKED: injection detected (redacted)" if mode == "block" else "WARNING: potential injection"
    headline = F.concat(F.lit(f"{label} on "), F.col("tool_name"), F.lit(" (score="), tenths, F.lit(", "), n.cast("string"), F.lit(" matches)"))
    report = F.transform("matches", lambda m: raw_line(m) if excerpts else safe_line(m))
    return e.select(key, "tool_name", n.alias("num_matches"), "score", "verdict", redacted.alias("redacted"), F.when(redacted, body).alias("redaction"), headline.alias("headline"), report.alias("report"))
