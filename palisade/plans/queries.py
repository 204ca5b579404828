"""Registered queries of the engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.functions.catalogue import DIVERSITY, PATTERNS, RATIONALE, THRESHOLDS, WEIGHTS, patterns_df, rationale_df, threshold
from palisade.functions.text import INVISIBLE, sha_prefix, strip_invisible, tail, truncate_bytes, truncate_marked, url_host
from palisade.operators.detect import Allow, dedup, envelope_verdicts, match_rows, once, record_verdicts, scan
from palisade.operators.records import Compression, Routing, compressor, extract_strings, hook, line_stats, process_lines
from palisade.operators.reports import explain, safe_line
from palisade.plans import seeds
from palisade.plans.seeds import probes_sql, sql_text
from palisade.sources import audit
from palisade.sources.tables import work_folder
from palisade.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# ---------------------------------------------------------------- shared SQL


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(sql_text(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_CLASS = INVISIBLE
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_P = f"p(pattern_id, category, severity, pattern_type, rx) AS (VALUES {_rows(PATTERNS)})"
_WEIGHT = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"
_DOCS = f"{probes_sql()}, texts AS (SELECT d.doc_id, d.lang, d.source, concat_ws(' ', d.text, snippet) AS text FROM documents d LEFT JOIN probes ON d.doc_id % {len(seeds.SNIPPETS)} = k)"
_TURNS = f"{probes_sql()}, texts AS (SELECT c.conv_id, c.turn, c.role, c.conv_id * 100 + c.turn AS doc_id, concat_ws(' ', c.text, snippet) AS text FROM conversations c LEFT JOIN probes ON (c.conv_id * 7 + c.turn) % {len(seeds.SNIPPETS)} = k)"
_NORM = f"norm AS MATERIALIZED (SELECT *, regexp_replace(coalesce(text, ''), '{_CLASS}', '', 'g') AS t FROM texts)"
_COUNT = f"CASE WHEN pattern_type = 'literal' THEN (strlen(t) - strlen(replace({_LOW.format('t')}, rx, ''))) // strlen(rx) ELSE len(regexp_extract_all(t, rx)) END"
_HITS = f"hits AS MATERIALIZED (SELECT * FROM (SELECT doc_id, pattern_id, category, severity, CAST({_COUNT} AS BIGINT) AS n FROM norm, p) WHERE n > 0)"


def _scored(hits: str = "hits", keys: str = "doc_id", source: str = "norm") -> str:
    return (
        f"sums AS (SELECT {keys}, sum(n) AS n, sum(n * {_WEIGHT}) AS w, count(DISTINCT category) AS kinds, bool_or(severity = 'critical') AS critical FROM {hits} GROUP BY {keys}), "
        f"scored AS (SELECT {keys}, CAST(coalesce(n, 0) AS BIGINT) AS num_matches, coalesce(w + {DIVERSITY}::DOUBLE * (kinds - 1), 0::DOUBLE) AS score, coalesce(critical, false) AS critical "
        f"FROM (SELECT DISTINCT {keys} FROM {source}) LEFT JOIN sums USING ({keys}))"
    )


def _verdict(sensitivity: str) -> str:
    return f"CASE WHEN num_matches > 0 AND (critical OR score >= {THRESHOLDS[sensitivity]}) THEN 'block' ELSE 'pass' END"


_BASE = f"WITH {_P}, {_DOCS}, {_NORM}, {_HITS}"
_TURN_BASE = f"WITH {_P}, {_TURNS}, {_NORM}, {_HITS}"


def _register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _n() -> F.Column:
    return F.size("matches").cast("long").alias("num_matches")


# ---------------------------------------------------------------- verdicts of documents


def _doc_verdict(sensitivity: str) -> Query:
    return lambda spark, d: scan(seeds.documents(spark, d), "text", sensitivity, offsets=False).select("doc_id", _n(), "score", "verdict")


for _s in THRESHOLDS:
    _register(f"doc_verdict_{_s}", _doc_verdict(_s), f"{_BASE}, {_scored()} SELECT doc_id, num_matches, score, {_verdict(_s)} AS verdict FROM scored")


def critical_docs(spark, d):
    return scan(seeds.documents(spark, d), offsets=False).where(F.exists("matches", lambda m: m["severity"] == "critical")).select("doc_id", "score")


_register("critical_docs", critical_docs, f"{_BASE}, {_scored()} SELECT doc_id, score FROM scored WHERE critical")


def _counts(*by: str) -> Query:
    def query(spark, d):
        m = scan(seeds.documents(spark, d), offsets=False).select(F.explode("matches").alias("m")).select("m.*")
        return m.groupBy(*by).agg(F.count("*").alias("n"))

    return query


for _by, _name in ((("pattern_id", "category", "severity"), "pattern"), (("category",), "category"), (("severity",), "severity")):
    _register(f"match_counts_by_{_name}", _counts(*_by), f"{_BASE} SELECT {', '.join(_by)}, CAST(sum(n) AS BIGINT) AS n FROM hits GROUP BY {', '.join(_by)}")


def _verdict_by(column: str) -> Query:
    def query(spark, d):
        s = scan(seeds.documents(spark, d), offsets=False)
        return s.groupBy(column).agg(F.count("*").alias("docs"), F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked"), F.sum("score").alias("score"))

    return query


for _c in ("lang", "source"):
    _register(
        f"verdicts_by_{_c}", _verdict_by(_c),
        f"{_BASE}, {_scored()} SELECT {_c}, count(*) AS docs, count(*) FILTER ({_verdict('medium')} = 'block') AS blocked, sum(score) AS score FROM scored JOIN texts USING (doc_id) GROUP BY {_c}",
    )


def match_facts(spark, d):
    return match_rows(scan(seeds.documents(spark, d)), "doc_id")


_PIECES = f"""CASE WHEN pattern_type = 'literal' THEN string_split({_LOW.format('t')}, rx) ELSE regexp_split_to_array(t, rx) END AS g,
  CASE WHEN pattern_type = 'literal' THEN list_transform(range(n), lambda x: rx) ELSE regexp_extract_all(t, rx) END AS m"""
_register(
    "match_facts", match_facts,
    f"""{_BASE}, parts AS (SELECT doc_id, t, pattern_id, h.category, h.severity, n, {_PIECES} FROM hits h JOIN norm USING (doc_id) JOIN p USING (pattern_id)),
spots AS (SELECT *, list_sum(list_transform(g[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: strlen(x))), 0) AS o, strlen(m[i]) AS size FROM parts, unnest(range(1, n + 1)) u(i))
SELECT doc_id, pattern_id, category, severity, CAST(o AS BIGINT) AS "offset", CAST(size AS BIGINT) AS text_len, substr(sha256(decode(encode(t)[o + 1 : o + size])), 1, 16) AS text_sha256 FROM spots""",
)


def dedup_matches(spark, d):
    s = scan(seeds.documents(spark, d))
    return s.select("doc_id", F.size(dedup(F.col("matches"))).cast("long").alias("n"))


_register("dedup_matches", dedup_matches, f"{_BASE}, {_scored()} SELECT doc_id, num_matches AS n FROM scored")


def strip_effect(spark, d):
    t = once(once(seeds.documents(spark, d), "text", F.col("text")), "s", strip_invisible(F.col("text")))
    return t.select("doc_id", (F.octet_length("text") - F.octet_length("s")).cast("long").alias("dropped"), F.md5(F.col("s").cast("binary")).alias("md5"))


_register("strip_effect", strip_effect, f"WITH {_DOCS}, {_NORM} SELECT doc_id, CAST(strlen(text) - strlen(t) AS BIGINT) AS dropped, md5(t) AS md5 FROM norm")

def match_reports(spark, d):
    m = scan(seeds.documents(spark, d)).select("doc_id", F.explode("matches").alias("m"))
    return m.select("doc_id", safe_line(F.col("m")).alias("line"))


_register("match_reports", match_reports, f"""SELECT doc_id, '  ' || pattern_id || ' [' || category || '/' || severity || '] offset=' || "offset" || ' len=' || text_len || ' sha256=' || text_sha256 AS line FROM ({SQL['match_facts']})""")

# ---------------------------------------------------------------- allow-lists


def allow_pattern_verdict(spark, d):
    return scan(seeds.documents(spark, d), "text", "medium", Allow(patterns=("ch-001", "ch-002", "ei-004")), offsets=False).select("doc_id", _n(), "score", "verdict")


_register(
    "allow_pattern_verdict", allow_pattern_verdict,
    f"{_BASE}, kept AS (SELECT * FROM hits WHERE pattern_id NOT IN ('ch-001', 'ch-002', 'ei-004')), {_scored('kept')} SELECT doc_id, num_matches, score, {_verdict('medium')} AS verdict FROM scored",
)

_WS = r"\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _host_sql(t: str) -> str:
    rest = f"CASE WHEN instr({t}, '://') > 0 THEN substr({t}, instr({t}, '://') + 3) WHEN instr({t}, '//') > 0 THEN substr({t}, instr({t}, '//') + 2) END"
    bare = f"regexp_extract(regexp_extract({rest}, '^[^/?#{_WS}]*'), '[^@]*$')"
    host = f"CASE WHEN starts_with({bare}, '[') THEN regexp_extract({bare}, '^\\[[^\\]]*\\]') ELSE split_part({bare}, ':', 1) END"
    return f"nullif({_LOW.format(f'regexp_replace(trim({host}), {chr(39)}\\.+${chr(39)}, {chr(39)*2})')}, '')"


def allow_host_verdict(spark, d):
    return scan(seeds.documents(spark, d), "text", "medium", Allow(hosts=("example.net", "example.com")), offsets=False).select("doc_id", _n(), "score", "verdict")


_OK = " OR ".join(f"h = '{x}' OR ends_with(h, '.{x}')" for x in ("example.net", "example.com"))
_register(
    "allow_host_verdict", allow_host_verdict,
    f"""{_BASE}, rxs AS (SELECT doc_id, pattern_id, h.category, h.severity, unnest(regexp_extract_all(t, rx)) AS x FROM hits h JOIN norm USING (doc_id) JOIN p USING (pattern_id) WHERE pattern_type = 'regex'),
hosts AS (SELECT *, {_host_sql('x')} AS h FROM rxs),
kept AS (SELECT doc_id, pattern_id, category, severity, count(*) AS n FROM hosts WHERE NOT coalesce({_OK}, false) GROUP BY ALL
  UNION ALL SELECT doc_id, pattern_id, hits.category, hits.severity, n FROM hits JOIN p USING (pattern_id) WHERE pattern_type = 'literal'),
{_scored('kept')} SELECT doc_id, num_matches, score, {_verdict('medium')} AS verdict FROM scored""",
)


def url_hosts(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", url_host(F.col("url")).alias("host"))


_register("url_hosts", url_hosts, f"SELECT page_id, {_host_sql('url')} AS host FROM pages")

# ---------------------------------------------------------------- records and envelopes


def conv_string_verdict(spark, d):
    return record_verdicts(scan(seeds.conversations(spark, d), offsets=False), "conv_id")


_PER_TURN = f"{_TURN_BASE}, {_scored()}, turns AS (SELECT t.conv_id, {_verdict('medium')} AS v FROM scored JOIN texts t USING (doc_id)), by_string AS (SELECT conv_id, count(*) FILTER (v = 'block') AS blocking, CASE WHEN bool_or(v = 'block') THEN 'block' ELSE 'pass' END AS verdict FROM turns GROUP BY conv_id)"
_register("conv_string_verdict", conv_string_verdict, f"{_PER_TURN} SELECT conv_id, blocking, verdict FROM by_string")


def conv_envelope_verdict(spark, d):
    return envelope_verdicts(scan(seeds.conversations(spark, d), offsets=False), "conv_id")


_ENVELOPE = f"{_TURN_BASE}, whole AS (SELECT conv_id, pattern_id, category, severity, n FROM hits JOIN texts USING (doc_id)), {_scored('whole', 'conv_id')}"
_register("conv_envelope_verdict", conv_envelope_verdict, f"{_ENVELOPE} SELECT conv_id, num_matches, score, {_verdict('medium')} AS verdict FROM scored")


def verdict_disagreement(spark, d):
    s = scan(seeds.conversations(spark, d), "text", "low", offsets=False)
    per = record_verdicts(s, "conv_id").select("conv_id", F.col("verdict").alias("by_string"))
    return envelope_verdicts(s, "conv_id", sensitivity="low").select("conv_id", F.col("verdict").alias("by_envelope")).join(per, "conv_id").where("by_string != by_envelope")


_register(
    "verdict_disagreement", verdict_disagreement,
    f"""{_TURN_BASE}, {_scored()}, a AS (SELECT t.conv_id, CASE WHEN bool_or({_verdict('low')} = 'block') THEN 'block' ELSE 'pass' END AS by_string FROM scored JOIN texts t USING (doc_id) GROUP BY 1),
whole AS (SELECT conv_id, category, severity, n FROM hits JOIN texts USING (doc_id)),
esums AS (SELECT conv_id, sum(n) AS n, sum(n * {_WEIGHT}) AS w, count(DISTINCT category) AS kinds, bool_or(severity = 'critical') AS critical FROM whole GROUP BY conv_id),
b AS (SELECT a.conv_id, a.by_string, CASE WHEN coalesce(critical OR w + {DIVERSITY} * (kinds - 1) >= {THRESHOLDS['low']}, false) THEN 'block' ELSE 'pass' END AS by_envelope FROM a LEFT JOIN esums USING (conv_id))
SELECT conv_id, by_envelope, by_string FROM b WHERE by_string <> by_envelope""",
)


def _envelopes(spark, d):
    t = seeds.conversations(spark, d)
    tool = F.when(F.col("role") == "user", "mcp__chat__user").when(F.col("role") == "assistant", "Bash").otherwise("Read")
    body = F.to_json(F.struct(tool.alias("tool_name"), F.struct(F.col("text").alias("content")).alias("tool_response")))
    return t.select((F.col("conv_id") * 100 + F.col("turn")).alias("envelope_id"), body.alias("value"))


def hook_redactions(spark, d):
    h = hook(_envelopes(spark, d), "medium", "block")
    slot = F.when(F.get_json_object("redaction", "$.hookSpecificOutput.updatedMCPToolOutput").isNotNull(), "updatedMCPToolOutput").otherwise("updatedToolOutput")
    return h.select("envelope_id", "tool_name", "num_matches", "score", "redacted", slot.alias("slot"))


_register(
    "hook_redactions", hook_redactions,
    f"""{_TURN_BASE}, {_scored()}, named AS (SELECT s.*, CASE role WHEN 'user' THEN 'mcp__chat__user' WHEN 'assistant' THEN 'Bash' ELSE 'Read' END AS tool_name FROM scored s JOIN texts USING (doc_id))
SELECT doc_id AS envelope_id, tool_name, num_matches, score, true AS redacted, CASE WHEN starts_with(tool_name, 'mcp__') THEN 'updatedMCPToolOutput' ELSE 'updatedToolOutput' END AS slot FROM named WHERE {_verdict('medium')} = 'block'""",
)


def redaction_notices(spark, d):
    return hook(_envelopes(spark, d), "medium", "block").select("envelope_id", "redaction", "headline")


_register(
    "redaction_notices", redaction_notices,
    f"""SELECT envelope_id, '{{"hookSpecificOutput":{{"hookEventName":"PostToolUse","' || slot || '":"[redacted: possible prompt injection (score=' || printf('%.1f', score) || ', ' || num_matches || ' pattern matches)]"}}}}' AS redaction,
  'BLOCKED: injection detected (redacted) on ' || tool_name || ' (score=' || printf('%.1f', score) || ', ' || num_matches || ' matches)' AS headline FROM ({SQL['hook_redactions']})""",
)


def _lines(spark, d):
    """Messages in every shape that the gates tell apart, by turn."""
    t = seeds.conversations(spark, d)
    key = F.col("conv_id") * 100 + F.col("turn")
    result = F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), key.alias("id"), F.struct(F.col("role").alias("kind"), F.col("text").alias("content")).alias("result")))
    shape = key % 5
    line = F.when(shape == 0, F.concat(F.lit(" "), result)).when(shape == 1, F.concat(F.lit("["), result, F.lit("]"))).when(shape == 2, F.concat(F.lit('{"jsonrpc":"2.0","id":'), key.cast("string"), F.lit(',"error":{"code":1}}'))).otherwise(result)
    return t.select(key.alias("line_id"), line.alias("value"))


def rpc_routes(spark, d):
    return process_lines(_lines(spark, d), Routing("medium", "block", scan_only=True)).select("line_id", "route", "blocking")


_SHAPED = f"{_TURN_BASE}, {_scored()}, lines AS (SELECT doc_id, doc_id % 5 AS shape, {_verdict('medium')} AS v FROM scored)"
_ROUTE = "CASE WHEN shape < 3 THEN 'passthrough' WHEN v = 'block' THEN 'blocked' ELSE 'rewritten' END"
_register("rpc_routes", rpc_routes, f"{_SHAPED} SELECT doc_id AS line_id, {_ROUTE} AS route, CAST(CASE WHEN shape >= 3 AND v = 'block' THEN 1 ELSE 0 END AS BIGINT) AS blocking FROM lines")


def rpc_errors(spark, d):
    out = process_lines(_lines(spark, d), Routing("medium", "block", scan_only=True)).where("route = 'blocked'")
    field = lambda p: F.get_json_object("out", p)
    return out.select("line_id", field("$.error.code").cast("long").alias("code"), field("$.id").cast("long").alias("id"))


_register("rpc_errors", rpc_errors, f"{_SHAPED} SELECT doc_id AS line_id, CAST(-32001 AS BIGINT) AS code, doc_id AS id FROM lines WHERE {_ROUTE} = 'blocked'")


def rpc_line_counts(spark, d):
    return line_stats(process_lines(_lines(spark, d), Routing("medium", "block", scan_only=True))).select("total", "processed", "warnings", "blocks")


_register("rpc_line_counts", rpc_line_counts, f"{_SHAPED} SELECT count(*) AS total, count(*) FILTER (shape >= 3) AS processed, count(*) FILTER (shape >= 3 AND v = 'block') AS warnings, count(*) FILTER (shape >= 3 AND v = 'block') AS blocks FROM lines")


def rewritten_lines(spark, d):
    out = process_lines(_lines(spark, d), Routing("medium", "block", scan_only=True)).where("route = 'rewritten'")
    return out.select("line_id", F.md5(F.col("out").cast("binary")).alias("md5"))


_register(
    "rewritten_lines", rewritten_lines,
    f"""{_SHAPED} SELECT doc_id AS line_id, md5('{{"jsonrpc":"2.0","id":' || doc_id || ',"result":{{"kind":' || to_json(role) || ',"content":' || to_json(text) || '}}}}') AS md5
FROM lines JOIN texts USING (doc_id) WHERE {_ROUTE} = 'rewritten'""",
)


def compressed_lines(spark, d):
    how = Routing("medium", "warn", compression=Compression(max_content_length=120, strip_fields=("kind",), content_fields=("content",)), compress_only=True)
    out = process_lines(_lines(spark, d), how).where("route = 'rewritten'")
    return out.select("line_id", F.md5(F.col("out").cast("binary")).alias("md5"), F.octet_length("out").cast("long").alias("size"))


_CUTS120 = "coalesce(" + ", ".join(f"try(decode(encode(text)[1:{120 - k}]))" for k in range(4)) + ")"
_register(
    "compressed_lines", compressed_lines,
    f"""WITH {_TURNS}, c AS (SELECT doc_id, text, CASE WHEN strlen(text) <= 120 THEN text ELSE {_CUTS120} END AS kept FROM texts WHERE doc_id % 5 >= 3),
o AS (SELECT doc_id, '{{"jsonrpc":"2.0","id":' || doc_id || ',"result":{{"content":' || to_json(CASE WHEN strlen(text) <= 120 THEN text ELSE kept || '...[truncated ' || (strlen(text) - strlen(kept)) || ' chars]' END) || '}}}}' AS s FROM c)
SELECT doc_id AS line_id, md5(s) AS md5, CAST(strlen(s) AS BIGINT) AS size FROM o""",
)


def stream_route(spark, d):
    """The lines as text files, routed by a stream and read back."""
    folder = work_folder(spark, "lines")
    _lines(spark, d).select("value").write.option("lineSep", "\n").text(f"{folder}/in")
    stream.write_ordered(stream.read_stream(spark, f"{folder}/in", 3), Routing("medium", "block", scan_only=True), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.select(F.regexp_extract("value", '"id":([0-9]+)', 1).cast("long").alias("line_id"), "route", "blocking")


_register("stream_route", stream_route, SQL["rpc_routes"])


def stream_verdicts(spark, d):
    """Blocking lines found by a stream and left in the audit log."""
    folder = work_folder(spark, "scan")
    t = seeds.conversations(spark, d)
    t.select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.option("lineSep", "\n").text(f"{folder}/in")
    stream.write_audit(stream.scan_stream(stream.read_stream(spark, f"{folder}/in", 3)), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return audit.read(spark, f"{folder}/log").groupBy("score", "num_matches").agg(F.count("*").alias("n"))


_register(
    "stream_verdicts", stream_verdicts,
    f"""WITH {_P}, {_TURNS.replace("concat_ws(' ', c.text, snippet) AS text", "regexp_replace(concat_ws(' ', c.text, snippet), '[' || chr(13) || chr(10) || ']+', ' ', 'g') AS text")}, {_NORM}, {_HITS}, {_scored()}
SELECT score, num_matches, count(*) AS n FROM scored WHERE {_verdict('medium')} = 'block' GROUP BY ALL""",
)


def extracted_strings(spark, d):
    t = seeds.conversations(spark, d)
    doc = F.to_json(F.struct(F.col("role").alias("role"), F.array("text", F.lit("abc")).alias("content")))
    return t.select("conv_id", "turn", F.posexplode(extract_strings(doc)).alias("pos", "s")).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.md5(F.col("s").cast("binary")).alias("md5"))


_register(
    "extracted_strings", extracted_strings,
    f"""WITH {_TURNS}, all_strings AS (SELECT conv_id, turn, list_filter(['role', role, 'content', text, 'abc'], lambda x: strlen(x) > 3) AS s FROM texts)
SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS pos, md5(s[i]) AS md5 FROM all_strings, unnest(range(1, len(s) + 1)) u(i)""",
)

# ---------------------------------------------------------------- compression


def truncated_content(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    return t.select("doc_id", F.md5(truncate_marked(F.col("text"), 203).cast("binary")).alias("md5"), F.octet_length(truncate_bytes(F.col("text"), 203)).cast("long").alias("kept"))


_CUTS = "coalesce(" + ", ".join(f"try(decode(encode(text)[1:{203 - k}]))" for k in range(4)) + ")"
_register(
    "truncated_content", truncated_content,
    f"""WITH c AS (SELECT doc_id, text, CASE WHEN strlen(text) <= 203 THEN text ELSE {_CUTS} END AS kept FROM documents)
SELECT doc_id, md5(CASE WHEN strlen(text) <= 203 THEN text ELSE kept || '...[truncated ' || (strlen(text) - strlen(kept)) || ' chars]' END) AS md5, CAST(strlen(kept) AS BIGINT) AS kept FROM c""",
)


def messages_tail(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet")
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    both = tail(tail(F.col("turns"), 4), 2)
    return g.select("conv_id", F.array_join(tail(F.col("turns"), 3).cast("array<string>"), ",").alias("last3"), F.array_join(both.cast("array<string>"), ",").alias("both"))


_register("messages_tail", messages_tail, "WITH g AS (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(t[-3:], ',') AS last3, array_to_string(t[-2:], ',') AS both FROM g")


def compressed_records(spark, d):
    t = seeds.conversations(spark, d)
    doc = F.to_json(F.struct("role", F.col("text").alias("content"), F.sequence(F.lit(1), (F.col("turn") + 1).cast("int")).alias("items")))
    c = compressor(Compression(max_content_length=120, strip_fields=("role",), content_fields=("content",), max_messages=3, max_array_items=2))
    field = lambda p: F.get_json_object("c.out", p)
    return t.select("conv_id", "turn", c(doc).alias("c")).select("conv_id", "turn", field("$.role").isNull().alias("stripped"), F.md5(field("$.content").cast("binary")).alias("md5"), field("$.items").alias("items"))


_CUTS120 = _CUTS.replace("203", "120").replace("202", "119").replace("201", "118").replace("200", "117")
_register(
    "compressed_records", compressed_records,
    f"""WITH {_TURNS}, c AS (SELECT conv_id, turn, text, CASE WHEN strlen(text) <= 120 THEN text ELSE {_CUTS120} END AS kept FROM texts)
SELECT conv_id, turn, true AS stripped, md5(CASE WHEN strlen(text) <= 120 THEN text ELSE kept || '...[truncated ' || (strlen(text) - strlen(kept)) || ' chars]' END) AS md5,
  '[' || array_to_string(range(1, turn + 2)[-2:], ',') || ']' AS items FROM c""",
)


def byte_reduction(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("text", truncate_marked(F.col("text"), 500).alias("out"))
    g = t.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes_in"), F.sum(F.octet_length("out").cast("long")).alias("bytes_out"))
    return g.withColumn("saved_percent", F.round(F.when(F.col("bytes_in") > 0, (F.col("bytes_in") - F.col("bytes_out")) / F.col("bytes_in") * 100), 6))


_CUTS500 = "coalesce(" + ", ".join(f"try(decode(encode(text)[1:{500 - k}]))" for k in range(4)) + ")"
_register(
    "byte_reduction", byte_reduction,
    f"""WITH c AS (SELECT text, CASE WHEN strlen(text) <= 500 THEN text ELSE {_CUTS500} END AS kept FROM documents),
s AS (SELECT CAST(sum(strlen(text)) AS BIGINT) AS bytes_in, CAST(sum(CASE WHEN strlen(text) <= 500 THEN strlen(text) ELSE strlen(kept) + strlen('...[truncated ' || (strlen(text) - strlen(kept)) || ' chars]') END) AS BIGINT) AS bytes_out FROM c)
SELECT bytes_in, bytes_out, round((bytes_in - bytes_out)::DOUBLE / bytes_in * 100, 6) AS saved_percent FROM s""",
)

# ---------------------------------------------------------------- audit


def _log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", "ts", F.col("event_type").alias("tool_name"), F.when(F.col("value") >= 50, "block").otherwise("pass").alias("verdict"), F.col("value").alias("score"))


_LOG = "WITH log AS (SELECT event_id, ts, event_type AS tool_name, CASE WHEN value >= 50 THEN 'block' ELSE 'pass' END AS verdict, value AS score FROM events)"
_SINCE = "2024-01-20 00:00:00"


def _audit(name: str, where: str, **conditions) -> None:
    def query(spark, d):
        since = F.lit(_SINCE).cast("timestamp_ntz") if conditions.get("since") else None
        return audit.query(_log(spark, d), since, conditions.get("verdict"), conditions.get("tool"), conditions.get("limit"), order=("event_id",)).select("event_id", "tool_name", "verdict", "score")

    limit = f" ORDER BY event_id DESC LIMIT {conditions['limit']}" if "limit" in conditions else ""
    _register(name, query, f"{_LOG} SELECT event_id, tool_name, verdict, score FROM log WHERE {where}{limit}")


_audit("audit_by_verdict", "verdict = 'block'", verdict="block")
_audit("audit_by_tool", "contains(tool_name, 'ic')", tool="ic")
_audit("audit_since", f"ts >= TIMESTAMP '{_SINCE}'", since=True)
_audit("audit_latest", "true", limit=20)
_audit("audit_combined", f"ts >= TIMESTAMP '{_SINCE}' AND verdict = 'block' AND contains(tool_name, 'e')", since=True, verdict="block", tool="e", limit=10)


def audit_events(spark, d):
    s = scan(seeds.documents(spark, d))
    e = audit.events(s, F.lit("2024-01-01 00:00:00").cast("timestamp"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), "medium", "warn")
    return e.select("tool_name", "mode", "verdict", "score", "num_matches", "redacted", F.aggregate("matches", F.lit(0).cast("long"), lambda a, m: a + m["text_len"]).alias("matched_bytes"))


_SIZES = f"list_sum(list_transform(CASE WHEN pattern_type = 'literal' THEN list_transform(range(n), lambda x: rx) ELSE regexp_extract_all(t, rx) END, lambda x: strlen(x)))"
_register(
    "audit_events", audit_events,
    f"""{_BASE}, {_scored()}, sizes AS (SELECT doc_id, sum({_SIZES}) AS b FROM hits JOIN norm USING (doc_id) JOIN p USING (pattern_id) GROUP BY doc_id)
SELECT 'doc-' || doc_id AS tool_name, 'warn' AS mode, 'block' AS verdict, score, num_matches, false AS redacted, CAST(b AS BIGINT) AS matched_bytes FROM scored JOIN sizes USING (doc_id) WHERE {_verdict('medium')} = 'block'""",
)

def audit_roundtrip(spark, d):
    """audit_events written to a log and read back."""
    folder = work_folder(spark, "audit")
    e = audit.events(scan(seeds.documents(spark, d)), F.lit("2024-01-01 00:00:00").cast("timestamp"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), "medium", "warn")
    audit.append(e, folder)
    return audit.query(audit.read(spark, folder), verdict="block", tool="doc-").select("tool_name", "mode", "verdict", "score", "num_matches", "redacted", F.aggregate("matches", F.lit(0).cast("long"), lambda a, m: a + m["text_len"]).alias("matched_bytes"))


_register("audit_roundtrip", audit_roundtrip, SQL["audit_events"])


def _event_log(spark, d):
    """The events as a log, in the order of their ids."""
    none = F.array().cast(audit.MATCHES)
    e = _log(spark, d).withColumn("tool_name", F.concat("tool_name", F.lit("-"), F.col("event_id").cast("string")))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "tool_name", F.lit("medium").alias("sensitivity"), F.lit("warn").alias("mode"), "verdict", "score", (F.col("event_id") % 9).alias("num_matches"), F.lit(False).alias("redacted"), none.alias("matches"))


def audit_file_order(spark, d):
    """The newest events of a log by file and place in it."""
    folder = work_folder(spark, "audit")
    audit.append(_event_log(spark, d).repartitionByRange(3, "event_id").sortWithinPartitions("event_id").drop("event_id"), folder)
    return audit.query(audit.read(spark, folder), verdict="block", limit=25).select("tool_name", "score")


_register("audit_file_order", audit_file_order, f"{_LOG} SELECT tool_name || '-' || event_id AS tool_name, score FROM log WHERE verdict = 'block' ORDER BY event_id DESC LIMIT 25")


def audit_lines(spark, d):
    return audit.table_lines(_event_log(spark, d)).select("event_id", "line")


_register(
    "audit_lines", audit_lines,
    f"""{_LOG} SELECT event_id, rpad(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 25, ' ') || ' ' || rpad(verdict, 7, ' ') || ' ' || rpad(printf('%.1f', score), CAST(greatest(6, len(printf('%.1f', score))) AS INTEGER), ' ') || ' ' || rpad(CAST(event_id % 9 AS VARCHAR), 7, ' ') || ' ' || tool_name || '-' || event_id AS line FROM log""",
)


def audit_details(spark, d):
    return audit.detail_lines(_event_log(spark, d)).select("event_id", F.array_join("lines", "|").alias("lines"))


_register(
    "audit_details", audit_details,
    f"""{_LOG} SELECT event_id, 'Event ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' WHEN epoch_us(ts) % 1000 = 0 THEN '.' || strftime(ts, '%g') ELSE '.' || strftime(ts, '%f') END || '+00:00|  tool:        ' || tool_name || '-' || event_id
  || '|  verdict:     ' || verdict || '  (mode=warn sensitivity=medium)|  score:       ' || printf('%.2f', score) || ' across ' || (event_id % 9) || ' matches|  redacted:    false' AS lines FROM log""",
)

# ---------------------------------------------------------------- catalogue

_RATIONALE = f"rationale(category, rationale) AS (VALUES {_rows(sorted(RATIONALE.items()))})"


def explain_patterns(spark, d):
    p = patterns_df(spark).join(F.broadcast(rationale_df(spark)), "category", "left")
    return p.select("pattern_id", "category", "severity", "pattern_type", F.md5(F.col("value").cast("binary")).alias("value_md5"), "rationale")


_register("explain_patterns", explain_patterns, f"WITH {_P}, {_RATIONALE} SELECT pattern_id, category, severity, pattern_type, md5(rx) AS value_md5, rationale FROM p LEFT JOIN rationale USING (category)")


def explain_ids(spark, d):
    """Answers for the ids that events name, most of them unknown."""
    ids = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("ch-00"), (F.col("event_id") % 9).cast("string")).alias("pattern_id")).distinct()
    return explain(ids).select("pattern_id", "known", "line", "rationale")


_register(
    "explain_ids", explain_ids,
    f"""WITH {_P}, {_RATIONALE}, ids AS (SELECT DISTINCT 'ch-00' || (event_id % 9) AS pattern_id FROM events)
SELECT i.pattern_id, p.rx IS NOT NULL AS known, CASE WHEN p.rx IS NULL THEN 'unknown pattern_id "' || i.pattern_id || '"' ELSE i.pattern_id || '  ' || p.category || '  ' || severity || '  ' || pattern_type || ' match' END AS line, rationale
FROM ids i LEFT JOIN p ON p.pattern_id = i.pattern_id LEFT JOIN rationale r ON r.category = p.category""",
)


def explain_hits(spark, d):
    m = match_rows(scan(seeds.documents(spark, d)), "doc_id").groupBy("pattern_id").agg(F.countDistinct("doc_id").alias("docs"))
    return m.join(F.broadcast(patterns_df(spark)), "pattern_id").select("pattern_id", "docs", "severity", "pattern_type")


_register("explain_hits", explain_hits, f"{_BASE} SELECT pattern_id, count(DISTINCT doc_id) AS docs, p.severity, p.pattern_type FROM hits JOIN p USING (pattern_id) GROUP BY ALL")


def categories_without_rationale(spark, d):
    return patterns_df(spark).select("category").distinct().join(rationale_df(spark), "category", "left_anti")


_register("categories_without_rationale", categories_without_rationale, f"WITH {_P}, {_RATIONALE} SELECT DISTINCT category FROM p WHERE category NOT IN (SELECT category FROM rationale)")


def solo_blocking_detectors(spark, d):
    p = patterns_df(spark)
    w = F.when(F.col("severity") == "critical", 2.0).when(F.col("severity") == "high", 1.5).when(F.col("severity") == "medium", 1.0).otherwise(0.5)
    return p.where((F.col("severity") == "critical") | (w >= threshold("medium"))).select("pattern_id", w.alias("weight"))


_register("solo_blocking_detectors", solo_blocking_detectors, f"WITH {_P} SELECT pattern_id, {_WEIGHT} AS weight FROM p WHERE severity = 'critical' OR {_WEIGHT} >= 1.0")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
