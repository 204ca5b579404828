"""The detector catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Identifiers, categories, severities, kinds and expressions of the 55 detectors. Verdicts depend on each of them.
PATTERNS: list[tuple[str, str, str, str, str]] = [
    ("io-001", "instruction-override", "critical", "literal", r"ignore previous instructions"),
    ("io-002", "instruction-override", "critical", "literal", r"ignore all previous"),
    ("io-003", "instruction-override", "critical", "literal", r"disregard previous instructions"),
    ("io-004", "instruction-override", "high", "literal", r"forget your instructions"),
    ("io-005", "instruction-override", "high", "literal", r"from now on you will"),
    ("io-006", "instruction-override", "high", "literal", r"new instructions:"),
    ("io-007", "instruction-override", "critical", "regex", r"(?i)ignore[\t\n\f\r ]+(any|all|every)[\t\n\f\r ]+(prior|previous|earlier)[\t\n\f\r ]+(instructions?|prompts?|rules?)"),
    ("pm-001", "prompt-marker", "critical", "literal", r"<|im_start|>system"),
    ("pm-002", "prompt-marker", "high", "literal", r"<|im_start|>"),
    ("pm-003", "prompt-marker", "high", "literal", r"[system]:"),
    ("pm-004", "prompt-marker", "high", "literal", r"[inst]"),
    ("pm-005", "prompt-marker", "critical", "literal", r"<<sys>>"),
    ("pm-006", "prompt-marker", "high", "regex", r"(?i)\[/?INST\]"),
    ("ac-001", "authority-claim", "critical", "literal", r"i am your developer"),
    ("ac-002", "authority-claim", "high", "literal", r"i am the system administrator"),
    ("ac-003", "authority-claim", "high", "literal", r"dan mode"),
    ("ac-004", "authority-claim", "high", "literal", r"admin override"),
    ("ac-005", "authority-claim", "medium", "literal", r"you are now in"),
    ("ac-006", "authority-claim", "critical", "regex", r"(?i)(I[\t\n\f\r ]+am|this[\t\n\f\r ]+is)[\t\n\f\r ]+(your|the)[\t\n\f\r ]+(developer|creator|admin|administrator|owner)"),
    ("ei-001", "exfil-instruction", "critical", "literal", r"send all data to"),
    ("ei-002", "exfil-instruction", "high", "literal", r"exfiltrate"),
    ("ei-003", "exfil-instruction", "critical", "regex", r"(?i)send[\t\n\f\r ]+(all|the|this|your)[\t\n\f\r ]+(the[\t\n\f\r ]+)?(data|information|context|conversation)[\t\n\f\r ]+(and[\t\n\f\r ]+[0-9A-Za-z_]+[\t\n\f\r ]+)?to[\t\n\f\r ]+(https?://|//|[a-z0-9.-]+\.[a-z]{2,})"),
    ("ei-004", "exfil-instruction", "medium", "regex", r"(?i)(fetch|load|visit|open|navigate)[\t\n\f\r ]+(https?://|//)[^\t\n\f\r ]+"),
    ("ei-005", "exfil-instruction", "high", "regex", r"!\[(track|pixel|1x1|beacon|exfil)[0-9A-Za-z_]*\]\(https?://[^\)]+\)"),
    ("om-001", "output-manipulation", "medium", "literal", r"respond only with"),
    ("om-002", "output-manipulation", "medium", "literal", r"do not mention"),
    ("om-003", "output-manipulation", "high", "regex", r"(?i)never[\t\n\f\r ]+(mention|reveal|disclose|discuss)[\t\n\f\r ]+(that|this|the|your)"),
    ("om-004", "output-manipulation", "medium", "regex", r"(?i)(always|must|should)[\t\n\f\r ]+respond[\t\n\f\r ]+(with|by|using)[\t\n\f\r ]+"),
    ("tm-001", "tool-manipulation", "high", "literal", r"call the tool"),
    ("tm-002", "tool-manipulation", "high", "literal", r"use the function"),
    ("tm-003", "tool-manipulation", "high", "literal", r"execute command"),
    ("tm-004", "tool-manipulation", "high", "regex", r'''(?i)(invoke|run|call|use)[\t\n\f\r ]+(the[\t\n\f\r ]+)?(tool|function|mcp)[\t\n\f\r ]+["'`]'''),
    ("tm-005", "tool-manipulation", "critical", "regex", r"(?i)(call|invoke|run)[\t\n\f\r ]+mcp_[0-9A-Za-z_]+"),
    ("ch-001", "context-hijacking", "low", "literal", r"important:"),
    ("ch-002", "context-hijacking", "low", "literal", r"critical:"),
    ("ch-003", "context-hijacking", "medium", "literal", r"override:"),
    ("ch-004", "context-hijacking", "high", "literal", r"<system>"),
    ("ch-005", "context-hijacking", "high", "literal", r"</system>"),
    ("uo-001", "unicode-obfuscation", "high", "regex", r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]{3,}"),
    ("uo-002", "unicode-obfuscation", "medium", "regex", r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]{2,}"),
    ("uo-003", "unicode-obfuscation", "medium", "regex", r"[\x{E000}-\x{F8FF}]{2,}"),
    ("uo-004", "unicode-obfuscation", "high", "regex", r"[\x{E0001}-\x{E007F}]"),
    ("di-001", "delimiter-injection", "high", "literal", r"---end system prompt---"),
    ("di-002", "delimiter-injection", "high", "regex", r"(?i)-{3,}[\t\n\f\r ]*(END|BEGIN)[\t\n\f\r ]+(SYSTEM|USER|ASSISTANT)[\t\n\f\r ]+(PROMPT|MESSAGE|INSTRUCTIONS?)[\t\n\f\r ]*-{3,}"),
    ("di-003", "delimiter-injection", "high", "regex", r'\{[\t\n\f\r ]*"role"[\t\n\f\r ]*:[\t\n\f\r ]*"(system|assistant)"[\t\n\f\r ]*'),
    ("enc-001", "encoded-injection", "high", "regex", r"(?i)eval[\t\n\f\r ]*\([\t\n\f\r ]*atob[\t\n\f\r ]*\("),
    ("enc-002", "encoded-injection", "medium", "regex", r"(?i)base64[_\-]?decode"),
    ("enc-003", "encoded-injection", "medium", "regex", r"(?i)String\.fromCharCode[\t\n\f\r ]*\("),
    ("hi-001", "html-injection", "medium", "regex", r'''(?i)[\t\n\f\r ]on(load|error|click|focus|mouseover|submit|toggle|animationend)[\t\n\f\r ]*=[\t\n\f\r ]*["']'''),
    ("hi-002", "html-injection", "medium", "regex", r"(?i)data:text/html"),
    ("hi-003", "html-injection", "medium", "regex", r"(?i)data:application/(x-)?(java)?script"),
    ("hi-004", "html-injection", "high", "regex", r'''(?i)expression[\t\n\f\r ]*\([\t\n\f\r ]*['"a-z(]'''),
    ("hi-005", "html-injection", "high", "regex", r"<!--[\t\n\f\r ]*(?i)(ignore|disregard|forget)[\t\n\f\r ]+(any|all|previous|your)"),
    ("svg-001", "svg-injection", "medium", "regex", r"(?i)<svg[^>]*[\t\n\f\r ]on[0-9A-Za-z_]+[\t\n\f\r ]*="),
    ("svg-002", "svg-injection", "medium", "regex", r"(?i)<foreignObject[\t\n\f\r >]"),
]

# Weights of severities, what each category beyond the first adds, and the thresholds of sensitivities.
WEIGHTS = {"critical": 2.0, "high": 1.5, "medium": 1.0, "low": 0.5}
DIVERSITY = 0.25
THRESHOLDS = {"low": 2.0, "medium": 1.0, "high": 0.5}

#: Why a category matters; the two markup categories have no entry of their own.
RATIONALE = {
    "instruction-override": "Tries to replace the instructions that the model was given.",
    "prompt-marker": "Carries markers of prompt formats, which content has no business to hold.",
    "authority-claim": "Claims a role or mode that would entitle the author to give orders.",
    "exfil-instruction": "Asks for data to be sent, or for an address to be fetched that could carry it.",
    "output-manipulation": "Tells the model what to say or to keep silent about.",
    "tool-manipulation": "Tells the model to call tools or run commands.",
    "context-hijacking": "Imitates labels or tags with which context is structured.",
    "unicode-obfuscation": "Hides text in characters that are not displayed.",
    "delimiter-injection": "Imitates the delimiters between parts of a prompt.",
    "encoded-injection": "Hides a payload in an encoding that is decoded when run.",
}

PATTERN_SCHEMA = "pattern_id string, category string, severity string, pattern_type string, value string"


def patterns_df(spark: SparkSession) -> DataFrame:
    """The catalogue as a table of 55 rows."""
    return spark.createDataFrame(PATTERNS, PATTERN_SCHEMA)


def rationale_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(RATIONALE.items()), "category string, rationale string")


def threshold(sensitivity: str) -> float:
    """Unknown sensitivities count as medium."""
    return THRESHOLDS.get(sensitivity.lower(), THRESHOLDS["medium"])


def weight(severity: str) -> float:
    return WEIGHTS.get(severity, 1.0)
