"""Detection: which detectors match a text, where, and what verdict follows.

Matches stay in an array next to their text: detection, allow-lists, score and verdict of a text are one projection without a shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.catalogue import DIVERSITY, PATTERNS, WEIGHTS, threshold
from palisade.functions.text import sha_prefix, strip_invisible, url_host

MATCH = "struct<pattern_id:string,category:string,severity:string,text:string,offset:bigint>"


@dataclass(frozen=True)
class Allow:
    """Matches not to count: detectors by id, and any match whose text holds an address on one of the hosts or under it."""

    hosts: Sequence[str] = field(default_factory=tuple)
    patterns: Sequence[str] = field(default_factory=tuple)

    def clean_hosts(self) -> list[str]:
        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return [h for h in (h.strip().lstrip(".").translate(lower) for h in self.hosts) if h]


# Per expression: lower-case fragments of which each text that it fits holds one. Expressions without any fit only rare characters.
NEEDS: dict[str, tuple[str, ...]] = {
    "io-007": ("ignore",), "pm-006": ("inst]",), "ac-006": ("developer", "creator", "admin", "owner"), "ei-003": ("send",), "ei-004": ("//",), "ei-005": ("](http",), "om-003": ("never",),
    "om-004": ("respond",), "tm-004": ("tool", "function", "mcp"), "tm-005": ("mcp_",), "di-002": ("---",), "di-003": ('"role"',), "enc-001": ("atob",), "enc-002": ("base64",), "enc-003": ("fromcharcode",),
    "hi-001": ("onload", "onerror", "onclick", "onfocus", "onmouseover", "onsubmit", "ontoggle", "onanimationend"), "hi-002": ("data:text",), "hi-003": ("data:app",), "hi-004": ("expression",),
    "hi-005": ("<!--",), "svg-001": ("<svg",), "svg-002": ("<foreign",),
}
#: What to step over where an expression fails, since it would fail from any later start in there too; keeps matching linear.
SKIPS = {"svg-001": r"(?i:<svg)[^>]*+", "di-002": r"-++", "ei-005": r"!\[(?:track|pixel|1x1|beacon|exfil)[0-9A-Za-z_]*\]\(https?://[^\)]++"}
#: Characters without one of which no expression outside NEEDS fits.
RARE = r"[\x{200B}-\x{200D}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{E000}-\x{F8FF}\x{FEFF}\x{E0001}-\x{E007F}]"


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row, however often it is used; a projection would be copied into each use."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(value)).alias(name))


@functools.cache
def _detectors_sql(patterns: tuple) -> str:
    """The catalogue as an array literal, which the optimizer folds into one constant."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = []
    for pattern_id, category, severity, kind, value in patterns:
        literal, skip = kind == "literal", SKIPS.get(pattern_id)
        regex = rf"(?i)(?=(\Q{value}\E))" if literal else f"({value})|{skip}" if skip else value
        needs = (value,) if literal else NEEDS.get(pattern_id, ())
        fields = {"pattern_id": quote(pattern_id), "category": quote(category), "severity": quote(severity), "literal": str(literal).lower(), "regex": quote(regex), "grp": str(int(literal or bool(skip)))}
        fields["needs"] = f"cast(array({', '.join(map(quote, needs))}) as array<string>)"
        rows.append("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")")
    return f"array({', '.join(rows)})"


def prefix_sums(steps: Column) -> Column:
    """Sums of all items up to each, by blocks of the root of their number: no item is added more than twice that often."""
    long = lambda c: c.cast("long")
    total = lambda a: F.aggregate(a, long(F.lit(0)), lambda s, x: s + x)

    def by_blocks(s: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(s))).cast("int")

        def summed(w: Column) -> Column:
            starts = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / w).cast("int"))
            blocks = F.transform(starts, lambda b: total(F.slice(s, b * w + 1, w)))
            before = let(blocks, lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))))
            return let(before, lambda base: F.transform(s, lambda _, i: F.get(base, F.floor(i / w).cast("int")) + total(F.slice(s, (i - i % w) + 1, i % w + 1))))

        return F.when(F.size(s) > 0, let(width, summed)).otherwise(F.array().cast("array<bigint>"))

    return let(steps, by_blocks)


def _offsets(text: Column, p: Column, found: Column) -> Column:
    """Byte offset of each found item, those stepped over included."""
    size = lambda x: F.octet_length(x).cast("long")

    def of_literal(pieces: Column) -> Column:  # cut before each occurrence; one at the very start leaves no empty piece
        at_start = F.when(F.size(pieces) == F.size(found), F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        return F.concat(at_start, F.slice(F.transform(pieces, size), F.lit(1), F.size(pieces) - 1))

    def of_regex(gaps: Column) -> Column:
        whole = F.regexp_extract_all(text, p["regex"], F.lit(0))
        return let(whole, lambda w: F.transform(w, lambda _, i: size(F.get(gaps, i)) + F.coalesce(size(F.get(w, i - 1)), F.lit(0).cast("long"))))

    return prefix_sums(let(F.split(text, p["regex"], -1), lambda g: F.when(p["literal"], of_literal(g)).otherwise(of_regex(g))))


def match_array(text: Column, offsets: bool = True, patterns=tuple(PATTERNS)) -> Column:
    """All matches in an already normalised text, detector by detector; without offsets these are null and cost nothing.

    An expression is tried only on a text that holds one of its fragments, or a rare character where it has none. text is used several times.
    """

    def found_by(p: Column) -> Column:
        def label(x: Column, offset: Column) -> Column:
            return F.struct(p["pattern_id"].alias("pattern_id"), p["category"].alias("category"), p["severity"].alias("severity"), x.alias("text"), offset.alias("offset"))

        found = F.regexp_extract_all(text, p["regex"], p["grp"])
        if not offsets:
            return F.transform(F.filter(found, lambda x: x != ""), lambda x: label(x, F.lit(None).cast("bigint")))
        return let(found, lambda e: F.when(F.size(e) > 0, F.filter(F.zip_with(e, _offsets(text, p, e), label), lambda m: m["text"] != "")).otherwise(F.array().cast(f"array<{MATCH}>")))

    def in_lower(low: Column, rare: Column) -> Column:
        fits = lambda p: F.when(F.size(p["needs"]) == 0, rare).otherwise(F.exists(p["needs"], lambda f: F.contains(low, f)))
        return F.flatten(F.transform(F.filter(F.expr(_detectors_sql(patterns)), fits), found_by))

    rare = (F.octet_length(text) != F.length(text)) & text.rlike(RARE)
    return let(F.struct(F.lower(text).alias("low"), rare.alias("rare")), lambda t: in_lower(t["low"], t["rare"]))


def keep_disallowed(matches: Column, allow: Allow) -> Column:
    """Matches that the allow-list does not drop; an address without a clear host is never allowed."""
    out = matches
    if allow.patterns:
        out = F.filter(out, lambda m: ~m["pattern_id"].isin(list(allow.patterns)))
    hosts = allow.clean_hosts()
    if hosts:

        def allowed(m: Column) -> Column:
            host = url_host(m["text"])
            fits = F.lit(False)
            for h in hosts:
                fits = fits | (host == h) | host.endswith("." + h)
            return F.coalesce(fits, F.lit(False))

        out = F.filter(out, lambda m: ~allowed(m))
    return out


def dedup(matches: Column) -> Column:
    """First match of each detector and offset, in that order; matches without offsets cannot be told apart and are an error."""
    keyed = F.array_sort(F.transform(matches, lambda m, i: F.struct(m["pattern_id"].alias("id"), m["offset"].alias("offset"), i.alias("i"), m.alias("m"))))
    fresh = lambda k: F.filter(k, lambda x, i: (i == 0) | (x["id"] != F.get(k, i - 1)["id"]) | (x["offset"] != F.get(k, i - 1)["offset"]))
    unique = let(keyed, lambda k: F.transform(fresh(k), lambda x: x["m"]))
    return F.when(F.exists(matches, lambda m: m["offset"].isNull()), F.raise_error(F.lit("matches have no offsets")).cast(f"array<{MATCH}>")).otherwise(unique)


def severity_weight(severity: Column) -> Column:
    out = F.lit(1.0)
    for name, w in WEIGHTS.items():
        out = F.when(severity == name, F.lit(w)).otherwise(out)
    return out


def score(matches: Column) -> Column:
    """Sum of severity weights, and a bonus for each category beyond the first."""
    total = F.aggregate(matches, F.lit(0.0), lambda s, m: s + severity_weight(m["severity"]))
    kinds = F.size(F.array_distinct(F.transform(matches, lambda m: m["category"])))
    return total + F.greatest(kinds - 1, F.lit(0)) * F.lit(DIVERSITY)


def verdict(matches: Column, total: Column, sensitivity: str = "medium") -> Column:
    """block at any critical match or from the threshold on, else pass."""
    critical = F.exists(matches, lambda m: m["severity"] == "critical")
    return F.when((F.size(matches) > 0) & (critical | (total >= threshold(sensitivity))), "block").otherwise("pass")


def blocks(text: Column, sensitivity: str = "medium", allow: Allow = Allow()) -> Column:
    """Whether one text blocks, as an expression for use inside arrays of texts."""
    found = let(strip_invisible(text), lambda c: keep_disallowed(match_array(c, offsets=False), allow))
    return let(found, lambda m: verdict(m, score(m), sensitivity) == "block")


def scan(df: DataFrame, text: str = "text", sensitivity: str = "medium", allow: Allow = Allow(), offsets: bool = True) -> DataFrame:
    """df with matches, score and verdict of its text column; null texts are empty and pass.

    Where a column fits (see sources.lines) is false the text is not looked at, and the verdict is block.
    """
    if "fits" in df.columns:
        seen = scan(df.withColumn("seen_", F.when(F.col("fits"), F.col(text))).withColumnRenamed("fits", "fits_"), "seen_", sensitivity, allow, offsets).withColumnRenamed("fits_", "fits")
        return seen.drop("seen_").withColumn("verdict", F.when(F.col("fits"), F.col("verdict")).otherwise("block"))
    out = once(df, "clean_", strip_invisible(F.col(text)))
    out = once(out, "matches", keep_disallowed(match_array(F.col("clean_"), offsets), allow)).drop("clean_")
    out = out.withColumn("score", score(F.col("matches")))
    return out.withColumn("verdict", verdict(F.col("matches"), F.col("score"), sensitivity))


def match_rows(scanned: DataFrame, *keys: str) -> DataFrame:
    """A row for each match, by keys, without its text: digest, length and offset only."""
    m = scanned.select(*keys, F.explode("matches").alias("m"))
    text_len = F.octet_length("m.text").cast("long").alias("text_len")
    return m.select(*keys, "m.pattern_id", "m.category", "m.severity", "m.offset", text_len, sha_prefix(F.col("m.text")).alias("text_sha256"))


def join_matches(texts: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """Relational form: texts joined with any pattern table (broadcast; a catalogue of at most thousands of rows) where the pattern occurs.

    Keeps a row for each text and pattern with its number of hits n. For catalogues given as data; the built-in one is faster by scan().
    """
    if (size := patterns.limit(10_001).count()) > 10_000:
        raise ValueError(f"a catalogue of over 10000 rows ({size}) is not broadcast")
    literal = F.col("pattern_type") == "literal"
    regex = F.when(literal, F.concat(F.lit(r"(?i)(?=(\Q"), F.col("value"), F.lit(r"\E))"))).otherwise(F.col("value"))
    table = F.broadcast(patterns.select("pattern_id", "category", "severity", regex.alias("regex"), F.when(literal, 1).otherwise(0).alias("grp")))
    n = F.size(F.expr(f"regexp_extract_all(`{text}`, regex, grp)")).cast("long")
    return texts.join(table, F.expr(f"`{text}` rlike regex"), "inner").withColumn("n", n).drop("regex", "grp")


def envelope_verdicts(scanned: DataFrame, *keys: str, sensitivity: str = "medium") -> DataFrame:
    """One verdict for each group over the union of its texts' matches; groups without matches pass with 0.

    The group's weights and categories are summed by partial aggregates; no group's matches are gathered.
    """
    per = scanned.select(
        *keys,
        F.size("matches").cast("long").alias("n"),
        F.aggregate("matches", F.lit(0.0), lambda s, m: s + severity_weight(m["severity"])).alias("w"),
        F.array_distinct(F.transform("matches", lambda m: m["category"])).alias("kinds"),
        F.exists("matches", lambda m: m["severity"] == "critical").alias("critical"),
    )
    kinds = sorted({p[1] for p in PATTERNS})
    seen = [F.max(F.array_contains("kinds", k).cast("int")).alias(f"k{i}") for i, k in enumerate(kinds)]
    g = per.groupBy(*keys).agg(F.sum("n").alias("num_matches"), F.sum("w").alias("w"), F.max("critical").alias("critical"), *seen)
    n_kinds = sum((F.col(f"k{i}") for i in range(len(kinds))), F.lit(0))
    g = g.withColumn("score", F.col("w") + F.greatest(n_kinds - 1, F.lit(0)) * F.lit(DIVERSITY))
    block = (F.col("num_matches") > 0) & (F.col("critical") | (F.col("score") >= threshold(sensitivity)))
    return g.select(*keys, "num_matches", "score", F.when(block, "block").otherwise("pass").alias("verdict"))


def record_verdicts(scanned: DataFrame, *keys: str) -> DataFrame:
    """A record blocks if any of its texts blocks."""
    blocking = F.count(F.when(F.col("verdict") == "block", 1)).alias("blocking")
    g = scanned.groupBy(*keys).agg(blocking)
    return g.select(*keys, "blocking", F.when(F.col("blocking") > 0, "block").otherwise("pass").alias("verdict"))
