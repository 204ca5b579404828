"""Column functions on text: normalisation, hosts, byte-safe truncation, digests. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: invisible format characters that are dropped before matching (tag characters U+E0001-E007F stay).
INVISIBLE = (
    r"[\x{AD}\x{600}-\x{605}\x{61C}\x{6DD}\x{70F}\x{890}-\x{891}\x{8E2}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}"
    r"\x{FEFF}\x{FFF9}-\x{FFFB}\x{110BD}\x{110CD}\x{13430}-\x{1343F}\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}]"
)
#: A quick look that all invisible characters pass and most others do not.
_MAY_BE = r"(?=[\x{AD}\x{600}-\x{2FFF}\x{E000}-\x{10FFFF}])"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def strip_invisible(text: Column) -> Column:
    plain = F.octet_length(text) == F.length(text)  # ASCII only
    return F.when(text.isNull(), "").when(plain, text).otherwise(F.regexp_replace(text, _MAY_BE + INVISIBLE, ""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def url_host(text: Column) -> Column:
    """Host of the first :// or else the first //; null if there is none, or it is empty or malformed."""
    at = F.when(F.instr(text, "://") > 0, F.instr(text, "://") + 3).when(F.instr(text, "//") > 0, F.instr(text, "//") + 2)
    authority = F.regexp_extract(F.substring(text, at, F.length(text)), r"(?U)^[^/?#\s]*", 0)
    bare = F.regexp_extract(authority, r"[^@]*$", 0)
    v6 = F.regexp_extract(bare, r"^\[[^\]]*\]", 0)
    host = F.when(bare.startswith("["), v6).otherwise(F.split_part(bare, F.lit(":"), F.lit(1)))
    clean = ascii_lower(F.regexp_replace(F.trim(host), r"\.+$", ""))
    return F.when(at.isNotNull() & (clean != ""), clean)


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest prefix of at most `most` bytes that ends between characters."""
    raw = text.cast("binary")
    tries = [F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(min(4, most + 1))]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*tries, F.lit("")))


def shorten(text: Column, most: int) -> Column:
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(truncate_bytes(text, most), F.lit("...")))


def truncate_marked(text: Column, most: int) -> Column:
    """A content string cut to `most` bytes with a note of the bytes dropped; 0 is no limit."""
    if most <= 0:
        return text
    cut = truncate_bytes(text, most)
    note = F.concat(cut, F.lit("...[truncated "), (F.octet_length(text) - F.octet_length(cut)).cast("string"), F.lit(" chars]"))
    return F.when(F.octet_length(text) <= most, text).otherwise(note)


def sha_prefix(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def tail(array: Column, most: int) -> Column:
    """The last `most` items of an array; 0 is no limit."""
    return array if most <= 0 else F.when(F.size(array) > most, F.slice(array, -most, most)).otherwise(array)


def fixed_point(number: Column, digits: int) -> Column:
    """A number with that many decimals and no thousands marks; ties go to the even digit."""
    return F.call_function("format_number", number, F.lit("0." + "0" * digits))


def quoted(text: Column) -> Column:
    """text in double quotes, with quotes, backslashes, control and other undisplayed characters escaped."""

    def one(c: Column) -> Column:
        plain = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}
        out = F.when(c.rlike(r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}\p{Zl}\p{Zp}]"), F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(c))), F.lit("}"))).otherwise(c)
        for k, v in plain.items():
            out = F.when(c == k, F.lit(v)).otherwise(out)
        return out

    return F.concat(F.lit('"'), F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one), ""), F.lit('"'))
