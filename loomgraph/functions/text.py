"""Scalar functions over labels and texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL_CAP = 256
# Direction and zero-width characters that are shown as escapes.
SHOWN_AS_ESCAPES = "\\u202A-\\u202E\\u2066-\\u2069\\u200B-\\u200F\\uFEFF\\p{Cc}"


def display_safe(s: Column) -> Column:
    """Controls and direction marks as ``\\u{XXXX}``; other text, the usual case, untouched."""
    risky = f"[{SHOWN_AS_ESCAPES}]"
    code = lambda c: F.concat(F.lit("\\u{"), F.lpad(F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 16), 4, "0"), F.lit("}"))
    shown = F.array_join(F.transform(F.split(s, ""), lambda c: F.when(c.rlike(risky), code(c)).otherwise(c)), "")
    return F.when(s.rlike(risky), shown).otherwise(s)


def sanitize_label(s: Column) -> Column:
    """Without control characters, at most 256 characters."""
    return F.substring(F.regexp_replace(s, r"\p{Cc}", ""), 1, LABEL_CAP)


def question_label(s: Column) -> Column:
    """A label to be read in a question: also without line separators, trimmed, never empty."""
    t = F.regexp_replace(sanitize_label(s), "[\\u2028\\u2029]", "")
    t = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    return F.when(t == "", "<unnamed>").otherwise(t)


def xml_escape(s: Column) -> Column:
    s = F.regexp_replace(s, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(raw), F.lit(entity))
    return s


def cypher_escape(s: Column) -> Column:
    for raw, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(raw), F.lit(escaped))
    return F.regexp_replace(s, "[\\x00-\\x1F]", "")


def md_link_text(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))


def yaml_token(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9._-]", "")


def yaml_quoted(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def field_key(s: Column) -> Column:
    return F.translate(s, "[]:", "")


def file_stem(s: Column) -> Column:
    """A label as a file name: separators and white space become underscores."""
    t = F.regexp_replace(sanitize_label(s), r"(?U)[/\s]", "_")
    return F.when(t == "", "_").otherwise(t)


def slug(s: Column) -> Column:
    """Lower case; runs of other than letters and digits become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\p{IsAlphabetic}\p{N}]+", "_"), "^_+|_+$", "")


def method_id(s: Column) -> Column:
    t = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(t == "", s).otherwise(t)


def stem_lower(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def crate_of(path: Column) -> Column:
    """The folder below a leading ``crates``, or the first segment, or ``root``."""
    parts = F.split(path, "/")
    first = F.element_at(parts, 1)
    own = F.when((first == "crates") & (F.size(parts) >= 2), F.get(parts, F.lit(1))).when(first != "", first)
    return F.coalesce(sanitize_label(own), F.lit("root"))


def lang_of(path: Column) -> Column:
    ext = F.element_at(F.split(path, r"\."), -1)
    return F.when(ext == "rs", "rust").when(ext == "py", "python").when(ext.isin("js", "ts", "tsx", "jsx"), "js").otherwise("other")


def estimate_tokens(s: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(s) / F.lit(4)).cast("bigint")


def span_bytes(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0))


def span_contains(start: Column, end: Column, byte: Column) -> Column:
    return (byte >= start) & (byte < end)


def span_well_formed(start: Column, end: Column, start_line: Column, end_line: Column) -> Column:
    return (start <= end) & (start_line <= end_line)
