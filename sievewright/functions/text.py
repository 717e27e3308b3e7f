"""Column builders for text, paths and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+"
#: Everything that ends a line, as Python's splitlines has it.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


#: A boundary between an ASCII letter, digit or underscore and anything else, as SQL's patterns have it; Java's own takes letters of
#: all scripts for parts of a word.
ASCII_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_words(pattern: str) -> str:
    r"""The pattern with ``\b`` as a boundary of ASCII words."""
    return pattern.replace(r"\b", ASCII_BOUNDARY)


def tokens(text: Column) -> Column:
    """Identifiers and numbers in lower case, repeats kept."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def lines(text: Column, end: str = LINE_END) -> Column:
    """Lines without their ends; no empty line behind a last line end."""
    parts = F.split(text, end, -1)
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def url_path(url: Column) -> Column:
    """The path of a URL, without query, fragment and slashes at either end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/?#]*", ""), r"[?#].*$", ""), r"^/+|/+$", "")


def file_role(path: Column) -> Column:
    """documentation, test, implementation or other; the first that holds."""
    p = F.lower(path)
    return F.when(p.rlike(r"\.(md|txt|rst|html)$") | p.rlike(r"(^|/)docs?(/|$)"), "documentation").when(p.rlike(r"(^|/)tests?(/|$)"), "test").when(p.rlike(r"(^|/)[a-z]{2}/[0-9]+$"), "implementation").otherwise("other")


def slug(text: Column) -> Column:
    """Lower-case words joined by hyphens, 120 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 120)


def uuid5_url(name: Column) -> Column:
    """UUID version 5 over the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "utf-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
