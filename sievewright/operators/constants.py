"""Documents that code refers to through a constant: an identifier in a snippet, its assignment in the same file, a string in that,
and the document of that name. Each step is a table and an equality join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines

#: How constants are written, how they get a value, and the strings in it.
CONSTANT = r"\b[A-Z][A-Z0-9_]{2,}\b"
ASSIGNED = r"^\s*(?:const\s+|let\s+|var\s+)?([A-Z][A-Z0-9_]{2,})(?:\s*:[^=]+)?\s*=\s*([^;]+)"
STRING = r"[\"']([^\"']+)[\"']"
DOCUMENTS = r"\.(?:md|json|yaml|yml|toml)$"


def base_name(path: Column) -> Column:
    """The last part of a path, in lower case."""
    return F.lower(F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1))


def assignments(files: DataFrame) -> DataFrame:
    """``(path, constant, value)``: what the first assignment to each constant of ``files(path, text)`` gives it, on its line."""
    rows = files.select("path", F.posexplode(F.filter(lines(F.col("text")), lambda x: x.rlike(ASSIGNED))).alias("no", "line"))
    found = rows.select("path", "no", F.regexp_extract("line", ASSIGNED, 1).alias("constant"), F.regexp_extract("line", ASSIGNED, 2).alias("value"))
    return found.groupBy("path", "constant").agg(F.min_by("value", "no").alias("value"))


def document_references(selected: DataFrame, files: DataFrame) -> DataFrame:
    """``(source, target, constant, document)`` for ``selected(ref, path, snippet)`` and ``files(path, text)``: a selected item that
    isn't a document names a constant whose value in its file holds the name of a selected document.

    Of several documents of one name the last by ref counts, of several constants that lead to one document the first by name.
    Nulls name nothing.
    """
    is_document = F.lower("path").rlike(DOCUMENTS)
    documents = selected.where(is_document).groupBy(base_name(F.col("path")).alias("name")).agg(F.max("ref").alias("target"))
    code = selected.where(~is_document)
    said = code.select(F.col("ref").alias("source"), "path", F.explode(F.array_distinct(F.regexp_extract_all("snippet", F.lit(CONSTANT), F.lit(0)))).alias("constant"))
    own = assignments(files.join(code.select("path").distinct(), "path", "left_semi"))
    strings = said.join(own, ["path", "constant"]).select("source", "constant", F.explode(F.regexp_extract_all("value", F.lit(STRING), F.lit(1))).alias("string"))
    hit = strings.select("source", "constant", F.regexp_extract("string", r"([^/\\]*)[/\\]*$", 1).alias("document"), base_name(F.col("string")).alias("name")).join(documents, "name")
    return hit.groupBy("source", "target").agg(F.min(F.struct("constant", "document")).alias("x")).select("source", "target", "x.constant", "x.document")
