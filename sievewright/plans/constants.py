"""Query: documents that files refer to through constants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constants as K
from ..sources.tables import REPOSITORY, repository


def constant_references(spark, d):
    """The supplied documents as files that name others by constants: each third one gets an assignment of the path of the file
    five numbers on, and its first line and the constant are the snippet; files that end in ``.md`` are documents."""
    f = repository(spark, d).select("doc_id", "path", F.coalesce("text", F.lit("")).alias("text"))
    to = f.select((F.col("doc_id") - 5).alias("doc_id"), F.col("path").alias("other"))
    j = f.join(to, "doc_id", "left")
    name = F.concat(F.lit("DOC_"), F.col("doc_id").cast("string"), F.lit("_PATH"))
    code = F.concat(F.lit("\nconst "), name, F.lit(': string = "../'), F.col("other"), F.lit('";\n'))
    named = (F.col("doc_id") % 3 == 0) & F.col("other").isNotNull()
    files = j.select("path", F.when(named, F.concat("text", code)).otherwise(F.col("text")).alias("text"))
    selected = j.select(F.col("doc_id").cast("string").alias("ref"), "path", F.concat(F.substring_index("text", "\n", 1), F.lit(" "), F.when(named, name).otherwise(F.lit(""))).alias("snippet"))
    return K.document_references(selected, files)


QUERIES = {"constant_references": constant_references}
ORACLES = {
    "constant_references": f"""
WITH {REPOSITORY}, j AS (
  SELECT f.doc_id, f.path, coalesce(f.text, '') AS text, o.path AS other FROM files f LEFT JOIN files o ON o.doc_id = f.doc_id + 5
), g AS (
  SELECT *, CASE WHEN doc_id % 3 = 0 AND other IS NOT NULL THEN text || chr(10) || 'const DOC_' || doc_id || '_PATH: string = "../' || other || '";' || chr(10) ELSE text END AS body,
    string_split(text, chr(10))[1] || ' ' || CASE WHEN doc_id % 3 = 0 AND other IS NOT NULL THEN 'DOC_' || doc_id || '_PATH' ELSE '' END AS snippet, regexp_matches(lower(path), '{K.DOCUMENTS}') AS document FROM j
), docs AS (
  SELECT lower(regexp_extract(path, '[^/]*$')) AS name, max(CAST(doc_id AS VARCHAR)) AS target FROM g WHERE document GROUP BY ALL
), said AS (
  SELECT DISTINCT doc_id, path, unnest(regexp_extract_all(snippet, '{K.CONSTANT}')) AS constant FROM g WHERE NOT document
), line AS (
  SELECT path, unnest(a) AS line, unnest(range(len(a))) AS no FROM (SELECT path, string_split(body, chr(10)) AS a FROM g WHERE NOT document)
), own AS (
  SELECT path, regexp_extract(line, '{K.ASSIGNED}', 1) AS constant, arg_min(regexp_extract(line, '{K.ASSIGNED}', 2), no) AS value FROM line WHERE regexp_matches(line, '{K.ASSIGNED}') GROUP BY ALL
), hit AS (
  SELECT CAST(doc_id AS VARCHAR) AS source, constant, regexp_extract(unnest(regexp_extract_all(value, '{K.STRING.replace("'", "''")}', 1)), '[^/]*$') AS document FROM said JOIN own USING (path, constant)
)
SELECT source, target, min((constant, document))[1] AS constant, min((constant, document))[2] AS document FROM hit JOIN docs ON name = lower(document) GROUP BY source, target""",
}
