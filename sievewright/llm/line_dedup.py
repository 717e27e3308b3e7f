"""Line dedup by overlapping windows of three lines, with DataFrame functions only.

Every line is hashed, every three consecutive line hashes make one window key of 128 bits, and the windows that occur
more than once are found with one aggregation. The first occurrence, by (doc_id, line number), stays; each later one
covers its three lines, covered positions are merged (windows overlap), and the lines left are joined again.

Only (key, document, position) is shuffled for the search, never a text; the aggregation combines before the shuffle,
so a window that a third of all documents hold arrives as one row per task. The join that finds the later occurrences
has plain equality keys on two shuffled sides, which adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_name, table, text_of


def line_window_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with the text that is left, and with ``n_lines`` and ``n_removed`` (these two replace columns of the
    same names).

    Null text counts as empty (the text that comes back is empty); texts under ``width`` lines have no window and stay
    as they are; very long texts are one array of lines in one row. Ties: rows of the same id are ordered by the hash
    of their text, and rows that repeat both id and text are one document (each copy gets the same text). Extra
    columns pass through; an empty table gives an empty table.
    """
    out = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    lines_c, key_c = free_name(docs, "w_lines"), free_name(docs, "w_key")
    split = docs.select(*[docs[c] for c in out], F.split(text_of(docs, text_col), "\n", -1).alias(lines_c), F.xxhash64(text_of(docs, text_col)).alias(key_c))
    hashed = split.select(F.col(id_col).alias("id"), F.col(key_c).alias("tk"), F.transform(lines_c, lambda x: F.xxhash64(x)).alias("h")).where(F.size("h") >= width).distinct()
    # h is an attribute of the aggregation above, so the lambda below doesn't hash the lines again for each window
    at = lambda i, k: F.get("h", i + F.lit(k))
    key = lambda i: F.struct(F.xxhash64(*[at(i, k) for k in range(width)]).alias("a"), F.xxhash64(F.lit(7), *[at(i, k) for k in reversed(range(width))]).alias("b"), i.alias("pos"))
    windows = hashed.select("id", "tk", F.inline(F.transform(F.sequence(F.lit(0), F.size("h") - width), key)))
    where = F.struct("id", "tk", "pos")
    repeated = windows.groupBy("a", "b").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", "first")
    later = windows.join(repeated, ["a", "b"]).where(~where.eqNullSafe(F.col("first")))
    covered = later.groupBy("id", "tk").agg(F.collect_set("pos").alias("starts"))
    covered = covered.select("id", "tk", F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + F.lit(width - 1))))).alias("gone"))
    joined = split.join(covered, split[id_col].eqNullSafe(covered["id"]) & (split[key_c] == covered["tk"]), "left")
    lines = F.col(lines_c)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i))
    text = F.when(F.col("gone").isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[split[c] for c in out], text.alias(text_col), F.size(lines).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_window_dedup(docs).select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.greatest(F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"), "text")


ORACLE = """
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents
), s AS (
  SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos FROM l
), w AS (
  SELECT doc_id, pos, line AS x, lead(line, 1) OVER o AS y, lead(line, 2) OVER o AS z, lead(pos, 2) OVER o AS ok
  FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), r AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, pos) AS n FROM w WHERE ok IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM r, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1
)
SELECT s.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed,
  coalesce(string_agg(s.line, chr(10) ORDER BY s.pos) FILTER (gone.pos IS NULL), '') AS text
FROM s LEFT JOIN gone ON s.doc_id = gone.doc_id AND s.pos = gone.pos
GROUP BY s.doc_id
"""
