"""What several queries share: the stored index of a data folder."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import generations as G
from ..operators import index as I
from ..sources.stored import shared_folder
from ..sources.tables import repository

_known: dict[tuple[str, str], G.Generations] = {}


def index_documents(spark: SparkSession, d: str):
    """``(key, text, source)``: what is indexed of the supplied documents, and the stored file that holds each."""
    docs = repository(spark, d, "_metadata.file_path AS stored_file")
    return docs.select(F.col("doc_id").alias("key"), I.document_text().alias("text"), F.col("stored_file").alias("source"))


def stored_index(spark: SparkSession, d: str) -> G.Generations:
    """The index of the supplied documents in the shared folder, whichever session wrote it, brought to the documents as they are.

    Whether they changed is told by names, sizes and times of the stored files; no text is read for that. The session looks
    the index up once and goes on with it while these stay.
    """
    docs = index_documents(spark, d)
    sources = G.source_signatures(docs)
    at = spark.sparkContext.applicationId, d
    if at not in _known or _known[at].sources != sources:
        _known[at] = G.sync(docs, index_folder(spark, d), sources).index
    return _known[at]


def index_folder(spark: SparkSession, d: str, name: str = "index") -> str:
    """A folder whose name any session gives to the index of ``d``."""
    return f"{shared_folder(spark)}/{name}-{hashlib.md5(d.encode()).hexdigest()}"


def symbol_graph(spark: SparkSession, d: str) -> tuple:
    """Nodes ``(id, kind, name, path, line_start, line_end)`` and edges ``(src, dst, kind)`` of the supplied documents: a
    declaration is a node, and each declaration of a name is linked to the next one of that name by path and line."""
    from pyspark.sql import Window

    from ..operators import chunks as C
    from .texts import DECLARATION

    cut = C.file_spans(repository(spark, d), DECLARATION).select("path", F.inline(F.transform("spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), F.get(F.col("ls"), s["start"]).alias("line")))))
    named = cut.withColumn("name", F.regexp_extract("line", SYMBOL, 1)).where("name <> ''")
    kind = F.when((F.col("b") - F.col("a")) % 2 == 0, "function").otherwise("class")
    node_id = F.concat("path", F.lit("#"), F.col("a").cast("string"))
    nodes = named.select(node_id.alias("id"), kind.alias("kind"), "name", "path", (F.col("a") + 1).alias("line_start"), F.col("b").alias("line_end"))
    following = F.lead("id").over(Window.partitionBy("name").orderBy("path", "line_start"))
    chosen = F.element_at(F.array(*map(F.lit, EDGE_KINDS)), (F.pmod(F.length("path") + F.col("line_start"), F.lit(len(EDGE_KINDS))) + 1).cast("int"))
    edges = nodes.select(F.col("id").alias("src"), following.alias("dst"), chosen.alias("kind")).where("dst IS NOT NULL")
    return nodes, edges


SYMBOL = r"^([A-Z][a-z]+) (?:the|and|of|th)\b"
EDGE_KINDS = ("calls", "references", "contains", "imports", "calls", "extends")
#: The same graph in SQL, behind the files, lines and kept spans of the repository queries.
GRAPH_SQL = f"""nodes AS (
  SELECT kept.path || '#' || s AS id, CASE WHEN (e - s) % 2 = 0 THEN 'function' ELSE 'class' END AS kind, regexp_extract(line, '{SYMBOL}', 1) AS name,
    kept.path, s + 1 AS line_start, e AS line_end
  FROM kept JOIN l ON l.path = kept.path AND no = s WHERE regexp_matches(line, '{SYMBOL}')
), edges AS (
  SELECT * FROM (
    SELECT id AS src, lead(id) OVER (PARTITION BY name ORDER BY path, line_start) AS dst, {list(EDGE_KINDS)}[CAST((length(path) + line_start) % {len(EDGE_KINDS)} AS INT) + 1] AS kind
    FROM nodes
  ) WHERE dst IS NOT NULL
)"""
