"""Queries: the symbol graph of the supplied documents, evidence on it, and the connections between evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators import evidence as E
from ..operators import graph as G
from ..sources.stored import stored
from ..sources.tables import load, repository
from .repository import _LINES
from .search import ITEMS, PARTS, REPOSITORY, bm25_ranked
from .shared import GRAPH_SQL, symbol_graph
from .texts import DECLARATION


def _places(spark, d):
    """Places that the events name: a document by the event's number, a line by its payload."""
    e = load(spark, d, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("line"))
    return e.join(repository(spark, d).select("doc_id", "path"), F.col("event_id") == F.col("doc_id")).select("path", "line").where("line > 0")


def _evidence(spark, d):
    """The hits of each item as evidence with a range of lines."""
    hits = bm25_ranked(spark, d).select(F.col("item_id").alias("grp"), "doc_id", F.col("rank").cast("long").alias("rank"))
    files = repository(spark, d).select("doc_id", "path")
    start = (F.col("doc_id") % 20 + 1).cast("int")
    return hits.join(files, "doc_id").select("grp", F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("ref"), "rank", "path", start.alias("line_start"), (start + 39).alias("line_end"))


def graph_nodes(spark, d):
    """Nodes by kind and name with their edges out and in."""
    nodes, edges = symbol_graph(spark, d)
    out, back = (edges.groupBy(c).agg(F.count(F.lit(1)).alias(n)).withColumnRenamed(c, "id") for c, n in (("src", "n_out"), ("dst", "n_in")))
    j = nodes.join(out, "id", "left").join(back, "id", "left")
    return j.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("n_out"), F.lit(0)).alias("edges_out"), F.coalesce(F.sum("n_in"), F.lit(0)).alias("edges_in"))


def symbol_at(spark, d):
    """The innermost node at each place."""
    at = E.nodes_at(symbol_graph(spark, d)[0], _places(spark, d)).where("depth = 1")
    return at.select("path", F.col("line").cast("long").alias("line"), "kind", "name", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


def call_files(spark, d):
    """Files of the callers and callees of what stands at each place."""
    nodes, edges = symbol_graph(spark, d)
    r = E.related_files(nodes, edges, _places(spark, d))
    return r.groupBy("path", F.col("line").cast("long").alias("line"), "direction").agg(F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"))


def exact_symbols(spark, d):
    """Symbols that an item's text names exactly, how many files declare them and the first of these."""
    words = load(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("name"))
    files = words.join(symbol_graph(spark, d)[0].select("name", "path").distinct(), "name").groupBy("item_id", "name")
    return files.agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))


def evidence_overlap(spark, d):
    """Symbols that each item's evidence touches."""
    return E.overlapping(symbol_graph(spark, d)[0], _evidence(spark, d)).select(F.col("grp").alias("item_id"), "ref", "id", "name")


def _edges(spark, d, evidence=None):
    nodes, edges = symbol_graph(spark, d)
    return E.evidence_edges(nodes, edges, evidence or _evidence(spark, d))


def _written(spark, d):
    """The evidence and the edges between it, written once for queries that need them several times."""
    e = stored(_evidence(spark, d), "evidence")
    return e, stored(_edges(spark, d, e), "evidence-edges")


def evidence_edges(spark, d):
    """Edges between two pieces of an item's evidence, by priority."""
    return _edges(spark, d).select(F.col("grp").alias("item_id"), F.col("ord").cast("long").alias("ord"), "source_ref", "target_ref", "edge_kind", "source_symbol", "target_symbol")


def structural_connections(spark, d):
    """These edges as connections, one for each pair."""
    c = E.unique_pairs(E.connections(_edges(spark, d)))
    return c.select(F.col("grp").alias("item_id"), F.col("ord").cast("long").alias("ord"), "source_ref", "target_ref", "relationship_kind", "label", "description")


def _said(evidence):
    """Connections that the hits suggest: each piece of evidence to the two after it, stated with more or less care."""
    e = evidence.select("grp", "ref", "rank")
    kinds, levels = F.array(*map(F.lit, (*E.CONNECTIONS, "guess"))), F.array(*map(F.lit, ("high", "medium", "low", "sure")))
    j = e.alias("a").join(e.alias("b"), F.expr("a.grp = b.grp AND b.rank > a.rank AND b.rank <= a.rank + 2"))
    n = F.expr("CAST(a.rank * 3 + b.rank + a.grp AS INT)")
    return j.select(
        "a.grp", F.expr("CAST(a.rank * 100 + b.rank AS INT)").alias("ord"), F.expr("a.ref").alias("source_ref"), F.expr("b.ref").alias("target_ref"), F.element_at(kinds, n % 8 + 1).alias("relationship_kind"), F.concat(F.expr("a.ref"), F.lit(" to "), F.expr("b.ref")).alias("label"),
        F.when(n % 11 != 0, "stated").otherwise(" ").alias("description"), F.when(n % 2 == 0, "Direct").otherwise("inferred").alias("grounding"), F.element_at(levels, n % 4 + 1).alias("confidence"),
    )


def _valid(e, edges):
    return E.valid_connections(_said(e), e, edges.select("grp", F.col("source_ref").alias("a"), F.col("target_ref").alias("b")))


def valid_connections(spark, d):
    """Of the suggested connections those that pass every check."""
    return _valid(*_written(spark, d)).select(F.col("grp").alias("item_id"), F.col("ord").cast("long").alias("ord"), "source_ref", "target_ref", "relationship_kind", "grounding", "confidence")


def _candidate_graph(e, edges):
    first = E.connections(edges).select("grp", "ord", "source_ref", "target_ref")
    return E.unique_pairs(first.union(_valid(e, edges).select("grp", F.col("ord") + 10_000, "source_ref", "target_ref")))


def evidence_coverage(spark, d):
    """Structural and valid connections together: what of each item's evidence they tie to its first piece, what is declared
    to stand apart (even documents of the later ranks) and what nobody accounts for."""
    e, edges = _written(spark, d)
    told = e.where("rank > 6 AND CAST(substring(ref, 2) AS LONG) % 2 = 0")
    return E.coverage(e, _candidate_graph(e, edges), e.where("rank = 1").select("grp", "ref"), told).groupBy(F.col("grp").alias("item_id"), "state").agg(F.count(F.lit(1)).alias("n"))


def evidence_forest(spark, d):
    """Connections of an item's evidence, structural ones first, without those that close a cycle."""
    c = _candidate_graph(*_written(spark, d))
    return G.minimal_forest(c.select(F.col("grp").cast("string").alias("grp"), "ord", F.col("source_ref").alias("src"), F.col("target_ref").alias("dst"))).groupBy("grp").agg(F.count(F.lit(1)).alias("edges"))


def organizer_errors(spark, d, least=8, most=16):
    """What is wrong with a selection of evidence: its size, references that are unknown or repeated, a root that isn't in it,
    pieces that nothing connects."""
    e, edges = _written(spark, d)
    chosen = e.where("rank % 4 <> 3").select("grp", "ref").union(e.where("rank = 2 AND grp % 3 = 0").select("grp", "ref")).union(e.where("rank = 5 AND grp % 5 = 0").select("grp", F.concat("ref", F.lit("x"))))
    per = chosen.groupBy("grp", "ref").agg(F.count(F.lit(1)).alias("n")).join(e.select("grp", "ref", F.lit(True).alias("known")), ["grp", "ref"], "left")
    s = per.groupBy("grp").agg(F.sum("n").alias("all"), F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("twice"))
    rooted = per.join(e.where("rank = 3").select("grp", "ref"), ["grp", "ref"], "left_semi").select("grp", F.lit(True).alias("rooted"))
    loose = E.coverage(e, _candidate_graph(e, edges), e.where("rank = 1").select("grp", "ref"), e.where("false")).where("state = 'unaccounted'").join(per.select("grp", "ref"), ["grp", "ref"], "left_semi").groupBy("grp").agg(F.count(F.lit(1)).alias("loose"))
    j = s.join(rooted, "grp", "left").join(loose, "grp", "left")
    size = F.when((F.col("all") < least) | (F.col("all") > most), F.lit("size"))
    errors = F.array_compact(F.array(size, F.when(F.col("unknown") > 0, F.lit("unknown")), F.when(F.col("twice") > 0, F.lit("repeated")), F.when(F.col("rooted").isNull(), F.lit("root")), F.when(F.col("loose") > 0, F.lit("disconnected"))))
    return j.select(F.col("grp").alias("item_id"), F.col("all").alias("selected"), F.array_join(errors, ",").alias("errors"))


def traversal(spark, d):
    """From the first declaration of each name up to three edges against their direction, through calls and references."""
    nodes, edges = symbol_graph(spark, d)
    roots = nodes.groupBy("name").agg(F.max_by("id", F.struct("path", "line_start")).alias("root")).select("root")
    t = G.traverse(nodes, edges, roots, "upstream", 3, edge_kinds=("calls", "references"))
    return t.select("root", "node", F.col("depth").cast("long").alias("depth"))


def declaration_shortlist(spark, d, most=8):
    """Declarations of each document that an item's evidence names, by words in their first line and body and by how near the
    evidence is; a span counts if it is near one of the first three."""
    nodes = symbol_graph(spark, d)[0]
    e = _evidence(spark, d)
    spans = e.select("grp", "ref", "path", F.col("line_start").alias("a"), F.col("line_end").alias("b"))
    decl = nodes.select(F.col("path").alias("p2"), "name", "line_start", "line_end")
    gap = E.distance((F.col("line_start"), F.col("line_end")), (F.col("a"), F.col("b")))
    j = spans.join(decl, F.col("path") == F.col("p2")).withColumn("gap", gap)
    near = F.when(F.col("gap") == 0, 7.0).when(F.col("gap") <= 20, F.greatest(F.lit(0.5), 4.0 - F.col("gap") / 8.0)).otherwise(0.0)
    s = j.select("grp", "ref", "path", "name", "line_start", "line_end", "gap", F.round(near, 3).alias("score"))
    ranked = s.withColumn("place", F.row_number().over(Window.partitionBy("grp", "ref").orderBy(F.desc("score"), F.desc("line_start")))).where(F.col("place") <= most)
    return ranked.select(F.col("grp").alias("item_id"), "ref", F.col("place").cast("long").alias("place"), "name", F.col("gap").cast("long").alias("gap"), "score")


def support_near(spark, d):
    """Chunks within twenty lines of a document's first three declarations."""
    nodes = symbol_graph(spark, d)[0]
    short = nodes.select("path", F.row_number().over(Window.partitionBy("path").orderBy("line_start")).alias("place"), F.col("line_start").alias("a"), F.col("line_end").alias("b"))
    c = C.chunks(repository(spark, d), DECLARATION).select("path", "line_start", "line_end")
    return E.near_top(short, c).select("path", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


QUERIES = {
    f.__name__: f
    for f in (graph_nodes, symbol_at, call_files, exact_symbols, evidence_overlap, evidence_edges, structural_connections, valid_connections, evidence_coverage, evidence_forest, organizer_errors, traversal, declaration_shortlist, support_near)
}

_BASE = f"WITH RECURSIVE {REPOSITORY}, {_LINES}, {GRAPH_SQL}"
_PLACES = """places AS (
  SELECT DISTINCT path, CAST(json_extract_string(props, '$.k') AS INT) AS line FROM events JOIN files ON event_id = doc_id WHERE line > 0
), located AS (
  SELECT nodes.*, line, row_number() OVER (PARTITION BY nodes.path, line ORDER BY line_end - line_start, id) AS depth
  FROM nodes JOIN places ON nodes.path = places.path AND line BETWEEN line_start AND line_end
)"""
_EVIDENCE = f"""WITH RECURSIVE {ITEMS}, {PARTS}, {_LINES}, {GRAPH_SQL}, hit AS (
  SELECT query AS item_id, doc_id, round(sum(idf * w), 6) AS score FROM w GROUP BY ALL
), ev AS (
  SELECT item_id, 'e' || doc_id AS ref, rank, path, doc_id % 20 + 1 AS a, doc_id % 20 + 40 AS b
  FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hit) JOIN files USING (doc_id) WHERE rank <= 10
), touched AS (
  SELECT item_id, ref, id, name FROM ev JOIN nodes ON nodes.path = ev.path AND line_start <= b AND line_end >= a
), ee AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY list_position({list(E.PRIORITY)}, edge_kind), source_ref, target_ref) AS ord FROM (
    SELECT x.item_id, x.ref AS source_ref, y.ref AS target_ref, edges.kind AS edge_kind, min((x.name, y.name)) AS s
    FROM touched x JOIN edges ON src = x.id JOIN touched y ON y.id = dst AND y.item_id = x.item_id
    WHERE x.ref <> y.ref AND edges.kind IN {E.PRIORITY} GROUP BY ALL
  )
), edge AS (
  SELECT item_id, ord, source_ref, target_ref, edge_kind, s[1] AS source_symbol, s[2] AS target_symbol FROM ee WHERE ord <= 40
)"""
_SAID = f""", proposed AS (
  SELECT a.item_id, a.rank * 100 + b.rank AS ord, a.ref AS source_ref, b.ref AS target_ref, CAST(a.rank * 3 + b.rank + a.item_id AS INT) AS n,
    regexp_matches(a.path, '{E.DOCUMENT_SUFFIX}') OR regexp_matches(b.path, '{E.DOCUMENT_SUFFIX}') AS doc
  FROM ev a JOIN ev b ON a.item_id = b.item_id AND b.rank > a.rank AND b.rank <= a.rank + 2
), ok AS (
  SELECT item_id, ord, source_ref, target_ref, {list(E.CONNECTIONS)}[n % 8 + 1] AS relationship_kind, CASE WHEN n % 2 = 0 THEN 'direct' ELSE 'inferred' END AS grounding,
    CASE WHEN n % 2 = 1 AND n % 4 = 0 THEN 'medium' ELSE ['high', 'medium', 'low'][n % 4 + 1] END AS confidence, row_number() OVER (PARTITION BY item_id ORDER BY ord) AS r
  FROM proposed WHERE n % 8 < 7 AND n % 4 < 3 AND n % 11 <> 0 AND NOT (n % 2 = 0 AND doc AND NOT EXISTS (
    SELECT 1 FROM edge WHERE edge.item_id = proposed.item_id AND least(edge.source_ref, edge.target_ref) = least(proposed.source_ref, proposed.target_ref)
      AND greatest(edge.source_ref, edge.target_ref) = greatest(proposed.source_ref, proposed.target_ref)))
), valid AS (
  SELECT * FROM ok WHERE r <= 16
), cand AS (
  SELECT DISTINCT item_id, source_ref AS x, target_ref AS y FROM edge UNION SELECT item_id, source_ref, target_ref FROM valid
), adj AS (
  SELECT * FROM cand UNION SELECT item_id, y, x FROM cand
), seen AS (
  SELECT item_id, ref FROM ev WHERE rank = 1 UNION SELECT seen.item_id, y FROM seen JOIN adj ON adj.item_id = seen.item_id AND x = ref
)"""
ORACLES = {
    "graph_nodes": f"""
{_BASE}
SELECT kind, name, count(*) AS nodes, CAST(sum((SELECT count(*) FROM edges WHERE src = id)) AS BIGINT) AS edges_out, CAST(sum((SELECT count(*) FROM edges WHERE dst = id)) AS BIGINT) AS edges_in
FROM nodes GROUP BY kind, name""",
    "symbol_at": f"{_BASE}, {_PLACES} SELECT path, line, kind, name, line_start, line_end FROM located WHERE depth = 1",
    "call_files": f"""
{_BASE}, {_PLACES}, r AS (
  SELECT DISTINCT located.path, line, 'callees' AS direction, o.path AS file FROM located JOIN edges ON src = located.id AND edges.kind = 'calls' JOIN nodes o ON o.id = dst
  UNION SELECT DISTINCT located.path, line, 'callers', o.path FROM located JOIN edges ON dst = located.id AND edges.kind = 'calls' JOIN nodes o ON o.id = src
)
SELECT path, line, direction, string_agg(file, ',' ORDER BY file) AS files FROM r GROUP BY ALL""",
    "exact_symbols": f"""
{_BASE}, words AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM benchmark
), f AS (
  SELECT DISTINCT item_id, name, path FROM words JOIN nodes USING (name)
)
SELECT item_id, name, count(*) AS n, min(path) AS first FROM f GROUP BY ALL""",
    "evidence_overlap": f"{_EVIDENCE} SELECT * FROM touched",
    "evidence_edges": f"{_EVIDENCE} SELECT * FROM edge",
    "structural_connections": f"""
{_EVIDENCE}, u AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, least(source_ref, target_ref), greatest(source_ref, target_ref) ORDER BY ord) AS r FROM edge
)
SELECT item_id, ord, source_ref, target_ref, CASE edge_kind WHEN 'calls' THEN 'control_flow' ELSE 'dependency' END AS relationship_kind,
  source_symbol || ' ' || CASE edge_kind WHEN 'calls' THEN 'calls' ELSE regexp_replace(edge_kind, 's+$', '') END || ' ' || target_symbol AS label,
  'The graph has a direct ' || edge_kind || ' relationship from ' || source_symbol || ' to ' || target_symbol || '.' AS description
FROM u WHERE r = 1""",
    "valid_connections": f"{_EVIDENCE}{_SAID} SELECT item_id, ord, source_ref, target_ref, relationship_kind, grounding, confidence FROM valid",
    "evidence_coverage": f"""
{_EVIDENCE}{_SAID}
SELECT ev.item_id, CASE WHEN seen.ref IS NOT NULL THEN 'connected' WHEN rank > 6 AND CAST(substr(ev.ref, 2) AS BIGINT) % 2 = 0 THEN 'declared' ELSE 'unaccounted' END AS state, count(*) AS n
FROM ev LEFT JOIN seen ON seen.item_id = ev.item_id AND seen.ref = ev.ref GROUP BY ALL""",
    "organizer_errors": f"""
{_EVIDENCE}{_SAID}, chosen AS (
  SELECT item_id, ref FROM ev WHERE rank % 4 <> 3 UNION ALL SELECT item_id, ref FROM ev WHERE rank = 2 AND item_id % 3 = 0
  UNION ALL SELECT item_id, ref || 'x' FROM ev WHERE rank = 5 AND item_id % 5 = 0
), per AS (
  SELECT item_id, ref, count(*) AS n FROM chosen GROUP BY ALL
), s AS (
  SELECT per.item_id, CAST(sum(n) AS BIGINT) AS selected, count_if(ev.ref IS NULL) AS unknown, count_if(n > 1) AS twice, count_if(coalesce(rank, 0) = 3) AS rooted,
    count_if(ev.ref IS NOT NULL AND seen.ref IS NULL) AS loose
  FROM per LEFT JOIN ev ON ev.item_id = per.item_id AND ev.ref = per.ref LEFT JOIN seen ON seen.item_id = per.item_id AND seen.ref = per.ref GROUP BY per.item_id
)
SELECT item_id, selected, array_to_string(list_filter([CASE WHEN selected < 8 OR selected > 16 THEN 'size' END, CASE WHEN unknown > 0 THEN 'unknown' END, CASE WHEN twice > 0 THEN 'repeated' END,
  CASE WHEN rooted = 0 THEN 'root' END, CASE WHEN loose > 0 THEN 'disconnected' END], lambda x: x IS NOT NULL), ',') AS errors
FROM s""",
    "traversal": f"""
{_BASE}, roots AS (
  SELECT arg_max(id, (path, line_start)) AS root FROM nodes GROUP BY name
), walk AS (
  SELECT root, root AS node, 0 AS depth FROM roots
  UNION ALL SELECT root, src, depth + 1 FROM walk JOIN edges ON dst = node WHERE depth < 3 AND edges.kind IN ('calls', 'references')
)
SELECT root, node, min(depth) AS depth FROM walk GROUP BY root, node""",
    "declaration_shortlist": f"""
{_EVIDENCE}, j AS (
  SELECT item_id, ref, name, line_start, CASE WHEN line_end >= a AND b >= line_start THEN 0 ELSE greatest(line_start, a) - least(line_end, b) END AS gap
  FROM ev JOIN nodes ON nodes.path = ev.path
), s AS (
  SELECT *, round(CASE WHEN gap = 0 THEN 7e0 WHEN gap <= 20 THEN greatest(0.5e0, 4e0 - gap / 8e0) ELSE 0e0 END, 3) AS score FROM j
), k AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, ref ORDER BY score DESC, line_start DESC) AS place FROM s
)
SELECT item_id, ref, place, name, gap, score FROM k WHERE place <= 8""",
    "support_near": f"""
{_BASE}, short AS (
  SELECT path, line_start AS a, line_end AS b, row_number() OVER (PARTITION BY path ORDER BY line_start) AS place FROM nodes
)
SELECT DISTINCT c.path, line_start, line_end FROM c JOIN short ON short.path = c.path AND place <= 3
  AND CASE WHEN line_end >= a AND b >= line_start THEN 0 ELSE greatest(line_start, a) - least(line_end, b) END <= 20""",
}
