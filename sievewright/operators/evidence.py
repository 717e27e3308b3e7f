"""Evidence over a symbol graph: nodes at places, edges between selected items, connections and what they leave out.

Nodes are ``(id, kind, name, path, line_start, line_end)``, edges ``(src, dst, kind)``. Joins have an equality on the path and
a range besides; groups (``grp``) are worked on side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import reach

#: Kinds of edges between evidence, the most telling first; kinds of connections.
PRIORITY = ("calls", "references", "imports", "instantiates", "returns", "extends", "implements", "overrides", "decorates", "exports", "type_of")
CONNECTIONS = ("dependency", "control_flow", "data_flow", "configuration", "validation", "rendering", "other")
DOCUMENT_SUFFIX = r"\.(md|json|yaml|yml|toml)$"


def nodes_at(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """Nodes around each ``places(path, line)``, ``depth`` 1 for the innermost; neither files nor imports."""
    p = places.select(F.col("path").alias("p2"), "line").distinct()
    j = p.join(nodes, (F.col("path") == F.col("p2")) & (F.col("line_start") <= F.col("line")) & (F.col("line_end") >= F.col("line"))).where(~F.col("kind").isin("file", "import"))
    order = Window.partitionBy("path", "line").orderBy(F.col("line_end") - F.col("line_start"), "id")
    return j.withColumn("depth", F.row_number().over(order)).select("path", "line", "depth", "id", "kind", "name", "line_start", "line_end")


def related_files(nodes: DataFrame, edges: DataFrame, places: DataFrame) -> DataFrame:
    """``(path, line, direction, file)``: the files of callers and callees of the nodes at each place, one hop away."""
    own = nodes_at(nodes, places).select("path", "line", F.col("id").alias("own"))
    calls = edges.where("kind = 'calls'")
    out = own.join(calls, F.col("own") == F.col("src")).select("path", "line", F.lit("callees").alias("direction"), F.col("dst").alias("other"))
    back = own.join(calls, F.col("own") == F.col("dst")).select("path", "line", F.lit("callers").alias("direction"), F.col("src").alias("other"))
    files = nodes.select(F.col("id").alias("other"), F.col("path").alias("file"))
    return out.union(back).join(files, "other").select("path", "line", "direction", "file").distinct()


def overlapping(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(grp, ref, id, name)``: nodes but files that share a line with an item of ``evidence(grp, ref, path, line_start, line_end)``."""
    e = evidence.select("grp", "ref", F.col("path").alias("p2"), F.col("line_start").alias("a"), F.col("line_end").alias("b"))
    j = e.join(nodes, (F.col("path") == F.col("p2")) & (F.col("line_start") <= F.col("b")) & (F.col("line_end") >= F.col("a")))
    return j.where("kind <> 'file'").select("grp", "ref", "id", "name")


def evidence_edges(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, most: int = 40) -> DataFrame:
    """``(grp, ord, source_ref, target_ref, edge_kind, source_symbol, target_symbol)``: edges of the graph between two items of
    a group, each pair and kind once with the first symbols, by priority of the kind and then by the items."""
    on = overlapping(nodes, evidence)
    src = on.select("grp", F.col("ref").alias("source_ref"), F.col("id").alias("src"), F.col("name").alias("source_symbol"))
    dst = on.select("grp", F.col("ref").alias("target_ref"), F.col("id").alias("dst"), F.col("name").alias("target_symbol"))
    j = src.join(edges.where(F.col("kind").isin(*PRIORITY)), "src").join(dst, ["grp", "dst"]).where("source_ref <> target_ref")
    one = j.groupBy("grp", "source_ref", "target_ref", F.col("kind").alias("edge_kind")).agg(F.min(F.struct("source_symbol", "target_symbol")).alias("s"))
    place = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("edge_kind"))
    ranked = one.withColumn("ord", F.row_number().over(Window.partitionBy("grp").orderBy(place, "source_ref", "target_ref")))
    return ranked.where(F.col("ord") <= most).select("grp", "ord", "source_ref", "target_ref", "edge_kind", "s.source_symbol", "s.target_symbol")


def connections(edges: DataFrame) -> DataFrame:
    """Evidence edges as connections: kind, label and description."""
    kind = F.when(F.col("edge_kind") == "calls", "control_flow").otherwise("dependency")
    verb = F.when(F.col("edge_kind") == "calls", "calls").otherwise(F.regexp_replace("edge_kind", "s+$", ""))
    label = F.concat_ws(" ", "source_symbol", verb, "target_symbol")
    about = F.concat(F.lit("The graph has a direct "), "edge_kind", F.lit(" relationship from "), "source_symbol", F.lit(" to "), "target_symbol", F.lit("."))
    return edges.select(
        "grp", "ord", "source_ref", "target_ref", kind.alias("relationship_kind"), F.substring(label, 1, 100).alias("label"), F.substring(about, 1, 500).alias("description"), F.lit("direct").alias("grounding"), F.lit("high").alias("confidence")
    )


def unique_pairs(found: DataFrame) -> DataFrame:
    """Of connections the first of each unordered pair; none without both ends or from an item to itself."""
    ends = F.array_sort(F.array("source_ref", "target_ref"))
    ok = found.where((F.coalesce("source_ref", F.lit("")) != "") & (F.coalesce("target_ref", F.lit("")) != "") & (F.col("source_ref") != F.col("target_ref")))
    return ok.withColumn("pair_place", F.row_number().over(Window.partitionBy("grp", ends).orderBy("ord"))).where("pair_place = 1").drop("pair_place")


def valid_connections(said: DataFrame, evidence: DataFrame, direct: DataFrame, most: int = 16) -> DataFrame:
    """Proposed connections that hold: known ends, an allowed kind, a label and a description, known grounding and confidence;
    a direct one that touches a document only where ``direct(grp, a, b)`` has the pair. An inferred one is never of high
    confidence. Each pair once, the first ``most`` of a group."""
    refs = evidence.select("grp", "ref", F.lower("path").rlike(DOCUMENT_SUFFIX).alias("is_doc")).distinct()
    end = lambda c: refs.select("grp", F.col("ref").alias(c), F.col("is_doc").alias(f"{c}_doc"))
    low = lambda c: F.lower(F.trim(c))
    s = said.withColumns({"source_ref": F.trim("source_ref"), "target_ref": F.trim("target_ref"), "relationship_kind": low("relationship_kind"), "label": F.trim("label"), "description": F.trim("description"), "grounding": low("grounding"), "confidence": low("confidence")})
    s = s.where(F.col("relationship_kind").isin(*CONNECTIONS) & (F.col("label") != "") & (F.col("description") != "") & F.col("grounding").isin("direct", "inferred") & F.col("confidence").isin("high", "medium", "low"))
    s = s.join(end("source_ref"), ["grp", "source_ref"]).join(end("target_ref"), ["grp", "target_ref"])
    known = direct.select("grp", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.lit(True).alias("known")).distinct()
    j = s.withColumns({"x": F.least("source_ref", "target_ref"), "y": F.greatest("source_ref", "target_ref")}).join(known, ["grp", "x", "y"], "left")
    touches = F.col("source_ref_doc") | F.col("target_ref_doc")
    j = j.where(~((F.col("grounding") == "direct") & touches & F.col("known").isNull()))
    j = j.withColumn("confidence", F.when((F.col("grounding") == "inferred") & (F.col("confidence") == "high"), "medium").otherwise(F.col("confidence")))
    j = unique_pairs(j.withColumns({"label": F.substring("label", 1, 100), "description": F.substring("description", 1, 500)}))
    first = j.withColumn("n", F.row_number().over(Window.partitionBy("grp").orderBy("ord"))).where(F.col("n") <= most)
    return first.select("grp", "ord", "source_ref", "target_ref", "relationship_kind", "label", "description", "grounding", "confidence")


def coverage(evidence: DataFrame, found: DataFrame, roots: DataFrame, declared: DataFrame) -> DataFrame:
    """``(grp, ref, state)`` of each item: connected to its group's root (``roots(grp, ref)``) over connections in any direction,
    declared as disconnected (``declared(grp, ref)``), or unaccounted. A declaration of what is connected is dropped."""
    key = lambda c: F.concat(F.col("grp").cast("string"), F.lit("\x1f"), F.col(c))
    one = found.select(key("source_ref").alias("src"), key("target_ref").alias("dst"))
    both = one.union(one.select("dst", "src")).distinct()
    seen = reach(both, roots.select(key("ref").alias("root"))).select(F.col("node").alias("k")).distinct().withColumn("connected", F.lit(True))
    told = declared.select(key("ref").alias("k")).distinct().withColumn("told", F.lit(True))
    items = evidence.select("grp", "ref", key("ref").alias("k")).distinct()
    state = F.when(F.col("connected"), "connected").when(F.col("told"), "declared").otherwise("unaccounted")
    return items.join(seen, "k", "left").join(told, "k", "left").select("grp", "ref", state.alias("state"))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """0 for ranges that share a line, else the gap; null without a range."""
    return F.when(a[0].isNull() | b[0].isNull(), None).when((a[1] >= b[0]) & (b[1] >= a[0]), 0).otherwise(F.greatest(a[0], b[0]) - F.least(a[1], b[1]))


def near_top(shortlist: DataFrame, spans: DataFrame, top: int = 3, gap: int = 20) -> DataFrame:
    """Of ``spans(path, line_start, line_end)`` those within ``gap`` lines of one of the path's first ``top`` declarations
    (``shortlist(path, place, a, b)``)."""
    first = shortlist.where(F.col("place") <= top).select(F.col("path").alias("p2"), "a", "b")
    near = distance((F.col("line_start"), F.col("line_end")), (F.col("a"), F.col("b"))) <= gap
    return spans.join(first, (F.col("path") == F.col("p2")) & near, "left_semi")
