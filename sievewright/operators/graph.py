"""Graph operators: reachability, minimal forests and greedy selection.

Frontiers advance by joins against the edges; the driver only learns whether a round found something new.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored

from ..sources.stored import stored


def reach(edges: DataFrame, roots: DataFrame, hops: int | None = None) -> DataFrame:
    """``(root, node, depth)`` of the nodes that ``edges(src, dst)`` reach from ``roots(root)``, least depth first; all that there
    are, or those up to ``hops`` away.

    Each round joins the last frontier to the edges and writes the new one; what was seen is the union of those. The edges
    are written once, so that no round works them out again.
    """
    edges = stored(edges.select("src", "dst"), "edges")
    front = stored(roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth")).distinct(), "front")
    seen, depth = front, 0
    while hops is None or depth < hops:
        depth += 1
        step = front.join(edges, front["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = stored(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def traverse(nodes: DataFrame, edges: DataFrame, roots: DataFrame, direction: str = "downstream", hops: int | None = None, node_kinds: tuple[str, ...] = (), edge_kinds: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`reach` over ``edges(src, dst, kind)`` of the given kinds, along them, against them or both; only through nodes
    ``(id, kind)`` of the given kinds (no kinds: any)."""
    kept = edges.where(F.col("kind").isin(*edge_kinds)) if edge_kinds else edges
    along, against = kept.select("src", "dst"), kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    used = {"downstream": along, "upstream": against, "both": along.union(against)}[direction].distinct()
    if node_kinds:
        allowed = nodes.where(F.col("kind").isin(*node_kinds)).select(F.col("id").alias("dst"))
        used = used.join(allowed, "dst", "left_semi").select("src", "dst")
    return reach(used, roots, hops)


def bounded_reach(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """As :func:`reach` for a small fixed number of hops, as one lazy plan."""
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    front = seen
    for depth in range(1, hops + 1):
        front = front.join(edges, front["node"] == edges["src"]).select("root", F.col("dst").alias("node"), F.lit(depth).alias("depth")).distinct()
        seen = seen.unionByName(front)
    return seen.groupBy("root", "node").agg(F.min("depth").alias("depth"))


def minimal_forest(groups: DataFrame) -> DataFrame:
    """Of ``(grp, ord, src, dst)`` the edges that don't close a cycle when taken by ``ord``, for each small group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        keep = []
        for row in pdf.sort_values("ord").itertuples(index=False):
            a, b = find(row.src), find(row.dst)
            if a != b:
                root[a] = b
            keep.append(a != b)
        return pdf.sort_values("ord")[keep]

    return groups.groupBy("grp").applyInPandas(run, groups.schema)


def round_robin(hits: DataFrame, cap: int = 12) -> DataFrame:
    """Of ``(grp, role, ord, ref)`` up to ``cap`` refs per group: roles take turns in order, and each takes its next ref that
    no role has taken yet."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        queues = [(r, iter(x.sort_values("ord")["ref"].tolist())) for r, x in pdf.groupby("role", sort=True)]
        seen, out = set(), []
        while queues and len(out) < cap:
            left = []
            for role, refs in queues:
                ref = next((x for x in refs if x not in seen), None)
                if ref is None:
                    continue
                left.append((role, refs))
                if len(out) < cap:
                    seen.add(ref)
                    out.append((role, ref))
            queues = left
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "rank": range(1, len(out) + 1), "role": [r for r, _ in out], "ref": [x for _, x in out]})

    return hits.groupBy("grp").applyInPandas(run, "grp string, rank int, role string, ref long")


def diverse(candidates: DataFrame, take: int = 4) -> DataFrame:
    """``(grp, rank, ref)``: of ``(grp, ref, path, score)`` greedily the best score less 2.5 for each taken one of its path and 0.7 for
    each of its first folder; of equals the higher score, then the lower ref.

    Each pick is an aggregation over all candidates, combined before the shuffle, against the few that are taken; so a group of
    any size is no task of its own.
    """
    folder = lambda c: F.split(c, "/")[0]
    some = candidates.select("grp", "ref", "path", "score")
    taken = some.select("grp").distinct().withColumn("picks", F.array().cast(f"array<struct<ref:{some.schema['ref'].dataType.simpleString()},path:string>>"))
    for _ in range(take):
        left = some.join(taken, "grp").where(~F.exists("picks", lambda p: p["ref"] == F.col("ref")))
        penalty = F.aggregate("picks", F.lit(0.0), lambda s, p: s + F.when(p["path"] == F.col("path"), 2.5).otherwise(0.0) + F.when(folder(p["path"]) == folder(F.col("path")), 0.7).otherwise(0.0))
        best = left.groupBy("grp").agg(F.max_by(F.struct("ref", "path"), F.struct(F.round(F.col("score") - penalty, 6).alias("v"), F.col("score"), (-F.col("ref")).alias("r"))).alias("pick"))
        taken = stored(taken.join(best, "grp", "left").select("grp", F.array_compact(F.concat("picks", F.array("pick"))).alias("picks")), "picks")
    return taken.select("grp", F.posexplode("picks").alias("rank", "pick")).select("grp", (F.col("rank") + 1).alias("rank"), "pick.ref")
