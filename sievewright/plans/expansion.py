"""Query: what a second round of retrieval would look at, as one union of its branches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import graphs, prompts, roles

BRANCHES = ("intent", "code_context", "converging_reference", "upward_caller")


def candidate_expansion(spark, d, most=8):
    """Of each item: roles to search for, documents that only the code-context query finds, first files of symbols that several
    files declare, and evidence that calls other evidence; each once, eight at most in this order."""
    pick = lambda df, branch, ref: df.select("item_id", F.lit(branch).alias("branch"), F.col(ref).cast("string").alias("ref"))
    every = pick(roles.role_intents(spark, d), "intent", "role").union(pick(prompts.second_pass(spark, d), "code_context", "doc_id"))
    every = every.union(pick(graphs.exact_symbols(spark, d).where("n >= 2"), "converging_reference", "first"))
    every = every.union(pick(graphs.evidence_edges(spark, d).where("edge_kind = 'calls'"), "upward_caller", "source_ref")).distinct()
    order = Window.partitionBy("item_id").orderBy(F.array_position(F.array(*map(F.lit, BRANCHES)), F.col("branch")), "ref")
    return every.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most).select("item_id", "branch", "ref", "place")


QUERIES = {"candidate_expansion": candidate_expansion}
ORACLES = {
    "candidate_expansion": f"""
SELECT item_id, branch, ref, place FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY list_position({list(BRANCHES)}, branch), ref) AS place FROM (
    SELECT item_id, 'intent' AS branch, role AS ref FROM ({roles.ORACLES["role_intents"]})
    UNION SELECT item_id, 'code_context', CAST(doc_id AS VARCHAR) FROM ({prompts.ORACLES["second_pass"]})
    UNION SELECT item_id, 'converging_reference', first FROM ({graphs.ORACLES["exact_symbols"]}) WHERE n >= 2
    UNION SELECT item_id, 'upward_caller', source_ref FROM ({graphs.ORACLES["evidence_edges"]}) WHERE edge_kind = 'calls'
  )
) WHERE place <= 8""",
}
