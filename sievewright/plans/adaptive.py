"""Query: rounds of retrieval for each item, with a second query and the promotion of a deferred objective."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import terms as T
from ..functions.text import tokens
from ..operators import adaptive as A
from ..operators import index as I
from ..operators import search as S
from ..sources.tables import load, repository
from .search import PARTS, TOKENS
from .shared import stored_index

#: Words that each promoted objective asks for, and the role it is for; an objective without words can't be asked for.
PROMOTED = {"verification_repro": ("tests", "onre erin"), "diagnostic_surface": ("diagnostics", ""), "behavior_path": ("behavior_output", "ation thtion"), "configuration_context": (None, "reti"), "usage_contract": ("representation", "ther stand")}
HITS, HEAD = 3, 6


def retrieval_rounds(spark, d):
    """Rounds of each item: its first words, then its whole text where no implementation file that has its longest word was
    found, then its text with the words of the first deferred objective; sufficient once a file holds the item's text."""
    items = load(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.trim("text").alias("text"))
    index = stored_index(spark, d)
    files = repository(spark, d).select(F.col("doc_id").cast("string").alias("ref"), "path", F.col("text").alias("body"))
    longest = F.get(F.array_sort(F.transform(T.owner_tokens(F.col("text")), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(0))["w"]

    def ask(words):
        hits = I.bm25(index, S.query_terms(words, "item", "text")).select(F.col("query").alias("item"), F.col("key").alias("key"), F.round("score", 6).alias("score"))
        return S.top(hits, "item", HITS, F.desc("score"), F.col("key")).select("item", F.col("key").cast("string").alias("ref"))

    of = lambda open_: open_.select("item", "objective").join(items, "item")
    first = lambda open_: ask(of(open_).select("item", F.array_join(F.slice(tokens(F.col("text")), 1, HEAD), " ").alias("text")))
    recover = lambda open_: ask(of(open_).select("item", "text"))
    said = F.coalesce(*(F.when(F.col("objective") == o, w) for o, (_, w) in PROMOTED.items()), F.lit(""))
    promote = lambda open_: ask(of(open_).select("item", F.concat_ws(" ", "text", said).alias("text")))

    def judge(refs):
        j = refs.join(files, "ref").join(items.select("item", "text", longest.alias("word")), "item")
        own = (P.file_role(F.col("path")) == "implementation") & F.contains(F.lower("body"), F.col("word"))
        return j.groupBy("item").agg(F.max(F.coalesce(own, F.lit(False))).alias("grounded"), F.max(F.coalesce(F.contains("body", F.col("text")), F.lit(False))).alias("sufficient"))

    rows = [(place, o, role, bool(words)) for place, (o, (role, words)) in enumerate(PROMOTED.items())]
    known = spark.createDataFrame(rows, "place int, objective string, role string, executable boolean")
    deferred = items.crossJoin(F.broadcast(known)).where((F.col("item") + F.col("place")) % 3 != 0).select("item", "objective", "role", "executable")  # five rows
    done = A.run_rounds(items, deferred, first, recover, promote, judge)
    return done.select(F.col("item").alias("item_id"), F.col("rounds").cast("long").alias("rounds"), "stop", F.array_join("promoted", ",").alias("promoted"), F.array_join("refs", ",").alias("refs"), F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("counts"))


QUERIES = {"retrieval_rounds": retrieval_rounds}

_WORDS = "CASE o " + " ".join(f"WHEN '{o}' THEN '{w}'" for o, (_, w) in PROMOTED.items()) + " ELSE '' END"
_ORDER = list(A.ORDER)
_KNOWN = ", ".join(f"({k}, '{o}', {'NULL' if role is None else repr(role)}, {str(bool(w)).lower()}, {_ORDER.index(o)})" for k, (o, (role, w)) in enumerate(PROMOTED.items()))
_ROLE = "CASE WHEN regexp_matches(path, '{}') THEN 'documentation' WHEN regexp_matches(path, '{}') THEN 'baseline_or_generated' WHEN regexp_matches(path, '{}') THEN 'test' WHEN regexp_matches(path, '{}') THEN 'implementation' ELSE 'other' END".format(P.DOCUMENTATION, P.GENERATED, P.TEST, P.IMPLEMENTATION)
ORACLES = {
    "retrieval_rounds": f"""
WITH known AS (
  SELECT * FROM (VALUES {_KNOWN}) AS v(place, o, role, executable, ord)
), items AS (
  SELECT item_id, trim(text) AS text, list_sort(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{{3,}}'), lambda v: NOT list_contains({T.OWNER_STOP.split()}, v)), lambda w: (-length(w), w)))[1][2] AS word FROM benchmark
), left_ AS (
  SELECT item_id, o, executable, ord, min(ord) FILTER (executable) OVER (PARTITION BY item_id) AS goal FROM items, known WHERE (item_id + place) % 3 <> 0 AND role IS NOT NULL
), chosen AS (
  SELECT item_id, max(o) FILTER (ord = goal) AS o, coalesce(list(o ORDER BY ord) FILTER (goal IS NULL OR ord < goal), []) AS skipped FROM left_ GROUP BY item_id
), asked AS (
  SELECT item_id, kind, CASE kind WHEN 0 THEN array_to_string(list_slice({TOKENS.format("text")}, 1, {HEAD}), ' ') WHEN 1 THEN text ELSE text || ' ' || {_WORDS} END AS said
  FROM items LEFT JOIN chosen USING (item_id), (SELECT unnest([0, 1, 2]) AS kind)
), q AS (
  SELECT query, term, CAST(count(*) AS DOUBLE) AS qtf FROM (SELECT item_id * 3 + kind AS query, unnest({TOKENS.format("said")}) AS term FROM asked) GROUP BY ALL
), {PARTS}, scored AS (
  SELECT query, doc_id, round(sum(idf * w), 6) AS score FROM w GROUP BY ALL
), top AS (
  SELECT query // 3 AS item_id, query % 3 AS kind, doc_id FROM scored QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) <= {HITS}
), hit AS (
  SELECT item_id, kind, doc_id, {_ROLE} = 'implementation' AND contains(lower(f.text), word) AS own, contains(f.text, i.text) AS whole FROM top JOIN files f USING (doc_id) JOIN items i USING (item_id)
), per AS (
  SELECT item_id, list_sort(list(DISTINCT CAST(doc_id AS VARCHAR)) FILTER (kind = 0)) AS r0, list_sort(list(DISTINCT CAST(doc_id AS VARCHAR)) FILTER (kind = 1)) AS r1, list_sort(list(DISTINCT CAST(doc_id AS VARCHAR)) FILTER (kind = 2)) AS r2,
    coalesce(bool_or(own) FILTER (kind = 0), false) AS g0, coalesce(bool_or(own) FILTER (kind <= 1), false) AS g1, coalesce(bool_or(whole) FILTER (kind = 0), false) AS s0,
    coalesce(bool_or(whole) FILTER (kind <= 1), false) AS s1, coalesce(bool_or(whole) FILTER (kind = 2), false) AS s2 FROM hit GROUP BY item_id
), e AS (
  SELECT i.item_id, coalesce(r0, []) AS r0, coalesce(r1, []) AS r1, coalesce(r2, []) AS r2, coalesce(g0, false) AS g0, coalesce(g1, false) AS g1, coalesce(s0, false) AS s0, coalesce(s1, false) AS s1, coalesce(s2, false) AS s2, o, coalesce(skipped, []) AS skipped
  FROM items i LEFT JOIN per USING (item_id) LEFT JOIN chosen USING (item_id)
), a AS (
  SELECT *, NOT s0 AND NOT g0 AS recovers, list_sort(list_distinct(CASE WHEN NOT s0 AND NOT g0 THEN r0 || r1 ELSE r0 END)) AS e1 FROM e
), b AS (
  SELECT *, CASE WHEN s0 THEN 'initial_round_sufficient' WHEN recovers AND s1 THEN 'owner_recovery_sufficient' WHEN recovers AND len(e1) = len(r0) AND NOT g1 THEN 'partial_no_owner_gain'
      WHEN recovers AND NOT g1 THEN 'partial_owner_not_grounded' WHEN o IS NULL THEN 'partial_no_deferred_promotion' END AS early FROM a
), c AS (
  SELECT *, list_sort(list_distinct(CASE WHEN early IS NULL THEN e1 || r2 ELSE e1 END)) AS e2 FROM b
)
SELECT item_id, CAST(1 + CASE WHEN recovers THEN 1 ELSE 0 END + CASE WHEN early IS NULL THEN 1 ELSE 0 END AS BIGINT) AS rounds,
  coalesce(early, CASE WHEN s2 OR (CASE WHEN recovers THEN s1 ELSE s0 END) THEN 'adaptive_round_sufficient' WHEN len(e2) = len(e1) THEN 'partial_no_promoted_evidence_gain' ELSE 'adaptive_round_limit' END) AS stop,
  CASE WHEN early IS NULL OR early = 'partial_no_deferred_promotion' THEN array_to_string(skipped || CASE WHEN o IS NULL THEN [] ELSE [o] END, ',') ELSE '' END AS promoted,
  array_to_string(e2, ',') AS refs, len(r0) || CASE WHEN recovers THEN ',' || len(e1) ELSE '' END || CASE WHEN early IS NULL THEN ',' || len(e2) ELSE '' END AS counts
FROM c""",
}
