"""Queries: intake and enrichment of hits, follow-up of weak items, and checks of answers, claims and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..sources.tables import load
from .search import BATCH, bm25_ranked

CONNECTIVE = "^(to|and|for|the)( |$)"
WORD = "[a-z]{6,}"


def enriched_hits(spark, d, enrich=3, least=1.0):
    """Hits of each item above a score; the first few learn their text, and a hit without one stays."""
    hits = bm25_ranked(spark, d).where(F.col("score") >= least).select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"))
    docs = load(spark, d, "documents", "doc_id", "text").withColumnRenamed("doc_id", "d2")
    j = hits.join(docs, (F.col("doc_id") == F.col("d2")) & (F.col("rank") <= enrich), "left")
    return j.select("item_id", "doc_id", "rank", F.when(F.col("rank") <= enrich, F.coalesce("text", F.lit(""))).alias("content"))


def evidence_intake(spark, d, most=8):
    """References that each user's events make: raw, valid, invalid, repeated, retained and over the limit.

    Counts need no order, so this is one aggregation that combines before its shuffle.
    """
    e = load(spark, d, "events", "user_id", "event_type", "value", "props").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    valid = F.col("k").isNotNull() & (F.col("value") >= 10)
    per = e.groupBy("user_id", F.when(valid, F.struct("event_type", "k")).alias("ref")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("ref").isNotNull()
    t = per.groupBy("user_id").agg(F.sum("n").alias("raw"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("valid"), F.count_if(known).alias("single"))
    kept = F.least(F.col("single"), F.lit(most))
    return t.select("user_id", "raw", "valid", (F.col("raw") - F.col("valid")).alias("invalid"), (F.col("valid") - F.col("single")).alias("duplicate"), kept.alias("retained"), (F.col("single") - kept).alias("limit_dropped"))


def sufficiency_check(spark, d, take=3):
    """Whether the first hits of each item support it; a hit that must not be cited makes that unclear."""
    hits = bm25_ranked(spark, d, take).join(load(spark, d, "labels"), "doc_id", "left")
    seen = hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("refs"), F.count_if(F.col("toxic") == 1).alias("invalid"), F.count_if(F.col("quality") == 1).alias("good"))
    x = load(spark, d, "benchmark", "item_id").join(seen, "item_id", "left").fillna(0, ["refs", "invalid", "good"])
    status = F.when(F.col("refs") == 0, "missing").when(F.col("invalid") > 0, "unclear").when(F.col("good") > 0, "covered").otherwise("partial")
    return x.select("item_id", "refs", "invalid", status.alias("status"))


def _replies(spark, d):
    """Each user message with the assistant's message of the next turn; an equality join, so a long conversation spreads."""
    t = load(spark, d, "conversations", "conv_id", "turn", "role", "text")
    said = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.coalesce("text", F.lit("")).alias("reply"))
    return t.where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("ask")).join(said, ["conv_id", "turn"], "left")


def reply_check(spark, d):
    """How many questions of each conversation are answered by the next turn, and the first that is not."""
    open_ = F.col("reply").isNull()
    g = _replies(spark, d).groupBy("conv_id").agg(F.count(F.lit(1)).alias("expected"), F.count("reply").alias("answered"), F.min(F.when(open_, F.col("turn"))).alias("next_turn"))
    status = F.when(F.col("expected") == F.col("answered"), "complete").when(F.col("answered") == 0, "none").otherwise("partial")
    return g.select("conv_id", "expected", "answered", status.alias("status"), "next_turn")


def grounding_check(spark, d):
    """Sentences of each reply: a claim must share a long word with its question, a connective sentence must not."""
    r = _replies(spark, d).where("reply IS NOT NULL").withColumn("known", F.regexp_extract_all(F.lower("ask"), F.lit(WORD), F.lit(0)))
    s = r.select("conv_id", "turn", "known", F.explode(F.split(F.lower("reply"), "[.\n]", -1)).alias("s")).withColumn("s", F.trim("s")).where("s != ''")
    cites = F.arrays_overlap("known", F.regexp_extract_all("s", F.lit(WORD), F.lit(0)))
    link = F.col("s").rlike(CONNECTIVE)
    return s.groupBy("conv_id", "turn").agg(F.count_if(~link).alias("claims"), F.count_if(~link & ~cites).alias("uncited"), F.count_if(link & cites).alias("bad_connectives"))


def question_check(spark, d, take=3):
    """The first three different questions of each conversation; repeats are folded before they are ranked."""
    sign = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " ")
    t = load(spark, d, "conversations", "conv_id", "turn", "role", "text").where("role = 'user'")
    single = t.groupBy("conv_id", F.xxhash64(sign).alias("h"), sign.alias("sign")).agg(F.min("turn").alias("turn"), F.count(F.lit(1)).alias("copies"))
    return S.top(single, "conv_id", take, F.col("turn"), F.col("sign")).select("conv_id", "turn", "copies", F.col("rank").cast("long").alias("rank"))


def weak_followup(spark, d, specs=4, take=4):
    """Follow-up of items whose five best hits don't hold them: documents with most of an item's rarest terms."""
    items, docs = load(spark, d, "benchmark", "item_id", "text"), load(spark, d, "documents", "doc_id", "text")
    ranked = bm25_ranked(spark, d)
    held = ranked.where("rank <= 5").join(docs, "doc_id").join(items.withColumnRenamed("text", "item"), "item_id").where(F.expr("contains(text, trim(item))"))
    weak = items.join(held.select("item_id"), "item_id", "left_anti")
    terms = S.query_terms(weak, "item_id", "text")
    post = S.postings(docs, terms)
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rare = S.top(terms.join(df, "term"), "query", specs, F.col("df"), F.col("term")).select(F.col("query").alias("item_id"), "term", "df")
    found = post.join(rare, "term").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("matched"), F.round(F.sum(1.0 / F.col("df")), 9).alias("score"))
    best = S.top(found, "item_id", take, F.desc("matched"), F.desc("score"), F.col("doc_id"))
    known = ranked.select("item_id", "doc_id", F.lit(True).alias("known"))
    j = best.join(known, ["item_id", "doc_id"], "left")
    return j.select("item_id", "doc_id", "matched", "score", F.col("rank").cast("long").alias("rank"), F.col("known").isNull().alias("fresh"))


QUERIES = {f.__name__: f for f in (enriched_hits, evidence_intake, sufficiency_check, reply_check, grounding_check, question_check, weak_followup)}
_REPLIES = """
q AS (SELECT u.conv_id, u.turn, coalesce(u.text, '') AS ask, CASE WHEN a.conv_id IS NOT NULL THEN coalesce(a.text, '') END AS reply
  FROM conversations u
  LEFT JOIN (SELECT *
  FROM conversations
  WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user')"""
_CITES = f"list_has_any(known, regexp_extract_all(s, '{WORD}'))"
_LINK = f"regexp_matches(s, '{CONNECTIVE}')"
ORACLES = {
    "enriched_hits": f"{BATCH} SELECT query AS item_id, r.doc_id, rank, CASE WHEN rank <= 3 THEN coalesce(text, '') END AS content FROM r LEFT JOIN documents d ON d.doc_id = r.doc_id WHERE rank <= 10 AND score >= 1",
    "evidence_intake": """
WITH e AS (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value
  FROM events),
p AS (SELECT user_id, event_type, k, k IS NOT NULL AND value >= 10 AS ok
  FROM e),
t AS (SELECT user_id, count(*) AS raw, count_if(ok) AS valid, count(DISTINCT CASE WHEN ok THEN event_type || ' ' || k END) AS single
  FROM p
  GROUP BY user_id) SELECT user_id, raw, CAST(valid AS BIGINT) AS valid, CAST(raw - valid AS BIGINT) AS invalid, CAST(valid - single AS BIGINT) AS duplicate, least(single, 8) AS retained, single - least(single, 8) AS limit_dropped
  FROM t""",
    "sufficiency_check": f"""
{BATCH}, g AS (SELECT query, count(*) AS refs, count_if(toxic = 1) AS invalid, count_if(quality = 1) AS good
  FROM r
  LEFT JOIN labels l ON l.doc_id = r.doc_id
  WHERE rank <= 3
  GROUP BY query) SELECT item_id, coalesce(refs, 0) AS refs, CAST(coalesce(invalid, 0) AS BIGINT) AS invalid, CASE WHEN refs IS NULL THEN 'missing' WHEN invalid > 0 THEN 'unclear' WHEN good > 0 THEN 'covered' ELSE 'partial' END AS status
  FROM benchmark
  LEFT JOIN g ON query = item_id""",
    "reply_check": f"""
WITH {_REPLIES} SELECT conv_id, count(*) AS expected, count(reply) AS answered, CASE WHEN count(*) = count(reply) THEN 'complete' WHEN count(reply) = 0 THEN 'none' ELSE 'partial' END AS status, min(CASE WHEN reply IS NULL THEN turn END) AS next_turn
  FROM q
  GROUP BY conv_id""",
    "grounding_check": f"""
WITH {_REPLIES}, x AS (SELECT conv_id, turn, regexp_extract_all(lower(ask), '{WORD}') AS known, unnest(string_split_regex(lower(reply), '[.\\n]')) AS s
  FROM q
  WHERE reply IS NOT NULL),
y AS (SELECT conv_id, turn, known, trim(s) AS s
  FROM x
  WHERE trim(s) <> '') SELECT conv_id, turn, CAST(count_if(NOT {_LINK}) AS BIGINT) AS claims, CAST(count_if(NOT {_LINK} AND NOT {_CITES}) AS BIGINT) AS uncited, CAST(count_if({_LINK} AND {_CITES}) AS BIGINT) AS bad_connectives
  FROM y
  GROUP BY conv_id, turn""",
    "question_check": """
WITH s AS (SELECT conv_id, turn, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g') AS sign
  FROM conversations
  WHERE role = 'user'),
g AS (SELECT conv_id, sign, min(turn) AS turn, count(*) AS copies
  FROM s
  GROUP BY conv_id, sign) SELECT conv_id, turn, copies, rank
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, sign) AS rank
  FROM g)
  WHERE rank <= 3""",
    "weak_followup": f"""
{BATCH}, h AS (SELECT DISTINCT query
  FROM r JOIN documents d ON d.doc_id = r.doc_id JOIN benchmark b ON b.item_id = r.query
  WHERE rank <= 5 AND contains(d.text, trim(b.text))),
v AS (SELECT DISTINCT query, doc_id, term
  FROM w),
f AS (SELECT term, count(DISTINCT doc_id) AS df
  FROM v
  GROUP BY term),
t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY df, term) AS n
  FROM (SELECT DISTINCT query, term, df
  FROM v JOIN f USING (term)
  WHERE query NOT IN (SELECT query
  FROM h))),
g AS (SELECT v.query, v.doc_id, count(*) AS matched, round(sum(1e0 / df), 9) AS score
  FROM v JOIN t ON t.query = v.query AND t.term = v.term
  WHERE n <= 4
  GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY matched DESC, score DESC, doc_id) AS place
  FROM g) SELECT b.query AS item_id, b.doc_id, matched, b.score, place AS rank, r.doc_id IS NULL AS fresh
  FROM b
  LEFT JOIN r ON r.query = b.query AND r.doc_id = b.doc_id AND r.rank <= 10
  WHERE place <= 4""",
}
