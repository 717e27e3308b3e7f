"""Queries: refinement, adaptive rounds, links and the validation of plans and decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import load
from .search import BATCH, bm25_ranked
from .texts import DECLARATION, LINES, PATH, declaration_spans

TERMS = {"thtion": 2.2, "onre": 1.8, "erin": 1.2}
LINK = 'href="([^"]*)"'
HOST = "^[a-z]+://([^/?#]*)"


def weighted_declarations(spark, d, take=4, most=80):
    """Of each document the best declarations by weighted terms, terms in the header, and support lines in their span.

    Lines learn their declaration from a running window, so spans and lines need no interval join.
    """
    docs = load(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("no", "line"))
    own = F.when(F.col("line").rlike(DECLARATION), F.col("no") + 1)
    lines = docs.withColumn("decl", F.last(own, True).over(Window.partitionBy("doc_id").orderBy("no"))).where(F.col("no") + 1 < F.col("decl") + most)
    low, header = F.lower("line"), F.col("no") + 1 == F.col("decl")
    said = [F.count_if(low.contains(t)).alias(t) for t in TERMS]
    spans = lines.groupBy("doc_id", "decl").agg(*said, F.count_if(header & low.rlike("|".join(TERMS))).alias("header"), F.count_if(low.contains("|")).alias("support"))
    score = F.lit(0.0)
    for t, w in TERMS.items():
        score += F.least(F.col(t), F.lit(3)) * w
    score += F.when(F.col("header") > 0, 1.5).otherwise(0.0) + F.when(F.col("support") > 0, 0.8).otherwise(0.0) - F.least(F.col("decl") / 10000.0, F.lit(0.6))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "decl"))
    best = spans.select("doc_id", F.col("decl").cast("long").alias("decl"), F.round(score, 4).alias("score")).where("score > 0")
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= take)


def snippets(spark, d, most=3):
    """The first lines of each declaration's span, clamped to the text."""
    docs = load(spark, d, "documents", "doc_id", "text").select("doc_id", T.lines(F.col("text")).alias("a"))
    spans = declaration_spans(spark, d)
    length = F.least(F.lit(most), F.col("end") - F.col("start") + 1)
    return spans.join(docs, "doc_id").select("doc_id", "start", F.array_join(F.slice("a", F.col("start").cast("int"), length.cast("int")), "\n").alias("snippet"))


def adaptive_rounds(spark, d):
    """Rounds of evidence for each item, and why they ended.

    A round reads on in one ranking (5, 10, then 20 hits) until a hit holds the item's text; a round that brings nothing
    new ends them too. All rounds are one aggregation over the ranking instead of a loop.
    """
    items = load(spark, d, "benchmark", "item_id", "text").withColumnRenamed("text", "item")
    hits = bm25_ranked(spark, d, 20).select("item_id", "doc_id", "rank").join(load(spark, d, "documents", "doc_id", "text"), "doc_id").join(items, "item_id")
    held = F.min(F.when(F.expr("contains(text, trim(item))"), F.col("rank"))).alias("held")
    seen = hits.groupBy("item_id").agg(held, *[F.count_if(F.col("rank") <= k).alias(f"n{k}") for k in (5, 10, 20)])
    x = items.select("item_id").join(seen, "item_id", "left").fillna(0, ["n5", "n10", "n20"])
    at = F.coalesce(F.col("held"), F.lit(99))
    stop = (
        F.when(at <= 5, "initial_round_sufficient").when(F.col("n10") == F.col("n5"), "no_new_evidence").when(at <= 10, "recovered")
        .when(F.col("n20") == F.col("n10"), "no_new_evidence").when(at <= 20, "promotion_sufficient").otherwise("round_limit")
    )
    rounds = F.when(at <= 5, 1).when((F.col("n10") == F.col("n5")) | (at <= 10), 2).otherwise(3).cast("long")
    used = F.when(F.col("rounds") == 1, F.col("n5")).when(F.col("rounds") == 2, F.col("n10")).otherwise(F.col("n20"))
    return x.select("item_id", rounds.alias("rounds"), stop.alias("stop_reason"), "n5", "n10", "n20").withColumn("evidence", used).drop("n5", "n10", "n20")


def link_resolution(spark, d):
    """Links of each host's pages: how many, to how many targets, and how many lead to a page of the table."""
    pages = load(spark, d, "pages", "url", "html").select(F.regexp_extract("url", HOST, 1).alias("host"), T.url_path(F.col("url")).alias("path"), "html")
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("href")).where(F.col("href").startswith("/"))
    targets = links.groupBy("host", F.regexp_replace("href", "^/+|/+$", "").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    known = pages.select("host", "path").distinct().withColumn("known", F.lit(True))
    j = targets.join(known, ["host", "path"], "left")
    return j.groupBy("host").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("targets"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("resolved"))


def source_plan_check(spark, d):
    """A plan must name each English source once: which entries are missing, unknown or repeated."""
    docs = load(spark, d, "documents", "doc_id", "source", "lang")
    allowed = docs.where("lang = 'en'").select("source").distinct().withColumn("allowed", F.lit(True))
    plan = load(spark, d, "labels").where("toxic = 1").join(docs, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("entries"))
    j = plan.join(allowed, "source", "full")
    status = F.when(F.col("allowed").isNull(), "unknown").when(F.col("entries").isNull(), "missing").when(F.col("entries") > 1, "duplicate").otherwise("ok")
    return j.select("source", F.coalesce("entries", F.lit(0)).alias("entries"), status.alias("status"))


def assessment_shortlist(spark, d, take=12):
    """Labelled documents as core, secondary or noise; the first twelve of each source count."""
    role = F.when(F.col("toxic") == 1, "noise").when(F.col("quality") == 1, "core").otherwise("secondary")
    j = load(spark, d, "labels").join(load(spark, d, "documents", "doc_id", "source"), "doc_id").select("source", "doc_id", role.alias("role"))
    r = j.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long"))
    return r.where(F.col("rank") <= take)


def policy_check(spark, d):
    """Whether a conversation is allowed, and the rules that it breaks."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    t = load(spark, d, "conversations").withColumn("previous", F.lag("role").over(w))
    broken = t.groupBy("conv_id").agg(
        F.max(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty_text"),
        F.max(F.coalesce(F.col("role") == F.col("previous"), F.lit(False))).alias("role_order"),
        F.max(~F.coalesce(F.col("role").isin("user", "assistant", "system"), F.lit(False))).alias("unknown_role"),
    )
    rules = F.concat_ws(",", *[F.when(F.col(c), c) for c in ("empty_text", "role_order", "unknown_role")])
    return broken.select("conv_id", (rules == "").alias("allowed"), rules.alias("violations"))


def cache_misses(spark, d):
    """Texts by language whose embedding key is in the cache (that of the labelled documents) or must be computed."""
    key = F.sha2(F.concat(F.lit("model\n"), "text"), 256)
    docs = load(spark, d, "documents", "doc_id", "text", "lang").select("doc_id", "lang", key.alias("key"))
    cache = docs.join(load(spark, d, "labels", "doc_id"), "doc_id", "left_semi").select("key").distinct().withColumn("held", F.lit(True))
    j = docs.select("lang", "key").distinct().join(cache, "key", "left")
    return j.groupBy("lang").agg(F.count("held").alias("hits"), F.count_if(F.col("held").isNull()).alias("misses"))


QUERIES = {f.__name__: f for f in (weighted_declarations, snippets, adaptive_rounds, link_resolution, source_plan_check, assessment_shortlist, policy_check, cache_misses)}
_SAID = ", ".join(f"count_if(contains(lower(line), '{t}')) AS {t}" for t in TERMS)
_SCORE = " + ".join(["0e0", *(f"least({t}, 3) * {w}e0" for t, w in TERMS.items())])
_BAND = ", ".join(f"count_if(rank <= {k}) AS n{k}" for k in (5, 10, 20))
_TARGET = "regexp_replace(href, '^/+|/+$', '', 'g')"
ORACLES = {
    "weighted_declarations": f"""
WITH {LINES}, m AS (SELECT *, max(CASE WHEN regexp_matches(line, '{DECLARATION}') THEN no END) OVER (PARTITION BY doc_id ORDER BY no) AS decl
  FROM l),
s AS (SELECT doc_id, decl, {_SAID}, count_if(no = decl AND regexp_matches(lower(line), '{'|'.join(TERMS)}')) AS header, count_if(contains(line, '|')) AS support
  FROM m
  WHERE no < decl + 80
  GROUP BY doc_id, decl),
x AS (SELECT doc_id, decl, round({_SCORE} + (CASE WHEN header > 0 THEN 1.5e0 ELSE 0e0 END + CASE WHEN support > 0 THEN 0.8e0 ELSE 0e0 END - least(decl / 10000e0, 0.6e0)), 4) AS score
  FROM s) SELECT *
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, decl) AS rank
  FROM x
  WHERE score > 0)
  WHERE rank <= 4""",
    "snippets": f"""
WITH {LINES}, s AS (SELECT doc_id, no AS start, coalesce(lead(no) OVER (PARTITION BY doc_id ORDER BY no) - 1, n) AS e
  FROM l
  WHERE regexp_matches(line, '{DECLARATION}')) SELECT doc_id, start, string_agg(line, chr(10) ORDER BY no) AS snippet
  FROM s JOIN l USING (doc_id)
  WHERE no BETWEEN start AND least(e, start + 2)
  GROUP BY doc_id, start""",
    "adaptive_rounds": f"""
{BATCH}, g AS (SELECT b.item_id, min(CASE WHEN contains(d.text, trim(b.text)) THEN rank END) AS held, {_BAND}
  FROM r JOIN benchmark b ON r.query = b.item_id JOIN documents d USING (doc_id)
  WHERE rank <= 20
  GROUP BY b.item_id),
x AS (SELECT b.item_id, coalesce(held, 99) AS a, coalesce(n5, 0) AS n5, coalesce(n10, 0) AS n10, coalesce(n20, 0) AS n20
  FROM benchmark b
  LEFT JOIN g ON b.item_id = g.item_id),
y AS (SELECT *, CAST(CASE WHEN a <= 5 THEN 1 WHEN n10 = n5 OR a <= 10 THEN 2 ELSE 3 END AS BIGINT) AS rounds
  FROM x) SELECT item_id, rounds, CASE WHEN a <= 5 THEN 'initial_round_sufficient' WHEN n10 = n5 THEN 'no_new_evidence' WHEN a <= 10 THEN 'recovered' WHEN n20 = n10 THEN 'no_new_evidence' WHEN a <= 20 THEN 'promotion_sufficient' ELSE 'round_limit' END AS stop_reason, CAST(CASE rounds WHEN 1 THEN n5 WHEN 2 THEN n10 ELSE n20 END AS BIGINT) AS evidence
  FROM y""",
    "link_resolution": f"""
WITH p AS (SELECT regexp_extract(url, '{HOST}', 1) AS host, {PATH} AS path, html
  FROM pages),
t AS (SELECT host, {_TARGET} AS path, count(*) AS n
  FROM (SELECT host, unnest(regexp_extract_all(html, '{LINK}', 1)) AS href
  FROM p)
  WHERE starts_with(href, '/')
  GROUP BY ALL),
k AS (SELECT DISTINCT host, path, 1 AS known
  FROM p) SELECT host, CAST(sum(n) AS BIGINT) AS links, count(*) AS targets, CAST(sum(CASE WHEN known = 1 THEN n ELSE 0 END) AS BIGINT) AS resolved
  FROM t
  LEFT JOIN k USING (host, path)
  GROUP BY host""",
    "source_plan_check": """
WITH a AS (SELECT DISTINCT source, 1 AS allowed
  FROM documents
  WHERE lang = 'en'),
p AS (SELECT source, count(*) AS entries
  FROM labels JOIN documents USING (doc_id)
  WHERE toxic = 1
  GROUP BY source) SELECT source, coalesce(entries, 0) AS entries, CASE WHEN allowed IS NULL THEN 'unknown' WHEN entries IS NULL THEN 'missing' WHEN entries > 1 THEN 'duplicate' ELSE 'ok' END AS status
  FROM p FULL JOIN a USING (source)""",
    "assessment_shortlist": """
SELECT *
  FROM (SELECT source, doc_id, CASE WHEN toxic = 1 THEN 'noise' WHEN quality = 1 THEN 'core' ELSE 'secondary' END AS role, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank
  FROM labels JOIN documents USING (doc_id))
  WHERE rank <= 12""",
    "policy_check": """
WITH t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS previous
  FROM conversations),
b AS (SELECT conv_id, concat_ws(',', CASE WHEN bool_or(trim(coalesce(text, '')) = '') THEN 'empty_text' END, CASE WHEN bool_or(coalesce(role = previous, false)) THEN 'role_order' END, CASE WHEN bool_or(NOT coalesce(role IN ('user', 'assistant', 'system'), false)) THEN 'unknown_role' END) AS violations
  FROM t
  GROUP BY conv_id) SELECT conv_id, violations = '' AS allowed, violations
  FROM b""",
    "cache_misses": """
WITH k AS (SELECT doc_id, lang, sha256('model' || chr(10) || text) AS key
  FROM documents),
c AS (SELECT DISTINCT key, 1 AS held
  FROM k
  WHERE doc_id IN (SELECT doc_id
  FROM labels)) SELECT lang, count(held) AS hits, CAST(count_if(held IS NULL) AS BIGINT) AS misses
  FROM (SELECT DISTINCT lang, key
  FROM k)
  LEFT JOIN c USING (key)
  GROUP BY lang""",
}
