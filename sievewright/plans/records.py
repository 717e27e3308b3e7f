"""Queries: payloads of connected sources, decisions about their documents, entity search, inputs of embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import terms as T
from ..functions.text import tokens
from ..operators import fuzzy as X
from ..operators import search as S
from ..sources.stored import stored
from ..sources.tables import REPOSITORY, load, repository
from .repository import _LINES, index_search
from .search import ITEMS, PARTS, TOKENS
from .shared import GRAPH_SQL, symbol_graph

CONTRIBUTIONS = ("behavior", "architecture", "implementation_history", "reproduction", "decision", "error", "symbol", "file", "acceptance_criteria", "terminology_only", "none")


def _payloads(spark, d):
    """A JSON payload for each order: its items under one of three keys, or the order alone."""
    item = F.struct(F.col("l_linenumber").cast("string").alias("id"), F.struct(F.lit(1).alias("x")).alias("name"), F.col("l_linestatus").alias("title"), F.col("l_quantity").alias("score"), F.col("l_returnflag").alias("type"))
    g = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("a"))
    k = F.col("l_orderkey") % 4
    body = F.when(k == 0, F.to_json(F.struct(F.col("a").alias("results")))).when(k == 1, F.to_json(F.struct(F.lit(3).alias("total"), F.col("a").alias("issues")))).when(k == 2, F.to_json(F.struct(F.col("l_orderkey").alias("id"), F.lit(" ").alias("content"), F.lit("body of it").alias("body"))))
    return g.select("l_orderkey", body.alias("payload"))


def json_records(spark, d):
    """Records of each payload, the first one's label and score, the payload's text, whether its type is enabled."""
    p = _payloads(spark, d)
    r = R.records(F.col("payload"))
    one = p.where("payload IS NOT NULL").select("l_orderkey", "payload", r.alias("r")).withColumn("first", F.get("r", F.lit(0)))
    kind = R.record_type(F.col("first"))
    wanted = F.create_map(F.lit("n"), F.lit(False), F.lit("r"), F.lit(True))
    text = F.when(F.size("r") == 1, R.payload_text(F.col("payload")))
    return one.select("l_orderkey", F.size("r").cast("long").alias("records"), R.first_scalar(F.col("first"), ("name", "title", "id")).alias("label"), R.first_number(F.col("first"), ("rank", "title", "score")).alias("score"), R.feature_enabled(kind, wanted).alias("enabled"), F.coalesce(F.length(text) > 0, F.lit(False)).alias("has_text"))


def event_metadata(spark, d):
    """Metadata of each user's last two events merged, the later winning, without reserved keys; and its cache key."""
    e = load(spark, d, "events", "event_id", "user_id", "event_type", "value")
    m = F.create_map(F.lit("type"), F.col("event_type"), F.lit("event"), F.col("event_id").cast("string"), F.concat(F.lit("seen_"), "event_type"), F.lit("1"))
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    two = e.select("user_id", m.alias("m"), F.row_number().over(w).alias("r")).where("r <= 2").groupBy("user_id").agg(F.max_by("m", F.when(F.col("r") == 1, 1)).alias("b"), F.max_by("m", F.when(F.col("r") == 2, 1)).alias("a"))
    both = R.merged(F.coalesce("a", F.expr("map_filter(b, (k, v) -> false)")), F.col("b"), ("event",))
    keys = F.array_join(F.array_sort(F.map_keys(both)), ",")
    return two.select("user_id", keys.alias("keys"), F.element_at(both, "type").alias("type"), R.cache_key(F.col("user_id"), keys).alias("cache_key"))


def tool_choice(spark, d):
    """The tool that fits each event type best: an exact name, else the highest score, the first of equals."""
    e = load(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    tools = ("searchPages", "page-view", "click_to_fetch", "purchaseOrders", "errorLog")
    wanted = F.array(F.concat(F.col("event_type"), F.lit("_page")), F.concat(F.lit("get_"), F.col("event_type")))
    scored = e.crossJoin(F.broadcast(spark.createDataFrame(list(enumerate(tools)), "ord int, tool string"))).withColumn("score", T.tool_score(F.col("tool"), wanted, F.array(F.lit("search"))))
    return scored.where("score > 0").groupBy("event_type").agg(F.min_by(F.struct("tool", "score"), F.struct(-F.col("score"), "ord")).alias("x")).select("event_type", "x.tool", F.col("x.score").cast("long").alias("score"))


def _decisions(spark, d):
    """A decision for each labelled document, as a model would have stated it."""
    j = load(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).join(load(spark, d, "documents", "doc_id", "source", "text", "n_chars"), "doc_id")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    return j.select("doc_id", "source", "text", (F.col("n_chars") / 4000.0).alias("relevance"), F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "Accept").otherwise("maybe").alias("decision"), pick((*CONTRIBUTIONS, "gossip")).alias("contribution"), (F.col("doc_id") % 3 != 0).alias("signal"), pick(("current", "historical", "newest", "Current", "current")).alias("currentness"), pick(("high", "medium", "low", "high", "sure", "high", "medium")).alias("confidence"))


def document_decisions(spark, d, context=4, evidence=2):
    """Decisions checked field by field; documents that disclaim themselves are rejected; of each source the most relevant
    ones that pass all six conditions are context, and the first of these evidence."""
    x = _decisions(spark, d)
    clamp = lambda c, allowed, other: F.when(F.lower(F.trim(c)).isin(*allowed), F.lower(F.trim(c))).otherwise(other)
    t = F.lower("text")
    disclaimed = F.contains(t, F.lit("the ")) & (F.contains(t, F.lit("erin")) | F.contains(t, F.lit("onre")))
    kind = F.when(disclaimed, "none").otherwise(clamp(F.col("contribution"), CONTRIBUTIONS, "none"))
    x = x.select("doc_id", "source", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "relevance")), 6).alias("relevance"), F.when(disclaimed, "reject").otherwise(F.lower("decision")).alias("said"), kind.alias("contribution"), (F.col("signal") & ~disclaimed).alias("signal"), F.when(disclaimed, "historical").otherwise(clamp(F.col("currentness"), ("current", "historical", "uncertain"), "uncertain")).alias("currentness"), F.when(disclaimed, "high").otherwise(clamp(F.col("confidence"), ("high", "medium", "low"), "low")).alias("confidence"))
    use = (F.col("said") != "reject") & F.col("signal") & ~F.col("contribution").isin("terminology_only", "none") & (F.col("currentness") != "uncertain") & (F.col("confidence") != "low")
    x = x.withColumn("use", use)
    r = F.row_number().over(Window.partitionBy("source", "use").orderBy(F.desc("relevance"), "doc_id"))
    decision = F.when(F.col("said").isin("accept", "reject", "uncertain"), F.col("said")).otherwise("reject")
    return x.withColumn("r", r).select("doc_id", "relevance", decision.alias("decision"), "contribution", "currentness", "confidence", (F.col("use") & (F.col("r") <= context)).alias("context_use"), (F.col("use") & (F.col("r") <= evidence)).alias("evidence_use"))


def supported_signals(spark, d):
    """Signals from decided documents (their code-like terms): those that touch a source in conflict, one whose documents
    are labelled both good and toxic, go unless they are mere retrieval terms."""
    x = _decisions(spark, d)
    conflict = x.groupBy("source").agg((F.max(F.lower("decision") == "accept") & F.max(F.col("decision") == "reject")).alias("c")).where("c").select("source")
    s = x.select("doc_id", "source", F.explode(F.array_distinct(T.code_terms(F.col("text"), 1 << 30))).alias("value"), F.when(F.col("doc_id") % 2 == 0, "retrieval_terms").otherwise("symbol_hints").alias("kind"))
    kept = s.where("kind = 'retrieval_terms'").unionByName(s.where("kind <> 'retrieval_terms'").join(conflict, "source", "left_anti").select(*s.columns))
    return kept.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("documents"))


def _words(spark, d):
    """``(item_id, term)``: the longer words of each item."""
    return load(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.filter(T.identifiers(F.col("text")), lambda w: F.length(w) >= 5))).alias("term"))


def entity_search(spark, d, most=3, edits=2):
    """Entities for each longer word of an item: declared names equal to it, else equal in lower case, else names of three
    letters or more that it begins with, else names of files whose path says it, by BM25, else names at most two edits away; the
    first way that finds any counts."""
    words = stored(_words(spark, d), "words")
    nodes = symbol_graph(spark, d)[0]
    names = stored(nodes.groupBy("name").agg(F.count(F.lit(1)).alias("nodes")), "names").withColumn("low", F.lower("name"))
    low = words.withColumn("low", F.lower("term"))
    way = lambda df, n, rank: df.select("item_id", "term", "name", "nodes", F.lit(n).cast("long").alias("way"), rank.cast("double").alias("place"))
    same = way(low.join(names, "low"), 1, F.lit(0)).withColumn("way", F.when(F.col("name") == F.col("term"), 1).otherwise(2).cast("long"))
    heads = low.select("item_id", "term", F.explode(F.transform(F.sequence(F.lit(3), F.length("low") - 1), lambda n: F.substring("low", F.lit(1), n))).alias("low"))
    begins = way(heads.join(names, "low"), 3, -F.length("name"))
    paths = nodes.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set(F.regexp_extract("path", "^[^/]+/[^/]+", 0))), " ").alias("text"))  # folders are few
    asked = words.select("term").distinct().select(F.col("term").alias("query"), F.lower("term").alias("term"), F.lit(1.0).alias("qtf"))
    said = S.bm25(paths.select(F.col("name").alias("doc_id"), "text"), asked).select(F.col("query").alias("term"), F.col("doc_id").alias("name"), F.round("score", 6).alias("score"))
    by_path = way(words.join(said, "term").join(names, "name"), 4, -F.col("score"))
    near = X.near_words(low.select(F.col("low").alias("a")), names.select(F.col("low").alias("b")), edits).where("edits > 0")
    fuzzy = way(low.join(near, F.col("low") == F.col("a")).drop("low").join(names, F.col("low") == F.col("b")), 5, F.col("edits"))
    s = same.unionByName(begins).unionByName(by_path).unionByName(fuzzy)
    first = s.groupBy("item_id", "term").agg(F.min("way").alias("way"))
    w = Window.partitionBy("item_id", "term").orderBy("place", "name")
    best = s.join(first, ["item_id", "term", "way"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return best.select("item_id", "term", "name", "way", F.levenshtein(F.lower("term"), F.lower("name")).cast("long").alias("edits"), "nodes")


def embedding_inputs(spark, d):
    """What would be embedded of each file, its cache key with the model's name, and whether the supplied vectors have it."""
    f = repository(spark, d)
    text = R.embedding_text(F.col("path"), F.col("text"), tokens(F.col("text")), 120, 400)
    have = load(spark, d, "embeddings", "vec_id").distinct().withColumn("cached", F.lit(True))
    x = f.select("doc_id", F.length(text).cast("long").alias("chars"), F.sha2(F.concat(F.lit("model\n"), text), 256).alias("key"))
    return x.join(have, F.col("doc_id") == F.col("vec_id"), "left").select("doc_id", "chars", "key", F.coalesce("cached", F.lit(False)).alias("cached"))


QUERIES = {f.__name__: f for f in (json_records, event_metadata, tool_choice, document_decisions, supported_signals, entity_search, embedding_inputs)}

_IDS = lambda t: rf"list_filter(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*$'))"
_BLOCKED = "[" + ", ".join(f"'{x}'" for x in T.BLOCKED.split()) + "]"
_DECISIONS = f"""dec AS (
  SELECT doc_id, source, text, least(1e0, greatest(0e0, n_chars / 4000e0)) AS relevance, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'accept' ELSE 'maybe' END AS said,
    {list((*CONTRIBUTIONS, "none"))}[doc_id % 12 + 1] AS contribution, doc_id % 3 <> 0 AS signal, ['current', 'historical', 'uncertain', 'current', 'current'][doc_id % 5 + 1] AS currentness,
    ['high', 'medium', 'low', 'high', 'low', 'high', 'medium'][doc_id % 7 + 1] AS confidence,
    contains(lower(text), 'the ') AND (contains(lower(text), 'erin') OR contains(lower(text), 'onre')) AS dis
  FROM (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) JOIN documents USING (doc_id)
)"""
ORACLES = {
    "json_records": """
WITH g AS (
  SELECT l_orderkey, count(*) AS n, arg_min((l_linestatus, l_quantity, l_returnflag), (CAST(l_linenumber AS VARCHAR), l_linestatus, l_quantity, l_returnflag)) AS x FROM lineitem GROUP BY l_orderkey
)
SELECT l_orderkey, CASE WHEN l_orderkey % 4 < 2 THEN n ELSE 1 END AS records, CASE WHEN l_orderkey % 4 < 2 THEN x[1] ELSE CAST(l_orderkey AS VARCHAR) END AS label,
  CASE WHEN l_orderkey % 4 < 2 THEN CAST(x[2] AS DOUBLE) END AS score, NOT (l_orderkey % 4 < 2 AND x[3] = 'N') AS enabled, l_orderkey % 4 = 2 OR n = 1 AS has_text
FROM g WHERE l_orderkey % 4 < 3""",
    "event_metadata": """
WITH e AS (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events
), k AS (
  SELECT user_id, max(event_type) FILTER (r = 1) AS type, string_agg(DISTINCT 'seen_' || event_type, ',' ORDER BY 'seen_' || event_type) || ',type' AS keys FROM e WHERE r <= 2 GROUP BY user_id
)
SELECT user_id, keys, type, sha256('["' || user_id || '","' || keys || '"]') AS cache_key FROM k""",
    "tool_choice": """
WITH t AS (
  SELECT * FROM (VALUES (0, 'searchPages', ['search', 'pages']), (1, 'page-view', ['page', 'view']), (2, 'click_to_fetch', ['click', 'to', 'fetch']), (3, 'purchaseOrders', ['purchase', 'orders']), (4, 'errorLog', ['error', 'log'])) AS v(ord, tool, words)
), s AS (
  SELECT event_type, tool, ord, greatest(CASE WHEN list_contains(words, 'search') THEN 3 ELSE 0 END, len(list_intersect(words, [event_type, 'page'])), len(list_intersect(words, ['get', event_type]))) AS score
  FROM (SELECT DISTINCT event_type FROM events), t
)
SELECT event_type, arg_min(tool, (-score, ord)) AS tool, max(score) AS score FROM s WHERE score > 0 GROUP BY event_type""",
    "document_decisions": f"""
WITH {_DECISIONS}, x AS (
  SELECT doc_id, source, round(relevance, 6) AS relevance, CASE WHEN dis THEN 'reject' ELSE said END AS said, CASE WHEN dis THEN 'none' ELSE contribution END AS contribution, signal AND NOT dis AS signal,
    CASE WHEN dis THEN 'historical' ELSE currentness END AS currentness, CASE WHEN dis THEN 'high' ELSE confidence END AS confidence FROM dec
), u AS (
  SELECT *, said <> 'reject' AND signal AND contribution NOT IN ('terminology_only', 'none') AND currentness <> 'uncertain' AND confidence <> 'low' AS use FROM x
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source, use ORDER BY relevance DESC, doc_id) AS r FROM u
)
SELECT doc_id, relevance, CASE WHEN said IN ('accept', 'reject', 'uncertain') THEN said ELSE 'reject' END AS decision, contribution, currentness, confidence, use AND r <= 4 AS context_use, use AND r <= 2 AS evidence_use FROM r""",
    "supported_signals": f"""
WITH {_DECISIONS}, c AS (
  SELECT source FROM dec GROUP BY source HAVING max(said = 'accept') AND max(said = 'reject')
), s AS (
  SELECT source, unnest(list_distinct(list_filter({_IDS("text")}, lambda x: length(x) >= 5 AND regexp_matches(x, '[A-Z]') AND NOT list_contains({_BLOCKED}, lower(x))))) AS value, CASE WHEN doc_id % 2 = 0 THEN 'retrieval_terms' ELSE 'symbol_hints' END AS kind FROM dec
)
SELECT kind, value, count(*) AS documents FROM s WHERE value IS NOT NULL AND (kind = 'retrieval_terms' OR source NOT IN (SELECT source FROM c)) GROUP BY ALL""",
    "entity_search": f"""
WITH {REPOSITORY}, {_LINES}, {GRAPH_SQL}, terms AS (
  SELECT item_id, unnest(list_distinct(list_filter({_IDS("text")}, lambda x: length(x) >= 5))) AS term FROM benchmark
), names AS (
  SELECT name, count(*) AS nodes, list_distinct(list(regexp_extract(path, '^[^/]+/[^/]+'))) AS folders FROM nodes GROUP BY name
), tok AS (
  SELECT name, flatten(list_transform(folders, lambda y: {TOKENS.format("y")})) AS t FROM names
), st AS (
  SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(len(t) AS DOUBLE)) AS avgdl FROM tok
), post AS (
  SELECT name, dl, t, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT name, CAST(len(t) AS DOUBLE) AS dl, unnest(t) AS t FROM tok) GROUP BY ALL
), dfs AS (
  SELECT t, CAST(count(*) AS DOUBLE) AS df FROM post GROUP BY t
), bm AS (
  SELECT name, t, round(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / greatest(avgdl, 1e0))), 6) AS score FROM post JOIN dfs USING (t), st
), s AS (
  SELECT item_id, term, name, nodes, levenshtein(lower(term), lower(name)) AS edits, score,
    CASE WHEN name = term THEN 1 WHEN lower(name) = lower(term) THEN 2 WHEN starts_with(lower(term), lower(name)) AND length(name) >= 3 THEN 3
      WHEN score > 0 THEN 4 WHEN levenshtein(lower(term), lower(name)) <= 2 THEN 5 END AS way
  FROM terms CROSS JOIN names LEFT JOIN bm USING (name) WHERE bm.t IS NULL OR bm.t = lower(term)
  UNION ALL SELECT item_id, term, name, nodes, levenshtein(lower(term), lower(name)), NULL,
    CASE WHEN name = term THEN 1 WHEN lower(name) = lower(term) THEN 2 WHEN starts_with(lower(term), lower(name)) AND length(name) >= 3 THEN 3 WHEN levenshtein(lower(term), lower(name)) <= 2 THEN 5 END
  FROM terms CROSS JOIN names WHERE NOT EXISTS (SELECT 1 FROM bm WHERE bm.name = names.name AND bm.t = lower(term))
), b AS (
  SELECT *, min(way) OVER (PARTITION BY item_id, term) AS best FROM s WHERE way IS NOT NULL
), k AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, term ORDER BY CASE way WHEN 3 THEN -length(name) WHEN 4 THEN -score WHEN 5 THEN edits ELSE 0 END, name) AS r
  FROM (SELECT DISTINCT * FROM b WHERE way = best)
)
SELECT item_id, term, name, CAST(way AS BIGINT) AS way, edits, nodes FROM k WHERE r <= 3""",
    "embedding_inputs": f"""
WITH {REPOSITORY}, t AS (
  SELECT doc_id, path, text, {TOKENS.format("text")} AS t FROM files
), x AS (
  SELECT doc_id, path || chr(10) || regexp_extract(path, '[^/]*$') || chr(10) || substr(CASE WHEN len(t) > 120 THEN array_to_string(list_slice(t, 1, 120), ' ') ELSE text END, 1, 400) AS e FROM t
)
SELECT doc_id, length(e) AS chars, sha256('model' || chr(10) || e) AS key, doc_id IN (SELECT vec_id FROM embeddings) AS cached FROM x""",
}
