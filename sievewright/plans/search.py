"""Queries: ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import generations as G
from ..operators import index as I
from ..operators import search as S
from ..operators import vectors as V
from ..sources.stored import stored
from ..sources.tables import REPOSITORY, load
from .shared import index_folder, stored_index

QUERY = "the thtion and onre thtion erin"
TOKENS = "[lower(x) for x in regexp_extract_all({}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')]"
TOK = TOKENS.format("text")
#: Postings of paths, file names and texts, and the BM25 parts of the terms in ``q``.
PARTS = f"""{REPOSITORY}, tok AS (
  SELECT doc_id, {TOKENS.format("path || chr(10) || regexp_extract(path, '[^/]*$') || chr(10) || coalesce(text, '')")} AS t FROM files
), st AS (
  SELECT CAST(count(*) AS DOUBLE) AS n, coalesce(avg(CAST(len(t) AS DOUBLE)), 0) AS avgdl FROM tok
), post AS (
  SELECT doc_id, dl, term, CAST(count(*) AS DOUBLE) AS tf
  FROM (SELECT doc_id, CAST(len(t) AS DOUBLE) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL
), dfs AS (
  SELECT term, CAST(count(*) AS DOUBLE) AS df FROM post GROUP BY term
), w AS (
  SELECT doc_id, query, post.term, qtf, ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) AS idf,
    tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / greatest(avgdl, 1e0))) AS w
  FROM post JOIN q USING (term) JOIN dfs USING (term), st
)"""
ONE = f"q AS (SELECT 0 AS query, term, CAST(count(*) AS DOUBLE) AS qtf FROM (SELECT unnest(string_split('{QUERY}', ' ')) AS term) GROUP BY term)"
ITEMS = f"q AS (SELECT query, term, CAST(count(*) AS DOUBLE) AS qtf FROM (SELECT item_id AS query, unnest({TOK}) AS term FROM benchmark) GROUP BY ALL)"
BATCH = f"WITH {ITEMS}, {PARTS}, s AS (SELECT query, doc_id, round(sum(idf * w), 6) AS score FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s)"


def _one(spark):
    return S.query_terms(spark.createDataFrame([(0, QUERY)], "query int, text string"), "query", "text")


def _docs(spark, d):
    return load(spark, d, "documents", "doc_id", "text")


def _bm25(spark, d, terms):
    return I.bm25(stored_index(spark, d), terms).withColumnRenamed("key", "doc_id")


def bm25_topk(spark, d):
    return _bm25(spark, d, _one(spark)).select("doc_id", F.round("score", 6).alias("score"), "matched").orderBy(F.desc("score"), "doc_id").limit(50)


_rankings: dict[tuple, DataFrame] = {}
RANKED = 20


def ranking(spark, d, index, k=10):
    """``(query, key, score, rank)``: the first hits of each item by an index, stored once a session for as long as the index and
    the items stay."""
    items = load(spark, d, "benchmark")
    at = spark.sparkContext.applicationId, index.folder, index.version, tuple(sorted(G.source_signatures(items).items())), max(k, RANKED)
    if at not in _rankings:
        s = I.bm25(index, S.query_terms(items, "item_id", "text")).select("query", "key", F.round("score", 6).alias("score"))
        _rankings[at] = stored(S.top(s, "query", max(k, RANKED), F.desc("score"), F.col("key")), "ranking")
    return _rankings[at].where(F.col("rank") <= k)


def bm25_ranked(spark, d, k=10):
    return ranking(spark, d, stored_index(spark, d), k).withColumnsRenamed({"query": "item_id", "key": "doc_id"})


def bm25_batch(spark, d):
    return bm25_ranked(spark, d).select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), "score")


def sparse_dot_topk(spark, d):
    return I.sparse_dot(stored_index(spark, d), _one(spark)).withColumnRenamed("key", "doc_id").select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


def _cosine(spark, d):
    v = load(spark, d, "embeddings", "vec_id", "embedding")
    return S.cosine(v, v.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))).select("vec_id", F.round("sim", 6).alias("sim"))


def cosine_topk(spark, d):
    return _cosine(spark, d).orderBy(F.desc("sim"), "vec_id").limit(20)


def _channels(spark, d):
    """The best 60 of the sparse and of the dense ranking."""
    sparse = I.sparse_dot(stored_index(spark, d), _one(spark)).withColumnRenamed("key", "doc_id").select("doc_id", F.round("score", 6).alias("s")).orderBy(F.desc("s"), "doc_id").limit(60).withColumn("g", F.lit(0))
    dense = _cosine(spark, d).select(F.col("vec_id").alias("doc_id"), F.col("sim").alias("s")).orderBy(F.desc("s"), "doc_id").limit(60).withColumn("g", F.lit(0))
    return [S.top(x, "g", 60, F.desc("s"), F.col("doc_id")) for x in (sparse, dense)]


def hybrid_rrf(spark, d):
    return S.fuse(_channels(spark, d), "doc_id").select("doc_id", F.round("rrf", 9).alias("rrf")).orderBy(F.desc("rrf"), "doc_id").limit(20)


def channel_breakdown(spark, d):
    """The fused ranking's documents with their places in the sparse and the dense one."""
    sparse, dense = (x.select("doc_id", F.col("rank").cast("long").alias(c)) for x, c in zip(_channels(spark, d), ("sparse_rank", "dense_rank"), strict=True))
    both = hybrid_rrf(spark, d).join(sparse, "doc_id", "left").join(dense, "doc_id", "left")
    channel = F.when(F.col("dense_rank").isNull(), "sparse").when(F.col("sparse_rank").isNull(), "dense").otherwise("hybrid")
    return both.select("doc_id", "rrf", "sparse_rank", "dense_rank", channel.alias("channel"))


def df_table(spark, d):
    return S.document_frequency(_docs(spark, d))


def corpus_stats(spark, d):
    return S.corpus_stats(_docs(spark, d)).select(F.col("n").cast("long").alias("n_docs"), F.round("avgdl", 6).alias("avgdl"))


def matched_terms(spark, d):
    q = [t for t in dict.fromkeys(QUERY.split())]
    return S.tokenized(_docs(spark, d)).select("doc_id", F.array_join(F.array_sort(F.array_intersect("tokens", F.array(*map(F.lit, q)))), " ").alias("terms")).where("terms <> ''")


def seeds_top2(spark, d):
    return bm25_ranked(spark, d, 2).select("item_id", "doc_id", F.col("rank").cast("long").alias("rn"))


def collapse_best(spark, d):
    """Hits of a whole source collapse to one row: best score and the three best references."""
    src = load(spark, d, "documents", "doc_id", "source")
    s = _bm25(spark, d, _one(spark)).select("doc_id", F.round("score", 6).alias("score")).join(src, "doc_id")
    best = S.top(s, "source", 3, F.desc("score"), F.col("doc_id"))
    return best.groupBy("source").agg(F.max("score").alias("best_score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("refs"))


def dedupe_keep_max(spark, d):
    """The best hit per lower-case source and role weight."""
    src = load(spark, d, "documents", "doc_id", "source", "lang")
    weight = F.when(F.col("lang") == "en", 1.3).when(F.col("lang") == "fr", 0.85).otherwise(0.6)
    s = _bm25(spark, d, _one(spark)).join(src, "doc_id").select("doc_id", "source", F.round(F.round("score", 6) * weight, 6).alias("key"))
    return S.top(s, "source", 1, F.desc("key"), F.col("doc_id")).select("source", "doc_id", "key")


LISTS = 16


def _collection(spark, d):
    """The supplied vectors in inverted lists, stored once a session."""
    at = spark.sparkContext.applicationId, d
    if at not in _collections:
        _collections[at] = V.save(load(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding"), index_folder(spark, d, "vectors"), LISTS)
    return _collections[at]


_collections: dict[tuple[str, str], V.Collection] = {}


def _item_vectors(spark, d):
    """A query vector for each item: the vector of its number."""
    v = load(spark, d, "embeddings").select(F.col("vec_id").alias("query"), F.col("embedding").cast("array<double>").alias("q"))
    return load(spark, d, "benchmark").select(F.col("item_id").alias("query")).join(v, "query")


def vector_topk(spark, d, k=20):
    """The nearest vectors of each item's vector, by all lists of the stored collection."""
    hits = V.search(_collection(spark, d), _item_vectors(spark, d), k, LISTS)
    return hits.select(F.col("query").alias("item_id"), F.col("key").alias("vec_id"), F.col("rank").cast("long").alias("rank"), "sim")


def vector_recall(spark, d, k=20, probes=10):
    """How many of the nearest vectors of each item the probed lists have."""
    c, q = _collection(spark, d), _item_vectors(spark, d)
    near, exact = V.search(c, q, k, probes), V.search(c, q, k, LISTS)
    hit = exact.join(near.select("query", "key", F.lit(1).alias("hit")), ["query", "key"], "left")
    return hit.groupBy(F.col("query").alias("item_id")).agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("of"))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_batch, sparse_dot_topk, cosine_topk, hybrid_rrf, channel_breakdown, df_table, corpus_stats, matched_terms, seeds_top2, collapse_best, dedupe_keep_max)}
_SPARSE = "SELECT doc_id, round(sum(qtf * idf * w), 6) AS score FROM w GROUP BY doc_id"
_BM = "SELECT doc_id, round(sum(idf * w), 6) AS score, count(*) AS matched FROM w GROUP BY doc_id"
_COS = "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS sim FROM embeddings"
ORACLES = {
    "bm25_topk": f"WITH {ONE}, {PARTS} {_BM} ORDER BY score DESC, doc_id LIMIT 50",
    "bm25_batch": f"{BATCH} SELECT query AS item_id, doc_id, rank, score FROM r WHERE rank <= 10",
    "sparse_dot_topk": f"WITH {ONE}, {PARTS} {_SPARSE} ORDER BY score DESC, doc_id LIMIT 50",
    "cosine_topk": f"{_COS} ORDER BY sim DESC, vec_id LIMIT 20",
    "channel_breakdown": f"""
WITH {ONE}, {PARTS}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r
  FROM ({_SPARSE})),
b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY sim DESC, vec_id) AS r
  FROM ({_COS})),
x AS (SELECT doc_id, round(sum(1e0 / (60e0 + r)), 9) AS rrf
  FROM (SELECT *
  FROM a
  WHERE r <= 60
  UNION ALL SELECT *
  FROM b
  WHERE r <= 60)
  GROUP BY doc_id ORDER BY rrf DESC, doc_id LIMIT 20) SELECT doc_id, rrf, a.r AS sparse_rank, b.r AS dense_rank, CASE WHEN b.r IS NULL THEN 'sparse' WHEN a.r IS NULL THEN 'dense' ELSE 'hybrid' END AS channel
  FROM x
  LEFT JOIN (SELECT *
  FROM a
  WHERE r <= 60) a USING (doc_id)
  LEFT JOIN (SELECT *
  FROM b
  WHERE r <= 60) b USING (doc_id)""",
    "hybrid_rrf": f"""
WITH {ONE}, {PARTS}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r
  FROM ({_SPARSE})),
b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY sim DESC, vec_id) AS r
  FROM ({_COS})) SELECT doc_id, round(sum(1e0 / (60e0 + r)), 9) AS rrf
  FROM (SELECT *
  FROM a
  WHERE r <= 60
  UNION ALL SELECT *
  FROM b
  WHERE r <= 60)
  GROUP BY doc_id
  ORDER BY rrf DESC, doc_id LIMIT 20""",
    "df_table": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY term",
    "corpus_stats": f"SELECT count(*) AS n_docs, round(avg(CAST(len({TOK}) AS DOUBLE)), 6) AS avgdl FROM documents",
    "matched_terms": f"""
SELECT doc_id, string_agg(term, ' ' ORDER BY term) AS terms
  FROM (SELECT DISTINCT doc_id, unnest({TOK}) AS term
  FROM documents)
  WHERE term IN (SELECT unnest(string_split('{QUERY}', ' ')))
  GROUP BY doc_id""",
    "seeds_top2": f"{BATCH} SELECT query AS item_id, doc_id, rank AS rn FROM r WHERE rank <= 2",
    "collapse_best": f"""
WITH {ONE}, {PARTS}, s AS ({_BM}),
r AS (SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rn
  FROM s JOIN documents USING (doc_id)) SELECT source, max(score) AS best_score, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rn) AS refs
  FROM r
  WHERE rn <= 3
  GROUP BY source""",
    "dedupe_keep_max": f"""
WITH {ONE}, {PARTS}, s AS ({_BM}),
k AS (SELECT source, doc_id, round(score * CASE lang WHEN 'en' THEN 1.3e0 WHEN 'fr' THEN 0.85e0 ELSE 0.6e0 END, 6) AS key
  FROM s JOIN documents USING (doc_id)) SELECT source, doc_id, key
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key DESC, doc_id) AS rn
  FROM k)
  WHERE rn = 1""",
}
QUERIES |= {"vector_topk": vector_topk, "vector_recall": vector_recall}
ORACLES["vector_topk"] = """
SELECT item_id, vec_id, rank, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, vec_id) AS rank FROM (
    SELECT item_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS sim
    FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings e
  )
) WHERE rank <= 20"""
