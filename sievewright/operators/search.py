"""Lexical, sparse and dense ranking, and their fusion.

Only tokens that some query uses are exploded, so postings stay proportional to the hits; document lengths come from
array sizes. Rankings carry a key that breaks ties, as the order of rows means nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.5, 0.75


def tokenized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", tokens(F.col("text")).alias("tokens")).withColumn("dl", F.size("tokens").cast("double"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: number of documents and mean length."""
    return tokenized(docs).agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def document_frequency(docs: DataFrame) -> DataFrame:
    return tokenized(docs).select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(doc_id, dl, term, tf)`` of the terms that ``terms(term)`` names."""
    said = tokenized(docs).select("doc_id", "dl", F.explode("tokens").alias("term"))
    return said.join(terms.select("term").distinct(), "term").groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def tf_weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * dl / F.greatest(avgdl, F.lit(1.0))))


def weighted(docs: DataFrame, query_terms: DataFrame) -> DataFrame:
    """Postings with their BM25 parts, for the terms of ``query_terms(query, term, qtf)``."""
    post = postings(docs, query_terms)
    df = post.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    parts = post.join(df, "term").crossJoin(F.broadcast(corpus_stats(docs)))  # one row
    return parts.select("doc_id", "term", idf(F.col("n"), F.col("df")).alias("idf"), tf_weight(F.col("tf"), F.col("dl"), F.col("avgdl")).alias("w")).join(query_terms, "term")


def bm25(docs: DataFrame, query_terms: DataFrame) -> DataFrame:
    """``(query, doc_id, score, matched)``; each distinct query term counts once."""
    return weighted(docs, query_terms).groupBy("query", "doc_id").agg(F.sum(F.col("idf") * F.col("w")).alias("score"), F.count(F.lit(1)).alias("matched")).where("score > 0")


def sparse_dot(docs: DataFrame, query_terms: DataFrame) -> DataFrame:
    """``(query, doc_id, score)``; repeated query terms count repeatedly."""
    return weighted(docs, query_terms).groupBy("query", "doc_id").agg(F.sum(F.col("qtf") * F.col("idf") * F.col("w")).alias("score"))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    return queries.select(F.col(key).alias("query"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).cast("double").alias("qtf"))


def cosine(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """``(vec_id, sim)`` against the one vector of ``query(q)``; doubles throughout."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    e, q = F.col("embedding"), F.col("q")
    return vectors.crossJoin(F.broadcast(query)).select("vec_id", (dot(e, q) / (F.sqrt(dot(e, e)) * F.sqrt(dot(q, q)))).alias("sim"))


def top(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each ``key``, with ``rank`` from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def fuse(rankings: list[DataFrame], id_col: str, k: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion of ``(id, rank)`` tables."""
    both = rankings[0].select(id_col, "rank")
    for r in rankings[1:]:
        both = both.unionByName(r.select(id_col, "rank"))
    return both.groupBy(id_col).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"))
