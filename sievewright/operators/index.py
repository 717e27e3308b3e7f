"""A stored lexical index: chunks, postings, document frequencies and statistics as Parquet.

Postings are partitioned by a hash of the term and sorted by it, so that a query reads the partitions of its terms alone,
and of these the row groups that can hold them. BM25 then needs no text: lengths stand beside the counts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.stored import stored
from .search import idf, tf_weight

PARTS = 32
#: Most rows of query terms that are sent to the postings, and about how many pairs of query and key a task adds up. Neither
#: changes a result.
FEW, PAIRS = 200_000, 1_500_000


@dataclass(frozen=True)
class Index:
    """Folder of a stored index; ``name`` of its tables: postings, terms, stats, manifest."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


def document_text(path: str = "path", text: str = "text") -> F.Column:
    """What is indexed of a chunk: its path, its file's name and its text."""
    return F.concat_ws("\n", F.col(path), F.element_at(F.split(path, "/"), -1), F.col(text))


def signature(docs: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """One row ``(n, sign)`` that changes with any text: an order-free sum of hashes."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(key, text).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("sign"))


def part(term: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def save(docs: DataFrame, folder: str) -> Index:
    """Indexes ``docs(key, text)``: each text is read and tokenized once."""
    said = docs.select("key", tokens(F.coalesce("text", F.lit(""))).alias("t"))
    counts = said.select("key", F.size("t").alias("dl"), F.explode_outer("t").alias("term")).groupBy("key", "dl", "term").agg(F.count("term").alias("tf"))
    laid = counts.where("term IS NOT NULL").withColumn("part", part(F.col("term"))).repartition("part", F.pmod(F.xxhash64("term"), F.lit(1 << 20)))
    laid.sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{folder}/postings")
    spark = docs.sparkSession
    spark.read.parquet(f"{folder}/postings").groupBy("part", "term").agg(F.count(F.lit(1)).alias("df")).sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{folder}/terms")
    said.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size("t")), F.lit(0.0)).alias("avgdl")).write.parquet(f"{folder}/stats")
    signature(docs).write.parquet(f"{folder}/manifest")  # last, so that a folder with one is whole
    return Index(spark, folder)


def load(spark: SparkSession, folder: str) -> Index:
    index = Index(spark, folder)
    index.table("manifest")  # raises where there is none
    return index


def synced(docs: DataFrame, root: str, known: dict[str, str], scope: str) -> Index:
    """The stored index of ``scope`` if its signature is that of ``docs``, else a new one under ``root``."""
    now = tuple(signature(docs).first())
    folder = known.get(scope)
    if folder and tuple(load(docs.sparkSession, folder).table("manifest").first()) == now and now[0]:
        return load(docs.sparkSession, folder)
    folder = known[scope] = f"{root}/index-{uuid.uuid4().hex}"
    return save(docs, folder)


def weights(index, query_terms: DataFrame) -> DataFrame:
    """``(query, key, qtf, idf, w)`` of the postings of ``query_terms(query, term, qtf)``; terms without any go.

    Only the partitions of these terms are read. Where the query terms are few they are sent to the postings: one slim row a
    posting is shuffled by its key, however many queries ask for the term, and the queries meet it behind that shuffle, in the
    partition that holds all of the key, so that sums over keys need no other. More query terms are joined as a table.
    """
    known = stored(query_terms.withColumn("part", part(F.col("term"))).join(index.table("terms"), ["part", "term"]).select("query", "term", "part", "qtf", "df"), "asked")
    postings = index.table("postings").where(F.col("part").isin([r["part"] for r in known.select("part").distinct().collect()]))  # PARTS at most
    if known.limit(FEW + 1).count() <= FEW:
        ids = stored(known.select("part", "term").distinct().withColumn("id", F.monotonically_increasing_id()), "asked-terms")
        pairs = known.select("query").distinct().count() * index.table("stats").first()["n"]
        tasks = max(int(index.spark.conf.get("spark.sql.shuffle.partitions")), pairs // PAIRS)
        slim = postings.join(F.broadcast(ids), ["part", "term"]).select("key", "id", "tf", "dl").repartition(tasks, "key")
        j = slim.join(F.broadcast(known.join(F.broadcast(ids), ["part", "term"]).select("id", "query", "qtf", "df")), "id")
    else:
        j = postings.join(known, ["part", "term"])
    j = j.crossJoin(F.broadcast(index.table("stats")))  # one row
    df, n = F.col("df").cast("double"), F.col("n").cast("double")
    return j.select("query", "key", "qtf", idf(n, df).alias("idf"), tf_weight(F.col("tf").cast("double"), F.col("dl").cast("double"), F.col("avgdl")).alias("w"))


def bm25(index, query_terms: DataFrame) -> DataFrame:
    """``(query, key, score, matched)``: each distinct query term counts once."""
    per = weights(index, query_terms).groupBy("query", "key")
    return per.agg(F.sum(F.col("idf") * F.col("w")).alias("score"), F.count(F.lit(1)).alias("matched")).where("score > 0")


def matched_terms(index, query_terms: DataFrame, hits: DataFrame) -> DataFrame:
    """``hits`` with ``terms``, the query's terms that stand in each; postings of other keys than those of hits go first."""
    own = index.table("postings").select("part", "term", "key").join(hits.select("key"), "key", "left_semi")
    asked = query_terms.select("query", "term").withColumn("part", part(F.col("term")))
    listed = hits.select("query", "key").join(own, "key").join(asked, ["query", "part", "term"], "left_semi").groupBy("query", "key").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    return hits.join(listed, ["query", "key"])


def sparse_dot(index, query_terms: DataFrame) -> DataFrame:
    """``(query, key, score)``: repeated query terms count repeatedly."""
    return weights(index, query_terms).groupBy("query", "key").agg(F.sum(F.col("qtf") * F.col("idf") * F.col("w")).alias("score"))
