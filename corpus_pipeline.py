"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Stages keep the columns of ``documents``; only the last, packing, returns its own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import sievewright
from sievewright.llm import decontaminate, line_dedup, packing, quality, simhash
from sievewright.llm.shared import free_name, settle, table, text_of


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go. Empty and null texts are scored as they are; all columns
    of the rows that stay are those that came."""
    model = quality.quality_model(table(spark, sf_dir, "documents"), spark, sf_dir)
    mark = free_name(docs, "q_score")
    return quality.score(docs, model, keep=True, name=mark, words=100_000).where(F.col(mark) >= quality.THRESHOLD).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go from the texts; every document stays. ``text`` and ``n_chars`` change, all
    other columns are those that came, ``n_lines`` and ``n_removed`` among them."""
    aside = {c: free_name(docs, f"own_{c}") for c in docs.columns if c.lower() in ("n_lines", "n_removed")}
    out = line_dedup.line_window_dedup(docs.withColumnsRenamed(aside))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays, of several such the one whose text has the
    smallest hash, and of rows that repeat both the one whose other columns have it; of null ids each group without another id
    keeps one."""
    mark = free_name(docs, "row_key")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(text_of(docs)).alias("tk"))
    kept = simhash.representatives(docs.select(key.alias("doc_id"), "text")).select(F.col("id").alias("kept"))
    keyed = docs.withColumn(mark, key)
    whole = keyed.join(kept, keyed[mark] == kept["kept"], "left_semi")
    plain = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]  # maps have no hash
    one = whole.groupBy(mark).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias("row"))
    return one.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.benchmark_matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "tk").distinct()
    found = settle(found, "contaminated").withColumnsRenamed({"doc_id": "hit_id", "tk": "hit_tk"})
    return docs.join(found, docs["doc_id"].eqNullSafe(found["hit_id"]) & (F.xxhash64(text_of(docs)) == found["hit_tk"]), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences. Nulls are empty texts; repeated rows are packed each;
    extra columns are ignored. Its tables of words are smaller than by themselves, as a worker may hold another stage's memory."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), words=250_000).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]
#: The classifier is trained and SimHash and CGK have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    sievewright.ship(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, name)
    return docs
