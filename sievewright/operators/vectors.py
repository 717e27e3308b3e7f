"""A stored collection of vectors in inverted lists: each vector lies in the lists of its nearest centroids, two by default, so
that one at a border is found from either side.

Centroids are trained in numpy on a bounded sample; every vector is indexed. A search reads the lists whose centroids are nearest to
a query, as the lists are partitions of the stored table, and ranks what is in them exactly; with as many probes as there
are lists it is the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import top

SAMPLE = 20_000


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def centroids(vectors: DataFrame, lists: int, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Unit centroids of ``vectors(key, embedding)``, from at most ``sample`` of them, the first by a hash of the key."""
    rows = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64("key"), "key").limit(sample).select("embedding").collect()
    x = unit(np.array([r["embedding"] for r in rows], np.float64))
    at = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)] if len(x) else np.zeros((0, 0))
    for _ in range(rounds if len(x) else 0):
        near = np.argmax(x @ at.T, axis=1)
        total = np.zeros_like(at)
        np.add.at(total, near, x)
        used = np.bincount(near, minlength=len(at)) > 0
        at = np.where(used[:, None], unit(total), at)
    return at


@dataclass(frozen=True)
class Collection:
    spark: SparkSession
    folder: str

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/vectors")

    @property
    def lists(self) -> DataFrame:
        """``(cell, centroid)``, as many rows as there are lists."""
        return self.spark.read.parquet(f"{self.folder}/lists")


def save(vectors: DataFrame, folder: str, lists: int = 64, spill: int = 2, sample: int = SAMPLE) -> Collection:
    """Stores ``vectors(key, embedding)``, each in ``spill`` lists; null vectors are left out. All have the same length."""
    spark = vectors.sparkSession
    at = centroids(vectors, lists, sample)
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(at)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/lists")
    sent = spark.sparkContext.broadcast(at)  # lists x length numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("embedding").to_pylist(), np.float64)
                cell = np.argsort(-(unit(x) @ sent.value.T), axis=1, kind="stable")[:, :spill].astype(np.int32)
                take = pa.array(np.repeat(np.arange(len(x)), cell.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("key").take(take), batch.column("embedding").take(take), pa.array(cell.ravel())], names=["key", "embedding", "cell"])

    kind = vectors.schema["key"].dataType.simpleString()
    rows = vectors.where("embedding IS NOT NULL").select("key", F.col("embedding").cast("array<double>").alias("embedding"))
    placed = rows.mapInArrow(run, f"key {kind}, embedding array<double>, cell int")
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/vectors")
    return Collection(spark, folder)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def probed(collection: Collection, queries: DataFrame, probes: int) -> DataFrame:
    """``(query, q, cell)``: of each of ``queries(query, q)`` the ``probes`` lists with the nearest centroids."""
    every = queries.crossJoin(F.broadcast(collection.lists)).select("query", "q", "cell", cosine(F.col("q"), F.col("centroid")).alias("near"))  # a row for each list
    return top(every, "query", probes, F.desc("near"), F.col("cell")).select("query", "q", "cell")


def search(collection: Collection, queries: DataFrame, k: int = 20, probes: int = 16, places: int = 6) -> DataFrame:
    """``(query, key, rank, sim)``: the ``k`` nearest vectors by cosine in the probed lists, of equal ones (rounded to ``places``) the
    lower key. The probed lists' partitions alone are read."""
    j = collection.vectors.join(probed(collection, queries, probes), "cell")
    every = j.select("query", "key", F.round(cosine(F.col("embedding"), F.col("q")), places).alias("sim"))
    hits = every.groupBy("query", "key").agg(F.max("sim").alias("sim"))  # a vector may be in several lists
    return top(hits, "query", k, F.desc("sim"), F.col("key")).select("query", "key", "rank", "sim")
