"""How the filters of a corpus interact: what each removes, in every order, from additive counts of failure masks.

1. Duplicate prepass: a counting Bloom filter of the whole texts. Every task adds up its own sketch (cells and counts), the
   sketches are merged by sums, and a text with a cell below two stands nowhere else. Only the cells that reach two are sent
   back, as bits of a fixed number; where a huge corpus fills them, more texts count as possible repeats and results stay.
2. One pass turns each text into a mask of the filters it fails, and keeps the text only of possible repeats.
3. Possible repeats are grouped by their full text, combined before the shuffle, for the smallest id of each text.
4. Masks with the duplicate bit join the labels and are counted by part. There are at most 32 masks, so the counts of the
   documents that pass every set of filters, and from these all orders, steps and shares, are sums over a few numbers a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bits_at, release, settle, slices, table, text_of

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
UPPER = bytes(range(65, 91))
SIGNS = b"#$%&*|"
LEAST_CELLS, MOST_CELLS, HASHES = 1 << 20, 1 << 27, 3


def failure_mask(text: bytes) -> int:
    """Which of the filters A to D a text fails, filter k as bit k."""
    words = text.split()  # the six ASCII white spaces
    points = len(text) if text.isascii() else len(text.decode("utf-8", "surrogatepass"))
    upper = len(text) - len(text.translate(None, UPPER))
    fails = len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * upper > 2 * points, len(text.translate(None, SIGNS)) < len(text)
    return sum(f << k for k, f in enumerate(fails))


def repeat_bits(keys: DataFrame, cells: int) -> bytes:
    """Bits of the counting Bloom filter's ``cells`` (a power of two) that reach two; ``keys(key)`` has one 64-bit hash per text. At
    most cells / 64 numbers reach the driver."""
    places = F.explode(F.array(*(cell(F.col("key"), k, cells) for k in range(HASHES))))
    sketch = keys.select(places.alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    words = sketch.selectExpr("cell div 64 AS word", "shiftleft(1L, CAST(cell % 64 AS INT)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(cells // 64, np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    return out.tobytes()


def cell(key, k: int, cells: int):
    """The k-th cell of a key: other bits of the hash for each."""
    return F.pmod(F.shiftrightunsigned(key, k * 18), F.lit(cells)) if k else F.pmod(key, F.lit(cells))


def cells_for(n: int) -> int:
    """About 16 cells a text, within fixed bounds."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (16 * n).bit_length()))


def masked(docs: DataFrame, cells: int | None = None) -> DataFrame:
    """``(id, part, tk, mask, maybe)`` per row of ``docs(doc_id, text, source)``: the mask of A to D, the text's hash, and the
    text itself where it may stand elsewhere too, else null."""
    source = docs.select(docs["doc_id"].alias("id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), F.xxhash64(text_of(docs)).alias("tk"), text_of(docs).alias("text"))
    cells = cells or cells_for(docs.count())
    sent = docs.sparkSession.sparkContext.broadcast(repeat_bits(source.select(F.col("tk").alias("key")), cells))  # MOST_CELLS / 8 bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        bits = np.frombuffer(sent.value, np.uint64)
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            masks = [failure_mask(x.encode("utf-8", "surrogatepass")) for x in texts]
            keys = part.column("tk").to_numpy().astype(np.int64)
            maybe = np.ones(len(texts), bool)
            for k in range(HASHES):
                maybe &= bits_at(bits, (keys.view(np.uint64) >> np.uint64(k * 18)).view(np.int64))
            kept = [x if m else None for x, m in zip(texts, maybe.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("part"), part.column("tk"), pa.array(masks, pa.int32()), pa.array(kept, pa.string())], names=["id", "part", "tk", "mask", "maybe"])

    return source.mapInArrow(run, f"id {docs.schema['doc_id'].dataType.simpleString()}, part string, tk long, mask int, maybe string")


def failures(docs: DataFrame, cells: int | None = None) -> DataFrame:
    """``(id, part, mask)`` per row of ``docs(doc_id, text, source)``, with the duplicate bit: set where a smaller id has the same
    text. Null ids are smaller than none and have none smaller; rows of one id and text aren't duplicates of each other."""
    rows = settle(masked(docs, cells), "masks")
    first = rows.where("maybe IS NOT NULL AND id IS NOT NULL").groupBy("maybe").agg(F.min("id").alias("first_id"), F.min("tk").alias("first_tk")).select("first_id", "first_tk", F.lit(0).alias("bit"))
    unsure = rows.where("maybe IS NOT NULL AND id IS NOT NULL").select("id", "part", "tk", "mask")
    told = unsure.join(first, (F.col("id") == F.col("first_id")) & (F.col("tk") == F.col("first_tk")), "left")
    again = told.select("id", "part", (F.col("mask") + F.coalesce("bit", F.lit(DUPLICATE))).alias("mask"))
    return rows.where("maybe IS NULL OR id IS NULL").select("id", "part", "mask").unionByName(again)


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``. Of several label rows of an id any that says 1 counts; null ids have no labels."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    few = failed.where("id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    joined = failed.where("id IS NOT NULL").join(marks, F.col("id") == marks["doc_id"], "left").select("part", "mask", "good", "toxic")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return joined.unionByName(few).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``mask_counts``; parts without rows have none.

    ``n[s]`` is how many of a part pass all filters of the set s. A filter f behind the set s removes n[s] - n[s + f]; it
    comes so in |s|! (all - |s| - 1)! orders, which gives its share over all orders without going through them.
    """
    k = len(filters)
    sets, every = range(1 << k), (1 << k) - 1
    passing = lambda c: F.array(*(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) == 0, F.col(c)).otherwise(0)) for s in sets)).alias(c)
    parts = counts.groupBy("part").agg(passing("n"), passing("good"), passing("toxic"))
    share = {}
    for f in range(k):
        share[f] = [factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) if not s >> f & 1 else -factorial(s.bit_count() - 1) * factorial(k - s.bit_count()) for s in sets]
    steps = []
    for order in permutations(range(k)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(filters[x] for x in order), step, before, before | 1 << f, 1 << f, every & ~(1 << f), share[f]))
            before |= 1 << f
    fixed = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, after int, own int, others int, share array<long>")  # k! * k rows, whatever the data
    at = lambda c, s: F.get(c, F.col(s))
    removed = lambda c: at(c, "before") - at(c, "after")
    return parts.crossJoin(F.broadcast(fixed)).select(
        "part", "filter_order", "step", at("n", "after").alias("kept"), removed("n").alias("removed"),
        (F.get("n", F.lit(0)) - at("n", "own") - removed("n")).alias("redundant"), (at("n", "others") - F.get("n", F.lit(every))).alias("unique_fails"),
        removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"),
        F.aggregate(F.zip_with("n", "share", lambda x, y: x * y), F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, cells: int | None = None) -> DataFrame:
    """The audit of ``docs(doc_id, text, source)`` with ``labels(doc_id, quality, toxic)``: a row per source, order and step.

    Null texts are empty ones, null sources the part ``''``, null ids documents without duplicates and labels; rows that repeat
    an id and a text are counted each; very long texts are read whole; extra columns of any name are ignored; an empty table
    gives no rows. ``cells`` sets the size of the duplicate prepass and changes no result.
    """
    return interactions(mask_counts(failures(docs, cells), labels))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents
), w AS (
  SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY x) AS first_id FROM d
), f AS (
  SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * len(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x), regexp_matches(x, '[#$%&*|]'), doc_id > first_id] AS fails FROM w
), g AS (
  SELECT part, fails, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic FROM f LEFT JOIN labels l USING (doc_id)
), m AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM g GROUP BY ALL
), k AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS k
), orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), steps AS (
  SELECT o, k AS step, o[k] AS own, o[1:k - 1] AS prior FROM orders, k
), per AS (
  SELECT part, o, step, own, n, good, toxic, fails[own] AS here, len(list_filter(prior, lambda p: fails[p])) > 0 AS gone,
    len(list_filter(fails, lambda y: y)) = 1 AS once FROM steps, m
), s AS (
  SELECT part, o, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT here), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND here), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND here), 0) AS redundant, coalesce(sum(n) FILTER (here AND once), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND here), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND here), 0) AS toxic_lost
  FROM per GROUP BY part, o, step, own
)
SELECT part, array_to_string(list_transform(o, lambda p: substr('ABCDE', CAST(p AS INT), 1)), '') AS filter_order, CAST(step AS INT) AS step,
  CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM s
"""
