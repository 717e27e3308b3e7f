"""Which texts contain which needles, as an equality join on trigrams.

Three consecutive characters of a needle stand in every text that contains it, so one of them is its key. The rarest makes the
fewest texts meet; which that is is judged by a bounded part of the texts, which changes the work and no result. What meets is
verified. Needles of one or two characters are keys themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored

GRAM = 3
SAMPLE = 5_000
FEW = 100_000


def grams(text: Column, n: int = GRAM) -> Column:
    """The distinct runs of ``n`` characters of a text, by one pass of a pattern that looks ahead at each place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def keyed_needles(needles: DataFrame, sample: DataFrame) -> DataFrame:
    """``(id, needle, gram)``: the needle's gram that the fewest texts of ``sample(text)`` have, of equal ones the least."""
    n = F.least(F.length("needle"), F.lit(GRAM))
    own = F.when(n == GRAM, grams(F.col("needle"))).otherwise(F.array("needle"))
    every = needles.select("id", "needle", F.explode(own).alias("gram"))
    seen = sample.select(F.explode(grams(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    counted = every.join(seen, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return counted.groupBy("id", "needle").agg(F.min(F.struct("df", "gram")).alias("x")).select("id", "needle", F.col("x.gram").alias("gram"))


def contained(texts: DataFrame, needles: DataFrame, fold_case: bool = False) -> DataFrame:
    """``(id, key)`` for each needle of ``needles(id, needle)`` and text of ``texts(key, text)`` that contains it; with ``fold_case``
    in whatever case.

    Null and empty needles and null texts match nothing; keys and ids may be of any type and repeat (a pair comes once). Few
    needles are sent to the texts; else grams meet without the texts, which are fetched for what met.
    """
    fold = (lambda c: F.lower(c)) if fold_case else (lambda c: c)
    texts = texts.select("key", fold(F.col("text")).alias("text")).where("text IS NOT NULL")
    needles = needles.select("id", fold(F.col("needle")).alias("needle")).where("length(needle) > 0").distinct()
    keys = stored(keyed_needles(needles, texts.select("text").limit(SAMPLE)), "needles")
    sizes = [r[0] for r in keys.select(F.length("gram")).distinct().collect()]  # 1 to 3
    every = F.flatten(F.array(*(grams(F.col("text"), n) for n in sizes))) if sizes else F.array().cast("array<string>")
    if keys.limit(FEW + 1).count() <= FEW:
        met = texts.select("key", "text", F.explode(every).alias("gram")).join(F.broadcast(keys), "gram")
        return met.where(F.contains("text", F.col("needle"))).select("id", "key").distinct()
    met = texts.select("key", F.explode(every).alias("gram")).join(keys.select("id", "gram"), "gram").select("id", "key").distinct()
    return met.join(texts, "key").join(needles, "id").where(F.contains("text", F.col("needle"))).select("id", "key").distinct()


def first_per_text(lines: DataFrame, needles: DataFrame, fold_case: bool = True) -> DataFrame:
    """``(id, key, place, no)``: of each asker ``id`` and text the first of its needles that stands in a line, and the first
    such line; ``needles(id, place, needle)``, ``lines(key, no, line)``."""
    text = lines.select(F.struct("key", "no").alias("key"), F.col("line").alias("text"))
    asked = needles.select(F.struct("id", "place").alias("id"), "needle")
    hits = contained(text, asked, fold_case).select("id.id", "id.place", "key.key", "key.no")
    return hits.groupBy("id", "key").agg(F.min(F.struct("place", "no")).alias("x")).select("id", "key", "x.place", "x.no")


def capped(hits: DataFrame, most: int, *order: str) -> DataFrame:
    """The first ``most`` rows of each ``id``."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("rank") <= most).drop("rank")
