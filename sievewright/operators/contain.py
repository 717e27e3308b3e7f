"""Which texts contain which needles, without comparing all with all.

A needle's second to fourth words are whole words of any text that contains it, so these three are a key for an equality
join; what meets is verified. Needles of fewer words have trigrams as keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .substrings import contained

WORDS = 3


def _words(text: F.Column) -> F.Column:
    return F.split(text, r"\s+")


def containing(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """``(id, key)`` for each needle of ``needles(id, needle)`` that stands in a text of ``texts(key, text)``, blanks at its ends
    left out. Nulls and blank needles match nothing. Needles under five words meet the texts by their rarest trigram."""
    n = needles.select("id", F.trim("needle").alias("needle")).withColumn("w", _words(F.col("needle")))
    short = contained(texts, n.where(F.size("w") < WORDS + 2).select("id", "needle")).select("id", "key")
    n = n.where(F.size("w") >= WORDS + 2).select("id", "needle", F.xxhash64(*[F.get("w", F.lit(i)) for i in range(1, WORDS + 1)]).alias("h"))
    t = texts.select("key", "text", _words(F.col("text")).alias("w")).where(F.size("w") >= WORDS)
    at = lambda i, k: F.get("w", i + F.lit(k))
    hashes = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - WORDS), lambda i: F.xxhash64(*[at(i, k) for k in range(WORDS)])))
    met = t.select("key", F.explode(hashes).alias("h")).join(n.select("id", "h"), "h").select("key", "id").distinct()
    long = met.join(texts.select("key", "text"), "key").join(n.select("id", "needle"), "id").where(F.expr("contains(text, needle)")).select("id", "key").distinct()
    return long.union(short)
