"""Pairs of words within a few edits, without comparing all with all.

Short words meet by deletion neighbourhoods: two words within ``most`` edits have a common rest once at most that many letters
are deleted from each. Long words would have many rests; of these one is cut into ``most`` + 1 pieces, of which one is
whole in the other, at most ``most`` places off. What meets is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT, LONG = 20, 17  # words up to 20 letters are short, from 17 on long; words in between are both, so lengths apart by edits meet


def deletions(word: Column, most: int = 2) -> Column:
    """The word and what is left of it when up to ``most`` letters go."""
    without = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    out = F.array(word)
    step = out
    for _ in range(most):
        step = F.array_distinct(F.flatten(F.transform(F.filter(step, lambda x: F.length(x) > 0), without)))
        out = F.array_union(out, step)
    return out


def _cuts(length: Column, most: int, k: int) -> tuple[Column, Column]:
    """Where the k-th of ``most`` + 1 pieces of a word of a length begins, and how long it is."""
    at = lambda i: F.floor(length * F.lit(i) / F.lit(most + 1)).cast("int")
    return at(k), at(k + 1) - at(k)


def pieces(word: Column, most: int = 2) -> Column:
    """Keys of a word's pieces: its length, the piece's number and the piece."""
    n = F.length(word)
    of = [_cuts(n, most, k) for k in range(most + 1)]
    return F.array(*(F.concat_ws(" ", n.cast("string"), F.lit(str(k)), F.substring(word, at + 1, size)) for k, (at, size) in enumerate(of)))


def piece_places(word: Column, most: int = 2) -> Column:
    """Keys under which a word meets the pieces of words at most ``most`` letters shorter or longer."""
    out = []
    for d in range(-most, most + 1):
        n = F.length(word) + d
        for k in range(most + 1):
            at, size = _cuts(n, most, k)
            for off in range(-most, most + 1):
                out.append(F.when((at + off >= 0) & (at + off + size <= F.length(word)), F.concat_ws(" ", n.cast("string"), F.lit(str(k)), F.substring(word, at + off + 1, size))))
    return F.array_distinct(F.array_compact(F.array(*out)))


def near_words(left: DataFrame, right: DataFrame, most: int = 2) -> DataFrame:
    """``(a, b, edits)`` for all words of ``left(a)`` and ``right(b)`` that ``most`` edits or fewer part (insertions, deletions,
    changes of a letter). Nulls meet nothing; words that repeat count once."""
    a, b = left.select("a").where("a IS NOT NULL").distinct(), right.select("b").where("b IS NOT NULL").distinct()
    short = a.where(F.length("a") <= SHORT).select("a", F.explode(deletions(F.col("a"), most)).alias("key")).join(b.where(F.length("b") <= SHORT).select("b", F.explode(deletions(F.col("b"), most)).alias("key")), "key")
    long = a.where(F.length("a") >= LONG).select("a", F.explode(pieces(F.col("a"), most)).alias("key")).join(b.where(F.length("b") >= LONG).select("b", F.explode(piece_places(F.col("b"), most)).alias("key")), "key")
    met = short.select("a", "b").union(long.select("a", "b")).distinct()
    return met.withColumn("edits", F.levenshtein("a", "b", most)).where("edits >= 0")
