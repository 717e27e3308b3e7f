"""Token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie. Each node has a failure link and the number of pieces that are complete when the
link is taken, both worked out once from its parent's. Reading a word then takes time linear in its length, never goes
back, and counts the pieces of greedy longest match without building one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Growing, WordTable, held, segment_sums, slices, table, text_of


class LongestMatch:
    """Counts greedy longest-match pieces of byte strings. Every single byte has to be a piece."""

    def __init__(self, pieces: list[bytes]):
        go: dict[int, int] = {}
        parent, letter, whole = [-1], [0], [False]
        for p in pieces:
            u = 0
            for c in p:
                v = go.get(u << 8 | c)
                if v is None:
                    v = go[u << 8 | c] = len(parent)
                    parent.append(u)
                    letter.append(c)
                    whole.append(False)
                u = v
            whole[u] = True
        if any(c not in go or not whole[go[c]] for c in range(256)):
            raise ValueError("every single byte has to be a piece")
        depth = [0] * len(parent)
        for v in range(1, len(parent)):  # a node comes after its parent
            depth[v] = depth[parent[v]] + 1
        fail, popped = [0] * len(parent), [0] * len(parent)
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            if whole[v]:
                popped[v] = 1  # the piece is complete and nothing is left of it
                continue
            z, n = fail[parent[v]], popped[parent[v]]
            while (z << 8 | letter[v]) not in go:
                z, n = fail[z], n + popped[z]
            fail[v], popped[v] = go[z << 8 | letter[v]], n
        self.go, self.fail, self.popped = go, fail, popped

    def count(self, word: bytes) -> int:
        go, fail, popped = self.go.get, self.fail, self.popped
        u = n = 0
        for c in word:
            v = go(u << 8 | c)
            while v is None:
                n += popped[u]
                u = fail[u]
                v = go(u << 8 | c)
            u = v
        while u:
            n += popped[u]
            u = fail[u]
        return n


class WordCounts:
    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as f:
            self.match = LongestMatch([base64.b64decode(line.split()[0]) for line in f if line.strip()])
        self.n = Growing(np.int64)
        self.words = WordTable(self._fill, self.n.clear)

    def _fill(self, words: list[str]) -> None:
        count = self.match.count
        self.n.extend([count(b" " + w.encode("utf-8", "surrogatepass")) for w in words])


def word_counts(vocabulary: str) -> WordCounts:
    return held(("word counts", vocabulary), lambda: WordCounts(vocabulary))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_tokens)`` per row of ``docs``: words between white space (as Unicode has it), each read with one
    space before it. Null and empty texts have none of either; texts may be of any length; repeated rows and null ids
    keep a row each; extra columns are ignored; no rows give none. ``vocabulary`` has a piece per line in base64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = word_counts(vocabulary)
        for part in slices(batches, "text"):
            codes, words = counts.words.codes(part.column("text").to_pylist(), str.split)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(words), pa.array(segment_sums(counts.n.a[codes], words))], names=["id", "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).select(F.col("id").alias("doc_id"), "n_words", "n_tokens")
