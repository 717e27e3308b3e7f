"""Supervised subword embeddings as a quality classifier.

A document's features are its words, the words' character n-grams and its word bigrams, hashed into tables of vectors.
The vectors are averaged per document and a softmax layer gives the classes; all is trained by stochastic gradient
descent in numpy, on a bounded sample of labelled documents (``max_train`` and ``max_features``, parameters). Bigrams are hashed by the
words' shapes and by whether the two words are equal, so that they say how text is written rather than what about.

Averaging and the last layer are linear, so after training each feature is one number and a word is the sum of its
features: scoring a text of any length is one sum over its words, with each distinct word worked out once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORDS, Growing, WordTable, hash32, held, segment_sums, settle, slices, table, text_of

WORD_BUCKETS, PAIR_BUCKETS, SHAPES = 1 << 17, 1 << 14, 1 << 12


PIECE = 64


def word_features(word: str) -> np.ndarray:
    """Buckets of the word and of its character 3- and 4-grams, with its ends marked."""
    w = f"<{word}>".encode("utf-8", "surrogatepass")
    grams = [w] + [w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1)]
    return hash32(grams) & (WORD_BUCKETS - 1)


def word_pieces(word: str) -> Iterator[np.ndarray]:
    """The word's features, those of a long word in turn: of the whole word, then of its n-grams by where they begin."""
    if len(word) <= PIECE:
        yield word_features(word)
        return
    w = f"<{word}>".encode("utf-8", "surrogatepass")
    yield hash32([w]) & (WORD_BUCKETS - 1)
    for k in range(0, len(w) - 2, PIECE * 64):
        part = w[k : k + PIECE * 64 + 3]  # overlaps by what a 4-gram reaches over
        grams = [part[i : i + n] for n in (3, 4) for i in range(min(PIECE * 64, len(part) - n + 1))]
        yield hash32(grams) & (WORD_BUCKETS - 1)


def word_shape(word: str) -> int:
    """Bucket of the word's run-free pattern of letter cases, digits and signs."""
    out = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return int(hash32(["".join(out).encode("utf-8", "surrogatepass")], 1)[0]) & (SHAPES - 1)


def pair_features(shapes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Buckets of consecutive words."""
    same = (codes[1:] == codes[:-1]).astype(np.int64)
    mixed = (shapes[:-1] * 4099 + shapes[1:] * 2 + same) * 0x9E3779B1
    return ((mixed >> 15) & (PAIR_BUCKETS // 2 - 1)) * 2 + same


@dataclass
class Model:
    word: np.ndarray  # of each word bucket, what it adds to the logit of class 1
    pair: np.ndarray
    bias: float


def features(text: str, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text (pairs behind the words) and how often each occurs, as shares of their kind."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.array([distinct[w] for w in words])
    known = {} if known is None else known
    for w in distinct:
        if w not in known:
            known[w] = np.concatenate(list(word_pieces(w))), word_shape(w)
    own = [known[w][0] for w in distinct]
    times = np.bincount(codes)
    buckets = np.concatenate(own)
    weight = np.repeat(times, [len(x) for x in own]).astype(float)
    shapes = np.array([known[w][1] for w in distinct], np.int64)[codes]
    pairs = pair_features(shapes, codes) + WORD_BUCKETS
    all_buckets = np.concatenate([buckets, pairs])
    shares = np.concatenate([weight / weight.sum(), np.full(len(pairs), 1 / max(1, len(pairs)))])
    ids, inverse = np.unique(all_buckets, return_inverse=True)
    return ids, np.bincount(inverse, shares)


def train(texts: list[str], labels: list[int], **how) -> Model:
    known: dict = {}
    return train_on([(*features(t, known), int(y)) for t, y in zip(texts, labels, strict=True)], **how)


def train_on(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 6, epochs: int = 5, rate: float = 6.0, seed: int = 1) -> Model:
    """SGD over single documents ``(buckets, shares, label)``, in an order that ``seed`` fixes, the rate falling to 0."""
    rng = np.random.default_rng(seed)
    rows = [r for r in rows if len(r[0])]
    table_ = rng.uniform(-1 / dim, 1 / dim, (WORD_BUCKETS + PAIR_BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, share, y = rows[k]
            share = share.astype(np.float32)
            now = rate * (1 - done / steps)
            done += 1
            mean = share @ table_[ids]
            logit = out @ mean + bias
            p = np.exp(logit - logit.max())
            g = p / p.sum()
            g[y] -= 1
            back = g @ out
            out -= now * 0.02 * np.outer(g, mean)
            bias -= now * 0.002 * g
            table_[ids] -= (now * share[:, None]) * back[None, :]
    lift = table_ @ (out[1] - out[0])
    return Model(lift[:WORD_BUCKETS].astype(np.float32), lift[WORD_BUCKETS:].astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    def __init__(self, model: Model, words: int = WORDS):
        self.model = model
        self.sum, self.n, self.shape = Growing(np.float64), Growing(np.int64), Growing(np.int64)
        self.words = WordTable(self._fill, self._empty, words)

    def _empty(self) -> None:
        for x in (self.sum, self.n, self.shape):
            x.clear()

    def _fill(self, words: list[str]) -> None:
        own = [word_features(w) if len(w) <= PIECE else np.zeros(0, np.int64) for w in words]
        n = np.array([len(x) for x in own])
        total = segment_sums(self.model.word[np.concatenate(own).astype(np.int64)].astype(np.float64), n)
        for i in np.flatnonzero(n == 0).tolist():
            for part in word_pieces(words[i]):  # a long word's features are never held at once
                total[i] += self.model.word[part].astype(np.float64).sum()
                n[i] += len(part)
        self.sum.extend(total)
        self.n.extend(n)
        self.shape.extend([word_shape(w) for w in words])

    def __call__(self, texts: list[str]) -> np.ndarray:
        codes, counts = self.words.codes(texts, str.split)
        total = segment_sums(self.sum.a[codes], counts) / np.maximum(segment_sums(self.n.a[codes], counts), 1)
        if len(codes) > 1:
            lift = self.model.pair[pair_features(self.shape.a[codes], codes)].astype(np.float64)
            ends = np.cumsum(counts)
            inner = np.ones(len(codes) - 1, bool)
            inner[(ends[(ends > 0) & (ends < len(codes))]) - 1] = False  # pairs that span two texts
            lift = np.append(np.where(inner, lift, 0.0), 0.0)
            total += segment_sums(lift, counts) / np.maximum(counts - 1, 1)
        return 1 / (1 + np.exp(-np.clip(total + self.model.bias, -50, 50)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for part in slices(batches, "text"):
        if len(known) > 100_000:
            known.clear()
        found = [features(x, known) for x in part.column("text").to_pylist()]
        ids, share = ([np.ascontiguousarray(x, kind).tobytes() for x in xs] for xs, kind in zip(zip(*found, strict=True), ("<i4", "<f4"), strict=True))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(ids, pa.binary()), pa.array(share, pa.binary())], names=["doc_id", "label", "ids", "shares"])


def fit(docs: DataFrame, labelled: DataFrame, max_train: int = 2400, max_features: int = 20_000_000) -> Model:
    """A model from at most ``max_train`` rows of ``labelled(doc_id, label)``, the first by a hash of the id. Null labels
    and ids don't count, an id with several labels has its largest, one with several texts the least. Without any labelled
    text every score is 0.5.

    The tasks turn texts into features, so that the driver gets 8 bytes for each distinct feature of a text and no text;
    of the chosen rows only as many are trained on, in the same order, as have ``max_features`` of them together.
    """
    place = F.struct(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).orderBy(place).limit(max_train)
    texts = docs.select(docs["doc_id"], text_of(docs).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = settle(texts.mapInArrow(_featured, f"doc_id {kind}, label int, ids binary, shares binary"), "features")
    sizes = found.select("doc_id", F.sum(F.octet_length("ids") / 4).over(Window.orderBy(place)).alias("total"))  # max_train rows
    rows = found.join(F.broadcast(sizes.where(F.col("total") <= max_features)), "doc_id").orderBy(place).select("label", "ids", "shares").collect()
    return train_on([(np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["shares"], "<f4"), r["label"]) for r in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, name: str = "score", words: int = WORDS) -> DataFrame:
    """``docs`` (or with ``keep=False`` only its id) with the column ``name``: the chance of label 1, for whole texts. Null and empty
    texts have the model's bias as their score. Repeated rows and null ids keep a row each; no rows give none. A task's table of
    known words holds ``words`` of them, which bounds its memory and changes no result."""
    sent, model_key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("scorer", model_key), lambda: Scorer(sent.value, words))
        for part in slices(batches, text_col):
            values = scorer([x or "" for x in part.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(values)], names=[*names, name])

    names = [c for c in docs.columns if c.lower() != name.lower()] if keep else [id_col]
    source = docs.select(*names) if keep else docs.select(id_col, text_of(docs, text_col).alias(text_col))
    return source.mapInArrow(run, source.select(*names).withColumn(name, F.lit(0.0)).schema)


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def quality_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> Model:
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return fit(docs, marks.where(~held_out(F.col("doc_id"))))


THRESHOLD = 0.7


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, quality_model(docs, spark, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
