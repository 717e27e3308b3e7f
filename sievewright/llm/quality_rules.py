"""Quality rules by gradient-boosted trees over document statistics.

One pass over the texts counts words, lines, signs and repeated windows of each document and stores a row of statistics, a
few dozen numbers for a text of any length. Trees are boosted in numpy on the statistics of a bounded sample of labelled
documents (``max_train``, a parameter), second order with a logistic loss. Statistics listed in ``MONOTONE`` may only
lower (-1) or raise (1) the score: a split that says otherwise isn't taken, and what lies below a split stays on its side of
the split's midpoint. The trees are then flattened into arrays of nodes, in which a leaf leads to itself, so that all
documents of a batch walk down all trees at once by ``depth`` look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import held_out
from .shared import Growing, WordTable, held, segment_sums, settle, slices, table, text_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = (
    "chars_per_word symbol_share dup_line_share repeat_share upper_share digit_share mark_share shout_share wordless_share "
    "again_share distinct_share capital_share words_per_line ended_line_share log_words"
).split()
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "shout_share": -1, "again_share": -1}


def _signs(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


#: What each byte of a word counts for; a code point counts by its first byte.
BYTES = {
    "word_chars": np.array([int(b & 0xC0 != 0x80) for b in range(256)]),
    "n_symbols": _signs(b"#*$%&|<>"),
    "upper": _signs(bytes(range(65, 91))),
    "digit": _signs(b"0123456789"),
    "mark": _signs(b".,;:?!"),
    "shout": _signs(b"!"),
    "letter": _signs(bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)])),
}


def repeated_words(codes: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of ``width`` consecutive words which stands at two places or more."""
    n = len(codes)
    if n <= width:
        return 0
    key = codes
    for k in range(1, width):  # a window's number from its beginning's and its next word
        key = key[: n - k] << 32 | codes[k:]
        if k + 1 < width:
            key = np.unique(key, return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    found = key[order]
    same = found[1:] == found[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = twice.copy()
    for k in range(1, width):
        covered[k:] |= twice[: n - k]
    return int(covered.sum())


class TextCounts:
    """Counts of UTF-8 texts; what a word alone decides is worked out once for each distinct word."""

    def __init__(self):
        self.of = {name: Growing(np.int64) for name in (*BYTES, "capital")}
        self.words = WordTable(self._fill, self._empty)

    def _empty(self) -> None:
        for x in self.of.values():
            x.clear()

    def _fill(self, words: list[bytes]) -> None:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer(b"".join(words), np.uint8)
        for name, counts in BYTES.items():
            self.of[name].extend(segment_sums(counts[chars], lengths))
        self.of["capital"].extend(BYTES["upper"][chars[np.cumsum(lengths) - lengths]])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The columns ``COUNTS`` and ``STATISTICS`` of the texts."""
        codes, n = self.words.codes(texts, bytes.split)  # the six ASCII white spaces
        total = {name: segment_sums(x.a[codes], n) for name, x in self.of.items()}
        wordless = segment_sums((self.of["letter"].a[codes] == 0).astype(np.int64), n)
        ends = np.cumsum(n)
        per = np.zeros((len(texts), 5), np.int64)  # repeated lines, repeated words, words as the one before, distinct words, ended lines
        lines = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = codes[ends[i] - n[i] : ends[i]]
            said = [x for x in text.split(b"\n") if x.strip()]
            lines[i] = len(said)
            per[i] = len(said) - len(set(said)), repeated_words(own), (own[1:] == own[:-1]).sum(), len(np.unique(own)), sum(x.rstrip().endswith((b".", b"!", b"?")) for x in said)
        words, chars, rows = (np.maximum(x, 1).astype(float) for x in (n, total["word_chars"], lines))
        counts = np.stack([n, total["word_chars"], total["n_symbols"], per[:, 0], per[:, 1]], axis=1)
        statistics = [
            total["word_chars"] / words, total["n_symbols"] / chars, per[:, 0] / rows, per[:, 1] / words, total["upper"] / chars, total["digit"] / chars, total["mark"] / chars,
            total["shout"] / chars, wordless / words, per[:, 2] / words, per[:, 3] / words, total["capital"] / words, n / rows, per[:, 4] / rows, np.log1p(n),
        ]
        return counts, np.stack(statistics, axis=1)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, *COUNTS, *STATISTICS)`` per row of ``docs``, over whole texts.

    Words are runs of other characters than ASCII white space. Null and empty texts have zeros throughout; texts and words may be
    of any length; repeated rows and null ids keep a row each; extra columns are ignored, so none can clash; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held("text counts", TextCounts)
        for part in slices(batches, "text"):
            counts, statistics = counter([x.encode("utf-8", "surrogatepass") for x in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, [*counts.T.copy(), *statistics.T.copy()])], names=["id", *COUNTS, *STATISTICS])

    kind = docs.schema[id_col].dataType.simpleString()
    columns = ", ".join([*(f"{c} long" for c in COUNTS), *(f"{c} double" for c in STATISTICS)])
    return docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text")).mapInArrow(run, f"id {kind}, {columns}")


@dataclass
class Forest:
    """Trees as node arrays; of a leaf, ``left`` and ``right`` are itself and ``value`` is what it adds to the logit."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row of statistics."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-np.clip(self.base + self.value[at].sum(axis=1), -50, 50)))


def boost(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, bins: int = 64, least: int = 8) -> Forest:
    """Boosted trees for labels 0 and 1. ``monotone`` has -1, 0 or 1 for each column of ``x``. Ties go to the first column and
    the lowest threshold; no rows, or rows of one label, give a forest that says 0.5 or that label's rate."""
    n, width = x.shape
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins, method="lower")) if n else np.zeros(0) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if n else np.zeros((0, width), np.int64)
    logit = np.full(n, base)
    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        open_ = [(roots[-1], np.arange(n), -np.inf, np.inf)]
        for level in range(depth + 1):
            following = []
            for node, rows, low, high in open_:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                own = float(np.clip(-total_g / (total_h + ridge), low, high))
                nodes[node][4] = own * rate
                logit[rows] += own * rate
                split = best_split(binned[rows], g[rows], h[rows], edges, monotone, low, high, ridge, least) if level < depth and len(rows) >= 2 * least else None
                if split is None:
                    continue
                logit[rows] -= own * rate
                f, k, below, above = split
                middle = (below + above) / 2
                goes = binned[rows, f] <= k
                kids = len(nodes), len(nodes) + 1
                nodes[node][:] = f, edges[f][k], *kids, 0.0
                nodes.extend([[0, np.inf, kid, kid, 0.0] for kid in kids])
                sign = monotone[f]
                following.append((kids[0], rows[goes], max(low, middle) if sign < 0 else low, min(high, middle) if sign > 0 else high))
                following.append((kids[1], rows[~goes], max(low, middle) if sign > 0 else low, min(high, middle) if sign < 0 else high))
            open_ = following
    columns = list(zip(*nodes, strict=True)) or [(), (), (), (), ()]
    kinds = (np.int64, float, np.int64, np.int64, float)
    return Forest(np.array(roots, np.int64), *(np.array(c, t) for c, t in zip(columns, kinds, strict=True)), depth, base)


def best_split(binned: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray], monotone: np.ndarray, low: float, high: float, ridge: float, least: int):
    """``(column, bin, value below, value above)`` of the split that lowers the loss most, or None."""
    best, found = 1e-6, None
    gain = lambda w, a, b: -(2 * a * w + (b + ridge) * w * w)
    whole = np.clip(-g.sum() / (h.sum() + ridge), low, high)
    before = gain(whole, g.sum(), h.sum())
    for f, e in enumerate(edges):
        if not len(e):
            continue
        size = len(e) + 1
        n, gs, hs = (np.cumsum(np.bincount(binned[:, f], w, size))[:-1] for w in (None, g, h))
        below = np.clip(-gs / (hs + ridge), low, high)
        above = np.clip(-(g.sum() - gs) / (h.sum() - hs + ridge), low, high)
        better = gain(below, gs, hs) + gain(above, g.sum() - gs, h.sum() - hs) - before
        better[(n < least) | (len(g) - n < least) | (monotone[f] * (above - below) < 0)] = 0
        k = int(np.argmax(better))
        if better[k] > best:
            best, found = better[k], (f, k, float(below[k]), float(above[k]))
    return found


def fit(statistics: DataFrame, labelled: DataFrame, max_train: int = 8000, **how) -> Forest:
    """Trees for the statistics of at most ``max_train`` rows of ``labelled(doc_id, label)``, the first by a hash of the id; only
    their numbers reach the driver. Null labels and ids don't count, an id with several labels has its largest, one with
    several texts the least row of statistics."""
    place = F.struct(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).orderBy(place).limit(max_train)
    own = statistics.select(F.col("id").alias("doc_id"), F.array(*STATISTICS).alias("x")).join(F.broadcast(chosen), "doc_id")  # max_train rows
    rows = own.groupBy("doc_id", "label").agg(F.min("x").alias("x")).orderBy(place).select("label", "x").collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(STATISTICS))
    return boost(x, np.array([r["label"] for r in rows], float), np.array([MONOTONE.get(c, 0) for c in STATISTICS]), **how)


def score(statistics: DataFrame, forest: Forest) -> DataFrame:
    """``statistics`` with ``score``, the trees' chance of label 1 (it replaces a column of that name)."""
    sent = statistics.sparkSession.sparkContext.broadcast(forest)  # of a fixed size
    names = [c for c in statistics.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in STATISTICS], axis=1)
            values = sent.value.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(values)], names=[*names, "score"])

    source = statistics.select(*names)
    return source.mapInArrow(run, source.withColumn("score", F.lit(0.0)).schema)


def quality_rules(docs: DataFrame, labelled: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """``(id, *COUNTS, *STATISTICS, score, base_failed, kept)``: a document is kept if it passes the base rules (50 words, at most
    half of them in repeated windows) and the trees give it ``threshold`` or more. Without labelled texts all scores are 0.5.
    Nulls, repeated rows and clashing names as in ``document_statistics``."""
    found = settle(document_statistics(docs), "statistics")
    scored = score(found, fit(found, labelled, **how))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~held_out(F.col("doc_id")))
    return quality_rules(docs, marks).select(F.col("id").alias("doc_id"), *COUNTS, "base_failed", "kept", "score")
