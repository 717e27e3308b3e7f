"""Benchmark decontamination by CGK embedding and bit-sampling LSH, with exact edit verification.

Words are the symbols. The random walk of Chakraborty, Goldenberg and Koucky reads a window and repeats or advances by a
random bit of (step, symbol), which turns a small edit distance into a small Hamming distance of the walks' outputs.
For each of ``repeats`` walks a key samples ``bits`` outputs of an item-sized window; windows of documents and items
that share a key are candidates, and each candidate is verified by an exact edit distance of the whole item.

Items are keyed at their first words and at places along their whole length, document windows wherever they begin, also
up to an item's edits before the text. A window can only hold an item's stretch if it has enough of the benchmark's word
pairs (an edit spoils two at most), so windows below that count are left out before the walks: this filter loses nothing,
what is missed is missed by the walks alone. A second bitmap of the items' keys leaves out keys that no item has. What
passes is settled once, with the words around it; the join is on keys alone and fetches the words of the candidates.

How many walks: a walk's ``bits`` samples agree for a stretch with the most edits allowed with a chance p of about 0.1, so
``repeats`` walks miss a window with (1 - p) ** repeats; 64 walks of 3 bits give a recall of 0.95 and more at the allowed
edits (tests measure it by kind of edit and length).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bitmap, bits_at, release, settle, slices, table, text_of

MOST_WINDOW = 256
BITMAP, KEY_BITMAP = 1 << 22, 1 << 25
BLOCK = 1 << 18  # bytes that are hashed at once
#: Window sizes in words: an item belongs to the largest that it reaches.
SIZES = [1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 25, 32, 40, 50, 64, 80, 100, 128, 160, 200, MOST_WINDOW]


def edits_allowed(words: int, similarity: float) -> int:
    return int((1 - similarity) * words + 1e-9)


def item_places(words: int, size: int) -> list[int]:
    """Where an item's keyed stretches begin: the first three, as its first words may be edited, each ``size`` words from
    there on, and the last."""
    last = words - size
    return sorted({*range(min(2, last) + 1), *range(0, last + 1, size), last})


def stretch_edits(words: int, size: int, similarity: float) -> int:
    """Edits of the least edited of an item's keyed stretches at most, as ``words // size`` of them share no word."""
    return edits_allowed(words, similarity) // (words // size)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def normal(text: str) -> list[str]:
    """Lower-case words between ASCII white space."""
    return [w.decode("utf-8", "surrogatepass") for w in text.lower().encode("utf-8", "surrogatepass").split()]


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letters = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
    base, one = 0x5851F42D4C957F2D, np.ones(1, np.uint64)
    up = np.cumprod(np.concatenate([one, np.full(n, base, np.uint64)]))
    down = np.cumprod(np.concatenate([one, np.full(n, pow(base, -1, 1 << 64), np.uint64)]))
    return letters, up, down


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, and the words of each text: sums of letters times powers, taken for all words of a
    block at once as differences of one running sum. A block ends with a word."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    ends = np.cumsum([len(x) + 1 for x in raw])
    out = np.empty(len(begin), np.uint64)
    k = 0
    while k < len(begin):
        to = max(k + 1, int(np.searchsorted(end, begin[k] + BLOCK, side="right")))
        a, z = int(begin[k]), int(end[to - 1])
        letters, up, down = _powers(1 << max(BLOCK.bit_length(), (z - a).bit_length()))
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[data[a:z]] * up[: z - a])])
        out[k:to] = (run[end[k:to] - a] - run[begin[k:to] - a]) * down[begin[k:to] - a]
        k = to
    return _mix(out), np.bincount(np.searchsorted(ends, begin, side="right"), minlength=len(raw)).astype(np.int64)


def pair_keys(hashes: np.ndarray) -> np.ndarray:
    return _mix(hashes[:-1] * np.uint64(3) + hashes[1:])


def word_keys(hashes: np.ndarray) -> np.ndarray:
    """In place of pairs, for items of one word."""
    return _mix(hashes * np.uint64(5))


@lru_cache(maxsize=64)
def _walk(size: int, repeats: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which outputs each walk samples (steps x repeats), and the random numbers that steer it."""
    rng = np.random.default_rng([size, repeats, bits])
    length = int(1.6 * size) + 1
    sampled = np.zeros((length, repeats), bool)
    for r in range(repeats):
        sampled[rng.choice(length, min(bits, length), replace=False), r] = True
    return sampled, rng.integers(1, 1 << 63, (length, repeats), dtype=np.uint64)


def cgk_keys(windows: np.ndarray, size: int, repeats: int, bits: int) -> np.ndarray:
    """Keys (windows x repeats) of windows of ``size`` symbols, 0 behind a text's end; all walks go in step."""
    sampled, salt = _walk(size, repeats, bits)
    windows = np.concatenate([windows, np.zeros((len(windows), 1), np.uint64)], axis=1)
    row = np.arange(len(windows))[:, None]
    at = np.zeros((len(windows), repeats), np.int64)
    key = np.tile(size * np.uint64(1000003) + np.arange(repeats, dtype=np.uint64), (len(windows), 1))
    for j in range(len(sampled)):
        symbol = windows[row, at]
        if sampled[j].any():
            key[:, sampled[j]] = _mix(key[:, sampled[j]] * np.uint64(31) + symbol[:, sampled[j]])
        at += ((symbol ^ salt[j]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(63)).astype(np.int64)
        np.minimum(at, size, out=at)
    return key


def windows_at(hashes: np.ndarray, starts: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    place = starts[:, None] + np.arange(size)
    return np.where((place >= begin[:, None]) & (place < end[:, None]), hashes[np.clip(place, 0, len(hashes) - 1)], np.uint64(0))


def window_starts(total: np.ndarray, begins: np.ndarray, ends: np.ndarray, size: int, spoil: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and start of every window with the word pairs that a stretch with ``spoil`` edits keeps; ``total`` counts the
    pairs before each word. Starts before the text's begin are for stretches that have lost their first words."""
    need, n = max(1, size - 1 - 2 * spoil), len(total) - 1
    starts = np.flatnonzero(total[np.minimum(np.arange(n) + size - 1, n)] - total[:-1] >= need)
    doc = np.searchsorted(ends, starts, side="right")
    enough = total[np.minimum(starts + size - 1, ends[doc])] - total[starts] >= need
    head = np.flatnonzero(total[np.minimum(begins + size - 2, ends)] - total[begins] >= need) if spoil else np.zeros(0, np.int64)
    early = (begins[head][:, None] - np.arange(1, spoil + 1)).ravel()
    text = np.repeat(head, spoil)
    good = total[np.clip(early + size - 1, begins[text], ends[text])] - total[begins[text]] >= need
    return np.concatenate([doc[enough], text[good]]), np.concatenate([starts[enough], early[good]])


def best_match(item: list[str], window: list[str]) -> tuple[int, int]:
    """Least edits that turn the item into some stretch of the window, and that stretch's end (the first such)."""
    codes: dict[str, int] = {}
    a = [codes.setdefault(w, len(codes)) for w in item]
    b = np.array([codes.setdefault(w, len(codes)) for w in window], np.int64)
    ramp = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)  # a stretch may begin anywhere
    for i, x in enumerate(a, 1):
        step = np.minimum(row[:-1] + (b != x), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate([[i], step]) - ramp) + ramp
    return int(row.min()), int(row.argmin())


def _items(items: DataFrame, id_col: str, text_col: str, similarity: float, repeats: int, bits: int) -> DataFrame:
    """``(item_id, size, words, spoil, kind, value)``: of each item its LSH keys (kind 1) and its word pairs (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = normal(text)
                if not words:
                    continue
                size = max(s for s in SIZES if s <= len(words))
                h, _ = word_hashes([text])
                own = i, size, len(words), stretch_edits(len(words), size, similarity)
                rows += [(*own, 0, x) for x in np.unique((pair_keys(h) if size > 1 else word_keys(h)).view(np.int64)).tolist()]
                starts = np.array(item_places(len(words), size))
                for k in range(0, len(starts), 2048):
                    some = starts[k : k + 2048]
                    keys = cgk_keys(windows_at(h, some, np.zeros_like(some), np.full_like(some, len(h)), size), size, repeats, bits).view(np.int64)
                    rows += [(*own, 1, x) for x in np.unique(keys).tolist()]
            if rows:
                at, *numbers = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), *numbers], names=["item_id", "size", "words", "spoil", "kind", "value"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(items[id_col].alias("id"), text_of(items, text_col).alias("text")).mapInArrow(run, f"item_id {kind}, size long, words long, spoil long, kind long, value long")


def _windows(docs: DataFrame, id_col: str, text_col: str, known, keyed, classes, similarity: float, repeats: int, bits: int) -> DataFrame:
    """``(doc_id, tk, start, words, keys)``: the LSH keys, shared with an item as far as the bitmap tells, of windows that may
    hold an item's stretch, and the words from ``start`` on of any item around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        pairs, item_keys = np.frombuffer(known.value, np.uint64), np.frombuffer(keyed.value, np.uint64)
        for part in slices(batches, "text", 2 << 20):
            texts = part.column("text").to_pylist()
            h, counts = word_hashes(texts)
            if not len(h) or not classes:
                continue
            ends = np.cumsum(counts)
            hit = np.append(bits_at(pairs, pair_keys(h)), False).astype(np.int32)
            hit[ends[counts > 0] - 1] = 0  # pairs that span two texts
            total = np.concatenate([[0], np.cumsum(hit)])
            begins = ends - counts
            found: dict[tuple, set] = {}
            for size, most, spoil in classes:
                if size > 1:
                    doc, opens = window_starts(total, begins, ends, size, spoil)
                else:
                    opens = np.flatnonzero(bits_at(pairs, word_keys(h)))
                    doc = np.searchsorted(ends, opens, side="right")
                spare = edits_allowed(most, similarity) + 2
                for k in range(0, len(opens), 2048):
                    d, s = doc[k : k + 2048], opens[k : k + 2048]
                    keys = cgk_keys(windows_at(h, s, begins[d], ends[d], size), size, repeats, bits)
                    i, r = np.nonzero(bits_at(item_keys, keys))
                    # windows that begin close together share one stretch of text, and its verification
                    near = ((s - begins[d]) // spare * spare)[i]
                    for x, at, key in zip(d[i].tolist(), near.tolist(), keys[i, r].view(np.int64).tolist(), strict=True):
                        found.setdefault((x, at, most, size, spare), set()).add(key)
            rows, last, words = [], -1, []
            for (d, first, most, size, spare), keys in sorted(found.items(), key=lambda x: x[0][0]):
                if d != last:
                    last, words = d, normal(texts[d])
                a = max(0, first - spare - (most - size))
                rows.append((d, a, " ".join(words[a : first + most + 2 * spare]), list(keys)))
            if rows:
                d, a, text, keys = zip(*rows, strict=True)
                at = pa.array(d, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("tk").take(at), pa.array(a, pa.int64()), pa.array(text, pa.string()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "tk", "start", "words", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = text_of(docs, text_col)
    return docs.select(docs[id_col].alias("id"), text.alias("text"), F.xxhash64(text).alias("tk")).mapInArrow(run, f"doc_id {kind}, tk long, start long, words string, keys array<long>")


def compare(item: list[str], window: list[str], most: int) -> tuple[int, int] | None:
    """As :func:`best_match` where that needs at most ``most`` edits; what is plain without it comes first."""
    near = set(window)
    if sum(w not in near for w in item) > most:
        return None
    joined = f" {' '.join(window)} "
    at = joined.find(f" {' '.join(item)} ")
    if at >= 0:
        return 0, joined.count(" ", 0, at) + len(item)
    edits, stop = best_match(item, window)
    return (edits, stop) if edits <= most else None


def _verify(similarity: float, item_kind: str, doc_kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (start, window, item) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("start", "words", "item")), strict=True)):
                words = normal(item)
                match = compare(words, window.split(" "), edits_allowed(len(words), similarity))
                if match:
                    rows.append((i, start + match[1], match[0], 1 - match[0] / len(words)))
            if rows:
                at, stop, edits, like = zip(*rows, strict=True)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("doc_id", "tk", "item_id")), pa.array(stop, pa.int64()), pa.array(edits, pa.int64()), pa.array(like)], names=["doc_id", "tk", "item_id", "end_word", "edits", "similarity"])

    return run, f"doc_id {doc_kind}, tk long, item_id {item_kind}, end_word long, edits long, similarity double"


def benchmark_matches(docs: DataFrame, items: DataFrame, similarity: float = 0.8, repeats: int = 64, bits: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that it holds: ``(doc_id, tk, item_id, edits, similarity, end_word)`` of the best
    place (least edits, then the first); tk is the hash of the document's text.

    Texts are compared in lower case, word by word; a place counts if at most ``1 - similarity`` of the item's words are
    edited, so items under five words are compared exactly; items without words match nothing; null texts are empty.
    Repeated items and documents each count once per id; null ids match like others. Extra columns are ignored. Either table may be empty.
    """
    context = docs.sparkSession.sparkContext
    parts = settle(_items(items, id_col=item_col, text_col=item_text, similarity=similarity, repeats=repeats, bits=bits), "item-keys")
    of = lambda kind, size: context.broadcast(bitmap(parts.where(F.col("kind") == kind).select(F.col("value").alias("key")), size))
    # one row for each size class
    classes = [(r["size"], r["most"], r["spoil"]) for r in parts.groupBy("size").agg(F.max("words").alias("most"), F.max("spoil").alias("spoil")).collect()]
    found = _windows(docs, id_col, text_col, of(0, BITMAP), of(1, KEY_BITMAP), sorted(classes), similarity, repeats, bits)
    windows = settle(found.withColumn("wk", F.xxhash64("words")), "windows")
    keyed = windows.select("doc_id", "tk", "start", "wk", F.explode("keys").alias("key"))
    keys = parts.where("kind = 1").select("item_id", F.col("value").alias("key")).distinct()
    hits = keyed.join(keys, "key").select(F.col("doc_id").alias("d2"), F.col("tk").alias("t2"), F.col("start").alias("s2"), F.col("wk").alias("w2"), "item_id").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("tk") == F.col("t2")) & (F.col("start") == F.col("s2")) & (F.col("wk") == F.col("w2"))
    candidates = windows.dropDuplicates(["doc_id", "tk", "start", "wk"]).join(hits, same).select("doc_id", "tk", "start", "words", "item_id")
    texts = items.select(items[item_col].alias("item"), text_of(items, item_text).alias("text")).distinct()
    both = candidates.join(texts, candidates["item_id"].eqNullSafe(texts["item"])).select("doc_id", "tk", "item_id", "start", "words", F.col("text").alias("item"))
    run, schema = _verify(similarity, items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString())
    found = both.mapInArrow(run, schema)
    best = found.groupBy("doc_id", "tk", "item_id").agg(F.min(F.struct("edits", "end_word", "similarity")).alias("x"))
    return best.select("doc_id", "tk", "item_id", "x.edits", "x.similarity", "x.end_word")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = benchmark_matches(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "item_id", "edits", "similarity", "end_word")
