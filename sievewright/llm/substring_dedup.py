"""Suffix-array dedup of repeated byte strings by bucket-pointer refinement.

A bucket identifier of a position stands for the q bytes that begin there. Identifiers of 2q bytes come from those of q
bytes at the position and at the later offset q, so 25-byte buckets are refined to 50, 100, 200 and 400 bytes, each
round reusing the last one's identifiers: within a task that is arithmetic on arrays. Identifiers are 128-bit mixes of
content, equal for equal strings in any task, so the buckets of different tasks need no common numbering.

All 400-byte buckets of a corpus are far more than its text, so only *anchors* leave a task. The anchor of a 400-byte
string is the least of its 200-byte identifiers; equal strings have it at the same place, and neighbouring strings
mostly share it, which makes one row of about 100 strings. What follows works on anchors:

1. Anchors whose 200-byte bucket holds no other anchor can't be in a repeated string and go.
2. Anchors with the same span around them form a class; a class of two or more is repeated as a whole.
3. In buckets with several classes, one member of each class is split into cells of 25 neighbouring strings. Cells that
   share the whole stretch they cover are repeated; cells whose common core no other has are not.
4. What is left, the cells at the ends of repeats, is refined to its 400-byte buckets; those of two classes are repeats.

Every grouping is an aggregation that combines before the shuffle; nothing is gathered per bucket. Texts of any length are
read in stretches of STRETCH bytes that overlap by LENGTH - 1, so identifiers take a bounded amount of memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bitmap, bits_at, release, settle, slices, table, text_of

LENGTH = 400
HALF = LENGTH // 2
#: Buckets of 8 bytes are refined to 16, 25, 50, 100, 200 and 400 bytes by those at these later offsets.
OFFSETS = (8, 9, 25, 50, 100, 200)
STRETCH = 1 << 24  # bytes that are worked on at once
PLACE_BITS = 25  # number the places of a stretch; the same for all, so that ties between identifiers end alike everywhere
CELL = 25  # of neighbouring strings that are settled together
BITMAP = 1 << 25
HOT = 1024  # keys with over 1 / HOT of all rows are fewer than HOT; their rows are dealt over SALTS places
SALTS = 64


def _lanes(data: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of HALF and of LENGTH bytes at every position where they fit: a stretch's tail may have room for HALF alone."""
    empty = np.zeros(0, np.uint64)
    if len(data) < HALF:
        return empty, empty
    rng = np.random.default_rng(1000 + lane)
    # the first buckets: 8 bytes, read as a number at every position
    ident = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,)) ^ rng.integers(1, 1 << 63, dtype=np.uint64)
    ident *= rng.integers(1, 1 << 62, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    half = empty
    for offset in OFFSETS:
        a, b = rng.integers(1, 1 << 62, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        right = ident[offset:] >> np.uint64(32)
        right ^= ident[offset:]
        right *= b
        ident = ident[: len(right)] >> np.uint64(29) ^ ident[: len(right)]
        ident *= a
        ident += right
        if offset == HALF // 2:
            half = ident
    return half, ident


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[: len(values) - step], values[step:])
        done += step
    return values


def _blend(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for x in parts:
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64)
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _at(data: np.ndarray, lane: int, stretch: int, halves: list[np.ndarray], wholes: list[np.ndarray]) -> list[np.ndarray]:
    """The lane's identifiers of HALF bytes at each array of places in ``halves``, then those of LENGTH bytes at ``wholes``."""
    out = [np.zeros(len(x), np.uint64) for x in (*halves, *wholes)]
    for k in range(0, len(data), stretch):
        half, whole = _lanes(data[k : k + stretch + LENGTH - 1], lane)
        for x, (ident, places) in zip(out, [*((half, p) for p in halves), *((whole, p) for p in wholes)], strict=True):
            here = slice(None) if len(data) <= stretch else np.flatnonzero((places >= k) & (places < k + stretch))
            x[here] = ident[places[here] - k]
    return out


def anchors(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of texts that stand one after another in ``data``: text, first and number of the strings that share the
    anchor (from the text's begin), how far behind the first the anchor is, and identifiers of the anchor and the span."""
    (half, _), (_, whole) = _lanes(data, 0), _lanes(data, 1)
    n = len(whole)
    if n < 1:
        return {}
    low = np.uint64((1 << PLACE_BITS) - 1)
    ranked = (half & ~low) | (np.arange(len(half), dtype=np.uint64) & low)
    anchor = (_least(ranked, HALF)[:n] & low).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    sizes = ends - begins
    valid = np.maximum(sizes - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(ends)), valid)
    starts = np.arange(int(valid.sum())) - np.repeat(np.cumsum(valid) - valid, valid) + begins[text]
    if not len(starts):
        return {}
    anchor = anchor[starts]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    first, last = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1]
    text, anchor = text[new], anchor[new]
    return {"text": text, "first": first - begins[text], "n": last - first + 1, "lead": anchor - first, "a": half[anchor], "s": _blend(whole[first], whole[last], last - first, anchor - first)}


def _joined(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw = [x.encode("utf-8", "surrogatepass") for x in part.column("text").to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw])


def _find(stretch: int):
    """Anchors of all texts. Where a text goes on in a next stretch, a span that both hold comes as two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches, "text", min(stretch, 1 << 19)):
            data, ends = _joined(part)
            cut = len(data) > stretch  # then the part is one text
            for k in range(0, len(data), stretch) if cut else (0,):
                piece = data[k : k + stretch + LENGTH - 1] if cut else data
                if found := anchors(piece, np.array([len(piece)]) if cut else ends):
                    found["first"] = found["first"] + k
                    at = pa.array(found["text"])
                    yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("tk").take(at), *(pa.array(found[c].astype(np.int32)) for c in ("first", "n", "lead")), *(pa.array(found[c].view(np.int64)) for c in ("a", "s"))], names=["id", "tk", "first", "n", "lead", "a", "s"])

    return run


def _runs(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run of ``n``."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)


def _listed(part: pa.RecordBatch, names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """The spans of all rows: row, then the fields."""
    spans = part.column("spans").to_pylist()
    row = np.repeat(np.arange(len(spans)), [len(x) for x in spans])
    return row, *(np.array([s[c] for x in spans for s in x], np.int64) for c in names)


def _cells(stretch: int):
    """Cells of the listed spans: CELL strings by their distance before the anchor, whole where the text allows it. All of
    a cell's strings hold its core, and its cover holds them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 19):
            data, ends = _joined(part)
            row, first, n, lead, cls = _listed(part, ("first", "n", "lead", "cls"))
            least, most = (lead - n + 1) // CELL, lead // CELL
            k = most - least + 1
            cell = _runs(least, k)
            row, anchor, cls = (np.repeat(x, k) for x in (row, first + lead, cls))
            base = (ends - np.diff(ends, prepend=0))[row]
            size = np.diff(ends, prepend=0)[row]
            high, low = anchor - cell * CELL, anchor - cell * CELL - CELL + 1
            a, b = np.maximum(low, 0), np.minimum(high, size - LENGTH)
            full = (a == low) & (b == high)
            core = _blend(*_at(data, 0, stretch, [base + high, base + high + LENGTH - CELL + 1 - HALF], []))
            begin, end = _at(data, 1, stretch, [], [base + a, base + b])
            cover = _blend(np.where(full, begin, cls.astype(np.uint64)), np.where(full, end, a.astype(np.uint64)), full)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("tk").take(at), pa.array(a.astype(np.int32)), pa.array((b - a + 1).astype(np.int32)), pa.array(full), pa.array(core.view(np.int64)), pa.array(cover.view(np.int64))], names=["id", "tk", "first", "n", "full", "core", "cover"])

    return run


def _strings(stretch: int):
    """Identifiers of every string of the listed spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 19):
            data, ends = _joined(part)
            row, first, n = _listed(part, ("first", "n"))
            start = _runs(first, n)
            row = np.repeat(row, n)
            place = (ends - np.diff(ends, prepend=0))[row] + start
            one, two = (_at(data, lane, stretch, [], [place])[0] for lane in (0, 1))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("tk").take(at), pa.array(start.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["id", "tk", "first", "w1", "w2"])

    return run


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                raw, at, n_spans, kept, to = text.encode("utf-8", "surrogatepass"), 0, 0, [], -1
                for begin, end in sorted((s["first"], s["first"] + s["n"] + LENGTH - 1) for s in spans or ()):
                    if begin > to:  # runs that touch are one run
                        n_spans += 1
                        kept.append(raw[at:begin])
                    to = at = max(to, end)
                kept.append(raw[at:])
                left = b"".join(kept)
                rows.append((len(raw), len(raw) - len(left), n_spans, left if keep_text else None, hashlib.sha256(left).hexdigest()))
            n, removed, spans, left, digest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(left, pa.binary()), pa.array(digest)], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return run


def _with_bit(df: DataFrame, key: str, held, wanted: bool) -> DataFrame:
    """Rows of ``df`` whose ``key`` has its bit set (or not)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint64)
        for batch in batches:
            hit = bits_at(bits, batch.column(key).to_numpy(zero_copy_only=False))
            if (hit == wanted).any():
                yield batch.filter(pa.array(hit == wanted))

    return df.mapInArrow(run, df.schema)


def _spread(rows: DataFrame, keys: DataFrame, on: list[str], load: str, total: int) -> DataFrame:
    """``rows`` whose ``on`` is in ``keys``, where ``load`` counts the rows that have it, ``total`` in all.

    The rows of a hot key don't meet in one task: they are salted, and the key is repeated for every salt. Hot keys are
    fewer than HOT by their definition, so the list of them may be broadcast.
    """
    is_hot = F.col(load) * HOT > total
    hot = F.broadcast(keys.where(is_hot).select(*on, F.lit(True).alias("hot")))
    salted = rows.join(hot, on, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0).cast("int"))
    places = keys.select(*on, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return salted.join(places, [*on, "salt"]).select(*rows.columns)


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, stretch: int = STRETCH) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept, kept_sha256)`` per row of ``docs``: every byte covered by a LENGTH-byte
    string that also starts anywhere else is removed; strings are judged on the input, and overlaps count. ``kept`` is
    null unless ``keep_text``.

    Texts are UTF-8 bytes, null is empty; ``kept`` may be cut inside a character. Texts under LENGTH bytes stay. Rows that
    repeat an id and a text are documents each, so all bytes of such a text stand elsewhere too. Null ids are ids. Extra
    columns are ignored; an empty table gives no rows.

    Bitmaps of a fixed size keep rows out of shuffles that surely have no partner; equality joins decide about the rest.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text, context = text_of(docs, text_col), docs.sparkSession.sparkContext
    source = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("tk"), F.xxhash64(docs[id_col], F.xxhash64(text)).alias("key"), text.alias("text"))
    found = settle(source.select("id", "tk", "text").mapInArrow(_find(stretch), f"id {kind}, tk long, first int, n int, lead int, a long, s long"), "anchors")
    shared = settle(found.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "shared")
    maybe = _with_bit(found, "a", context.broadcast(bitmap(shared.select(F.col("a").alias("key")), BITMAP)), True)
    mine = settle(_spread(maybe, shared, ["a"], "k", found.count()).distinct(), "shared-anchors")
    span = ["a", "lead", "n", "s"]
    classes = settle(mine.groupBy(*span).agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("id", "tk", "first")).alias("rep")), "classes")
    crowded = classes.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    split = settle(_spread(classes, crowded, ["a"], "k", classes.count()).select("rep.*", "n", "lead", F.xxhash64(*span).alias("cls")), "split")
    whole = settle(_spread(mine, classes.where("members > 1"), span, "members", mine.count()).select("id", "tk", "first", "n"), "whole")

    again = source.groupBy("id", "tk").agg(F.count(F.lit(1)).alias("rows"), F.max(F.octet_length("text")).alias("bytes")).where((F.col("rows") > 1) & (F.col("bytes") >= LENGTH))
    again = settle(again.select("id", "tk", F.lit(0).alias("first"), (F.col("bytes") - LENGTH + 1).cast("int").alias("n")), "again")  # documents that stand in several rows
    whole = whole.unionByName(again)

    other = {"id": "id2", "tk": "tk2"}
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("tk") == F.col("tk2"))
    of = lambda rows, *fields: rows.groupBy("id", "tk").agg(F.collect_list(F.struct(*fields)).alias("spans")).withColumnsRenamed(other)
    touched = whole.select("id", "tk").union(split.select("id", "tk")).distinct()
    marks = context.broadcast(bitmap(touched.select(F.xxhash64("id", "tk").alias("key")), BITMAP))
    texts = settle(_with_bit(source, "key", marks, True).select("id", "tk", "text"), "touched")
    listed = texts.join(of(split, "first", "n", "lead", "cls"), same).select("id", "tk", "text", "spans")
    cells = settle(listed.mapInArrow(_cells(stretch), f"id {kind}, tk long, first int, n int, full boolean, core long, cover long").distinct(), "cells")
    covers = cells.groupBy("core", "cover").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("id", "tk", "first", "n")).alias("rep"))
    covers = settle(covers, "covers")
    mixed = covers.groupBy("core").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    accepted = _spread(cells.where("full"), covers.where("members > 1"), ["core", "cover"], "members", cells.count()).select("id", "tk", "first", "n")
    rest = _spread(covers, mixed, ["core"], "k", covers.count()).select("rep.*")
    listed = texts.join(of(rest, "first", "n"), same).select("id", "tk", "text", "spans")
    strings = settle(listed.mapInArrow(_strings(stretch), f"id {kind}, tk long, first int, w1 long, w2 long"), "strings")
    place = F.struct("id", "tk", "first")  # cells of one text may overlap, so a string may come twice from one place
    twice = strings.groupBy("w1", "w2").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.count(F.lit(1)).alias("k")).where("NOT x <=> y")
    single = _spread(strings, twice, ["w1", "w2"], "k", strings.count()).select("id", "tk", "first", F.lit(1).alias("n"))

    spans = of(whole.union(accepted).union(single), "first", "n")
    out = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    cut = texts.join(spans, same, "left").select("id", "text", "spans").mapInArrow(_cut(keep_text), out)
    rest = _with_bit(source, "key", marks, False).select("id", "text", F.lit(None).cast("array<struct<first:int,n:int>>").alias("spans"))
    return cut.union(rest.mapInArrow(_cut(keep_text), out))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_substrings(docs, keep_text=False).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
