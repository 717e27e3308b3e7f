"""SimHash near-dedup with pivot distance tables.

1. One pass over the texts makes a 64-bit fingerprint per document; equal fingerprints are one class from then on.
2. Routing: the 64 bits are cut into 7 blocks. Two fingerprints that differ in at most 4 bits agree on 3 blocks at
   least, so all 35 choices of 3 blocks are keys, and every link meets under one of them. The keys carry 27 or 28 bits,
   so few other fingerprints meet; a fixed number of rows per class is shuffled, whatever the data.
3. Within a key, distances to fixed reference fingerprints (the pivots) are tabled. By the triangle inequality a pair
   with |d(x, p) - d(y, p)| > 4 for some pivot can't be a link; the maximum over all pivots discards pairs, and what
   survives is verified. Links are followed breadth first and a fingerprint that is reached leaves the set that is
   compared, so a dense group costs about its size and yields a forest, not all its pairs.
4. Keys with more than ``cell`` classes go through as rows and are split by the bits that their key leaves open: these are
   cut into 6 blocks, of which two agree at least, so 15 finer keys hold every link. What is still large is split again;
   rows grow by 15 a level and never with the square of a key's size, and the third level leaves at most 2^13 fingerprints a key.
5. Connected components over the forests give the classes' smallest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import release, settle, slices, table, text_of

BLOCKS = 7
AGREE = 3
MOST = 4
SPLIT, SPLIT_AGREE = 6, 2
LEVELS = 3
PATH_BITS = 6, 20  # of a key, that tell its mask: at the first level, at finer ones


def fingerprint(text: str, words: int = 4) -> int:
    """The SimHash of one text, unsigned."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    if not found:
        return 0
    joined = b" ".join(found)
    n = max(1, len(found) - words + 1)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    a, b = starts[:n].tolist(), (ends[words - 1 :] if len(found) >= words else ends[-1:]).tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[x:y], 42) for x, y in zip(a, b, strict=True)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        total += np.unpackbits(hashes[k : k + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)``: a signed 64-bit fingerprint for each row. Null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches, "text"):
            fp = np.array([fingerprint(x) for x in part.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def block_masks() -> list[int]:
    """Masks of every choice of AGREE blocks, as signed longs."""
    edges = [round(64 * k / BLOCKS) for k in range(BLOCKS + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [int(np.uint64(sum(c)).astype(np.int64)) for c in combinations(block, AGREE)]


def finer_masks(mask: int) -> list[int]:
    """``mask`` and every choice of SPLIT_AGREE of the SPLIT blocks into which it leaves the other bits, unsigned."""
    free = [b for b in range(64) if not mask >> b & 1]
    edges = [round(len(free) * k / SPLIT) for k in range(SPLIT + 1)]
    block = [sum(1 << b for b in free[a:z]) for a, z in zip(edges, edges[1:], strict=False)]
    return [mask | sum(c) for c in combinations(block, SPLIT_AGREE)]


@lru_cache(maxsize=1 << 12)
def mask_at(level: int, path: int) -> int:
    """The mask of a key by its path: which choice of blocks, then which finer one at each level."""
    if not level:
        return block_masks()[path] & (1 << 64) - 1
    width = len(list(combinations(range(SPLIT), SPLIT_AGREE)))
    return finer_masks(mask_at(level - 1, path // width))[path % width]


def _finer(level: int):
    """Keys of ``level`` for rows (key, fp) of the level before."""
    width, before = len(list(combinations(range(SPLIT), SPLIT_AGREE))), PATH_BITS[level > 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            path = key & np.uint64((1 << before) - 1)
            for p in np.unique(path).tolist():
                f, old = fp[path == p], key[path == p]
                for c in range(width):
                    held = f & np.uint64(mask_at(level, p * width + c))
                    mixed = (held ^ (held >> np.uint64(31)) ^ old) * np.uint64(0x9E3779B97F4A7C15)
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    finer = mixed >> np.uint64(PATH_BITS[1]) << np.uint64(PATH_BITS[1]) | np.uint64(p * width + c)
                    yield pa.RecordBatch.from_arrays([pa.array(finer.view(np.int64)), pa.array(f.view(np.int64))], names=["key", "fp"])

    return run


def pivots(n: int = 16) -> np.ndarray:
    """Reference fingerprints: the first ``n`` outputs of the splitmix64 generator."""
    z = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def links(fps: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges (seed, member) that connect the distinct fingerprints of one key as their links do."""
    tab = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)
    rest, u, v = np.arange(len(fps)), [], []
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        front = [seed]
        while front and len(rest):
            x = front.pop()
            near = np.abs(tab[rest] - tab[x]).max(axis=1) <= MOST
            near[near] = np.bitwise_count(fps[rest[near]] ^ fps[x]) <= MOST
            if near.any():
                hit = rest[near]
                rest = rest[~near]
                front.extend(hit.tolist())
                u.append(np.full(len(hit), fps[seed]))
                v.append(fps[hit])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(u), np.concatenate(v)) if u else (none, none)


def _linked(cell: int):
    """Over rows sorted by key: edges (kind 0: u, v); rows of keys with more than ``cell`` rows pass (kind 1: key, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots()
        held_k, held_f, hot = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def batch(kind: int, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u.astype(np.uint64).view(np.int64)), pa.array(v.astype(np.uint64).view(np.int64))], names=["kind", "u", "v"])

        def solve(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(k[1:] != k[:-1]) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(k)]])
            size = ends - starts
            two = starts[size == 2]
            a, b = f[two], f[two + 1]
            near = np.ones(len(two), bool)
            for p in refs:  # the pivot table of pairs, column by column
                near &= np.abs(np.bitwise_count(a ^ p).astype(np.int8) - np.bitwise_count(b ^ p).astype(np.int8)) <= MOST
            near[near] = np.bitwise_count(a[near] ^ b[near]) <= MOST
            us, vs = [a[near]], [b[near]]
            for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
                x, y = links(f[s:e], refs)
                us.append(x)
                vs.append(y)
            yield batch(0, np.concatenate(us), np.concatenate(vs))

        for got in batches:
            k = np.concatenate([held_k, got.column("key").to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, got.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if hot is not None:  # go on with a key that is too large for one task
                n = int(np.searchsorted(k != hot, True)) if k[-1] != hot else len(k)
                yield batch(1, k[:n].view(np.uint64), f[:n])
                k, f = k[n:], f[n:]
                hot = hot if not len(k) else None
            if not len(k):
                held_k, held_f = k, f
                continue
            last = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
            if last:
                big = np.flatnonzero(np.diff(np.flatnonzero(np.concatenate([[True], k[1:last] != k[: last - 1], [True]]))) > cell)
                if len(big):
                    runs = np.flatnonzero(np.concatenate([[True], k[1:last] != k[: last - 1], [True]]))
                    keep = np.ones(last, bool)
                    for r in big.tolist():
                        s, e = runs[r], runs[r + 1]
                        yield batch(1, k[s:e].view(np.uint64), f[s:e])
                        keep[s:e] = False
                    if keep.any():
                        yield from solve(k[:last][keep], f[:last][keep])
                else:
                    yield from solve(k[:last], f[:last])
            held_k, held_f = k[last:], f[last:]
            if len(held_k) > cell:
                hot = held_k[0]
                yield batch(1, held_k.view(np.uint64), held_f)
                held_k, held_f = held_k[:0], held_f[:0]
        if len(held_k):
            yield from solve(held_k, held_f)

    return run


def link_forest(fps: DataFrame, cell: int = 20_000) -> DataFrame:
    """``(u, v)`` edges that connect the distinct ``fp`` of ``fps`` exactly as all links within MOST bits would."""
    path = PATH_BITS[0]
    keys = F.explode(F.array(*[F.shiftleft(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))), path).bitwiseOR(F.lit(k)) for k, m in enumerate(block_masks())]))
    keyed, edges = fps.select(keys.alias("key"), "fp"), None
    for level in range(LEVELS + 1):
        most = cell if level < LEVELS else 1 << 60
        met = keyed.repartition("key").sortWithinPartitions("key")
        found = settle(met.mapInArrow(_linked(most), "kind int, u long, v long"), "links")
        own = found.where("kind = 0").select("u", "v")
        edges = own if edges is None else edges.union(own)
        hot = found.where("kind = 1").select(F.col("u").alias("key"), F.col("v").alias("fp"))
        if level == LEVELS or hot.isEmpty():
            return edges
        keyed = hot.mapInArrow(_finer(level + 1), "key long, fp long")


def _rooted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(id, fp)`` per row, and of each fingerprint ``(fp, least, root)``: its smallest id and its component's root."""
    fps = settle(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    stars = components(link_forest(classes.select("fp")))
    return fps, settle(classes.join(stars, classes["fp"] == stars["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component)`` per row of ``docs``: fp the signed fingerprint, component the smallest id reachable over
    links of at most MOST differing bits, the row's own id included.

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null id take part; a component whose
    ids are all null has a null component. Repeated ids keep one row each. An empty table gives no rows.
    """
    fps, rooted = _rooted(docs, id_col, text_col)
    best = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = rooted.join(best, "root").select("fp", "component")
    return fps.join(by_fp, "fp").select("id", "fp", "component")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id)``: the smallest id of each component."""
    return _rooted(docs, id_col, text_col)[1].groupBy("root").agg(F.min("least").alias("id")).select("id")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
