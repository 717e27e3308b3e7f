"""Codes of vectors by active-entry Lloyd rounds over integer parts.

Components become integers, a vector four parts, and each part the index of its nearest codebook entry. All arithmetic is on
integers, so that no order of tasks or sums changes a result: in 64-bit floats where every intermediate value stays under
2^53, else on Python's integers.

A round reads the stored state of the round before: the vector, the assigned entries and the exact distances to them. A
part whose entry stayed where it was keeps its distance, and any nearer entry must be one that moved, so it is compared
with the moved ones alone; a part whose entry moved is compared with all. Equal distances go to the lower index either way.
The new state is written, and the sums of each entry's parts, at most 4 x 256 rows however many vectors there are, give
the next codebooks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import forget, release, settle, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
EXACT = 1 << 53
LIMB = 31
FEW_LABELS = 100_000


@dataclass(frozen=True)
class Shape:
    """What all vectors have in common: components a part, and the largest magnitude of an integer component."""

    width: int
    most: int

    @property
    def plain(self) -> bool:
        """Whether distances and what leads to them are exact in 64-bit floats."""
        return 4 * max(self.width, 1) * (self.most + 1) ** 2 < EXACT

    @property
    def kind(self):
        return np.float64 if self.plain else object

    @property
    def limbs(self) -> int:
        """Numbers of 31 bits that hold a component, so that sums over 2^32 vectors fit 64 bits."""
        return 1 if self.plain else self.most.bit_length() // LIMB + 1


def integers(values: np.ndarray, lengths: np.ndarray, shape: Shape) -> np.ndarray:
    """``floor(1024 * x)`` of each component, a row a vector, filled with zeros to whole parts. ``values`` has the vectors in a row."""
    out = np.zeros((len(lengths), PARTS * shape.width), shape.kind)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.floor(values * SCALE) if shape.plain else [whole(x) for x in values.tolist()]
    return out


def whole(x: float) -> int:
    """``floor(1024 * x)`` of a finite number of any size."""
    return math.floor(x * SCALE) if abs(x) < 1e15 else int(x) * SCALE


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all parts to all entries."""
    return (parts * parts).sum(axis=1)[:, None] - 2 * (parts @ entries.T) + (entries * entries).sum(axis=1)[None, :]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each part the nearest entry's index, the lower of equal ones, and the distance to it."""
    d = distances(parts, entries)
    at = np.argmin(d, axis=1) if d.dtype != object else np.array([min(range(len(row)), key=row.__getitem__) for row in d], np.int64)
    return at, d[np.arange(len(parts)), at]


def reassign(parts: np.ndarray, entries: np.ndarray, moved: np.ndarray, at: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` for parts whose ``distance`` to entry ``at`` was exact and least before the entries ``moved`` did."""
    at, distance = at.copy(), distance.copy()
    again = moved[at]
    if again.any():
        at[again], distance[again] = nearest(parts[again], entries)
    active = np.flatnonzero(moved)
    still = np.flatnonzero(~again)
    if len(active) and len(still):
        found, d = nearest(parts[still], entries[active])
        found = active[found]
        better = ((d < distance[still]) | ((d == distance[still]) & (found < at[still]))).astype(bool)
        at[still[better]], distance[still[better]] = found[better], d[better]
    return at, distance


def _split(values: np.ndarray, shape: Shape) -> np.ndarray:
    """Signed limbs of integers, the lowest first, along a new last axis."""
    if shape.plain:
        return values.astype(np.int64)[..., None]
    flat = [[(abs(int(x)) >> LIMB * k & (1 << LIMB) - 1) * (1 if x >= 0 else -1) for k in range(shape.limbs)] for x in values.ravel()]
    return np.array(flat, np.int64).reshape(*values.shape, shape.limbs)


def _pack(values: np.ndarray, shape: Shape) -> list[bytes]:
    """Each row of integers as bytes."""
    return [row.tobytes() for row in values.astype("<i8")] if shape.plain else [",".join(map(str, row)).encode() for row in values.tolist()]


def _unpack(rows: list[bytes], width: int, shape: Shape) -> np.ndarray:
    if shape.plain:
        return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), width).astype(np.float64)
    return np.array([[int(x) for x in r.split(b",") if x] for r in rows], object).reshape(len(rows), width)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, label, vector)`` of the rows whose vector isn't null and holds finite numbers only."""
    rows = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("vector"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col("vector").isNotNull() & ~F.exists("vector", odd))


def measured(rows: DataFrame) -> Shape:
    size = lambda x: F.coalesce(F.aggregate(x, F.lit(0.0), lambda a, y: F.greatest(a, F.abs(y))), F.lit(0.0))
    r = rows.agg(F.max(F.size("vector")).alias("n"), F.max(size(F.col("vector"))).alias("most")).first()
    return Shape(-(-(r["n"] or 0) // PARTS), abs(whole(-(r["most"] or 0.0))))


def first_entries(rows: DataFrame, shape: Shape, entries: int = ENTRIES) -> list[np.ndarray]:
    """The codebooks to begin with: the parts of the ``entries`` smallest ids. Null ids come last; of rows that repeat an id the
    lesser vector comes first."""
    found = rows.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    values = np.array([x for r in found for x in r["vector"]], np.float64)
    return np.split(integers(values, np.array([len(r["vector"]) for r in found], np.int64), shape), PARTS, axis=1)


def _assigned(rows: DataFrame, shape: Shape, books: list[np.ndarray], moved: list[np.ndarray] | None) -> DataFrame:
    """The state after one more assignment; without ``moved`` the first, from vectors."""
    sent, kind = rows.sparkSession.sparkContext.broadcast((books, moved)), rows.schema["id"].dataType.simpleString()  # 4 x 256 entries
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        books, moved = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                some = batch.slice(k, 2048)
                if moved is None:
                    vector = some.column("vector")
                    whole_ = integers(vector.flatten().to_numpy(), pc.list_value_length(vector).to_numpy().astype(np.int64), shape)
                else:
                    whole_ = _unpack(some.column("whole").to_pylist(), PARTS * shape.width, shape)
                    codes = np.frombuffer(b"".join(some.column("code").to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64)
                    known = _unpack(some.column("distance").to_pylist(), PARTS, shape)
                found = []
                for p, parts in enumerate(np.split(whole_, PARTS, axis=1)):
                    found.append(nearest(parts, books[p]) if moved is None else reassign(parts, books[p], moved[p], codes[:, p], known[:, p]))
                code = np.stack([a for a, _ in found], axis=1).astype(np.uint8)
                distance = np.stack([d for _, d in found], axis=1)
                same = pa.array(_pack(whole_, shape), pa.binary()) if moved is None else some.column("whole")
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("label"), same, pa.array([r.tobytes() for r in code], pa.binary()), pa.array(_pack(distance, shape), pa.binary())], names=["id", "label", "whole", "code", "distance"])

    return rows.mapInArrow(run, f"id {kind}, label {label}, whole binary, code binary, distance binary")


def _sums(state: DataFrame, shape: Shape) -> DataFrame:
    """``(part, entry, n, total)``: how many parts each entry has and the sums of their components' limbs."""
    width, limbs = shape.width, shape.limbs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        n, total = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, width * limbs), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            whole_ = _split(_unpack(batch.column("whole").to_pylist(), PARTS * width, shape), shape).reshape(batch.num_rows, PARTS, width * limbs)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
            for p in range(PARTS):
                n[p] += np.bincount(codes[:, p], minlength=ENTRIES)
                np.add.at(total[p], codes[:, p], whole_[:, p])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    per_task = state.select("whole", "code").mapInArrow(run, "part int, entry int, n long, total array<long>")
    return per_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(k))) for k in range(width * limbs))).alias("total"))


def updated(books: list[np.ndarray], sums: list, shape: Shape) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The codebooks after a round, and of each part which entries are others than before; unused entries stay."""
    new = [b.copy() for b in books]
    for r in sums:
        limbs = [int(x) for x in r["total"]]
        for c in range(shape.width):
            total = sum(limbs[c * shape.limbs + k] << LIMB * k for k in range(shape.limbs))
            new[r["part"]][r["entry"], c] = total // r["n"]
    return new, [(a != b).any(axis=1) if shape.width else np.zeros(len(a), bool) for a, b in zip(books, new, strict=True)]


def codebook_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for row in b for x in row).encode()).hexdigest()


def lloyd(rows: DataFrame, shape: Shape, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """The final state of ``usable`` rows, stored, and the final codebooks."""
    books = first_entries(rows, shape)
    state = settle(_assigned(rows, shape, books, None), "codes")
    for _ in range(rounds):
        books, moved = updated(books, _sums(state, shape).collect(), shape)  # 4 x 256 rows at most
        following = settle(_assigned(state, shape, books, moved), "codes")
        forget(state)
        state = following
    return state, books


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """``(id, label, code, part_errors, error, label_error, codebooks_sha256)`` per usable row of ``vectors``.

    Null vectors and those with null or non-finite components give no row. Vectors may be of any length: all count as long as
    the longest, filled with zeros to a multiple of four; components of any size are exact, errors end at the largest long.
    Fewer than 256 rows make codebooks of as many entries. Repeated rows and null ids keep a row each; equal labels, nulls
    together, share ``label_error``; extra columns are ignored; no rows give none.
    """
    rows = usable(vectors, id_col, vector_col, label_col)
    shape = measured(rows)
    state, books = lloyd(rows, shape, rounds)
    most = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            known = [[int(x) for x in row] for row in _unpack(batch.column("distance").to_pylist(), PARTS, shape).tolist()]
            errors = pa.array([[min(x, most) for x in row] for row in known], pa.list_(pa.int64()))
            total = pa.array([min(sum(row), most) for row in known], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([c.hex() for c in batch.column("code").to_pylist()], pa.string()), errors, total], names=["id", "label", "code", "part_errors", "error"])

    kind, label = (state.schema[c].dataType.simpleString() for c in ("id", "label"))
    coded = state.select("id", "label", "code", "distance").mapInArrow(run, f"id {kind}, label {label}, code string, part_errors array<long>, error long")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(most).cast("decimal(38,0)")).cast("long")
    of_label = settle(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "label_errors")
    few = of_label.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    joined = coded.join(F.broadcast(of_label) if few else of_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("id", "label", "code", "part_errors", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """Each round as a step of plain SQL: all distances, the nearest entry, the mean of its parts."""
    steps = [
        """kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, (SELECT unnest(range(4)) AS p)
), book0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)
)"""
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT vec_id, label, p, min({{'d': list_sum(list_transform(list_zip(x, c), lambda y: (y[1] - y[2]) * (y[1] - y[2]))), 'i': i}}) AS best FROM parts JOIN book{r} USING (p) GROUP BY ALL
)""")
        if r < ROUNDS:
            steps.append(f"""cells{r} AS (
  SELECT p, best.i AS i, k, sum(x[k]) AS s, count(*) AS n FROM near{r} JOIN parts USING (vec_id, label, p), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS k) GROUP BY ALL
), means{r} AS (
  SELECT p, i, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS c FROM cells{r} GROUP BY p, i
), book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.i, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN means{r} m ON b.p = m.p AND b.i = m.i
)""")
    return f"""WITH {", ".join(steps)}, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.i), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, i)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded"""


ORACLE = _oracle()
