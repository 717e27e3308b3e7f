"""Helpers that every training-data operator uses.

Document keys: an operator that joins its findings back to the documents keys them by ``(id, xxhash64(text))``.
Rows that share an id but not a text are thus separate documents, rows that repeat both are one document found
several times, and a null id is a key like any other.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and all tasks
    run on this machine."""
    app = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own.get(app)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _own[app] = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    return folder


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it again, so that a lost executor
    costs a read and not a recomputation. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes the table that ``settle`` wrote for ``df``, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` doesn't have, so that extra columns never clash with helper columns."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows of about ``limit`` text bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def bitmap(keys: DataFrame, bits: int) -> bytes:
    """``bits`` bits (a power of two), set at each ``key`` modulo ``bits``; it is built and sent as bits / 64 numbers at
    most, however many keys there are. Bit k is that of word k div 64 with the value 1 << (k mod 64)."""
    words = keys.selectExpr(f"pmod(key, {bits}) div 64 AS word", "shiftleft(1L, CAST(pmod(key, 64) AS INT)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    return out.tobytes()


def bits_at(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key (as 64-bit numbers of any sign) is set in ``bitmap`` (uint64 words)."""
    slot = keys.view(np.uint64) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


_tables: dict = {}


def held(key, make):
    """What ``make()`` gives, kept in this worker for its next tasks. A worker keeps the tables of one operator at a time, so
    that those of a job's stages never add up."""
    if key not in _tables:
        _tables.clear()
        _tables[key] = make()
    return _tables[key]


def release() -> None:
    """For tasks of operators that keep nothing."""
    _tables.clear()


#: Distinct words that a task's table holds, unless told otherwise.
WORDS = 250_000


class WordTable(dict):
    """Numbers the distinct words of a task's texts, so that what a word alone decides is computed once.

    ``fill(words)`` gets the words that are new and appends their values, in this order. The table is emptied when it
    holds more than ``limit`` words, which bounds its memory and changes no result.
    """

    def __init__(self, fill, empty, limit: int = WORDS):
        super().__init__()
        self.fill, self.empty, self.limit, self.fresh = fill, empty, limit, []

    def __missing__(self, word):
        code = self[word] = len(self)
        self.fresh.append(word)
        return code

    def codes(self, texts: list, split) -> tuple[np.ndarray, np.ndarray]:
        """The words' codes of all texts, and the words of each text."""
        if len(self) > self.limit:
            self.clear()
            self.empty()
        out, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = split(text)
            counts[i] = len(words)
            out.extend([self[w] for w in words])
        if self.fresh:
            self.fill(self.fresh)
            self.fresh = []
        return np.array(out, np.int64), counts


class Growing:
    """A numpy array that grows at its end."""

    def __init__(self, dtype):
        self.n, self.a = 0, np.zeros(1024, dtype)

    def extend(self, values) -> None:
        values = np.asarray(values, self.a.dtype)
        if self.n + len(values) > len(self.a):
            self.a = np.concatenate([self.a[: self.n], np.zeros(max(len(self.a), len(values)), self.a.dtype)])
        self.a[self.n : self.n + len(values)] = values
        self.n += len(values)

    def clear(self) -> None:
        self.n = 0


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``counts`` values."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def hash32(words: list[bytes], seed: int = 0) -> np.ndarray:
    from xxhash import xxh32_intdigest

    return np.array([xxh32_intdigest(w, seed) for w in words], np.uint32)
