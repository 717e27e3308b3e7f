"""Best-fit packing with certified bin counts.

Texts are tokenized once, in place; what is shuffled are pieces, a few integers each. Pieces are dealt by hash into groups
of about ``group_size``, each packed by best-fit decreasing. Dual feasible functions give a lower bound for the number
of bins of any packing of the group, so a group that meets its bound is certified optimal; of its bins only the emptiest
goes on. A group with a gap gives up its least filled bins, up to a FAN-th of its pieces. What is given up meets that of
FAN - 1 other groups in the next round and is packed again, until one group is left. So no group of any round has many
more than ``group_size`` pieces, whatever the lengths, and each round has a FAN-th of the last one's pieces at most.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Growing, WordTable, held, segment_sums, settle, slices, table, text_of

FAN = 16
#: What the vocabulary's normalizer takes for white space; str.split() also takes the four separators.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = re.compile("[\x1c-\x1f]")


def split_words(text: str) -> list[str]:
    """The stretches between white space; tokens never reach across it."""
    return [w for w in SPACE.split(text) if w] if SEPARATORS.search(text) else text.split()


#: Distinct words that a task knows at a time, unless told otherwise.
WORDS = 1_000_000


class TokenIds:
    """Token ids of whole texts. Each distinct word is worked out once, and what tokenizes alike is tokenized once:
    ASCII words in lower case (so the vocabulary's normalizer has it), without one sign at the end of letters (a token
    of its own)."""

    def __init__(self, vocabulary: str, limit: int = WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.signs = {c: self.tokenizer.encode(c, add_special_tokens=False).ids[0] for c in ".,;:!?"}
        self.ids, self.at, self.n = Growing(np.uint32), Growing(np.int64), Growing(np.int64)
        self.core_ids, self.core_at, self.core_n = Growing(np.uint32), Growing(np.int64), Growing(np.int64)
        self.words = WordTable(self._fill, self._empty, limit)
        self.cores = WordTable(self._tokenize, lambda: None, limit)

    def _empty(self) -> None:
        self.cores.clear()
        for x in (self.ids, self.at, self.n, self.core_ids, self.core_at, self.core_n):
            x.clear()

    def _tokenize(self, words: list[str]) -> None:
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begins = np.cumsum([0, *(len(w) + 1 for w in some)])
            at = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.offsets))
            n = np.bincount(np.searchsorted(begins, at, side="right") - 1, minlength=len(some))[: len(some)]
            self.core_at.extend(self.core_ids.n + np.cumsum(n) - n)
            self.core_n.extend(n)
            self.core_ids.extend(found.ids)

    def _fill(self, words: list[str]) -> None:
        core, sign = np.empty(len(words), np.int64), np.full(len(words), -1, np.int64)
        for i, w in enumerate(words):
            if w.isascii() and "<|" not in w:  # special tokens are matched before the case is changed
                w = w.lower()
            if w[-1] in self.signs and w[:-1].isalpha():
                w, sign[i] = w[:-1], self.signs[w[-1]]
            core[i] = self.cores[w]
        if self.cores.fresh:
            self._tokenize(self.cores.fresh)
            self.cores.fresh = []
        own, more = self.core_n.a[core], sign >= 0
        n = own + more
        ends = np.cumsum(n)
        ids = np.empty(int(ends[-1]), np.uint32)
        place = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        ids[np.repeat(ends - n, own) + place] = self.core_ids.a[np.repeat(self.core_at.a[core], own) + place]
        ids[(ends - 1)[more]] = sign[more]
        self.at.extend(self.ids.n + ends - n)
        self.n.extend(n)
        self.ids.extend(ids)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of each text's."""
        codes, words = self.words.codes(texts, split_words)
        n, at = self.n.a[codes], self.at.a[codes]
        ends = np.cumsum(n)
        index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - (ends - n), n)
        return self.ids.a[index], segment_sums(n, words)


def token_ids(vocabulary: str, limit: int = WORDS) -> TokenIds:
    return held(("token ids", vocabulary, limit), lambda: TokenIds(vocabulary, limit))


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: each whole text's ids and ``end_id``, cut where longer than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(vocabulary, words)
        for part in slices(batches, "text", 1 << 20):
            ids, counts = encode(part.column("text").to_pylist())
            rows, at = [], 0
            for i, n in enumerate(counts.tolist()):
                whole = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                rows += [(i, k // capacity, k, min(capacity, n + 1 - k), zlib.crc32(whole[k : k + capacity].tobytes())) for k in range(0, n + 1, capacity)]
            row, piece, start, length, crc = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column("id").take(row), piece.cast(pa.int32()), start, length, crc], names=["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each of the ``lengths`` (given in falling order), and the number of bins. Bins are kept by the
    room they have left; the set bits of one integer tell which rooms occur."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = bins = 0
    which, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, x in enumerate(lengths):
        fits = rooms >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        which[i], offset[i] = b, capacity - room
        left = room - x
        if left:
            stacks[left].append(b)
            rooms |= 1 << left
    return which, offset, bins


def bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of two families of dual feasible functions."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    small = np.arange(capacity // 2 + 1)  # below: 0; above capacity - small: a whole bin
    large = count[-1] - count[capacity - small + 1]
    best = int(np.max(-(-(capacity * large + total[capacity - small + 1] - total[small]) // capacity)))
    for k in range(1, 33):  # (k + 1) x rounded down to whole bins, unless it is whole already
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # times k
        best = max(best, int(-(-int((n * value).sum()) // (capacity * k))))
    return best


def given_up(which: np.ndarray, room: np.ndarray, gap: int, most: int) -> np.ndarray:
    """Bins that are opened again, the emptiest first: one where the group meets its bound, else as many as hold ``most``
    pieces. Full bins stay."""
    order = np.argsort(-room, kind="stable")
    pieces = np.cumsum(np.bincount(which, minlength=len(room))[order])
    some = order[: max(1, int(np.searchsorted(pieces, most, side="right"))) if gap else 1]
    out = np.zeros(len(room), bool)
    out[some[room[some] > 0]] = True
    return out


def _pack(capacity: int, level: int, last: bool, most: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = group["length"].to_numpy()
        which, offset, bins = best_fit_decreasing(lengths.tolist(), capacity)
        room = capacity - np.bincount(which, lengths, bins).astype(np.int64)
        again = np.zeros(bins, bool) if last else given_up(which, room, bins - bound(lengths, capacity), most)
        group["sequence_id"] = (np.int64(level) << 58) | (np.int64(key[0]) << 30) | which
        group["offset"], group["again"] = offset, again[which]
        return group

    return run


def pack_pieces(pieces: DataFrame, capacity: int = 4096, group_size: int = 4096) -> DataFrame:
    """``pieces(id, piece, start, length, ids_crc32)`` with ``sequence_id`` and ``offset``. Offsets of a sequence are
    gapless from 0; every piece, repeated rows and null ids too, is placed once; no pieces give no rows."""
    kind = pieces.schema["id"].dataType.simpleString()
    base = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    groups = max(1, -(-pieces.count() // group_size))
    # rows that are equal in all fields are dealt apart by where they stand in the stored table
    dealt = F.xxhash64("id", "piece", "start", "ids_crc32", F.monotonically_increasing_id())
    now = pieces.withColumn("g", F.pmod(dealt, F.lit(groups)))
    done, level = None, 0
    while True:
        last = groups == 1
        packed = now.groupBy("g").applyInPandas(_pack(capacity, level, last, group_size // FAN), f"{base}, g long, sequence_id long, offset long, again boolean")
        packed = settle(packed, "packed")
        final = packed.where("NOT again").select("id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
        done = final if done is None else done.union(final)
        if last:
            return done
        groups, level = -(-groups // FAN), level + 1
        now = packed.where("again").select("id", "piece", "start", "length", "ids_crc32", F.expr(f"g div {FAN}").alias("g"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """All documents in as few sequences of ``capacity`` tokens as the method finds. Null and empty texts are one piece of
    one token; only documents over ``capacity`` are cut; extra columns are ignored, repeated rows and null ids keep pieces each; no documents
    give no rows. A task's tables of known words hold ``words`` of them, which bounds its memory and changes no result."""
    return pack_pieces(settle(token_pieces(docs, vocabulary, capacity, id_col=id_col, text_col=text_col, words=words), "pieces"), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
