"""Media columns: AVI files of lossless motion JPEG.

A frame is one 48 x 12 grey picture of 8-bit samples, coded by the lossless process of JPEG (SOF3, predictor 1) with a
fixed Huffman table and a restart marker behind each row. Restarted rows don't depend on each other, so numpy decodes
all rows of all frames of a batch in step, sample by sample. Files carry the usual RIFF lists and an ``idx1`` index,
through which the reader finds the frames. Shots are cut where the grey-level histogram changes by more than an
adaptive threshold: mean plus twice the deviation of the clip's own changes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices, table, text_of

WIDTH, HEIGHT, FRAME_MS = 48, 12, 40
SAMPLES = WIDTH * HEIGHT
#: Huffman table: 3-bit codes for six difference classes, 4-bit codes for three; the code of ones stays free.
BITS = (0, 0, 6, 3) + (0,) * 12
CLASSES = (0, 3, 4, 5, 6, 7, 1, 2, 8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEADER = (
    b"\xff\xd8"
    + _segment(0xC4, bytes([0, *BITS, *CLASSES]))
    + _segment(0xC3, struct.pack(">BHHBBBB", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0))
    + _segment(0xDD, struct.pack(">H", WIDTH))
    + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
)


def _codes(bits: tuple[int, ...], classes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical code and its length for each difference class."""
    code, k, value, length = 0, 0, np.zeros(17, np.int32), np.zeros(17, np.int32)
    for n, count in enumerate(bits, 1):
        for _ in range(count):
            value[classes[k]], length[classes[k]] = code, n
            code, k = code + 1, k + 1
        code <<= 1
    return value, length


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """JPEG pictures of ``samples`` (frames x SAMPLES, uint8): all bytes one after another, and each picture's length."""
    rows = samples.reshape(-1, WIDTH).astype(np.int32)
    diff = np.diff(rows, axis=1, prepend=np.int32(128)).ravel()
    size = np.array([int(x).bit_length() for x in range(256)], np.int32)[np.abs(diff)]
    code, length = _codes(BITS, CLASSES)
    bits = (length[size] + size).astype(np.int64)
    value = (code[size] << size) | np.where(diff < 0, diff + (1 << size) - 1, diff)
    within = np.cumsum(bits.reshape(-1, WIDTH), axis=1)
    row_bits = within[:, -1]
    row_bytes = (row_bits + 7) >> 3
    row_at = np.cumsum(row_bytes) - row_bytes
    at = ((within - bits.reshape(-1, WIDTH)) + row_at[:, None] * 8).ravel()
    total = int(row_bytes.sum())
    index = at >> 3
    shifted = value.astype(np.int64) << (24 - bits - (at & 7))
    packed = np.bincount(index, shifted >> 16, total + 2) + np.bincount(index + 1, (shifted >> 8) & 255, total + 2) + np.bincount(index + 2, shifted & 255, total + 2)
    packed = packed[:total].astype(np.uint8)
    packed[row_at + row_bytes - 1] |= ((1 << (row_bytes * 8 - row_bits)) - 1).astype(np.uint8)
    full = packed == 255
    stuffed = np.add.reduceat(full.astype(np.int64), row_at) + row_bytes
    # place: picture header, then each row and a marker of two bytes
    n = len(samples)
    size_of = (stuffed + 2).reshape(n, HEIGHT)
    lengths = size_of.sum(axis=1) + len(HEADER)
    start = np.cumsum(lengths) - lengths
    row_to = ((np.cumsum(size_of, axis=1) - size_of) + start[:, None] + len(HEADER)).ravel()
    out = np.zeros(int(lengths.sum()), np.uint8)
    out[start[:, None] + np.arange(len(HEADER))] = np.frombuffer(HEADER, np.uint8)
    before = np.cumsum(full) - full
    to = np.arange(total) + before + np.repeat(row_to - (row_at + before[row_at]), row_bytes)
    out[to] = packed  # the byte behind each 255 stays 0
    marker = row_to + stuffed
    kinds = np.tile(np.append(0xD0 + np.arange(HEIGHT - 1) % 8, 0xD9), n).astype(np.uint8)
    out[marker], out[marker + 1] = 255, kinds
    return out, lengths


def decode_frames(pictures: list[bytes]) -> np.ndarray:
    """Samples (frames x SAMPLES, uint8) of JPEG pictures that share one header."""
    if not pictures:
        return np.zeros((0, SAMPLES), np.uint8)
    head, code, length = _read_header(pictures[0])
    for p in pictures:
        if not p.startswith(head) or p[-2:] != b"\xff\xd9":
            raise ValueError("a picture's header differs from its clip's")
    data = np.frombuffer(b"".join(p[len(head) :] for p in pictures), np.uint8)
    ff = np.flatnonzero(data[:-1] == 255)
    follow = data[ff + 1]
    if not np.isin(follow, [0, 0xD9, *range(0xD0, 0xD8)]).all():
        raise ValueError("a marker that doesn't belong into a scan")
    keep = np.ones(len(data), bool)
    keep[ff[follow == 0] + 1] = False
    marks = ff[follow >= 0xD0]
    keep[marks] = keep[marks + 1] = False
    if len(marks) != len(pictures) * HEIGHT:
        raise ValueError("rows are missing")
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    at = kept_before[np.concatenate([[0], marks[:-1] + 2])] * 8
    raw = np.concatenate([data[keep], np.zeros(4, np.uint8)]).astype(np.int32)
    window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    step, value = np.zeros(4096, np.int64), np.zeros(4096, np.int32)
    for c in range(9):
        n = length[c] + c
        for extra in range(1 << c):
            first = ((int(code[c]) << c) | extra) << (12 - n)
            d = extra if c == 0 or extra >> (c - 1) else extra - (1 << c) + 1
            step[first : first + (1 << (12 - n))], value[first : first + (1 << (12 - n))] = n, d
    out = np.empty((WIDTH, len(at)), np.int32)
    for k in range(WIDTH):
        twelve = (window[at >> 3] >> (12 - (at & 7))) & 4095
        out[k] = value[twelve]
        at = at + step[twelve]
    return ((np.cumsum(out, axis=0, dtype=np.int32) + 128) & 255).astype(np.uint8).T.reshape(len(pictures), SAMPLES)


def _read_header(picture: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    at, code, length = 2, None, None
    if picture[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG picture")
    while True:
        _, marker, size = struct.unpack_from(">BBH", picture, at)
        body = picture[at + 4 : at + 2 + size]
        if marker == 0xC4:
            code, length = _codes(tuple(body[1:17]), tuple(body[17:]))
        elif marker == 0xC3 and body != struct.pack(">BHHBBBB", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0):
            raise ValueError("pictures of another shape")
        at += 2 + size
        if marker == 0xDA:
            return picture[:at], code, length


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(pictures: list[bytes]) -> bytes:
    n = len(pictures)
    main = struct.pack("<14I", FRAME_MS * 1000, 0, 0, 0x10, n, 0, 1, 0, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, FRAME_MS, 1000, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", SAMPLES, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    index, parts, at = [], [], 4
    for p in pictures:
        c = _chunk(b"00dc", p)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(p)))
        parts.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"movi" + b"".join(parts)) + _chunk(b"idx1", b"".join(index)))


def read_avi(media: bytes) -> list[bytes]:
    """The pictures of an AVI file, by its index."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index = 12, None, b""
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no pictures")
    return [media[movi + o + 8 : movi + o + 8 + n] for _, _, o, n in struct.iter_unpack("<4sIII", index)]


def cuts(samples: np.ndarray, of: np.ndarray) -> np.ndarray:
    """True at each frame that opens a shot; ``of`` numbers the clip of each frame, in order."""
    n = len(samples)
    hist = np.bincount((np.arange(n)[:, None] * 16 + (samples >> 4)).ravel(), minlength=n * 16).reshape(n, 16)
    change = np.concatenate([[0], np.abs(np.diff(hist, axis=0)).sum(axis=1)]) / (2 * SAMPLES)
    first = np.concatenate([[True], of[1:] != of[:-1]]) if n else np.zeros(0, bool)
    change[first] = 0
    groups = int(of[-1]) + 1 if n else 0
    count = np.maximum(np.bincount(of[~first], minlength=groups), 1)
    mean = np.bincount(of, change, groups) / count
    deviation = np.sqrt(np.maximum(np.bincount(of, change**2, groups) / count - mean**2, 0))
    return first | (change > (mean + 2 * deviation)[of] + 1e-9)


def _pairs(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else x or b"" for x in batch.column(column).to_pylist()]


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, media)``: each whole text as UTF-8, filled with bytes 255 to whole frames (one at least), as an AVI
    file. Null texts are empty ones; equal texts give equal files; every row gives a row, repeated and null ids too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            raw = _pairs(part, "text")
            frames = [max(1, -(-len(x) // SAMPLES)) for x in raw]
            joined = b"".join(x + b"\xff" * (f * SAMPLES - len(x)) for x, f in zip(raw, frames, strict=True))
            out, lengths = encode_frames(np.frombuffer(joined, np.uint8).reshape(-1, SAMPLES))
            data, ends, k, media = out.tobytes(), np.cumsum(lengths).tolist(), 0, []
            starts = [0, *ends[:-1]]
            for f in frames:
                media.append(write_avi([data[a:b] for a, b in zip(starts[k : k + f], ends[k : k + f], strict=True)]))
                k += f
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def _decoded(media: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pictures = [read_avi(m) for m in media]
    samples = decode_frames([p for x in pictures for p in x])
    return samples, np.repeat(np.arange(len(media)), [len(x) for x in pictures])


def _shots(opens: np.ndarray, of: np.ndarray, files: int) -> tuple[np.ndarray, ...]:
    """File, first frame and number of frames of each shot, and where each file's shots begin."""
    at = np.flatnonzero(opens)
    frames = np.bincount(of, minlength=files)
    begin = np.cumsum(frames) - frames
    doc = of[at]
    end = np.minimum(np.append(at[1:], len(of)), (begin + frames)[doc])
    return doc, at - begin[doc], end - at, np.searchsorted(doc, np.arange(files + 1))


def clips(media: DataFrame) -> DataFrame:
    """``(id, clip, first_frame, n_frames, start_ms, end_ms)``: one row per shot of each file of ``media(id, media)``.
    Null files have no rows; a file that can't be read ends the job with the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", 1 << 20):
            samples, of = _decoded(part.column("media").to_pylist())
            doc, first, n, begins = _shots(cuts(samples, of), of, part.num_rows)
            clip = np.arange(len(doc)) - begins[doc]
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(doc)), *map(pa.array, (clip, first, n, first * FRAME_MS, (first + n) * FRAME_MS))], names=["id", "clip", "first_frame", "n_frames", "start_ms", "end_ms"])

    kind = media.schema["id"].dataType.simpleString()
    return media.where("media IS NOT NULL").select("id", "media").mapInArrow(run, f"id {kind}, clip long, first_frame long, n_frames long, start_ms long, end_ms long")


def read_media(media: DataFrame) -> DataFrame:
    """Digests of what ``media(id, n_bytes, media)`` holds and its timed clips, read from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", 1 << 20):
            files = part.column("media").to_pylist()
            samples, of = _decoded(files)
            frames = np.bincount(of, minlength=len(files)).tolist()
            opens, data, k, rows = cuts(samples, of), samples.tobytes(), 0, []
            _, first, n, begins = _shots(opens, of, len(files))
            timed = pa.StructArray.from_arrays([pa.array(first * FRAME_MS), pa.array((first + n) * FRAME_MS)], names=["start_ms", "end_ms"])
            shots_of = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), timed)
            for m, f in zip(files, frames, strict=True):
                payload = data[k * SAMPLES : (k + f) * SAMPLES]
                shots = np.flatnonzero(opens[k : k + f]).tolist()
                feature = f"frames={f};shots={len(shots)};cuts={','.join(map(str, shots[1:]))}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
                k += f
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), shots_of], names=names)

    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
    kind = media.schema["id"].dataType.simpleString()
    return media.where("media IS NOT NULL").select("id", "n_bytes", "media").mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<start_ms:long,end_ms:long>>")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_media(encode_media(docs)).withColumnRenamed("id", "doc_id")
