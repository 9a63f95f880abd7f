"""Binary media columns: PNG by zlib chunks, and hashes of low cosine frequencies.

Scale: narrow maps, no shuffle.  A task holds one image and its rows' worth of
float averages; batches are cut by bytes, not by rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridlark.llm.common import tidy

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples per pixel by PNG colour type.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Payload bytes are a multiple of this; one row of the stored image has as many samples.
BLOCK = 576
#: Bytes of media that a task gathers before it hands a batch on.
BATCH_BYTES = 4_000_000


class MediaError(ValueError):
    """Bytes that aren't a PNG this reader can trust."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filter_rows(rows: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Filtered bytes of rows (height x bytes); kinds: the filter of each row; step: bytes per pixel."""
    left = np.zeros_like(rows)
    left[:, step:] = rows[:, :-step]
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    corner = np.zeros_like(rows)
    corner[1:, step:] = rows[:-1, :-step]
    by = [np.zeros_like(rows), left, up, _average(left, up), _paeth(left, up, corner)]
    return rows - np.choose(kinds[:, None], by)


def chosen_filters(rows: np.ndarray, step: int) -> np.ndarray:
    """For each row none, left or up: the one whose bytes, read as signed, have the least sum of sizes; the first of equals."""
    left, up = rows.copy(), rows.copy()
    left[:, step:] -= rows[:, :-step]
    up[1:] -= rows[:-1]
    sums = [np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for x in (rows, left, up)]
    return np.argmin(sums, axis=0).astype(np.uint8)


def _average(left: np.ndarray, up: np.ndarray) -> np.ndarray:
    return ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (left, up, corner))
    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, up, corner)).astype(np.uint8)


def unfilter_rows(data: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """The inverse of filter_rows.

    Runs of rows without average or Paeth filters are solved by sums along an
    axis.  Others go by skewed diagonals: the pixels of one diagonal need only
    those of the two before, so each numpy step solves a whole diagonal.
    """
    out = data.copy()
    if not kinds.any():
        return out
    height, width = data.shape[0], data.shape[1] // step
    if not (kinds >= 3).any():
        pixels = out.reshape(height, width, step)
        at = kinds == 1
        pixels[at] = np.cumsum(pixels[at], axis=1, dtype=np.uint8)
        for y in np.flatnonzero(kinds == 2):
            if y:
                out[y] += out[y - 1]
        return out
    grid = np.zeros((height + 1, width + 1, step), np.uint8)  # with a row above and a column before
    raw = data.reshape(height, width, step)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner = grid[y + 1, x], grid[y, x + 1], grid[y, x]
        guess = np.choose(kinds[y][:, None], [np.zeros_like(left), left, up, _average(left, up), _paeth(left, up, corner)])
        grid[y + 1, x + 1] = raw[y, x] + guess
    return grid[1:, 1:].reshape(height, width * step)


def encode_png(samples: np.ndarray, kinds: np.ndarray | None = None, level: int = 3) -> bytes:
    """8-bit grey or RGB samples (height x width, or x 3) as PNG; kinds: the filter of each row, chosen_filters by default."""
    height, width = samples.shape[:2]
    step = 1 if samples.ndim == 2 else 3
    rows = np.ascontiguousarray(samples, np.uint8).reshape(height, width * step)
    kinds = chosen_filters(rows, step) if kinds is None else kinds
    lines = np.empty((height, width * step + 1), np.uint8)
    lines[:, 0] = kinds
    lines[:, 1:] = filter_rows(rows, kinds, step) if kinds.any() else rows
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if step == 1 else 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Samples (height x width x samples) of an 8-bit, not interlaced PNG; a palette's indices stay indices.

    Each chunk's checksum is tested.  Raises MediaError for anything else.
    """
    if data[:8] != _SIGNATURE:
        raise MediaError("no PNG signature")
    at, head, packed, ended = 8, b"", [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise MediaError("cut short")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise MediaError(f"bad checksum of {kind!r}")
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if len(head) != 13 or not ended:
        raise MediaError("cut short")
    width, height, depth, colour, method, filtering, interlace = struct.unpack(">IIBBBBB", head)
    if depth != 8 or colour not in _SAMPLES or method or filtering or interlace or not width or not height:
        raise MediaError("not an 8-bit, not interlaced PNG")
    step = _SAMPLES[colour]
    try:
        flat = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise MediaError(str(e)) from None
    if len(flat) != height * (width * step + 1):
        raise MediaError("wrong number of samples")
    lines = flat.reshape(height, width * step + 1)
    if lines[:, 0].max() > 4:
        raise MediaError("unknown filter")
    return unfilter_rows(lines[:, 1:], lines[:, 0], step).reshape(height, width, step)


_SIDE, _LOW = 32, 8
_BASIS = np.cos(np.pi / _SIDE * (np.arange(_SIDE)[None, :] + 0.5) * np.arange(_LOW)[:, None])


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits in hex: which of the 8 x 8 lowest cosine frequencies of the grey image exceed their median.

    The image is averaged to 32 x 32 first (rows and columns repeat if it has fewer).
    """
    grey = samples.reshape(samples.shape[0], samples.shape[1], -1)[:, :, : 3 if samples.ndim == 3 and samples.shape[2] >= 3 else 1]
    grey = grey.sum(axis=2, dtype=np.int64)
    for axis in (0, 1):
        n = grey.shape[axis]
        edges = np.arange(_SIDE) * n // _SIDE
        sizes = np.maximum(np.diff(np.r_[edges, n]), 1)
        grey = np.add.reduceat(grey, edges, axis=axis) / (sizes[:, None] if axis == 0 else sizes[None, :])
    low = np.round(_BASIS @ grey @ _BASIS.T, 6)
    return np.packbits(low > np.median(low)).tobytes().hex()


def payload_of(text: bytes) -> bytes:
    """text and bytes 255 up to a positive multiple of BLOCK."""
    return text + b"\xff" * (BLOCK * max(1, -(-len(text) // BLOCK)) - len(text))


def text_to_media(df: DataFrame, text: str = "text", media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all by default) and media: a grey PNG whose samples are the UTF-8 text, padded by 255s.

    Each row of the image has the filter of the least sum.  A null text is an
    empty one; a very long text is one tall image, held whole; equal texts have
    equal media, repeated rows each their own.  A column of df named like media
    is replaced.  An empty df gives an empty result.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != media]
    place = df.columns.index(text)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: pa.RecordBatch, made: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(made, pa.binary())], [*keep, media])

        for batch in batches:
            first, made, size = 0, [], 0
            for k, value in enumerate(batch.column(place)):
                payload = payload_of((value.as_py() or "").encode())
                made.append(encode_png(np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)))
                size += len(made[-1])
                if size >= BATCH_BYTES:
                    yield out(batch.slice(first, len(made)), made)
                    first, made, size = k + 1, [], 0
            if made:
                yield out(batch.slice(first, len(made)), made)

    return df.mapInArrow(tidy(run), schema)


#: What read_media adds; the columns are null, but for media_bytes, media_sha256 and error, if the bytes can't be read.
READ = T.StructType(
    [
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def read_one(data: bytes | None) -> dict:
    """Digests and the cosine hash of the samples, read back from the stored bytes."""
    out = dict.fromkeys(READ.names)
    if data is None:
        return out | {"error": "null"}
    out |= {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
    try:
        samples = decode_png(data)
    except MediaError as e:
        return out | {"error": str(e)}
    payload = samples.tobytes()
    return out | {
        "width": samples.shape[1],
        "height": samples.shape[0],
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-32:]),
        "feature": cosine_hash(samples),
    }


def read_media(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all by default) and READ's; broken media give a row with error set, never a crash.

    Columns of df named like READ's are replaced; an empty df gives an empty result.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in READ.names]
    place = df.columns.index(media)
    schema = T.StructType([*(df.schema[c] for c in keep), *READ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                rows = [read_one(x.as_py()) for x in part.column(place)]
                made = [pa.array([r[f.name] for r in rows], pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in READ]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), *made], [*keep, *READ.names])

    return df.mapInArrow(tidy(run), schema)
