"""Media columns: 8-bit grey PNG in binary columns, and cosine-transform hashes.

The writer and reader are made here from zlib and numpy: chunks with their CRC-32, and
rows filtered each by that of the five PNG filters whose differences are smallest. A payload
of bytes is an image 64 samples wide. ``store`` puts the media into a binary column;
``read_back`` tests checksums and undoes the filters of all images of a batch together. The feature is
the sign pattern of the 8 x 8 lowest frequencies (the constant one aside) of the cosine
transform of the image averaged down to 32 x 32.

Defined cases: a null or empty text is a payload of 64 zero bytes; ids may be null and
may repeat; other columns are ignored, whatever their names; an empty table gives an
empty result; damaged or null media raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, SIDE, LOW = 64, 32, 8
#: Compressed bytes in each data chunk, and those of the media that are read at once.
CHUNK, MEDIA_BYTES = 1 << 16, 1 << 20

_COSINE = np.cos(np.pi * (2 * np.arange(SIDE) + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _predicted(kind: int, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What a filter of the PNG standard subtracts (as int16)."""
    if kind == 0:
        return np.zeros_like(left)
    if kind < 3:
        return left if kind == 1 else up
    if kind == 3:
        return (left + up) >> 1
    da, db, dc = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
    return np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))


def filtered(samples: np.ndarray, filter_type: int | None = None) -> np.ndarray:
    """Rows with their filter types in front: one filter for all, or for each row the one with the smallest sum of absolute differences."""
    height, width = samples.shape
    padded = np.zeros((height + 1, width + 1), np.int16)
    padded[1:, 1:] = samples
    left, up, corner = padded[1:, :-1], padded[:-1, 1:], padded[:-1, :-1]
    rows = np.empty((height, width + 1), np.uint8)
    kinds = range(5) if filter_type is None else [filter_type]
    least = np.full(height, np.iinfo(np.int64).max)
    for kind in kinds:
        now = (padded[1:, 1:] - _predicted(kind, left, up, corner)).astype(np.uint8)
        size = np.abs(now.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)
        better = size < least
        least[better] = size[better]
        rows[better, 0] = kind
        rows[better, 1:] = now[better]
    return rows


def write_png(samples: np.ndarray, filter_type: int | None = None, level: int = 6) -> bytes:
    """PNG of a two-dimensional uint8 array."""
    height, width = samples.shape
    data = zlib.compress(filtered(samples, filter_type).tobytes(), level)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def rows_of(media: bytes) -> np.ndarray:
    """Filtered rows of an 8-bit grey PNG without interlace; every chunk's checksum is tested."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, data, ended = 8, None, [], False
    while at + 12 <= len(media) and not ended:
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(body) != n or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} at byte {at} is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("the PNG is cut short or of another kind")
    width, height = head[:2]
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if rows.size != height * (width + 1):
        raise ValueError("the PNG has another size than its header says")
    return rows.reshape(height, width + 1)


def read_png(media: bytes) -> np.ndarray:
    """Samples of one PNG."""
    rows = rows_of(media)
    return unfilter(rows, np.zeros(1, np.int64))


def unfilter(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Samples of images of one width, below each other, from filtered rows; starts: each image's first row.

    Rows that look up depend on the row above, so runs of them are undone by diagonals: at
    each step a row is one sample behind the one above it, and all runs go on together.
    """
    kinds = rows[:, 0]
    if kinds.size and kinds.max() > 4:
        raise ValueError("no such filter")
    height, width = rows.shape[0], rows.shape[1] - 1
    # A row and a column of zeros stand above and to the left; each image's first row looks up at the zeros.
    out = np.zeros((height + 1, width + 1), np.int16)
    out[1:, 1:] = rows[:, 1:]
    alone = np.flatnonzero(kinds == 1) + 1
    out[alone, 1:] = np.cumsum(out[alone, 1:], axis=1) & 255
    first = np.zeros(height, bool)
    first[starts[starts < height]] = True
    looks = kinds > 1
    if not looks.any():
        return out[1:, 1:].astype(np.uint8)
    # How many rows of its run stand above a row: it starts so many steps later.
    at = np.arange(height)
    anchor = np.maximum.accumulate(np.where(~looks | first, at, 0))
    delay = at - anchor
    own = np.flatnonzero(looks)
    own = own[np.argsort(delay[own], kind="stable")]
    delay, kind = delay[own], kinds[own]
    above = np.where(first[own], 0, own)  # of the padded rows
    lows = np.searchsorted(delay, np.arange(-width + 1, int(delay[-1]) + width))
    highs = np.searchsorted(delay, np.arange(int(delay[-1]) + width), side="right")
    flat, line = out.reshape(-1), width + 1
    base, base_up = (own + 1) * line + 1 - delay, above * line + 1 - delay
    for step in range(int(delay[-1]) + width):
        a, b = lows[step], highs[step]
        if a == b:
            continue
        here, over = base[a:b] + step, base_up[a:b] + step
        up, left, k = flat[over], flat[here - 1], kind[a:b]
        corner = flat[over - 1]
        # By Paeth's rule, then the average, then the sample above.
        da, db, dc = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        guess = np.where(k == 4, guess, np.where(k == 3, (left + up) >> 1, up))
        flat[here] = (flat[here] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def _averaged(samples: np.ndarray, n: int) -> np.ndarray:
    """The first axis averaged over n even spans, or repeated where it has fewer."""
    size = samples.shape[0]
    if size <= n:
        return samples[np.arange(n) * size // n]
    starts = np.arange(n) * size // n
    return np.add.reduceat(samples, starts, axis=0) / np.diff([*starts, size])[:, None]


def cosine_hash(samples: np.ndarray) -> str:
    """16 hexadecimal digits: which low frequencies lie above their median."""
    small = _averaged(_averaged(samples.astype(np.float64), SIDE).T, SIDE).T
    low = np.round(_COSINE @ small @ _COSINE.T, 6).ravel()
    low[0] = 0
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def payload(text: str | None) -> bytes:
    """UTF-8, with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


STORED = "n_bytes long, media binary"
FIELDS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, STORED) for each row of ``docs``: its text's bytes as a PNG in a binary column."""
    kind = docs.schema[id_col].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part.column(1).to_pylist()
            sizes = [len((t or "").encode()) for t in texts]
            media = [write_png(np.frombuffer(payload(t), np.uint8).reshape(-1, WIDTH)) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {STORED}")
    return out.withColumnRenamed("id", id_col)


def read_back(stored: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id_col, n_bytes, FIELDS) for each row of ``stored``, from nothing but its PNG and n_bytes, which is passed on."""
    kind = stored.schema[id_col].dataType.simpleString()
    names = ["id", "n_bytes", *(f.split()[0] for f in FIELDS.split(", "))]
    types = [pa.int64() if " long" in f else pa.string() for f in FIELDS.split(", ")]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", MEDIA_BYTES):
            media = part.column(2).to_pylist()
            if None in media:
                raise ValueError("a row has no media")
            images = [rows_of(m) for m in media]
            if any(i.shape[1] != WIDTH + 1 for i in images):
                raise ValueError(f"media must be {WIDTH} samples wide")
            edges = np.cumsum([0, *map(len, images)])
            samples = unfilter(np.concatenate(images), edges[:-1])
            found = []
            for m, a, b in zip(media, edges.tolist(), edges[1:].tolist()):
                own = samples[a:b]
                got = own.tobytes()
                found.append((len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-WIDTH:]), len(m), hashlib.sha256(m).hexdigest(), cosine_hash(own)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(zip(*found), types))], names)

    rows = stored.select(F.col(id_col).alias("id"), "n_bytes", F.col(media_col).alias("media"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, {FIELDS}").withColumnRenamed("id", id_col)
