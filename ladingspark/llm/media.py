"""Texts kept losslessly as PNG in a binary column, with a low-frequency cosine hash.

The payload is the text's UTF-8 bytes, padded with byte 255 to a positive multiple of 576, as
rows of 576 8-bit grey samples. The file is built and read chunk by chunk: each chunk's length,
type and checksum are tested, the rows come out of zlib and are unfiltered with numpy. Defined
results: a null text is empty (one padded row); a text of any length is one file, read back whole;
repeated rows give repeated results; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_of

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Side of the reduced image and of its low-frequency corner.
GRID, CORNER = 32, 8


def padded(text: str) -> bytes:
    data = text.encode()
    return data + b"\xff" * (-len(data) % WIDTH if data else WIDTH)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Each row takes the filter none, sub or up whose signed result is smallest in sum."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    sub = rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    forms = (rows, sub, up)
    cost = np.stack([np.abs(f.view(np.int8).astype(np.int16)).sum(axis=1) for f in forms])
    best = cost.argmin(axis=0)
    out = np.empty((len(rows), WIDTH + 1), np.uint8)
    out[:, 0] = best
    for k, form in enumerate(forms):
        out[best == k, 1:] = form[best == k]
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(out.tobytes(), 3)) + chunk(b"IEND", b"")


def unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Samples of 8-bit grey rows; runs of rows with one filter go together where they can."""
    out = np.zeros_like(rows)
    zero = np.zeros(rows.shape[1], np.uint8)
    at = 0
    while at < len(rows):
        kind, end = int(kinds[at]), at + 1
        while end < len(rows) and kinds[end] == kind:
            end += 1
        above = out[at - 1] if at else zero
        if kind == 0:
            out[at:end] = rows[at:end]
        elif kind == 1:
            out[at:end] = np.cumsum(rows[at:end], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[at:end] = np.cumsum(rows[at:end], axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for y in range(at, end):
                left = corner = 0
                line, over = rows[y].tolist(), above.tolist()
                for x, v in enumerate(line):
                    b = over[x]
                    if kind == 3:
                        guess = (left + b) >> 1
                    else:
                        p = left + b - corner
                        guess = min((left, b, corner), key=lambda c, p=p: abs(p - c))
                    left, corner = (v + guess) & 255, b
                    out[y, x] = left
                above = out[y]
        else:
            raise ValueError(f"unknown filter {kind}")
        at = end
    return out


def from_png(media: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG without interlacing; ValueError if a test fails."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, shape, parts, ended = 8, None, [], False
    while at < len(media) and not ended:
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data, check = media[at + 8 : at + 8 + size], media[at + 8 + size : at + 12 + size]
        if len(check) < 4 or zlib.crc32(kind + data) != struct.unpack(">I", check)[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", data)
            if (depth, colour, *rest) != (8, 0, 0, 0, 0):
                raise ValueError("not 8-bit grey without interlacing")
            shape = (height, width)
        elif kind == b"IDAT":
            parts.append(data)
        ended = kind == b"IEND"
        at += 12 + size
    if shape is None or not ended:
        raise ValueError("a chunk is missing")
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[0], shape[1] + 1)
    return unfiltered(lines[:, 0], lines[:, 1:])


def means(x: np.ndarray, n: int) -> np.ndarray:
    """Means of n bands of rows; few rows are repeated first."""
    if len(x) < n:
        return x[np.arange(n) * len(x) // n].astype(np.float64)
    edges = np.arange(n + 1) * len(x) // n
    return np.add.reduceat(x, edges[:-1], axis=0, dtype=np.float64) / np.diff(edges)[:, None]


_k = np.arange(GRID)
COSINES = np.cos(np.pi * (2 * _k[None, :] + 1) * np.arange(CORNER)[:, None] / (2 * GRID))


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits: which low-frequency cosine coefficients of the 32 x 32 means exceed their median."""
    small = means(means(samples, GRID).T, GRID).T
    low = np.round(COSINES @ small @ COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low)).tobytes().hex()


def media_columns(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and the media column.

    All but n_bytes is computed from the stored bytes after reading them back.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + (", media binary" if keep_media else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, rows = batch.slice(start, 256), []
                for text in part.column("text").to_pylist():
                    media = to_png(padded(text))
                    samples = from_png(media)
                    payload = samples.tobytes()
                    rows.append((len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples), media))
                cols = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols][: len(names)], names=names)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)
