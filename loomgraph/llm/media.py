"""Binary media columns: PNG written and read through zlib chunks, and low-frequency cosine-transform hashes.

A payload becomes a grey picture of 8-bit samples, 64 to a row.  Reading tests
the signature, the order and the checksum of every chunk, inflates the data and
undoes the row filters (all five kinds) with numpy.  The feature is a 64-bit
hash: the picture reduced to 32 x 32 means, a two-dimensional cosine transform,
and the signs of its 8 x 8 lowest frequencies against their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.common import table

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64


class BadImage(ValueError):
    pass


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filtered(rows: np.ndarray) -> np.ndarray:
    """Each row with its filter byte before it: none, left or up, whichever has the smallest sum of signed magnitudes."""
    left = rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    tried = np.stack([rows, left, up])
    kind = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = tried[kind, np.arange(len(rows))]
    return out


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """A grey 8-bit PNG of width columns that holds the payload, whose length is a positive multiple of width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered(rows).tobytes(), level)) + _chunk(b"IEND", b"")


def unfiltered(rows: np.ndarray) -> np.ndarray:
    """Undoes the filters of rows (filter byte first), one byte a sample."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise BadImage("unknown filter")
    left = kinds == 1
    out[left] = np.cumsum(out[left], axis=1, dtype=np.uint8)
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
        kind = int(kinds[a])
        if kind == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind > 2:
            for y in range(a, b):
                above = out[y - 1].astype(int).tolist() if y else [0] * out.shape[1]
                row, before, corner = out[y].tolist(), 0, 0
                for x, u in enumerate(above):
                    if kind == 3:
                        guess = (before + u) // 2
                    else:
                        p = before + u - corner
                        guess = min((abs(p - before), 0, before), (abs(p - u), 1, u), (abs(p - corner), 2, corner))[2]
                    before, corner = (row[x] + guess) & 255, u
                    row[x] = before
                out[y] = row
    return out


def decode_png(image: bytes) -> np.ndarray:
    """The samples, rows by columns, of a grey 8-bit PNG without interlace; BadImage when anything in it is wrong."""
    if image[:8] != SIGNATURE:
        raise BadImage("signature")
    at, head, data, ended = 8, None, [], False
    while at < len(image) and not ended:
        if at + 12 > len(image):
            raise BadImage("cut short")
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        body, crc = image[at + 8 : at + 8 + n], image[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(body, zlib.crc32(kind)) != int.from_bytes(crc, "big"):
            raise BadImage(f"checksum of {kind!r}")
        if (head is None) != (kind == b"IHDR"):
            raise BadImage("order of chunks")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
        at += 12 + n
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise BadImage("header or end")
    width, height = head[:2]
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise BadImage("data") from e
    if len(raw) != height * (width + 1):
        raise BadImage("size")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def _cosines(size: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(size)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * size)) * np.where(k == 0, np.sqrt(1 / size), np.sqrt(2 / size))


_C = _cosines(32, 8)


def reduced(samples: np.ndarray) -> np.ndarray:
    """The 32 x 32 means of a picture; a side under 32 repeats its rows or columns."""
    out = samples.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        if n < 32:
            out = np.take(out, np.arange(32) * n // 32, axis=axis)
        else:
            cuts = np.arange(33) * n // 32
            shape = (-1, 1) if axis == 0 else (1, -1)
            out = np.add.reduceat(out, cuts[:-1], axis=axis) / np.diff(cuts).reshape(shape)
    return out


def cosine_hash(small: np.ndarray) -> list[str]:
    """For pictures (n, 32, 32): 16 hexadecimal digits each, a bit for each of the 8 x 8 lowest frequencies above their median (the mean level not counted)."""
    low = np.round(np.matmul(np.matmul(_C, small), _C.T).reshape(len(small), 64), 6)
    bits = low > np.median(low[:, 1:], axis=1, keepdims=True)
    return [x.tobytes().hex() for x in np.packbits(bits, axis=1)]


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Stores each text as a PNG, reads it back and computes its features; one row for each row of docs, nothing is shuffled.

    Returns id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, and with with_media the PNG as binary
    column media.  A null text counts as empty, and empty ones as 64 zero
    bytes.  Equal texts have equal values.  An empty table gives no rows; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                n, size, sha, tail, media_size, media_sha, small, media = [], [], [], [], [], [], [], []
                for value in batch.column(1):
                    data = (value.as_py() or "").encode("utf-8", "surrogatepass")
                    image = encode_png(data + bytes(-len(data) % WIDTH or (0 if data else WIDTH)))
                    samples = decode_png(image)
                    payload = samples.tobytes()
                    n.append(len(data))
                    size.append(len(payload))
                    sha.append(hashlib.sha256(payload).hexdigest())
                    tail.append(zlib.crc32(payload[-WIDTH:]))
                    media_size.append(len(image))
                    media_sha.append(hashlib.sha256(image).hexdigest())
                    small.append(reduced(samples))
                    if with_media:
                        media.append(image)
                columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, size)), pa.array(sha, pa.string()), *(pa.array(x, pa.int64()) for x in (tail, media_size)), pa.array(media_sha, pa.string()), pa.array(cosine_hash(np.array(small)), pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(media, pa.binary())] * with_media, names)

    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * with_media
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
