"""PNG columns: lossless storage of payloads, checked reading, low-frequency hashes.

`encode` stores bytes as 8-bit greyscale PNG, 64 samples a row, in a binary
column. `decode` walks the chunks, tests every checksum, inflates the zlib
stream and undoes the row filters with numpy. The feature is a 64-bit hash of
the signs of the 8 x 8 lowest frequencies of a cosine transform of the picture
averaged to 32 x 32.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkloom.llm.words import buffers, slices

WIDTH = 64
CHUNK = 1 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MOST_PIXELS = 1 << 31
_K = np.arange(32)
_DCT = np.cos(np.pi * (2 * _K[None, :] + 1) * np.arange(8)[:, None] / 64)


def pad(data: bytes) -> bytes:
    """Append zero bytes up to a positive multiple of 64."""
    return data + bytes((-len(data)) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _filtered(img: np.ndarray) -> np.ndarray:
    """Rows with their filter byte: `up` where a row repeats the one above, else none.

    Differences of text bytes compress worse than the bytes, so no others are used.
    """
    h, w = img.shape
    out = np.empty((h, w + 1), dtype=np.uint8)
    out[:, 0] = 0
    out[:, 1:] = img
    if h > 1:
        same = np.flatnonzero((img[1:] == img[:-1]).all(axis=1)) + 1
        out[same, 0] = 2
        out[same, 1:] = 0
    return out


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """A PNG whose samples are the payload's bytes; its length is a multiple of 64."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    img = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    packed = zlib.compress(_filtered(img).tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(img), 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", packed[k : k + CHUNK]) for k in range(0, len(packed), CHUNK)]
    parts.append(_chunk(b"IEND", b""))
    return b"".join(parts)


def _chunks(media: bytes) -> Iterator[tuple[bytes, memoryview]]:
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, view = 8, memoryview(media)
    while at < len(media):
        if at + 12 > len(media):
            raise ValueError("a chunk is cut short")
        (n,) = struct.unpack_from(">I", media, at)
        if at + 12 + n > len(media):
            raise ValueError("a chunk is cut short")
        kind, body = bytes(view[at + 4 : at + 8]), view[at + 8 : at + 8 + n]
        if zlib.crc32(view[at + 4 : at + 8 + n]) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"bad checksum in {kind!r}")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("no IEND")


def _unfilter(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the five PNG filters; rows has the filter byte in column 0.

    Rows without filter or with `sub` don't need the row above and go in two
    array operations; runs of `up` are one cumulative sum; `average` and
    `paeth` go sample by sample.
    """
    kinds, img = rows[:, 0], rows[:, 1:].copy()
    if len(kinds) and kinds.max() > 4:
        raise ValueError("unknown filter")
    sub = np.flatnonzero(kinds == 1)
    if len(sub):
        part = img[sub].reshape(len(sub), -1, bpp)
        img[sub] = np.cumsum(part, axis=1, dtype=np.uint8).reshape(len(sub), -1)
    dependent = np.flatnonzero(kinds >= 2)
    k = 0
    while k < len(dependent):
        first = last = int(dependent[k])
        if kinds[first] == 2:
            while k + 1 < len(dependent) and dependent[k + 1] == last + 1 and kinds[last + 1] == 2:
                k, last = k + 1, last + 1
            lo = max(0, first - 1)
            img[lo : last + 1] = np.cumsum(img[lo : last + 1], axis=0, dtype=np.uint8)
        else:
            _sequential(img, first, int(kinds[first]), bpp)
        k += 1
    return img


def _sequential(img: np.ndarray, r: int, kind: int, bpp: int) -> None:
    row = img[r].tolist()
    above = img[r - 1].tolist() if r else [0] * len(row)
    for x in range(len(row)):
        a = row[x - bpp] if x >= bpp else 0
        b = above[x]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            c = above[x - bpp] if x >= bpp else 0
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
        row[x] = (row[x] + guess) & 255
    img[r] = row


def decode_png(media: bytes) -> np.ndarray:
    """Height x bytes-a-row samples of a non-interlaced 8-bit PNG; ValueError if damaged."""
    head, inflate, parts = None, zlib.decompressobj(), []
    bound = 0
    for kind, body in _chunks(media):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
            w, h, depth, colour, _, _, interlace = head
            if depth != 8 or interlace or colour not in (0, 2, 3, 4, 6) or w * h > MOST_PIXELS:
                raise ValueError("unsupported PNG form")
            bpp = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
            bound = h * (w * bpp + 1)
        elif kind == b"IDAT":
            if head is None:
                raise ValueError("no IHDR")
            try:
                parts.append(inflate.decompress(body, max(1, bound + 1 - sum(map(len, parts)))))
            except zlib.error as e:
                raise ValueError("bad zlib stream") from e
    if head is None:
        raise ValueError("no IHDR")
    raw = b"".join(parts)
    if len(raw) != bound or not inflate.eof:
        raise ValueError("wrong number of samples")
    return _unfilter(np.frombuffer(raw, dtype=np.uint8).reshape(h, w * bpp + 1), bpp)


def dct_hash(img: np.ndarray) -> str:
    """16 hexadecimal digits: signs of the low frequencies against their median."""
    h, w = img.shape
    rows = np.add.reduceat(img, np.minimum(_K * h // 32, h - 1), axis=0, dtype=np.float64) if h >= 32 else img[_K * h // 32].astype(np.float64)
    if h >= 32:
        rows /= np.diff(np.append(_K * h // 32, h))[:, None]
    cols = np.add.reduceat(rows, _K * w // 32, axis=1) / np.diff(np.append(_K * w // 32, w)) if w >= 32 else rows[:, _K * w // 32]
    # Rounded so that the order of additions can't flip a bit.
    low = np.round(_DCT @ cols @ _DCT.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def encode(docs: DataFrame, column: str = "text", level: int = 1) -> DataFrame:
    """doc_id, n_bytes, media (binary) for each row of docs.

    Null and empty texts are 64 zero bytes. Equal texts have equal media.
    """
    schema = "doc_id long, n_bytes long, media binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offs = buffers(part.column(1))
                raw = data.tobytes()
                media = [encode_png(pad(raw[a:b]), level) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offs), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("text")).mapInArrow(run, schema)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def features(stored: DataFrame) -> DataFrame:
    """Read each `media` back and describe it; damaged media give null features and an `error`."""

    def one(media: bytes | None) -> tuple:
        if media is None:
            return None, None, None, None, None, None, "no media"
        own = len(media), hashlib.sha256(media).hexdigest()
        try:
            img = decode_png(media)
        except (ValueError, struct.error) as e:
            return None, None, None, *own, None, str(e)
        payload = img.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *own, dct_hash(img), None

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(2)
            rows = [one(x.as_py()) for x in col]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "n_bytes", *names])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)
