"""Vectorised word and shingle hashing over Arrow text columns.

Words are runs of bytes other than space and tab to carriage return; A-Z count
as a-z. Hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SEGMENT = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 rounds)."""
    x = np.asarray(x, dtype=U).copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(salt)) | U(1)


_BYTES = mix(np.arange(256, dtype=U) + U(0xA5A5))
_BYTES[65:91] = _BYTES[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _SEGMENT + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            p = np.empty(size, dtype=U)
            p[0] = 1
            done = 1
            while done < size:
                take = min(done, size - done)
                p[done : done + take] = p[:take] * U(pow(b, done, 1 << 64))
                done += take
            out.append(p)
        _powers[:] = out
    return _powers[0], _powers[1]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _cuts(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about _SEGMENT bytes that begin and end between words."""
    at, end = 0, int(offs[-1])
    while at < end:
        stop = min(end, at + _SEGMENT)
        if stop < end:
            k = int(offs[np.searchsorted(offs, stop, "right") - 1])
            if k > at:
                stop = k
            else:
                white = np.flatnonzero(_WHITE[data[at:stop]])
                if len(white):
                    stop = at + int(white[-1]) + 1
                else:
                    limit = int(offs[np.searchsorted(offs, at, "right")])
                    while stop < limit and not _WHITE[data[stop]]:
                        stop += 1
        yield at, stop
        at = stop


def hash_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and offsets (n + 1) of each text's words."""
    hashes, firsts = [], []
    for lo, hi in _cuts(data, offs):
        part = data[lo:hi]
        black = ~_WHITE[part]
        before = np.empty(len(part), dtype=bool)
        before[0] = True
        before[1:] = ~black[:-1]
        after = np.empty(len(part), dtype=bool)
        after[-1] = True
        after[:-1] = ~black[1:]
        edges = offs[np.searchsorted(offs, lo, "left") : np.searchsorted(offs, hi, "left")] - lo
        before[edges] = True
        after[edges[edges > 0] - 1] = True
        s, e = np.flatnonzero(black & before), np.flatnonzero(black & after) + 1
        up, down = _power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=U)
        np.cumsum(_BYTES[part] * up[: len(part)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(U)))
        firsts.append(s + lo)
    words = np.concatenate(hashes) if hashes else np.zeros(0, U)
    at = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    return words, np.searchsorted(at, offs, "left")


def shingles(words: np.ndarray, woffs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles in order, and their offsets by text.

    A text of 1 to n - 1 words has one shingle: its whole sequence.
    """
    count = np.diff(woffs)
    out = np.zeros(len(words), dtype=U)
    mult = seeds(n, 77)
    m = len(words) - n + 1
    if m > 0:
        acc = words[:m] * mult[0]
        for j in range(1, n):
            acc = (acc ^ (acc >> U(29))) + words[j : j + m] * mult[j]
        out[:m] = mix(acc)
    each = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    for d in np.flatnonzero((count > 0) & (count < n)):
        w = words[woffs[d] : woffs[d + 1]]
        out[woffs[d]] = mix(np.array([np.bitwise_xor.reduce(mix(w * mult[: len(w)])) + U(len(w))], dtype=U))[0]
    soffs = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(each, out=soffs[1:])
    index = np.arange(soffs[-1]) - np.repeat(soffs[:-1], each) + np.repeat(woffs[:-1], each)
    return out[index], soffs


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy parts of a batch that hold about `most` bytes of one text column."""
    _, offs = buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        stop = min(stop, batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop
