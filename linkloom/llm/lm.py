"""Stupid-backoff scores of all documents against counts of the whole corpus.

Every document is scored by what the other documents hold: its own occurrences
are taken off the counts, so that an n-gram seen once is one that no other
document has. Documents are dealt into chunks by a hash. A chunk explodes its
texts into n-grams of all orders and asks for the counts of the distinct ones;
the requests, packed by hash range, meet in the count tables' partitions, where
they are added up and answered. The answers are joined to the n-grams of the
chunk and summed by document. What moves is one entry for each distinct n-gram
of a chunk, so frequent n-grams are counted before the shuffle; a row for each
n-gram of each document would be several times the disk limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from linkloom.llm.mixing import word_count
from linkloom.llm.words import U, buffers, hash_words, mix

CHUNK_DOCS = 2048
#: Words of a chunk, about: long documents make smaller chunks.
CHUNK_WORDS = 600_000
ALPHA = 0.4
ORDER = 3
#: Bits of an n-gram's key: among 10 billion n-grams, one in 7 million shares its key with another.
KEY_BITS = 56


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys as differences of the least width, which comes first."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=U(0))
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, U)
    width = packed[0]
    raw = np.frombuffer(packed, dtype=np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, :width] = raw
    return np.cumsum(wide.view("<u8").ravel().astype(U))


def squeeze(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct keys and their counts, byte place by byte place, compressed: high bytes and counts are mostly alike."""
    steps = np.diff(keys, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    width = next(w for w in range(8, 0, -1) if w == 1 or steps[:, w - 1].any())
    wide = 4 if int(counts.max()) >= 1 << 16 else 2 if int(counts.max()) >= 1 << 8 else 1
    planes = steps[:, :width].T.tobytes() + counts.astype(f"<u{wide}").tobytes()
    return bytes([width, wide]) + len(keys).to_bytes(4, "little") + zstandard.compress(planes, 1)


def unsqueeze(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, wide, n = packed[0], packed[1], int.from_bytes(packed[2:6], "little")
    raw = zstandard.decompress(packed[6:])
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, :width] = np.frombuffer(raw, np.uint8, width * n).reshape(width, n).T
    return np.cumsum(steps.view("<u8").ravel().astype(U)), np.frombuffer(raw, f"<u{wide}", n, width * n).astype(np.int64)


def squeeze_counts(counts: np.ndarray) -> bytes:
    wide = next(w for w in (1, 2, 4, 8) if not len(counts) or int(counts.max()) < 1 << (8 * w))
    return bytes([wide]) + zstandard.compress(counts.astype(f"<u{wide}").tobytes(), 1)


def unsqueeze_counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed[1:]), dtype=f"<u{packed[0]}").astype(np.int64)


class Grams:
    """The n-grams of some texts, order by order, with their places in the sorted distinct keys."""

    def __init__(self, texts: pa.Array, order: int):
        words, self.offs = hash_words(*buffers(texts))
        self.n = len(words)
        self.doc = np.repeat(np.arange(len(self.offs) - 1), np.diff(self.offs))
        place = np.arange(self.n) - self.offs[self.doc] if self.n else np.zeros(0, np.int64)
        #: For each order, the places of the words that end an n-gram.
        self.ends = [np.flatnonzero(place >= k) for k in range(order)]
        keys, h = [], words
        for k in range(order):
            # h[i] stands for the k + 1 words that end at i.
            h = h if k == 0 else mix(np.concatenate([h[:1], h[:-1]]) * U(0x9E3779B97F4A7C15) + words + U(k)) if self.n else h
            keys.append(mix(h + U(k + 1))[self.ends[k]] >> U(64 - KEY_BITS))
        self.sizes = [len(x) for x in keys]
        self.keys, self.at, self.counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)

    def own(self) -> np.ndarray:
        """For each n-gram, how often its document holds it."""
        doc = np.concatenate([self.doc[e] for e in self.ends])
        _, where, times = np.unique(doc * max(1, len(self.keys)) + self.at, return_inverse=True, return_counts=True)
        return times[where]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U(KEY_BITS - 32)) * U(buckets) >> U(32)).astype(np.int64)


def _requests(buckets: int, order: int):
    def run(table: pa.Table) -> pa.Table:
        g = Grams(_texts(table), order)
        of = _bucket(g.keys, buckets)
        edges = np.flatnonzero(np.diff(of, prepend=-1))
        stops = np.append(edges[1:], len(of)) if len(edges) else edges
        rows = [(int(of[a]), squeeze(g.keys[a:b], g.counts[a:b])) for a, b in zip(edges.tolist(), stops.tolist(), strict=True)]
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"chunk": pa.array([chunk] * len(rows), pa.int64()), "bucket": pa.array([r[0] for r in rows], pa.int64()), "keys": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _answers(table: pa.Table) -> pa.Table:
    asked = [unsqueeze(x) for x in table.column("keys").to_pylist()]
    every, at = np.unique(np.concatenate([k for k, _ in asked]), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([c for _, c in asked]), minlength=len(every)).astype(np.int64)
    sizes = np.cumsum([len(k) for k, _ in asked])[:-1]
    packed = [squeeze_counts(x) for x in np.split(total[at], sizes)]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "counts": pa.array(packed, pa.binary())})


SCORED = "doc_id long, n_words long, n_backoff long, logprob double"


def _scores(n_total: int, alpha: float, order: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_backoff": pa.array([], pa.int64()), "logprob": pa.array([], pa.float64())})
        g = Grams(_texts(texts), order)
        parts = sorted(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist(), strict=True))
        total = np.concatenate([unsqueeze_counts(c) for _, c in parts]) if parts else np.zeros(0, np.int64)
        if len(total) != len(g.keys):
            raise RuntimeError("the answers don't match the chunk's n-grams")
        every, edges = total[g.at], np.cumsum([0, *g.sizes])
        others = every - g.own()
        # The last resort counts the document too, so that no word has probability 0.
        score, steps = np.log(every[: g.n]) - np.log(max(1, n_total)), np.zeros(g.n, dtype=np.int64)
        seen = others[: g.n]
        for k in range(1, order):
            end = g.ends[k]
            count = np.zeros(g.n, dtype=np.int64)
            count[end] = others[edges[k] : edges[k + 1]]
            found = count[end] > 0
            hit, miss = end[found], end[~found]
            score[miss] += np.log(alpha)
            steps[miss] += 1
            # The context ends one word before.
            score[hit] = np.log(count[hit]) - np.log(seen[hit - 1])
            steps[hit] = 0
            seen = count
        n_words = np.diff(g.offs)
        sums = np.bincount(g.doc, weights=score, minlength=len(n_words)).astype(np.float64)
        fell = np.bincount(g.doc, weights=steps > 0, minlength=len(n_words)).astype(np.int64)
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(n_words), "n_backoff": pa.array(fell), "logprob": pa.array(sums)})

    return run


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [zstandard.compress(t.encode("utf-8", "surrogatepass"), 3) if t else b"" for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["chunk", "doc_id", "packed"])


def _texts(table: pa.Table) -> pa.Array:
    raw = [zstandard.decompress(x) if x else b"" for x in table.column("packed").to_pylist()]
    return pa.array(raw, pa.large_binary()).cast(pa.large_string(), safe=False)


def score(docs: DataFrame, alpha: float = ALPHA, order: int = ORDER, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """doc_id, n_words, n_backoff, logprob, score for each row of docs.

    A word scores c(n-gram) / c(its context) by the longest n-gram, up to
    `order` words, that another document holds too, times `alpha` for each order
    that it had to leave out; without one, alpha^k c(w) / N over the whole
    corpus. n_backoff counts the words that had to leave out an order that the
    text has room for. `logprob` is the sum of natural logarithms, `score` its
    mean by word. Texts that are null or have no words have 0 words, logprob 0
    and a null score. Repeated rows are documents of their own. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_rows, n_total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(word_count(F.col("text"))), F.lit(0))).first()
    chunks = max(1, -(-n_rows // chunk_docs), -(-n_total // CHUNK_WORDS))
    keyed = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), "doc_id", "text")
    texts = keyed.mapInArrow(_squeezed, "chunk long, doc_id long, packed binary")
    requests = texts.groupBy("chunk").applyInArrow(_requests(chunks, order), "chunk long, bucket long, keys binary")
    answers = requests.groupBy("bucket").applyInArrow(_answers, "chunk long, bucket long, counts binary")
    scored = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scores(n_total, alpha, order), SCORED)
    return scored.withColumn("score", F.when(F.col("n_words") > 0, F.col("logprob") / F.col("n_words")))
