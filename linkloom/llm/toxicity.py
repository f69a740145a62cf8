"""Toxicity scores from a factorization machine over hashed terms.

Terms are the distinct words of a text and their prefixes, hashed. The terms
that labels depend on, alone or as a pair of frequent terms, become the inputs
of a second-order factorization machine: a linear weight for each, and a vector
whose inner products weigh every pair, so that two terms can mean together what
neither does alone. Terms without either sign are left out, as they only
let the machine learn its sample by heart.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkloom.llm.langid import is_training
from linkloom.llm.words import slices

BUCKETS = 1 << 20
#: Labelled rows learnt from, of each class at most; drawn by a hash of doc_id.
SAMPLE = 4000
#: Inputs at most that tell by themselves, and by pairs.
INPUTS, PAIR_INPUTS = 1024, 128
#: Most frequent terms whose pairs are looked at, the rows that must hold a term, and the least square of a pair's z.
PAIR_TERMS, PAIR_ROWS, PAIR_LEAST = 1024, 20, 40.0
FACTORS = 8
ROUNDS = 120
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
CACHE = 400_000
_LETTERS = re.compile(r"[^\W\d_]+")


def word_buckets(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its prefixes."""
    terms = [b"w" + word.encode("utf-8", "surrogatepass")] + [b"p" + word[:n].encode("utf-8", "surrogatepass") for n in PREFIXES if len(word) >= n]
    return tuple(zlib.crc32(t) % BUCKETS for t in terms)


def terms(text: str | None, cache: dict) -> set[int]:
    """Distinct buckets of a text."""
    out: set[int] = set()
    for w in set(_LETTERS.findall((text or "").lower())):
        got = cache.get(w)
        if got is None:
            got = cache[w] = word_buckets(w)
        out.update(got)
    return out


def choose_inputs(rows: list[np.ndarray], y: np.ndarray, most: int = INPUTS, least: float = 10.0) -> np.ndarray:
    """Buckets of the greatest likelihood-ratio statistic against the label, sorted."""
    if not rows or y.min() == y.max():
        return np.zeros(0, np.int64)
    flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    names, at = np.unique(flat, return_inverse=True)
    owner = np.repeat(y, sizes)
    pos = np.bincount(at, weights=owner, minlength=len(names))
    neg = np.bincount(at, weights=1 - owner, minlength=len(names))
    n1, n0 = y.sum(), len(y) - y.sum()

    def g(k, n, rest_k, rest_n):
        p = (k + rest_k) / (n + rest_n)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / (n * p)), 0.0) + np.where(n > k, (n - k) * np.log((n - k) / (n * (1 - p))), 0.0)

    stat = 2 * (g(pos, n1, neg, n0) + g(neg, n0, pos, n1))
    stat = np.nan_to_num(stat)
    order = np.lexsort((names, -stat))[:most]
    return np.sort(names[order[stat[order] >= least]])


def choose_pairs(rows: list[np.ndarray], y: np.ndarray, most: int = PAIR_INPUTS, least: float = PAIR_LEAST) -> np.ndarray:
    """Buckets of the frequent terms whose product with another depends most on the label, sorted."""
    if not rows or y.min() == y.max():
        return np.zeros(0, np.int64)
    names, times = np.unique(np.concatenate(rows), return_counts=True)
    # A term that nearly all rows hold says as little as one that nearly none does.
    spread = np.minimum(times, len(rows) - times)
    order = np.lexsort((names, -spread))[:PAIR_TERMS]
    names = np.sort(names[order[spread[order] >= PAIR_ROWS]])
    if len(names) < 2:
        return np.zeros(0, np.int64)
    x = np.zeros((len(rows), len(names)), dtype=np.float32)
    for k, r in enumerate(rows):
        x[k, np.searchsorted(names, r[np.isin(r, names, assume_unique=True)])] = 1.0
    x -= x.mean(axis=0)
    e = (y - y.mean()).astype(np.float32)
    top = x.T @ (x * e[:, None])
    together = x.T @ x
    own = np.sqrt(np.maximum(np.diag(together), 1e-6))
    together = np.abs(together) / np.outer(own, own)
    np.multiply(x, x, out=x)
    low = x.T @ x
    # Terms that nearly always come together, such as a word and its prefix, are one term.
    z2 = np.triu(np.where(together > 0.7, 0.0, top**2 / (np.maximum(low, 1e-6) * float((e * e).mean()))), 1)
    out: list[int] = []
    for k in np.argsort(-z2, axis=None, kind="stable")[: most * 4]:
        i, j = divmod(int(k), len(names))
        if z2[i, j] < least or len(out) >= most:
            break
        out += [v for v in (int(names[i]), int(names[j])) if v not in out]
    return np.sort(np.array(out, dtype=np.int64))


def fit(x: np.ndarray, y: np.ndarray, factors: int = FACTORS, rounds: int = ROUNDS, l2: float = 1e-4) -> dict:
    """Weights by Adam on the logistic loss over all rows; the same in every run.

    x: rows by inputs, 0 or 1. Classes count alike, whatever their numbers.
    """
    rng = np.random.default_rng(7)
    n, d = x.shape
    params = [np.zeros(1), np.zeros(d), rng.normal(0, 0.02, (d, factors))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    for t in range(1, rounds + 1):
        b, w, v = params
        xv = x @ v
        z = b + x @ w + 0.5 * ((xv * xv).sum(1) - x @ (v * v).sum(1))
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        xe = x.T @ e
        grads = [np.array([e.sum()]), xe + l2 * w, x.T @ (e[:, None] * xv) - xe[:, None] * v + l2 * v]
        for k, grad in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            params[k] = params[k] - 0.05 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-9)
    return {"bias": float(params[0][0]), "linear": params[1], "factors": params[2]}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from labelled rows that may be learnt from; `sample` rows of each class at most.

    Null labels are left out. With one class only, or no row, every score is
    that class's smoothed share (0.5 without rows).
    """
    spark = docs.sparkSession
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("y in (0, 1)").where(is_training("doc_id")).dropDuplicates(["doc_id"])
    order = [F.xxhash64(F.col("doc_id"), F.lit(11)), F.col("doc_id")]
    # At most 2 * sample narrow rows: small enough to broadcast.
    drawn = rows.where("y = 1").orderBy(*order).limit(sample).union(rows.where("y = 0").orderBy(*order).limit(sample))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for part in slices(batch, "text"):
                packed = [np.sort(np.fromiter(terms(t, cache), np.int32)).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(packed, pa.binary())], ["doc_id", "y", "terms"])

    got = sorted(picked.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, terms binary").collect())
    y = np.array([r["y"] for r in got], dtype=np.float64)
    xs = [np.frombuffer(r["terms"], dtype=np.int32).astype(np.int64) for r in got]
    return learn(xs, y)


def learn(rows: list[np.ndarray], y: np.ndarray) -> dict:
    """A model from the sorted distinct buckets of each row and its label, 0 or 1."""
    inputs = np.union1d(choose_inputs(rows, y), choose_pairs(rows, y)) if len(y) else np.zeros(0, np.int64)
    if not len(inputs):
        share = (y.sum() + 1) / (len(y) + 2)
        return {"inputs": inputs, "bias": float(np.log(share / (1 - share))), "linear": np.zeros(0), "factors": np.zeros((0, FACTORS))}
    x = np.zeros((len(rows), len(inputs)), dtype=np.float32)
    for k, r in enumerate(rows):
        x[k, np.searchsorted(inputs, r[np.isin(r, inputs, assume_unique=True)])] = 1.0
    return {"inputs": inputs} | fit(x, y.astype(np.float32))


class Scorer:
    def __init__(self, model: dict):
        self.at = {int(b): k for k, b in enumerate(model["inputs"])}
        self.bias, self.linear, self.v = model["bias"], model["linear"], model["factors"]
        self.seen: set[str] = set()
        self.hot: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        """Probability of label 1; texts without known terms get the bias alone."""
        words = set(_LETTERS.findall((text or "").lower()))
        if len(self.seen) > CACHE:
            self.seen, self.hot = set(), {}
        fresh = words - self.seen
        for w in fresh:
            if got := tuple(self.at[b] for b in word_buckets(w) if b in self.at):
                self.hot[w] = got
        self.seen |= fresh
        active = {k for w in words & self.hot.keys() for k in self.hot[w]}
        z = self.bias
        if active:
            idx = np.fromiter(sorted(active), np.int64, len(active))
            v = self.v[idx]
            s = v.sum(axis=0)
            z += self.linear[idx].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


SCORED = "doc_id long, score double, predicted int"


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD, column: str = "text") -> DataFrame:
    """doc_id, score, predicted for each row of docs; only the text is looked at.

    Null and empty texts, and those without known terms, get the bias alone;
    very long texts are scored whole. Repeated rows give equal rows, null ids
    stay. An empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                got = [scorer.score(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.float64()), pa.array([int(g >= threshold) for g in got], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("text")).mapInArrow(run, SCORED)
