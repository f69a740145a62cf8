"""Vectors: means, centring, cosines, exact top neighbours by blocked matrix products."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

#: Vectors of a product's two sides; pairs that are worked on at once.
STRIP, BLOCK, STEP = 512, 1024, 1 << 16
#: Vectors of a tile's side: it isn't divided below the first, and never holds more than about the second.
LEAST_SIDE, MOST_SIDE = 256, 1 << 18


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def mean_vector(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, mean: element-wise means, missing places not counted. Sums are decimal, so order doesn't matter."""
    places = df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg((F.sum(F.col("x").cast("decimal(28,18)")).cast("double") / F.count("x")).alias("m"))
    return places.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))


def centred(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """The vectors minus their mean, which is one row and broadcast."""
    mean = mean_vector(vectors, [], vector)
    return vectors.crossJoin(F.broadcast(mean)).withColumn(vector, F.zip_with(F.col(vector), F.col("mean"), lambda a, m: a - m)).drop("mean")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Over the common length; 0 if a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)


def score(cos: Column) -> Column:
    """0 to 100 with two places."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (cos + 1) / 2 * 100)), 2)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors as rows of length one, zero ones as they are; all must have as many places."""
    places = set(vectors.value_lengths().to_pylist())
    if len(places) > 1:
        raise ValueError("vectors differ in their number of places")
    m = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(vectors), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1.0)


def _cents(sim: np.ndarray) -> np.ndarray:
    """Hundredths, rounded as SQL rounds: what is written as a half goes up."""
    shifted = sim * 100 + 0.5
    out = np.floor(shifted)
    for k in np.flatnonzero(np.abs(shifted - np.rint(shifted)) < 1e-6):
        out[k] = float(Decimal(repr(float(sim[k]))).quantize(Decimal("0.01"), ROUND_HALF_UP) * 100)
    return out


def _true(flags: np.ndarray, n: int) -> np.ndarray:
    """Where the first n flags are true; eight are looked at together, as few are."""
    flags[n : -(-n // 8) * 8] = False
    words = np.flatnonzero(flags[: -(-n // 8) * 8].view(np.uint64))
    at, bit = np.nonzero(flags.reshape(-1, 8)[words])
    return words[at] * 8 + bit


class _Tile:
    """One side of a tile, which the other streams past in order of ids.

    Single precision finds the pairs that may count, double precision scores
    them. Of each row the best k are held, by hundredths, then by the other's id.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, least: float, k: int | None):
        self.ids, self.m, self.least, self.k = ids, m, least, k
        self.small, self.slack = m.astype(np.float32), 1e-5 + 2e-7 * m.shape[1]
        self.bar, self.first = np.full(len(ids), self._cosine(least * 100)), True
        self.held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def _cosine(self, cents):
        """The least cosine, with some room, that makes so many hundredths."""
        return (cents - 0.5) / 5000 - 1 - self.slack

    def meet(self, ids: np.ndarray, m: np.ndarray) -> None:
        rows, cols, small, bar = [], [], np.ascontiguousarray(m.T, dtype=np.float32), self.bar.astype(np.float32)
        room, flags = np.empty(STRIP * BLOCK, np.float32), np.empty(STRIP * BLOCK, bool)
        for b in range(0, len(ids), BLOCK):
            some = np.ascontiguousarray(small[:, b : b + BLOCK])
            for a in range(0, len(self.ids), STRIP):
                part = self.small[a : a + STRIP]
                n = len(part) * some.shape[1]
                # The same memory for every product, so that it stays in the cache.
                x = np.matmul(part, some, out=room[:n].reshape(len(part), -1))
                if self.first and b == 0 and self.k is not None and x.shape[1] > self.k + 1:
                    # One more than k, as a row may meet itself.
                    top = np.partition(x, -self.k - 1, axis=1)[:, -self.k - 1]
                    bar[a : a + STRIP] = np.fmax(bar[a : a + STRIP], top - 2.1e-4 - 2 * self.slack)
                np.greater_equal(x, bar[a : a + STRIP, None], out=flags[:n].reshape(x.shape))
                i, j = np.divmod(_true(flags, n), x.shape[1])
                rows.append(i + a)
                cols.append(j + b)
        self.first = False
        i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, cols))
        keep = self.ids[i] != ids[j]
        i, j = i[keep], j[keep]
        cos = [np.einsum("ij,ij->i", self.m[i[c : c + STEP]], m[j[c : c + STEP]]) for c in range(0, len(i), STEP)]
        sim = np.clip((np.concatenate([np.empty(0), *cos]) + 1) / 2 * 100, 0, 100)
        i, t, sim = (np.concatenate(x) for x in zip(self.held, (i, ids[j], sim), strict=True))
        cents = _cents(sim)
        order = np.lexsort((t, -cents, i))
        order = order[cents[order] >= self.least * 100]
        i, t, sim, cents = i[order], t[order], sim[order], cents[order]
        if self.k is not None:
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            last = rank == self.k - 1
            # Ids to come are greater and lose ties.
            self.bar[i[last]] = self._cosine(cents[last] + 1)
            i, t, sim = (x[rank < self.k] for x in (i, t, sim))
        self.held = i, t, sim

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        i, t, sim = self.held
        for c in range(0, len(i), STEP):
            yield self.ids[i[c : c + STEP]], t[c : c + STEP], sim[c : c + STEP]
        self.held = i[:0], t[:0], sim[:0]


def _tiles(least: float, k: int | None):
    """Rows tile, streams, id, vector, in this order: what doesn't stream is held first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, tile = None, [], None

        def ended() -> Iterator[pa.RecordBatch]:
            for s, t, sim in tile.found() if tile else ():
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(t, pa.int64()), pa.array(sim, pa.float64())], ["s", "t", "sim"])

        for batch in batches:
            tiles, streams = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            ids, m = batch.column(2).to_numpy(zero_copy_only=False), _matrix(batch.column(3))
            cuts = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(streams.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if lo == hi:
                    continue
                if tiles[lo] != at:
                    yield from ended()
                    at, waiting, tile = tiles[lo], [], None
                if not streams[lo]:
                    waiting.append((ids[lo:hi], m[lo:hi]))
                elif waiting or tile:
                    if tile is None:
                        tile, waiting = _Tile(np.concatenate([x for x, _ in waiting]), np.concatenate([x for _, x in waiting]), least, k), []
                    tile.meet(ids[lo:hi], m[lo:hi])
                    if k is None:
                        yield from ended()
        yield from ended()

    return run


def sides(spark: SparkSession, n: int) -> int:
    """Parts of n vectors as a side of tiles: some tiles for each core, and no more parts with more vectors until tiles would be too large."""
    return max(1, min(-(-n // LEAST_SIDE), max(math.isqrt(12 * spark.sparkContext.defaultParallelism), -(-n // MOST_SIDE))))


def neighbours(sources: DataFrame, targets: DataFrame, least: float, k: int | None, blocks: tuple[int, int] | None = None, by: str = "s") -> DataFrame:
    """s, t, sim: all pairs of score `least` and above, the best k of each `by` if k is given.

    sources, targets: id, vector. Exact: each part of the rows of one side meets
    each part of the other's, so every row moves once for a part of the other
    side. A task holds one part while the other streams past it, and gives out
    the best k of its rows.
    """
    if blocks is None:
        blocks = tuple(sides(sources.sparkSession, df.count()) for df in (sources, targets))
    (one, ones), (two, twos) = ((sources, blocks[0]), (targets, blocks[1])) if by == "s" else ((targets, blocks[1]), (sources, blocks[0]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("p")
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    held = one.select("id", "vector", every(twos)).select((own(ones) * twos + F.col("p")).alias("tile"), F.lit(False).alias("streams"), "id", "vector")
    stream = two.select("id", "vector", every(ones)).select((F.col("p") * twos + own(twos)).alias("tile"), F.lit(True).alias("streams"), "id", "vector")
    tiles = held.unionByName(stream).repartitionById(ones * twos, "tile").sortWithinPartitions("tile", "streams", "id")
    found = tiles.mapInArrow(_tiles(least, k), "s long, t long, sim double")
    if by == "t":
        found = found.select(F.col("t").alias("s"), F.col("s").alias("t"), "sim")
    found = found.withColumn("sim", F.round("sim", 2)).where(F.col("sim") >= least)
    if k is None:
        return found
    other = "t" if by == "s" else "s"
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("sim"), other))
    return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def places_of(tokens: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The place and the sign of each token, by its MD5."""
    coded = tokens.dictionary_encode()
    h = np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big") for t in coded.dictionary.to_pylist()], dtype=np.int64)
    k = coded.indices.to_numpy(zero_copy_only=False)
    return (h % dims)[k] if len(h) else h, np.where(h // dims % 2 == 0, 1, -1)[k] if len(h) else h


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).reshape(-1)))


def hashed_embedding(df: DataFrame, keys: list[str], tokens: str, dims: int = 64) -> DataFrame:
    """keys, vector: signed feature hashing of tokens (array column), length one, for use without a model. Rows without tokens go; a key has one row."""
    rows = df.select(*keys, F.col(tokens).alias("tok")).where(F.size("tok") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tok = batch.column(len(keys))
            place, sign = places_of(tok.flatten(), dims)
            row = np.repeat(np.arange(len(tok)), tok.value_lengths().to_numpy(zero_copy_only=False))
            raw = np.bincount(row * dims + place, weights=sign, minlength=len(tok) * dims).reshape(-1, dims)
            norm = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], _lists(raw / np.where(norm > 0, norm, 1.0))], [*keys, "vector"])

    return rows.mapInArrow(run, StructType([*rows.select(*keys).schema, StructField("vector", ArrayType(DoubleType()))]))


#: Sums of vectors of length one are whole numbers of this share, so that their order doesn't matter; so many fit into eight bytes.
_SHARE, _RUN = 2.0**50, 4096


def mean_of(df: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """key, vector: means of vectors of length one or less. Neighbouring rows of a key are summed before they move."""
    kind = df.schema[key].dataType

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, m = batch.column(0), np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            same = pc.fill_null(pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)), False).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], ~same]) | (np.arange(len(ids)) % _RUN == 0))
            whole = np.add.reduceat(np.rint(m * _SHARE).astype(np.int64), starts, axis=0)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(starts)), pa.array(np.diff([*starts, len(ids)])), _lists(whole)], [key, "n", "sums"])

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(1)
            starts = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
            n, whole = parts.flatten().field("n").to_numpy(), parts.flatten().field("sums")
            whole = np.asarray(whole.flatten()).reshape(len(n), -1)
            high, low = np.add.reduceat(whole >> 25, starts, axis=0), np.add.reduceat(whole & (1 << 25) - 1, starts, axis=0)
            m = (high * 2.0**25 + low) / _SHARE / np.add.reduceat(n, starts)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(m)], [key, "vector"])

    parts = df.select(key, vector).mapInArrow(sums, StructType([StructField(key, kind), StructField("n", LongType()), StructField("sums", ArrayType(LongType()))]))
    whole = parts.groupBy(key).agg(F.collect_list(F.struct("n", "sums")).alias("parts"))
    return whole.mapInArrow(means, StructType([StructField(key, kind), StructField("vector", ArrayType(DoubleType()))]))


def best_of(rows: DataFrame) -> DataFrame:
    """s, t, idx, score: of the vectors of s the one nearest to that of t, the first on a tie; null without vectors.

    rows: s, t, own (array of idx and vector), vector, mean; both sides are centred by the mean.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t, own, vector, mean = batch.columns
            full = np.flatnonzero(pc.and_(pc.is_valid(vector), pc.greater(pc.fill_null(pc.list_value_length(own), 0), 0)).to_numpy(zero_copy_only=False))
            idx, best = np.zeros(len(s), np.int32), np.full(len(s), -1.0)
            if len(full):
                own, pick = own.take(pa.array(full)), pa.array(full)
                n = own.value_lengths().to_numpy(zero_copy_only=False)
                flat = own.flatten()
                middle = np.asarray(mean[0].values, dtype=np.float64)
                a = np.asarray(flat.field("vector").flatten(), dtype=np.float64).reshape(len(flat), -1) - middle
                b = np.asarray(vector.take(pick).flatten(), dtype=np.float64).reshape(len(full), -1) - middle
                row = np.repeat(np.arange(len(full)), n)
                norm = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)[row]
                dots = np.einsum("ij,ij->i", a, b[row])
                cents = _cents(np.clip((np.where(norm > 0, dots / np.where(norm > 0, norm, 1.0), 0.0) + 1) / 2 * 100, 0, 100))
                place = np.asarray(flat.field("idx"))
                order = np.lexsort((place, -cents, row))
                first = order[np.concatenate([[0], np.cumsum(n)[:-1]])]
                idx[full], best[full] = place[first], cents[first] / 100
            none = best < 0
            yield pa.RecordBatch.from_arrays([s, t, pa.array(idx, mask=none), pa.array(best, mask=none)], ["s", "t", "idx", "score"])

    return rows.select("s", "t", "own", "vector", "mean").mapInArrow(run, "s long, t long, idx int, score double")
