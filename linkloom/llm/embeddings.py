"""Embedding near-duplicates through a pivot-permutation index.

Reference points (pivots) are spread over a bounded sample of the vectors. A
vector is described by its nearest pivots in order, and stands in the inverted
lists of these pivots. Members of a list that share two pivots or more are
verified by matrix products in double precision, tile by tile; a pair counts
only in the list of the first pivot it shares, so that nothing is counted twice
and no pairs are shuffled. Where lists would grow long, they are parted by the
second shared pivot. Vectors of rare lengths form a list for each length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from linkloom.operators.components import components
from linkloom.session import Workspace

PREFIX = 7
#: Members that share a tile; lists are made about as long, and longer ones cut.
TILE = 512
#: Vectors of one length from which on they get pivots of their own; fewer are compared in tiles directly.
FEW = 4096
MOST_PIVOTS = 16_384
SAMPLE_PER_PIVOT = 4

Batches = Iterator[pa.RecordBatch]


def units(vectors: DataFrame) -> DataFrame:
    """vec_id, key, raw (binary), width: components as they come, 4 bytes each for array<float>, else 8.

    key is a digest of the vector of length one in double precision. Null, empty
    and zero vectors and those with null or non-finite components have null key
    and raw.
    """
    kind = vectors.schema["embedding"].dataType.elementType
    narrow = isinstance(kind, FloatType)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            col = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            offs = np.concatenate([[0], np.cumsum(sizes)])
            flat = pc.list_flatten(col)
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            # Nulls among the components become NaN.
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            good = (sizes > 0) & (bad[offs[1:]] == bad[offs[:-1]])
            keys, raws = [None] * len(sizes), [None] * len(sizes)
            for k in np.flatnonzero(good).tolist():
                v = x[offs[k] : offs[k + 1]]
                if (top := np.abs(v).max()) > 0:
                    keys[k] = hashlib.blake2b(_unit(v / top).tobytes(), digest_size=16).hexdigest()
                    raws[k] = (v.astype(np.float32) if narrow else v).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(raws, pa.binary())], ["vec_id", "key", "raw"])

    typed = F.col("embedding") if narrow else F.col("embedding").cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), typed.alias("embedding")).mapInArrow(run, "vec_id long, key string, raw binary").withColumn("width", (F.length("raw") / (4 if narrow else 8)).cast("int"))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum()) + 0.0


def _matrix(raws: list[bytes], width: int) -> np.ndarray:
    """Rows of length one in double precision."""
    data = b"".join(raws)
    x = np.frombuffer(data, dtype=np.float32 if len(data) == 4 * width * len(raws) else np.float64).reshape(-1, width).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Greedy farthest points of the sample, from its first row on."""
    if not len(sample):
        return sample
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        k = int(near.argmin())
        chosen.append(k)
        near = np.maximum(near, sample @ sample[k])
    return sample[chosen]


def prefixes(unit: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Indices of the nearest pivots in order, nearest first."""
    length = min(length, len(pivots))
    out = np.empty((len(unit), length), dtype=np.int64)
    for at in range(0, len(unit), 1024):
        dot = unit[at : at + 1024] @ pivots.T
        part = np.argpartition(-dot, length - 1, axis=1)[:, :length]
        order = np.argsort(-np.take_along_axis(dot, part, 1), axis=1, kind="stable")
        out[at : at + 1024] = np.take_along_axis(part, order, 1)
    return out


def _lists(pivots: np.ndarray, prefix: int, parts: int):
    """Rows (list, class_id, copies, near) for the inverted lists of each vector.

    A list belongs to a pivot and a part of the other pivots; the first two
    pivots that a pair shares name the one list where it counts.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column(2).to_pylist(), pivots.shape[1])
            near = np.sort(prefixes(unit, pivots, prefix), axis=1)
            described = near.astype(np.int32)
            if near.shape[1] > 1:
                keys = np.sort(np.stack([near[:, a] * parts + near[:, b] % parts for a, b in combinations(range(near.shape[1]), 2)], 1), axis=1)
                fresh = np.ones(keys.shape, dtype=bool)
                fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
                who, at = np.nonzero(fresh)
                keys = keys[who, at]
            else:
                keys, who = near.ravel(), np.arange(len(near))
            take = pa.array(who)
            near_of = pa.array([r.tobytes() for r in described], pa.binary()).take(take)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(take), batch.column(1).take(take), near_of], ["list", "class_id", "copies", "near"])

    return run


def _first_shared(p: np.ndarray, q: np.ndarray, parts: int) -> np.ndarray:
    """The list where pairs of sorted pivot sets count, row by row; -1 with fewer than two shared pivots."""
    common = (p[:, :, None] == q[:, None, :]).any(axis=2)
    count = common.sum(axis=1)
    first = common.argmax(axis=1)
    rows = np.arange(len(p))
    common[rows, first] = False
    second = common.argmax(axis=1)
    return np.where(count > 1, p[rows, first] * parts + p[rows, second] % parts, -1)


def _links(least: float, parts: int):
    """Links of one tile row: blocks `mine` against `theirs`, both lists of structs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            links: list[pd.DataFrame] = []
            for row in pdf.itertuples(index=False):
                same = row.x == row.y
                a, b = row.mine, row.mine if same else row.theirs
                ids = [np.array([s["class_id"] for s in side], dtype=np.int64) for side in (a, b)]
                copies = [np.array([s["copies"] for s in side], dtype=np.int64) for side in (a, b)]
                near = [np.frombuffer(b"".join(s["near"] for s in side), dtype=np.int32).reshape(len(side), -1).astype(np.int64) for side in (a, b)]
                unit = [_matrix([s["raw"] for s in side], row.width) for side in (a, b)]
                cos = unit[0] @ unit[1].T
                if same:
                    cos[np.tril_indices(len(cos))] = -2.0
                i, j = np.nonzero(cos >= least)
                if near[0].shape[1] > 1 and len(i):
                    keep = np.concatenate([_first_shared(near[0][i[k : k + 65536]], near[1][j[k : k + 65536]], parts) for k in range(0, len(i), 65536)]) == row.list
                    i, j = i[keep], j[keep]
                if len(i):
                    links.append(_summary(ids, copies, i, j))
            if links:
                yield pd.concat(links).groupby(["node", "root"], as_index=False)["links"].sum()

    return run


def _summary(ids, copies, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """Linked copies of each end, and the smallest end of its component in the tile."""
    node = np.concatenate([ids[0][i], ids[1][j]])
    other = np.concatenate([ids[1][j], ids[0][i]])
    gain = np.concatenate([copies[1][j], copies[0][i]])
    names, at = np.unique(node, return_inverse=True)
    to = np.searchsorted(names, other)
    root = np.arange(len(names))
    while True:
        new = root.copy()
        np.minimum.at(new, at, root[to])
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    return pd.DataFrame({"node": names, "root": names[root], "links": np.bincount(at, weights=gain, minlength=len(names)).astype(np.int64)})


def near_duplicates(vectors: DataFrame, least: float = 0.95, prefix: int = PREFIX, ws: Workspace | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding).

    Cosines are taken in double precision and compared with `least`. Vectors
    that are null, empty, zero or hold null or non-finite components, and rows
    without vec_id, link with nothing (n_links 0, component_id their vec_id,
    kept). Repeated rows count as links of one another. Vectors of different
    lengths have no cosine. Ties among pivots go to the earlier one. An empty
    table gives an empty result; other columns are ignored. The number of pivots
    follows the number of vectors, so that lists stay small; lists of near
    copies are split into tiles, never into one task.
    """
    spark = vectors.sparkSession
    ws = ws or Workspace(spark, "embed")
    all_units = ws.cut(units(vectors))
    classes = all_units.where("key is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw"), F.first("width").alias("width"))
    classes = ws.cut(classes)
    widths = ws.cut(classes.groupBy("width").agg(F.count(F.lit(1)).alias("n")))
    rare = classes.join(widths.where(F.col("n") <= FEW).select("width"), "width").select(F.col("width").cast("long").alias("list"), "class_id", "copies", F.lit(b"").alias("near"))
    found = _tiled(rare, classes, least, 1)
    # A length of more than FEW vectors is worth pivots of its own.
    for r in widths.where(F.col("n") > FEW).orderBy("width").toLocalIterator():
        found = found.union(_join(classes.where(F.col("width") == r["width"]), r["n"], least, prefix, ws))
    found = ws.cut(found)
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), ws)
    gains = found.groupBy("node").agg(F.sum("links").alias("links"))
    per = classes.select("key", "class_id", "copies").join(gains, F.col("class_id") == F.col("node"), "left").drop("node")
    per = per.join(comp, F.col("class_id") == F.col("node"), "left").select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    out = all_units.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(per, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _join(classes: DataFrame, n: int, least: float, prefix: int, ws: Workspace) -> DataFrame:
    """node, root, links of n classes of one length; see `_summary`."""
    count = int(min(MOST_PIVOTS, max(16, n * prefix // TILE)))
    parts = max(1, n * prefix // (count * TILE))
    sample = classes.select("raw", "key", "width").orderBy("key").limit(SAMPLE_PER_PIVOT * count).collect()
    pivots = choose_pivots(_matrix([r["raw"] for r in sample], sample[0]["width"]), count)
    narrow = ws.cut(classes.select("class_id", "copies", "raw").mapInArrow(_lists(pivots, prefix, parts), "list long, class_id long, copies long, near binary"))
    return _tiled(narrow, classes, least, parts)


def _tiled(narrow: DataFrame, classes: DataFrame, least: float, parts: int) -> DataFrame:
    """node, root, links of the members of lists; every list is cut into tiles, which meet in pairs."""
    sizes = narrow.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("list", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("class_id", "list"), F.col("tiles")).cast("int")
    dealt = narrow.join(sizes, "list").withColumn("own", own).join(classes.select("class_id", "raw", "width"), "class_id")
    # Every member goes to the tiles of its row and of its column.
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("x"), F.greatest(k, F.col("own")).alias("y"))))
    item = F.struct("class_id", "copies", "near", "raw")
    spread = dealt.select("list", "width", "own", item.alias("item"), tile.alias("t")).select("list", "width", "own", "item", "t.x", "t.y")
    tiles = spread.groupBy("list", "width", "x", "y").agg(F.collect_list(F.when(F.col("own") == F.col("x"), F.col("item"))).alias("mine"), F.collect_list(F.when((F.col("own") == F.col("y")) & (F.col("x") != F.col("y")), F.col("item"))).alias("theirs"))
    tiles = tiles.where("size(mine) > 0 and (size(theirs) > 0 or x = y)")
    return tiles.select("list", "width", "x", "y", "mine", "theirs").mapInPandas(_links(least, parts), "node long, root long, links long").groupBy("node", "root").agg(F.sum("links").alias("links"))
