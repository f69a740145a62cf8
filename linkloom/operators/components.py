"""Connected components of a large edge list by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from linkloom.session import Workspace


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace the edges of each batch by a star for each component of the batch."""
    for pdf in frames:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        rows = [(x, r) for x in list(parent) if (r := find(x)) != x]
        yield pd.DataFrame(rows, columns=["a", "b"]).astype("int64")


def components(edges: DataFrame, ws: Workspace, max_rounds: int = 60) -> DataFrame:
    """Columns ``a``, ``b`` (long) in; ``node``, ``component`` (smallest node) out.

    Only nodes that have an edge to another node appear. Every round is two
    grouped minima and two joins on narrow rows; a hot centre is pre-aggregated
    in the minima and split by adaptive execution in the joins. Null ends and
    self loops are ignored; an empty list gives an empty result.
    """
    clean = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    e = ws.cut(clean.mapInPandas(_forest, "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    mark = _mark(e)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = e.union(e.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = ws.cut(small.union(low2.toDF("u", "v")).distinct())
        ws.drop(e)
        e, old, mark = new, mark, _mark(new)
        if old == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    own = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own)


def _mark(e: DataFrame) -> tuple[int, int, int]:
    h = F.xxhash64("u", "v")
    row = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(h % 1000003), F.lit(0)), F.coalesce(F.bit_xor(h), F.lit(0))).first()
    return int(row[0]), int(row[1]), int(row[2])
