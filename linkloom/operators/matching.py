"""Matching: top neighbours of centred vectors, eligibility, upsert of opportunities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkloom.functions.vectors import centred, neighbours, sides
from linkloom.settings import Settings


def match_outgoing(vectors: DataFrame, s: Settings, blocks=None) -> DataFrame:
    """s, t, sim: the best neighbours of every source, before any test of the target."""
    c = centred(vectors)
    return neighbours(c, c, s.min_doc_similarity, s.match_top_k, blocks or _blocks(vectors))


def _blocks(vectors: DataFrame) -> tuple[int, int]:
    n = sides(vectors.sparkSession, vectors.count())
    return n, n


def match_incoming(vectors: DataFrame, sources: DataFrame, targets: DataFrame, s: Settings, blocks=None) -> DataFrame:
    """s, t, sim: the best eligible sources (id) of the targets (id)."""
    c = centred(vectors)
    return neighbours(c.join(sources, "id", "left_semi"), c.join(targets, "id", "left_semi"), s.min_doc_similarity, s.match_top_k, blocks or _blocks(vectors), by="t")


def both_directions(pairs: DataFrame, s: Settings) -> DataFrame:
    """Pairs, with the reverse of the strong ones."""
    back = pairs.where(F.col("sim") >= s.both_direction_min).select(F.col("t").alias("s"), F.col("s").alias("t"), "sim")
    return pairs.select("s", "t", "sim").union(back).dropDuplicates(["s", "t"])


def eligible(pairs: DataFrame, sources: DataFrame, targets: DataFrame, s: Settings) -> DataFrame:
    """Pairs of eligible sources and published targets; strong ones in both directions if both allow it.

    sources: id of posts whose outgoing links are below their own maximum;
    targets: id of published posts.
    """
    src, tgt = sources.select(F.col("id").alias("s")), targets.select(F.col("id").alias("t"))
    good = pairs.join(src, "s", "left_semi").join(tgt, "t", "left_semi")
    back = good.where(F.col("sim") >= s.both_direction_min).select(F.col("t").alias("s"), F.col("s").alias("t"), "sim")
    back = back.join(src, "s", "left_semi").join(tgt, "t", "left_semi")
    return good.select("s", "t", "sim").unionByName(back).dropDuplicates(["s", "t"])


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old (s, t, sim, status, ...) with the similarity of new pairs; pairs not there yet are pending."""
    n = new.select(F.col("s").alias("_s"), F.col("t").alias("_t"), F.col("sim").alias("_sim"))
    joined = old.join(n, (F.col("s") == F.col("_s")) & (F.col("t") == F.col("_t")), "full_outer")
    values = {"s": F.coalesce("s", "_s"), "t": F.coalesce("t", "_t"), "sim": F.coalesce("_sim", "sim"), "status": F.coalesce("status", F.lit("pending"))}
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in old.columns])
