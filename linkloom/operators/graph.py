"""The semantic graph: nodes, undirected edges, degrees, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from linkloom.session import Workspace


def edges(opps: DataFrame, nodes: DataFrame, least: float = 55.0) -> DataFrame:
    """a, b, weight, inserted for each unordered pair of nodes (id); invalid rows don't count."""
    live = opps.where((F.col("sim") >= least) & (F.col("status") != "invalid"))
    for end in ("s", "t"):
        live = live.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return live.groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.round(F.max("sim"), 1).alias("weight"), F.bool_or(F.col("status") == "inserted").alias("inserted"))


def link_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, weight (100), inserted for each unordered pair of nodes with an active link."""
    live = links.where("status = 'active'")
    for end in ("s", "t"):
        live = live.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return live.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct().select("a", "b", F.lit(100.0).alias("weight"), F.lit(True).alias("inserted"))


def edges_of(kind: str, opps: DataFrame, links: DataFrame, nodes: DataFrame, least: float = 55.0) -> DataFrame:
    """Edges by kind: semantic, links, or both: the semantic ones, inserted too where a link is active. Pairs with a link alone aren't added to both."""
    if kind == "links":
        return link_edges(links, nodes)
    e = edges(opps, nodes, least)
    if kind == "semantic":
        return e
    linked = link_edges(links, nodes).select("a", "b", F.col("inserted").alias("_l"))
    return e.join(linked, ["a", "b"], "left").withColumn("inserted", F.col("inserted") | F.coalesce("_l", F.lit(False))).drop("_l")


def nodes_of(index: DataFrame, posts: DataFrame, e: DataFrame, orphans: bool = True) -> DataFrame:
    """id, title, incoming, outgoing, passages, degree of indexed posts; without those of degree 0 if orphans don't count."""
    rows = index.where("indexed_at is not null").join(posts.select("post_id", "title"), "post_id")
    found = rows.join(degrees(e).withColumnRenamed("id", "post_id"), "post_id", "left").select(
        F.col("post_id").alias("id"), "title", F.col("incoming_links").alias("incoming"), F.col("outgoing_links").alias("outgoing"), F.col("passage_count").alias("passages"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree")
    )
    return found if orphans else found.where("degree > 0")


def meta(nodes: DataFrame, e: DataFrame, least: float, kind: str) -> DataFrame:
    """One row: numbers of nodes and edges, the least similarity, the kind of edges."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(nodes, "nodes").crossJoin(count(e, "edges")).select("nodes", "edges", F.lit(float(least)).alias("min_sim"), F.lit(kind).alias("edge_type"))


def degrees(e: DataFrame) -> DataFrame:
    return e.select(F.col("a").alias("id")).union(e.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def communities(e: DataFrame, nodes: DataFrame, ws: Workspace, sweeps: int = 12) -> DataFrame:
    """id, community: weighted label propagation, all nodes at once in each sweep.

    The label of the greatest summed weight wins; a node keeps its own on a tie,
    else takes the least. Isolated nodes stay alone. Labels are numbered from 0
    by their first node.
    """
    both = ws.cut(e.select("a", "b", "weight").union(e.select("b", "a", "weight")).toDF("id", "nb", "w"))
    labels = ws.cut(nodes.select("id", F.col("id").alias("label")))
    for _ in range(sweeps):
        votes = both.join(labels.toDF("nb", "vote"), "nb").groupBy("id", "vote").agg(F.round(F.sum("w"), 6).alias("w"))
        own = labels.join(votes, "id", "left")
        best = own.groupBy("id").agg(F.first("label").alias("label"), F.max_by("vote", F.struct("w", (F.col("vote") == F.col("label")).alias("own"), (-F.col("vote")).alias("low"))).alias("new"))
        moved = ws.cut(best.select("id", F.coalesce("new", "label").alias("label"), (F.col("new") != F.col("label")).alias("_moved")))
        ws.drop(labels)
        labels = moved.select("id", "label")
        if not moved.where("_moved").head(1):
            break
    first = ws.cut(labels.groupBy("label").agg(F.min("id").alias("_first")))
    return labels.join(_numbered(first, ws), "label").select("id", "community")


def _numbered(first: DataFrame, ws: Workspace) -> DataFrame:
    """label, community: labels numbered by their first node, range by range, so that no task sorts them all."""
    spread = ws.cut(first.repartitionByRange("_first").select("*", F.spark_partition_id().alias("_part")))
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    # One row for each partition.
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_first")) - 1
    return spread.withColumn("_w", within).join(F.broadcast(before), "_part").select("label", (F.col("_before") + F.col("_w")).cast("long").alias("community"))
