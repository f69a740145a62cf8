"""The post index as state: upserts, stubs, passages, counters, deletions, vectors of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linkloom.functions import text as T, vectors as V

#: Columns that an index run never overwrites.
KEPT = ("incoming_links", "outgoing_links", "max_outgoing_links")


def decode_vector(json: Column) -> Column:
    """A vector from its JSON text; null if it is empty or no list of numbers."""
    v = F.from_json(json, "array<double>")
    return F.when(F.size(v) > 0, v)


def document_vectors(posts: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors of passages (post_id, idx, vector) and of documents (id, vector).

    A document's vector is the mean of its title's and its passages'. The title,
    an empty one too, is embedded along but isn't a passage.
    """
    titles = posts.join(passages.select("post_id").distinct(), "post_id", "left_semi").select("post_id", F.lit(-1).alias("idx"), F.coalesce("title", F.lit("")).alias("text"))
    both = titles.unionByName(passages.select("post_id", F.col("idx").cast("int").alias("idx"), "text"))
    vectors = V.hashed_embedding(both.select("post_id", "idx", T.idf_tokens(F.col("text")).alias("tok")), ["post_id", "idx"], "tok")
    means = V.mean_of(vectors, "post_id").select(F.col("post_id").alias("id"), "vector")
    return vectors.where("idx >= 0"), means


def upsert(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with new rows: what they hold replaces the old, but counters and own limits stay."""
    fresh = new.select(F.struct(*new.columns).alias("n"))
    joined = index.join(fresh, F.col("post_id") == F.col("n.post_id"), "full_outer")
    pick = {c: F.coalesce(F.col(c), F.col(f"n.{c}")) if c in KEPT else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)) for c in new.columns}
    return joined.select(*[pick.get(c, F.col(c)).alias(c) for c in index.columns])


def with_stubs(index: DataFrame, ids: DataFrame, most_outgoing: int) -> DataFrame:
    """The index with an empty row for each id (post_id) that has none."""
    missing = ids.select("post_id").where("post_id is not null").distinct().join(index.select("post_id"), "post_id", "left_anti")
    zero = {"passage_count": 0, "incoming_links": 0, "outgoing_links": 0, "max_outgoing_links": most_outgoing}
    stub = missing.select(*[F.col(f.name) if f.name == "post_id" else F.lit(zero.get(f.name)).cast(f.dataType).alias(f.name) for f in index.schema])
    return index.unionByName(stub)


def replace_passages(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Passages after the touched posts (post_id) were split anew; rows without vector are skipped, places keep their gaps."""
    return old.join(touched.select("post_id"), "post_id", "left_anti").unionByName(new.where("size(vector) > 0").select(*old.columns))


def without(rows: DataFrame, ids: DataFrame, *ends: str) -> DataFrame:
    """Rows of which no end is among the ids (post_id)."""
    out = rows
    for end in ends:
        out = out.join(ids.select(F.col("post_id").alias(end)).distinct(), end, "left_anti")
    return out.select(*rows.columns)


def source_eligible(index: DataFrame) -> DataFrame:
    """id of posts with fewer outgoing links than their own limit."""
    return index.where("outgoing_links < max_outgoing_links").select(F.col("post_id").alias("id"))


def bump_counters(index: DataFrame, links: DataFrame, by: int) -> DataFrame:
    """The index after the links (s, t) came (by = 1) or went (-1): sums first, never below 0."""
    ends = links.select(F.col("s").alias("post_id"), F.lit(by).alias("o"), F.lit(0).alias("i")).union(links.select("t", F.lit(0), F.lit(by)))
    sums = ends.groupBy("post_id").agg(F.sum("o").alias("_o"), F.sum("i").alias("_i"))
    moved = lambda c, d: F.greatest(F.lit(0), F.col(c) + F.coalesce(F.col(d), F.lit(0))).cast(index.schema[c].dataType)
    return index.join(sums, "post_id", "left").withColumns({"outgoing_links": moved("outgoing_links", "_o"), "incoming_links": moved("incoming_links", "_i")}).select(*index.columns)


def delete_posts(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables after posts (post_id) were deleted for good.

    Counters of the other ends of active links go down by them; links, scanned
    links, opportunities, jobs, passages and index rows of the posts go.
    """
    gone = ids.select("post_id").distinct()
    active = tables["links"].where("status = 'active'")
    left = without(active, gone, "s", "t").select("id")
    out = dict(tables)
    out["index"] = without(bump_counters(tables["index"], active.join(left, "id", "left_anti"), -1), gone, "post_id")
    for name in ("links", "opportunities", "site_links"):
        if name in tables:
            out[name] = without(tables[name], gone, "s", "t")
    for name in ("queue", "passages"):
        if name in tables:
            out[name] = without(tables[name], gone, "post_id")
    return out


def health(links: DataFrame, posts: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and index after a check: active links to posts that are gone or unpublished break, counters go down by them."""
    from linkloom.operators.linkscan import broken

    checked = broken(links, posts)
    newly = checked.where("status = 'broken'").join(links.where("status = 'active'").select("id"), "id", "left_semi")
    return checked, bump_counters(index, newly, -1)
