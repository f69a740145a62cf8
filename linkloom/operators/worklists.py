"""Work lists, review pages and their flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkloom.schema import status_table
from linkloom.settings import Settings

PREPARABLE = ("pending", "ready", "rewrite_suggested", "no_anchor", "low_relevance")
APPROVABLE = ("ready", "verified", "rewrite_suggested")
REJECTABLE = ("pending", *APPROVABLE)


def _surest(rows: DataFrame, most: int) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("confidence"), "id").limit(most)


def prepare_batch(opps: DataFrame, s: Settings) -> DataFrame:
    """Pending rows to prepare next, the most similar first; fewer where a model is asked for anchors."""
    return opps.where("status = 'pending'").orderBy(F.desc("sim"), "id").limit(5 if s.use_ai_anchor else 25)


def verify_batch(opps: DataFrame, most: int = 5) -> DataFrame:
    """Ready rows to judge next, the surest first."""
    return _surest(opps.where("status = 'ready'"), most)


def insert_batch(opps: DataFrame, s: Settings, most: int = 10) -> DataFrame:
    """Kept rows to insert next: verified ones, or ready ones where nothing is judged."""
    return _surest(opps.where(F.col("status") == ("verified" if s.use_ai_rerank else "ready")), most)


def auto_insert_batch(opps: DataFrame, s: Settings) -> DataFrame:
    """Ready rows sure enough to be inserted without review, the surest first."""
    return opps.where((F.col("status") == "ready") & (F.col("confidence") >= s.auto_min_confidence)).orderBy(F.desc("confidence"), "id")


def latest_links(links: DataFrame, posts: DataFrame, most: int = 200) -> DataFrame:
    """The newest inserted links with the titles of both ends."""
    newest = links.orderBy(F.desc("inserted_at"), F.desc("id")).limit(most)
    return with_titles(newest, posts)


def with_titles(rows: DataFrame, posts: DataFrame, s: str = "s", t: str = "t") -> DataFrame:
    """Rows with source_title and target_title; null where a post is gone."""
    title = posts.select(F.col("post_id").alias("_p"), F.col("title").alias("_x"))
    one = rows.join(title, F.col(s) == F.col("_p"), "left").withColumnRenamed("_x", "source_title").drop("_p")
    return one.join(title, F.col(t) == F.col("_p"), "left").withColumnRenamed("_x", "target_title").drop("_p")


def recent_index(index: DataFrame, posts: DataFrame, page: int = 1, size: int = 25) -> DataFrame:
    """A page of index rows with their posts, the last indexed first."""
    own = posts.select("post_id", "title", "status")
    return index.join(own, "post_id").orderBy(F.desc_nulls_last("indexed_at"), "post_id").offset((page - 1) * size).limit(size)


def orphan_page(posts: DataFrame, index: DataFrame, site_links: DataFrame | None, limit: int = 50, offset: int = 0) -> DataFrame:
    """post_id, passage_count of posts that nothing links to.

    With a scan: published posts without a scanned link to them, the newest
    first. Without: index rows that count no incoming link, the last indexed
    first.
    """
    if site_links is None:
        rows = index.where("incoming_links = 0").orderBy(F.desc_nulls_last("indexed_at"), "post_id")
        return rows.offset(offset).limit(limit).select("post_id", "passage_count")
    live = posts.where("status = 'publish' and type = 'post'").select("post_id")
    free = live.join(site_links.select(F.col("t").alias("post_id")), "post_id", "left_anti").join(index.select("post_id", "passage_count"), "post_id", "left")
    return free.select("post_id", F.coalesce("passage_count", F.lit(0)).alias("passage_count")).orderBy(F.desc("post_id")).offset(offset).limit(limit)


def orphan_count(posts: DataFrame, index: DataFrame, site_links: DataFrame | None) -> DataFrame:
    """One row, n: orphans by the scan, or by the counters without one."""
    if site_links is None:
        return index.where("incoming_links = 0").agg(F.count(F.lit(1)).alias("n"))
    live = posts.where("status = 'publish' and type = 'post'").select("post_id")
    return live.join(site_links.select(F.col("t").alias("post_id")), "post_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))


def excerpts(posts: DataFrame, passages: DataFrame, most_words: int = 80) -> DataFrame:
    """post_id, excerpt: the first two passages, or the first words of the text of posts without any."""
    first = passages.withColumn("r", F.row_number().over(Window.partitionBy("post_id").orderBy("idx"))).where("r <= 2")
    two = first.groupBy("post_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), " ").alias("two"))
    words = F.filter(F.split(F.coalesce("content", F.lit("")), r"(?U)\s+"), lambda w: w != "")
    return posts.join(two, "post_id", "left").select("post_id", F.coalesce("two", F.array_join(F.slice(words, 1, most_words), " ")).alias("excerpt"))


def actions(opps: DataFrame, rerank: bool = False) -> DataFrame:
    """id, bucket, label and what can be done with each row."""
    named = opps.join(F.broadcast(status_table(opps.sparkSession, rerank)), "status", "left")
    label = F.coalesce("label", F.initcap(F.translate("status", "_", " ")))
    flags = [F.col("status").isin(*names).alias(f"show_{verb}") for verb, names in (("prepare", PREPARABLE), ("approve", APPROVABLE), ("reject", REJECTABLE))]
    return named.select("id", "status", F.coalesce("bucket", F.lit("working")).alias("bucket"), label.alias("label"), *flags)


def review_fields(rows: DataFrame) -> DataFrame:
    """id and what stored signals (JSON) say of a judgement: reason (older form too), anchor, scores."""
    at = lambda path: F.get_json_object("signals", path)
    return rows.select("id", F.coalesce(at("$.rerank.reason"), at("$.rerank_reason"), F.lit("")).alias("reason"), F.coalesce(at("$.rerank.grounded"), F.lit("")).alias("ai_anchor"), at("$.rerank.pair_score").cast("int").alias("pair_score"), at("$.rerank.anchor_score").cast("int").alias("anchor_score"))


def steps_done(posts: DataFrame, index: DataFrame, queue: DataFrame, opps: DataFrame, rerank: bool) -> DataFrame:
    """One row: whether indexing, preparing and verifying are through."""
    n = lambda df, cond, name: df.agg(F.count(F.when(F.expr(cond), 1)).alias(name))
    row = n(posts, "status = 'publish' and type = 'post'", "posts").crossJoin(n(index, "indexed_at is not null", "indexed")).crossJoin(n(queue, "status in ('pending', 'processing')", "busy"))
    kept = "verified" if rerank else "ready"
    out = "'rewrite_suggested', 'no_anchor', 'rejected_relevance', 'rejected', 'capped', 'reciprocal', 'low_relevance', 'invalid'"
    counts = opps.agg(*[F.count(F.when(F.expr(c), 1)).alias(x) for x, c in (("pending", "status = 'pending'"), ("awaiting", "status = 'ready'"), ("insertable", f"status = '{kept}'"), ("not_linked", f"status in ({out})"))])
    prepared = (F.col("pending") == 0) & (F.col("insertable") + F.col("not_linked") > 0)
    verified = (F.col("awaiting") == 0) & (F.col("insertable") > 0) if rerank else prepared
    return row.crossJoin(counts).select(((F.col("posts") > 0) & (F.col("indexed") >= F.col("posts")) & (F.col("busy") == 0)).alias("indexed_done"), prepared.alias("prepared_done"), verified.alias("verified_done"))


def touching(opps: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of which an end is among the ids (id), once each."""
    s, t = (opps.join(ids.select(F.col("id").alias(c)).distinct(), c, "left_semi").select(*opps.columns) for c in ("s", "t"))
    return s.union(t).dropDuplicates(["id"])


def contains_fragment(title: Column, fragment: str) -> Column:
    """Whether a title holds a fragment as it stands, in any case; signs of patterns have no meaning."""
    return F.contains(F.lower(title), F.lit(fragment.lower()))
