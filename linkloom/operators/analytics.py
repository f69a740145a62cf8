"""Reports and exports: counts, lists, queue state, evaluation, retention."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window, functions as F

from linkloom.schema import STATUSES, status_table
from linkloom.settings import Settings

EXPORT_ROWS = 10_000
EXPORT_LOGS = 1_000
#: Rank of a status in the evaluation; others rank 0.
EVAL_RANK = {"inserted": 11, "verified": 10, "ready": 9, "rewrite_suggested": 8, "reciprocal": 7, "rejected_relevance": 6, "no_anchor": 5, "low_relevance": 4, "capped": 3, "pending": 2, "invalid": 1}
READY = ("ready", "verified", "rewrite_suggested", "inserted")


def status_counts(df: DataFrame, names=tuple(STATUSES)) -> DataFrame:
    """status, n for every known status, 0 included."""
    spark = df.sparkSession
    all_ = spark.createDataFrame([(s,) for s in names], "status string")
    return F.broadcast(all_).join(df.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").fillna(0, ["n"])


def bucket_counts(df: DataFrame, rerank: bool = False) -> DataFrame:
    names = F.broadcast(status_table(df.sparkSession, rerank))
    return df.join(names, "status", "left").groupBy(F.coalesce("bucket", F.lit("working")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def review_list(opps: DataFrame, most: int = 200) -> DataFrame:
    """What waits for review, the surest first."""
    return opps.where(F.col("status").isin("ready", "verified")).orderBy(F.desc_nulls_last("confidence"), F.desc("sim"), F.desc("id")).limit(most)


def focus_list(opps: DataFrame, post: int, order: tuple[str, ...], most: int = 200) -> DataFrame:
    """Rows of one post, by the given order of statuses (others first), then confidence."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("status"))
    return opps.where((F.col("s") == post) | (F.col("t") == post)).orderBy(place, F.desc_nulls_last("confidence"), F.desc("id")).limit(most)


def suggestion_counts(opps: DataFrame) -> DataFrame:
    """id, n_out, n_in of live suggestions."""
    live = opps.where(F.col("status").isin("pending", "ready", "verified", "inserted"))
    ends = live.select(F.col("s").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(live.select("t", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def queue_dedupe(queue: DataFrame) -> DataFrame:
    """The first unfinished job of each type and post."""
    w = Window.partitionBy("job_type", "post_id").orderBy("id")
    return queue.where(F.col("status").isin("pending", "processing")).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def queue_stale(queue: DataFrame, as_of, minutes: int = 5, attempts: int = 3) -> DataFrame:
    """Jobs processing for too long fail after their attempts, else wait again."""
    stale = (F.col("status") == "processing") & (F.col("created_at") < as_of - F.expr(f"INTERVAL {minutes} MINUTES"))
    return queue.withColumn("status", F.when(stale & (F.col("attempts") >= attempts), "failed").when(stale, "pending").otherwise(F.col("status")))


def retention(rows: DataFrame, as_of, days: int, done_only: bool = False) -> DataFrame:
    old = F.col("created_at") < as_of - F.expr(f"INTERVAL {days} DAYS")
    return rows.where(~(old & (F.col("status") == "done")) if done_only else ~old)


def eval_pairs(pairs: DataFrame, posts: DataFrame, opps: DataFrame) -> DataFrame:
    """kind, a_fragment, b_fragment, status: the best status of either direction of each pair.

    Fragments resolve to the first published post whose title contains them.
    Titles and fragments meet by three letters: the fragment's first ones, at
    each place of the title. Empty fragments resolve to nothing.
    """
    frags = pairs.select(F.lower("a_fragment").alias("f")).union(pairs.select(F.lower("b_fragment"))).distinct().where("f <> ''").withColumn("g", F.substring("f", 1, 3))
    live = posts.where("status = 'publish'").select("post_id", F.lower("title").alias("title"))
    # A fragment shorter than three letters is met by the places' own shorter beginnings.
    places = F.sequence(F.lit(1), F.greatest(F.length("title"), F.lit(1)))
    grams = F.array_distinct(F.flatten(F.transform(places, lambda k: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring(F.col("title"), k, n)))))
    hit = live.select("post_id", "title", F.explode(grams).alias("g")).join(frags, "g").where(F.contains("title", "f")).groupBy("f").agg(F.min("post_id").alias("p"))
    both = pairs.join(hit.select(F.col("f").alias("_fa"), F.col("p").alias("pa")), F.lower("a_fragment") == F.col("_fa"), "left").join(hit.select(F.col("f").alias("_fb"), F.col("p").alias("pb")), F.lower("b_fragment") == F.col("_fb"), "left")
    rank = F.create_map(*[F.lit(x) for kv in EVAL_RANK.items() for x in kv])
    ranked = opps.select(F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi"), "id", "status", F.coalesce(rank[F.col("status")], F.lit(0)).alias("rk")).groupBy("lo", "hi").agg(F.max_by("status", F.struct("rk", "id")).alias("best"))
    joined = both.join(ranked, (F.least("pa", "pb") == F.col("lo")) & (F.greatest("pa", "pb") == F.col("hi")), "left")
    status = F.when(F.col("pa").isNull() | F.col("pb").isNull(), "unresolved").otherwise(F.coalesce("best", F.lit("absent")))
    return joined.select("kind", "a_fragment", "b_fragment", status.alias("status"))


def eval_summary(results: DataFrame) -> DataFrame:
    pos, neg = F.col("kind") == "positive", F.col("kind") == "negative"
    known = F.col("status") != "unresolved"
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    share = lambda c, n: F.round(100 * count(c) / F.when(n > 0, n), 1)
    ready = F.col("status").isin(*READY)
    return results.agg(
        count(pos & known).alias("positives_resolved"), share(pos & known & (F.col("status") != "absent"), count(pos & known)).alias("candidate_recall"), share(pos & ready, count(pos & known)).alias("ready_recall"),
        count(neg & known).alias("negatives_resolved"), share(neg & known & ~ready, count(neg & known)).alias("precision_suppression"),
    )


def totals(posts: DataFrame, indexed: DataFrame, opps: DataFrame, links: DataFrame, site_links: DataFrame, orphans: DataFrame) -> DataFrame:
    """One row of counts over the tables."""
    parts = [("published", posts.where("status = 'publish'")), ("indexed", indexed), ("opportunities", opps), ("active_links", links.where("status = 'active'")), ("site_links", site_links), ("orphans", orphans)]
    out = None
    for name, df in parts:
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def export_meta(totals_: DataFrame, s: Settings, scanned: bool) -> DataFrame:
    """Totals with the settings (without the key) and where orphans come from."""
    return totals_.select("*", F.lit(json.dumps(s.public(), sort_keys=True)).alias("settings"), F.lit("scanned_site_links" if scanned else "plugin_links_only").alias("orphan_source"), F.lit(EXPORT_ROWS).alias("row_cap"))


def export_opportunities(opps: DataFrame, posts: DataFrame, most: int = EXPORT_ROWS) -> DataFrame:
    """Rows with the titles of both ends, by id, as the JSON export gives them."""
    titles = posts.select(F.col("post_id").alias("_p"), F.col("title").alias("_x"))
    first = opps.orderBy("id").limit(most)
    one = first.join(titles, F.col("s") == F.col("_p"), "left").withColumnRenamed("_x", "source_title").drop("_p")
    return one.join(titles, F.col("t") == F.col("_p"), "left").withColumnRenamed("_x", "target_title").drop("_p")


def export_queue(queue: DataFrame, most: int = EXPORT_ROWS) -> DataFrame:
    return queue.orderBy(F.desc("id")).limit(most)


def export_site_links(site_links: DataFrame, posts: DataFrame, most: int = EXPORT_ROWS) -> DataFrame:
    """Scanned links (s, t, anchor) with the titles of both ends, by source and target."""
    from linkloom.operators.worklists import with_titles

    return with_titles(site_links.orderBy("s", "t").limit(most), posts)


def export_orphans(index: DataFrame, posts: DataFrame, most: int = EXPORT_ROWS) -> DataFrame:
    """Index rows without a counted incoming link, by post; the scan isn't asked."""
    rows = index.where("incoming_links = 0").orderBy("post_id").limit(most)
    return rows.join(posts.select("post_id", "title"), "post_id", "left").select("post_id", "passage_count", "outgoing_links", "title")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
