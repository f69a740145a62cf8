"""Links in HTML resolved to posts, in-degrees, orphans, broken links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkloom.functions.text import norm_host, norm_path

LINK = r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
TAGS = r"(?s)<[^>]*>"


def link_scan(posts: DataFrame) -> DataFrame:
    """post_id, pos, href, anchor for each quoted link of the content, in order."""
    found = F.arrays_zip(F.regexp_extract_all("content", F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all("content", F.lit(LINK), F.lit(2)).alias("inner"))
    return posts.select("post_id", F.posexplode(found).alias("pos", "l")).select("post_id", "pos", F.col("l.href").alias("href"), F.trim(F.regexp_replace(F.col("l.inner"), TAGS, "")).alias("anchor"))


def resolve(links: DataFrame, posts: DataFrame, host: str = "") -> DataFrame:
    """source, target, anchor: links to other posts, the first anchor for each target.

    Relative, scheme-less and own-host addresses resolve by ?p= / ?page_id= or
    by path; on equal paths the last post wins. The path map has one row a post.
    """
    href = F.trim(F.regexp_replace("href", "&amp;", "&"))
    full = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/") | href.startswith("?"), F.concat(F.lit(f"https://{host}"), href)).otherwise(href)
    ok = ~href.rlike(r"(?i)^(mailto:|tel:|javascript:|#|$)") & full.rlike(r"(?i)^https?://")
    own = norm_host(F.regexp_extract(full, r"(?i)^https?://([^/?#]*)", 1)) == F.lit(host.lower().removeprefix("www."))
    by_id = F.regexp_extract(full, r"[?&](?:p|page_id)=(\d+)(?:&|#|$)", 1)
    path = norm_path(F.regexp_extract(full, r"(?i)^https?://[^/?#]*([^?#]*)", 1))
    rows = links.where(ok & own).select(F.col("post_id").alias("source"), "pos", "anchor", F.when(by_id != "", by_id.cast("long")).alias("by_id"), path.alias("path"))
    live = posts.where("status = 'publish' and type = 'post'")
    paths = live.groupBy(norm_path(F.col("permalink")).alias("path")).agg(F.max("post_id").alias("path_id"))
    ids = live.select(F.col("post_id").alias("id_hit"))
    got = rows.join(paths, "path", "left").join(ids, F.col("by_id") == F.col("id_hit"), "left").withColumn("target", F.coalesce("id_hit", "path_id"))
    return got.where("target is not null and target <> source").groupBy("source", "target").agg(F.min_by("anchor", "pos").alias("anchor"))


def in_degree(site_links: DataFrame) -> DataFrame:
    return site_links.groupBy("target").agg(F.count(F.lit(1)).alias("in_links"))


def orphans(posts: DataFrame, site_links: DataFrame) -> DataFrame:
    live = posts.where("status = 'publish' and type = 'post'").select("post_id")
    return live.join(site_links.select(F.col("target").alias("post_id")), "post_id", "left_anti")


def broken(links: DataFrame, posts: DataFrame) -> DataFrame:
    """Links with the status broken where an active one's target is missing or not published."""
    live = posts.where("status = 'publish'").select(F.col("post_id").alias("_p"), F.lit(True).alias("_live"))
    dead = (F.col("status") == "active") & F.col("_live").isNull()
    return links.join(live, F.col("t") == F.col("_p"), "left").withColumn("status", F.when(dead, "broken").otherwise(F.col("status"))).select(*links.columns)


def counters(links: DataFrame, posts: DataFrame) -> DataFrame:
    """post_id, outgoing_links, incoming_links over active links."""
    active = links.where("status = 'active'")
    ends = active.select(F.col("s").alias("post_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(active.select("t", F.lit(0), F.lit(1)))
    sums = ends.groupBy("post_id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    zero = F.lit(0).cast("long")
    return posts.select("post_id").join(sums, "post_id", "left").select("post_id", F.coalesce("o", zero).alias("outgoing_links"), F.coalesce("i", zero).alias("incoming_links"))
