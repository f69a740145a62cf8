"""From the corpus tables to the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.functions.vectors import as_double


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts_from_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Posts whose title is the first line, 80 characters of it; toxic ones are drafts."""
    toxic = labels.select(F.col("doc_id").alias("post_id"), "toxic")
    base = docs.select(F.col("doc_id").alias("post_id"), F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"), F.col("text").alias("content"), "lang")
    status = F.when(F.coalesce("toxic", F.lit(0)) == 1, "draft").otherwise("publish")
    return base.join(toxic, "post_id", "left").select("post_id", "title", "content", "lang", status.alias("status"), F.lit("post").alias("type"), F.concat(F.lit("/d/"), F.col("post_id").cast("string")).alias("permalink"))


def posts_from_pages(pages: DataFrame) -> DataFrame:
    """Posts of raw pages; the permalink is the lower-case first word of the title."""
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    first = F.split(title, " ")[0]
    return pages.select(F.col("page_id").alias("post_id"), "url", title.alias("title"), F.col("html").alias("content"), F.lit("publish").alias("status"), F.lit("post").alias("type"), F.lower(F.concat(F.lit("/"), first)).alias("permalink"))


def vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("id"), as_double(F.col("embedding")).alias("vector")).where("vector is not null")


def queue_from_events(events: DataFrame) -> DataFrame:
    """Event types as job types, users as posts, values as attempts."""
    state = F.element_at(F.array(*map(F.lit, ("pending", "processing", "done", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("post_id"), F.col("event_type").alias("job_type"), state.alias("status"), (F.floor("value") % 4).cast("int").alias("attempts"), F.col("ts").alias("created_at"))
