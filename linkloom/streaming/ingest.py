"""Incremental ingest: post changes in, current passages and their hashes out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.functions import text as T


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each post in a batch (post_id, op, title, content, changed_at)."""
    w = Window.partitionBy("post_id").orderBy(F.desc("changed_at"), F.desc("op"))
    return changes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def index_rows(posts: DataFrame) -> DataFrame:
    """post_id, content_hash, passage_count, passages of posts (post_id, title, content)."""
    p = T.passages(F.coalesce("content", F.lit("")))
    split = posts.select("post_id", F.coalesce("title", F.lit("")).alias("title"), p.alias("passages"))
    return split.select("post_id", F.md5(F.encode(F.concat_ws("|", "title", F.array_join("passages", "|")), "utf-8")).alias("content_hash"), F.size("passages").alias("passage_count"), "passages")


def apply_batch(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The index after a batch: deleted posts go, changed ones are replaced, equal hashes keep their row.

    A post whose content became empty keeps its old row.
    """
    last = latest(changes)
    gone = last.where("op = 'delete'").select("post_id")
    new = index_rows(last.where("op <> 'delete'")).where("passage_count > 0")
    old = index.select("post_id", "content_hash")
    changed = new.join(old, ["post_id", "content_hash"], "left_anti")
    return index.join(gone, "post_id", "left_anti").join(changed.select("post_id"), "post_id", "left_anti").unionByName(changed.select(*index.columns))


INDEX = "post_id long, content_hash string, passage_count int, passages array<string>"


def start(spark: SparkSession, source: str, schema: str, index_dir: str, checkpoint: str, per_batch: int = 20) -> StreamingQuery:
    """Follow a folder of change files; one index version is written for each micro-batch.

    A batch that is replayed after a failure writes its version again from the
    version before it, so no change counts twice. `availableNow` drains what is
    there; a processing-time trigger would follow the folder.
    """

    def batch(changes: DataFrame, n: int) -> None:
        s = changes.sparkSession
        before = s.read.schema(INDEX).parquet(f"{index_dir}/v{n - 1}") if n else s.createDataFrame([], INDEX)
        apply_batch(before, changes).write.mode("overwrite").parquet(f"{index_dir}/v{n}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_counts(events: DataFrame, minutes: int = 60) -> DataFrame:
    """Jobs by type and window of event time; late events are dropped after a window's length."""
    return events.withWatermark("ts", f"{minutes} minutes").groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
