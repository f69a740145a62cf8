"""The job queue and the log as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

UNFINISHED = ("pending", "processing")
MOST_ATTEMPTS = 3
#: What follows a job that is done.
CHAIN = {"index_post": "generate_matches", "generate_matches": "finalize_post"}


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """The queue with new jobs (id, post_id, job_type, auto, created_at).

    A post has one unfinished job of a type: the one that is there stays, else
    the first new one is taken. Its auto flag is set if any of them has it.
    Jobs without a post are never held back.
    """
    key = ["job_type", "post_id"]
    rows = new.select("id", *key, F.lit("pending").alias("status"), F.lit(0).alias("attempts"), "auto", "created_at")
    open_ = queue.where(F.col("status").isin(*UNFINISHED) & F.col("post_id").isNotNull())
    flags = rows.where("post_id is not null").groupBy(*key).agg(F.bool_or("auto").alias("_new"))
    first = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    once = rows.where("post_id is not null").withColumn("_r", first).where("_r = 1").drop("_r").join(open_.select(*key), key, "left_anti").join(flags, key)
    added = once.withColumn("auto", F.col("_new")).select(*rows.columns).unionByName(rows.where("post_id is null"))
    old = queue.join(flags, key, "left").withColumn("auto", F.col("auto") | (F.coalesce("_new", F.lit(False)) & F.col("status").isin(*UNFINISHED)))
    return old.select(*queue.columns).unionByName(added.select(*queue.columns))


def claim(queue: DataFrame, most: int) -> DataFrame:
    """The first pending jobs by id, of whatever type, as claimed: processing, one attempt more."""
    first = queue.where("status = 'pending'").orderBy("id").limit(max(1, most))
    return first.withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1})


def release(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """Claimed jobs (id) that were not started wait again and keep their attempt."""
    back = queue.join(ids.select("id", F.lit(True).alias("_b")).distinct(), "id", "left")
    hit = F.coalesce("_b", F.lit(False)) & (F.col("status") == "processing")
    return back.withColumns({"attempts": F.when(hit, F.greatest(F.lit(0), F.col("attempts") - 1)).otherwise(F.col("attempts")), "status": F.when(hit, "pending").otherwise(F.col("status"))}).select(*queue.columns)


def finish(queue: DataFrame, results: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """The queue after jobs ran; results: id, error (null if done). Failed ones wait again until their attempts are used up."""
    met = queue.join(results.select("id", F.col("error").alias("_e"), F.lit(True).alias("_ran")), "id", "left")
    status = F.when(F.col("_ran").isNull(), F.col("status")).when(F.col("_e").isNull(), "done").when(F.col("attempts") >= most, "failed").otherwise("pending")
    return met.withColumn("status", status).select(*queue.columns, F.col("_e").alias("last_error"))


def next_jobs(done: DataFrame, auto_link_new: bool) -> DataFrame:
    """post_id, job_type, auto of the jobs that follow done ones (job_type, post_id, auto, skipped).

    An unchanged post isn't matched again; only matches of an edit that asked
    for it are finalised.
    """
    after = F.create_map(*[F.lit(x) for kv in CHAIN.items() for x in kv])[F.col("job_type")]
    go = F.when(F.col("job_type") == "index_post", ~F.col("skipped")).when(F.col("job_type") == "generate_matches", F.col("auto") & F.lit(auto_link_new)).otherwise(F.lit(False))
    return done.where(go).select("post_id", after.alias("job_type"), F.when(F.col("job_type") == "index_post", F.col("auto")).otherwise(F.lit(False)).alias("auto"))


def log_append(log: DataFrame, new: DataFrame, debug: bool = False) -> DataFrame:
    """The log with new entries; debug ones only where they are asked for."""
    return log.unionByName((new if debug else new.where("level <> 'debug'")).select(*log.columns))


def log_read(log: DataFrame, most: int = 100, level: str | None = None) -> DataFrame:
    """The newest entries, of one level if it is given."""
    rows = log if not level else log.where(F.col("level") == level)
    return rows.orderBy(F.desc("id")).limit(most)


def payload_flag(payload: Column, name: str) -> Column:
    """Whether a flag of a JSON payload is set; a broken payload has none."""
    return F.coalesce(F.get_json_object(payload, f"$.{name}").cast("int"), F.lit(0)) != 0
