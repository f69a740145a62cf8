"""Table schemas, statuses and their buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: DDL of each table; `empty(spark, name)` makes one without rows.
TABLES = {
    "posts": "post_id long, blog_id long, title string, content string, status string, type string, post_date timestamp, permalink string",
    "post_index": "post_id long, blog_id long, doc_vector array<double>, content_hash string, passage_count int, incoming_links int, outgoing_links int, max_outgoing_links int, indexed_at timestamp, updated_at timestamp",
    "passages": "passage_id long, post_id long, blog_id long, idx int, text string, vector array<double>",
    "opportunities": "id long, source_post_id long, target_post_id long, doc_similarity double, passage_similarity double, best_passage_id long, status string, anchor_text string, confidence double, signals struct<passage_score:double,anchor_spec:double,retrieval:string,ai_anchor:boolean,best_passage:string,reason:string,verified:boolean,reject_reason:string,rerank:struct<topic:boolean,product:boolean,jurisdiction:boolean,pair_score:int,anchor:string,anchor_score:int,grounded:string,reason:string>>, created_at timestamp",
    "links": "id long, source_post_id long, target_post_id long, anchor_text string, inserted_at timestamp, status string",
    "site_links": "source_post_id long, target_post_id long, blog_id long, anchor_text string, scanned_at timestamp",
    "queue": "id long, post_id long, job_type string, status string, attempts int, payload string, last_error string, created_at timestamp, updated_at timestamp",
    "logs": "id long, level string, message string, context string, created_at timestamp",
    "verdicts": "opportunity_id long, topic_match boolean, product_match boolean, jurisdiction_match boolean, pair_score int, anchor string, anchor_score int, reason string",
}

#: Each status with its bucket and label.
STATUSES = {
    "pending": ("working", "Pending"),
    "ready": ("review", "Ready"),
    "verified": ("review", "Verified"),
    "rewrite_suggested": ("excluded", "No usable anchor"),
    "no_anchor": ("excluded", "No anchor"),
    "inserted": ("live", "Inserted"),
    "rejected_relevance": ("excluded", "AI rejected"),
    "rejected": ("excluded", "Rejected"),
    "capped": ("excluded", "Over cap"),
    "reciprocal": ("excluded", "Reverse kept"),
    "low_relevance": ("excluded", "Low relevance"),
    "invalid": ("excluded", "Invalid"),
}
BUCKETS = ("review", "live", "excluded", "working")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def check(df: DataFrame, name: str) -> DataFrame:
    """The frame if it has the table's columns; ValueError names what is missing."""
    wanted = [c.split(" ", 1)[0] for c in _split(TABLES[name])]
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df


def _split(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:k].strip())
            at = k + 1
    return [*out, ddl[at:].strip()]


def status_table(spark: SparkSession, rerank: bool = False) -> DataFrame:
    """status, bucket, label; with the verification step on, `ready` is still in progress."""
    rows = [(s, "working" if rerank and s == "ready" else b, "Awaiting verification" if rerank and s == "ready" else x) for s, (b, x) in STATUSES.items()]
    return spark.createDataFrame(rows, "status string, bucket string, label string")
