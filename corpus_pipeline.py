"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and works on all rows of its
predecessor. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.llm import bpe, langid, mixing, nearset, queries, secrets
from linkloom.session import Workspace


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or with an unclear language go; all others stay as they are."""
    model = langid.train(docs, langid.public_pieces(queries.vocabulary(queries.PIECES)))
    return langid.accepted(docs, model)


def _free(docs: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of docs has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id.

    Where a doc_id is null or comes twice, rows are told apart by numbers of
    their own, so that a row goes only if another with a near text stays. Texts
    without words stay.
    """
    ws, row = Workspace(spark, "pipeline-near"), _free(docs, "row_number")
    unclear = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").head(1)
    rows = ws.cut(docs.withColumn(row, F.monotonically_increasing_id())) if unclear else docs.withColumn(row, F.col("doc_id").cast("long"))
    groups = nearset.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), words=5, percent=80, ws=ws)
    gone = ws.cut(groups.where("not kept").select(F.col("doc_id").alias(row)))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found secret is masked, and n_chars is the masked text's."""
    out = secrets.redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none to three times, a repeat as a row of its own."""
    return mixing.repeated(docs, Workspace(spark, "pipeline-mix")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text for each row."""
    return bpe.encode(docs, queries.vocabulary(queries.VOCABULARY), digest=True)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix", mix),
    ("encode", encode),
]

#: Learnt models and sampling aren't expressible in SQL; tests/llm holds a run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        new = ws.cut(stage(spark, docs, sf_dir))
        ws.drop(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
