"""The registered queries of the corpus operators, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.llm import bpe, embeddings, langid, lm, media, mixing, nearset, passages, secrets, toxicity

#: Public vocabulary files, by their names in the installed package.
PIECES = "byte_bpe_multi_50k.tiktoken"
VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the words the mix takes of them; see mixing.mix."""
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with links and component at cosine 0.95; see embeddings.near_duplicates."""
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.95)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as PNG and read back; see media.encode and media.features."""
    return media.features(media.encode(_documents(spark, sf_dir))).drop("error")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of documents; see secrets.scan."""
    found = secrets.scan_documents(_documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.encode("base_spans", "utf-8"), 256).alias("base_sha256"), "spans")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages; see langid.train and langid.predict."""
    docs = _documents(spark, sf_dir)
    model = langid.train(docs, langid.public_pieces(vocabulary(PIECES)))
    return langid.predict(docs, model).select("doc_id", (~langid.is_training("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of documents; see lm.score."""
    return lm.score(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_backoff", F.round("logprob", 4).alias("logprob"), F.round("score", 6).alias("score"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of documents; see toxicity.train and toxicity.score."""
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", (~langid.is_training("doc_id")).alias("held_out"), "score", "predicted")


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words or more; see passages.near_duplicate_passages."""
    return passages.near_duplicate_passages(_documents(spark, sf_dir))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents at 0.85 on 3-word shingles; see nearset.near_duplicates."""
    return nearset.near_duplicates(_documents(spark, sf_dir), words=3, percent=85)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of token ids and decoded texts; see bpe.encode."""
    return bpe.encode(_documents(spark, sf_dir), vocabulary(VOCABULARY), digest=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_embedding_near_dedup, op3_media, op4_secrets, op5_language, op6_lm_scoring, op7_toxicity, op8_passages, op9_minhash, op10_bpe)}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_COMPONENTS = """
reach AS (
  SELECT id, id AS r FROM nodes
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a
)"""

OP2 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), nodes AS (
  SELECT id FROM v
), links AS (
  SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id AND list_cosine_similarity(x.e, y.e) >= 0.95
), {_COMPONENTS}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, min(r) AS component_id, min(r) = id AS kept
FROM reach GROUP BY id
"""

OP6 = rf"""
WITH w AS (
  SELECT doc_id, {_WORDS} AS words FROM documents
), g AS (
  SELECT doc_id, k, words[k] AS z, CASE WHEN k > 1 THEN words[k - 1] END AS y, CASE WHEN k > 2 THEN words[k - 2] END AS x
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS k FROM w)
), uni AS (
  SELECT z, count(*) AS c FROM g GROUP BY z
), uni_own AS (
  SELECT doc_id, z, count(*) AS c FROM g GROUP BY doc_id, z
), bi AS (
  SELECT y, z, count(*) AS c FROM g WHERE y IS NOT NULL GROUP BY y, z
), bi_own AS (
  SELECT doc_id, y, z, count(*) AS c FROM g WHERE y IS NOT NULL GROUP BY doc_id, y, z
), tri AS (
  SELECT x, y, z, count(*) AS c FROM g WHERE x IS NOT NULL GROUP BY x, y, z
), tri_own AS (
  SELECT doc_id, x, y, z, count(*) AS c FROM g WHERE x IS NOT NULL GROUP BY doc_id, x, y, z
), n AS (
  SELECT count(*) AS n FROM g
), counted AS (
  SELECT g.doc_id, g.k, uz.c AS c1, n.n, coalesce(t.c - tw.c, 0) AS c3, coalesce(b.c - bw.c, 0) AS c2, pb.c - pbw.c AS ctx2, py.c - pyw.c AS ctx1
  FROM g CROSS JOIN n JOIN uni uz ON g.z = uz.z
  LEFT JOIN bi b ON g.y = b.y AND g.z = b.z LEFT JOIN bi_own bw ON g.doc_id = bw.doc_id AND g.y = bw.y AND g.z = bw.z
  LEFT JOIN tri t ON g.x = t.x AND g.y = t.y AND g.z = t.z LEFT JOIN tri_own tw ON g.doc_id = tw.doc_id AND g.x = tw.x AND g.y = tw.y AND g.z = tw.z
  LEFT JOIN bi pb ON g.x = pb.y AND g.y = pb.z LEFT JOIN bi_own pbw ON g.doc_id = pbw.doc_id AND g.x = pbw.y AND g.y = pbw.z
  LEFT JOIN uni py ON g.y = py.z LEFT JOIN uni_own pyw ON g.doc_id = pyw.doc_id AND g.y = pyw.z
), s AS (
  SELECT doc_id, CASE WHEN c3 > 0 THEN ln(c3) - ln(ctx2) WHEN c2 > 0 THEN ln(c2) - ln(ctx1) + CASE WHEN k > 2 THEN ln(0.4) ELSE 0 END
      ELSE ln(c1) - ln(n) + CASE WHEN k > 2 THEN 2 * ln(0.4) WHEN k > 1 THEN ln(0.4) ELSE 0 END END AS p,
    CASE WHEN (k > 2 AND c3 = 0) OR (k = 2 AND c2 = 0) THEN 1 ELSE 0 END AS fell FROM counted
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(sum(s.fell), 0)::BIGINT AS n_backoff, round(coalesce(sum(s.p), 0), 4) AS logprob, round(sum(s.p) / len(w.words), 6) AS score
FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id, w.words
"""

OP9 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id AS id, {_WORDS} AS words FROM documents
), sets AS (
  SELECT id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda k: words[k] || ' ' || words[k + 1] || ' ' || words[k + 2])) END AS s FROM w
), sh AS (
  SELECT id, len(s) AS n, unnest(s) AS t FROM sets
), pairs AS (
  SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS c FROM sh x JOIN sh y ON x.t = y.t AND x.id < y.id AND 100 * x.n >= 85 * y.n AND 100 * y.n >= 85 * x.n GROUP BY ALL
), half AS (
  SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c)
), links AS (
  SELECT a, b FROM half UNION ALL SELECT b, a FROM half
), nodes AS (
  SELECT id FROM sets
), {_COMPONENTS}
SELECT reach.id AS doc_id, any_value(len(s))::BIGINT AS n_shingles, min(r) AS component_id, min(r) = reach.id AS kept
FROM reach JOIN sets ON reach.id = sets.id GROUP BY reach.id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_near_dedup": OP2, "op6_lm_scoring": OP6, "op9_minhash": OP9}
