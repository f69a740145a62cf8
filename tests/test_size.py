"""What steps move and hold must not grow faster than their input; the results are those of plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom import pipeline
from linkloom.functions import html as H, text as T, vectors as V
from linkloom.operators import placement, prepare
from linkloom.session import Workspace
from linkloom.settings import Settings


@pytest.mark.parametrize("by", ["s", "t"])
def test_parts_of_a_side_do_not_grow_with_the_vectors(spark, by):
    assert V.sides(spark, 20_000) == V.sides(spark, 1_000_000) and V.sides(spark, 100 * V.MOST_SIDE) == 100
    rng = np.random.default_rng(2)
    v = rng.normal(size=(900, 6))[rng.integers(0, 900, 1500)]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vector array<double>")
    got = {(r.s, r.t): r.sim for r in V.neighbours(df.where("id % 3 > 0"), df.where("id % 2 > 0"), 70, 5, by=by).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(np.clip((u @ u.T + 1) * 50, 0, 100), 2)
    want, (ones, others) = {}, ((3, 2) if by == "s" else (2, 3))
    for a in (k for k in range(1500) if k % ones):
        best = sorted((-sims[a, b], b) for b in range(1500) if b % others and a != b and sims[a, b] >= 70)[:5]
        want |= {((a, b) if by == "s" else (b, a)): -x for x, b in best}
    assert got == want


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_move_by_token_and_post_alone(spark):
    posts = spark.createDataFrame([(1, "Car Loans", "Car loans NASA nasa car loans rates"), (2, None, "rates of banks"), (3, "", None)], "post_id long, title string, content string")
    df = spark.createDataFrame([("car", 1), ("loans", 1), ("rates", 2), ("nasa", 1)], "token string, df long")
    n = spark.createDataFrame([(2,)], "n long")
    out = placement.candidates(posts, df, n)
    idf = {1: math.log(3 / 2) + 1, 0: math.log(3) + 1, 2: 1.0}
    got = {(r.post_id, r.phrase): (round(r.spec, 9), r.seq) for r in out.collect()}
    want = {(1, "car loans"): (idf[1] + 1.5, 1_000_000), (1, "loans nasa"): (idf[1], 2_000_001), (1, "nasa"): (idf[1] + 3, 3_000_000), (2, "banks"): (idf[0], 4_000_001)}
    assert {k: got.get(k) for k in want} == {k: (round(x, 9), y) for k, (x, y) in want.items()}
    assert (2, "rates") not in got and (1, "rates") not in got and (1, "car loans rates") in got
    exchanges = [x for x in _plan(out).splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and not any("phrase" in x for x in exchanges)


def test_means_and_best_passages_move_packed(spark):
    p = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.6, 0.8]), (1, 2, [0.6, 0.8]), (2, 0, [0.0, 1.0])], "post_id long, idx int, vector array<double>")
    docs = V.mean_of(p, "post_id")
    got = {r.post_id: r.vector for r in docs.collect()}
    assert got[2] == [0.0, 1.0] and np.allclose(got[1], [2.2 / 3, 1.6 / 3], atol=1e-15)
    mean = spark.createDataFrame([([0.1, 0.2],)], "mean array<double>")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 9), (9, 1)], "s long, t long")
    out = placement.best_passage(pairs, p, docs.withColumnRenamed("post_id", "id"), mean, 55)
    a, b = np.array([0.5, 0.6]), np.array([-0.1, 0.8])
    best = round((a @ b / np.linalg.norm(a) / np.linalg.norm(b) + 1) * 50, 2)
    rows = {(r.s, r.t): (r.idx, r.passage_score, r.status) for r in out.collect()}
    assert rows[1, 2] == (1, best, "ready") and rows[1, 9] == rows[9, 1] == (None, 0.0, "low_relevance") and rows[2, 1][0] == 0
    assert "Window" not in _plan(out) and "Generate" not in _plan(docs)


def test_texts_are_split_once_for_their_tokens(spark):
    class Seen:
        def cut(self, df):
            self.plan = _plan(df)
            return df

    ws = Seen()
    texts = spark.createDataFrame([(1, "One paragraph of words that is long enough."), (2, "short")], "post_id long, text string")
    df, n = T.document_frequency_of(texts.select("post_id", T.passages(F.col("text")).alias("passages")), ws)
    assert ws.plan.count("ArrowEvalPython") == 1
    assert n.first().n == 1 and {r.token for r in df.collect()} == {"one", "paragraph", "words", "that", "long", "enough"}


@pytest.mark.parametrize("anchor, passage, want", [("CAR loans", "Scar loans, car loans.", "car loans"), ("car loans", "car\nloans", "car\nloans"), ("a.b", "xa.b a.b", "a.b"), ("ÉTÉ", "en été", "été"), ("car", "cars scar", "")])
def test_ground_anchor_with_and_without_a_pattern(anchor, passage, want):
    assert H.ground_anchor(anchor, passage) == want


def test_pairs_carry_topics_not_texts(spark):
    posts = spark.createDataFrame([(1, "Loan Rates", "banks lend, banks borrow")], "post_id long, title string, content string")
    rows = prepare.topics(posts)
    assert [tuple(r) for r in rows.collect()] == [(1, "bank loan rat")]
    out = rows.select(prepare.refined(F.lit("x"), F.lit("Banks set loan rates."), "_topics").alias("a"), prepare.refined(F.lit(None).cast("string"), F.lit("Banks"), "_topics").alias("b")).first()
    assert (out.a, out.b) == (H.refine_anchor("x", "Banks set loan rates.", "Loan Rates", "banks lend, banks borrow"), None)


def test_links_are_prepared_from_all_of_a_text(spark):
    paragraphs = [f"Paragraph number {k} speaks of words enough." for k in range(70)]
    text = "\n\n".join(paragraphs)
    df = spark.createDataFrame([(1, "Long", text, "publish", "/1"), (2, "Short", paragraphs[69], "publish", "/2")], "post_id long, title string, content string, status string, permalink string")
    got = df.select(F.size(T.passages(F.col("content"))), F.size(T.all_passages(F.col("content")))).first()
    assert tuple(got) == (60, 70)
    assert pipeline.run(df, Settings(), Workspace(spark, "t")).passages.where("post_id = 1").count() == 70
