"""Index, jobs, judgements, preparing, insertion, removal: small tables with known results."""

import json

import pytest
from pyspark.sql import functions as F

from linkloom import registry, schema
from linkloom.functions import html as H, providers
from linkloom.operators import analytics, index as I, insertion, jobs, linkscan, resolve, worklists as W
from linkloom.session import Workspace
from linkloom.settings import Settings

D = "/root/testdata/sf0.001"
OPPS = "id long, s long, t long, sim double, status string, confidence int, anchor string, sentence string"


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def site(spark):
    posts = [
        (1, "Car Loans", "<p>Our guide to home insurance and car rental helps. Compare home insurance today.</p>", "publish", "/1"),
        (2, "Home Insurance", "<p>Pay your car loans early, then see car rental.</p>", "publish", "/2"),
        (3, "Car Rental", "<h2>car loans</h2>", "publish", "/3"),
    ]
    return spark.createDataFrame(posts, "post_id long, title string, content string, status string, permalink string")


def test_insert_and_remove(spark, site):
    ws, s = Workspace(spark, "t"), Settings(link_word_gap=0)
    opps = spark.createDataFrame(
        [
            (1, 1, 2, 70.0, "ready", 80, "home insurance", None), (2, 2, 1, 70.0, "ready", 75, "car loans", None), (3, 1, 3, 60.0, "verified", 70, "car rental", None), (4, 3, 1, 60.0, "ready", 90, "car loans", None),
            (5, 2, 3, 60.0, "rejected", 90, "car rental", None), (6, 3, 2, 60.0, "ready", 90, "", None), (7, 9, 1, 60.0, "ready", 90, "x", None),
        ],
        OPPS,
    )
    links = spark.createDataFrame([(90, 2, 3, "old", "removed")], "id long, s long, t long, anchor string, status string").withColumn("inserted_at", F.lit("2024-01-01").cast("timestamp"))
    index = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "post_id long, incoming_links int, outgoing_links int")
    got = insertion.insert_links(opps.select("id"), opps, links, site, s, ws, F.lit("2024-01-20").cast("timestamp"), index)
    # Row 4 finds no place (a heading), so the pair's other row, 3, has its turn.
    assert {r.id: r.outcome for r in got.results.collect()} == {1: "inserted", 2: "reciprocal", 3: "inserted", 4: "not_found", 5: "decided", 6: "no_anchor"}
    assert {r.id: r.status for r in got.opportunities.collect()} == {1: "inserted", 2: "reciprocal", 3: "inserted", 4: "ready", 5: "rejected", 6: "ready", 7: "ready"}
    page = {r.post_id: r.content for r in got.posts.collect()}
    assert page[1].count("<a ") == 2 and '<a href="/2" ' in page[1] and page[3] == "<h2>car loans</h2>"
    assert {tuple(r) for r in got.index.collect()} == {(1, 0, 3), (2, 1, 0)}
    after, now = ws.cut(got.links), ws.cut(got.posts)
    assert sorted(r.status for r in after.collect()) == ["active", "active", "removed"]
    again = insertion.insert_links(opps.where("id = 2").select("id", F.lit("car loans").alias("override")), opps, after, now, s, ws, F.lit("2024-01-20").cast("timestamp"))
    assert rows(again.results.select("outcome")) == [("reciprocal",)]
    summary, back = insertion.remove_links(after, got.opportunities, now, ws, got.index)
    assert rows(summary) == [(2, 1, 0)] and {r.post_id: r.content for r in back.posts.collect()} == {r.post_id: r.content for r in site.collect()}
    assert {r.id: r.status for r in back.opportunities.collect()}[1] == "verified" and {tuple(r) for r in back.index.collect()} == {(1, 0, 1), (2, 0, 0)}
    gone, _ = insertion.remove_links(after, got.opportunities, now.withColumn("content", F.lit("x")), ws)
    assert rows(gone) == [(0, 0, 2)]


def test_prepared_rows_against_plain_functions(spark):
    from linkloom import catalog

    got = {r.id: r for r in catalog.prepare_opportunities(spark, D).collect()}
    opps = {r.id: r for r in registry._opps(spark, D).collect()}
    posts = {r.post_id: r for r in registry._posts(spark, D).collect()}
    passages = {(r.post_id, r.idx): r.text for r in registry._passages(spark, D).collect()}
    assert set(got) == set(opps)
    for k, r in got.items():
        o = opps[k]
        if o.status not in W.PREPARABLE:
            assert (r.status, r.confidence) == (o.status, o.confidence)
        elif o.s not in posts or o.t not in posts:
            assert r.status == "invalid"
        elif r.status == "low_relevance":
            assert r.passage_score < 55 and r.anchor is None
        elif r.status == "ready":
            text = passages[o.s, r.idx]
            assert r.passage_score >= 55 and r.anchor in text and 20 <= r.confidence <= 96 and len(r.anchor) <= 255
            assert H.refine_anchor(r.anchor, text, posts[o.t].title, posts[o.t].content).count(" ") <= max(5, r.anchor.count(" "))
        else:
            assert r.status in ("no_anchor", "invalid")
    states = {r.status for r in got.values()}
    assert {"ready", "no_anchor", "low_relevance", "invalid"} <= states
    kept = {r.id: r for r in catalog.insert_links(spark, D).collect()}
    assert {r.outcome for r in kept.values()} <= {"inserted", "reciprocal", "not_found"} and sum(r.outcome == "inserted" for r in kept.values()) > 20
    ((removed, pages, missing, _),) = rows(catalog.remove_links(spark, D))
    assert removed == sum(r.outcome == "inserted" for r in kept.values()) and missing == 0 and pages > 0


def test_pipeline_from_posts_to_links(spark):
    from linkloom import pipeline

    posts = registry._posts(spark, D)
    got = pipeline.run(posts, Settings(use_ai_rerank=True), Workspace(spark, "t"), providers.RuleJudge(), F.lit("2024-01-20").cast("timestamp"))
    opps = got.opportunities.collect()
    kept = {(r.s, r.t) for r in opps if r.status in ("verified", "inserted")}
    assert kept and not any((t, s) in kept for s, t in kept)
    per: dict = {}
    for s, _ in kept:
        per[s] = per.get(s, 0) + 1
    assert max(per.values()) <= 2
    links, pages = got.links.collect(), {r.post_id: r.content for r in got.posts.collect()}
    assert len(links) == sum(r.status == "inserted" for r in opps) and all(f'href="/d/{r.t}"' in pages[r.s] for r in links)


def test_providers(spark):
    assert providers.parse_json('x {"a": {"b": 1}} y') == {"a": {"b": 1}}
    for bad in ("", "{", "[1, 2]", None):
        with pytest.raises(ValueError):
            providers.parse_json(bad)
    v = providers.read_verdict(json.dumps({"topic_match": 1, "pair_score": "140", "anchor": " a "}))
    assert (v["topic_match"], v["product_match"], v["jurisdiction_match"], v["pair_score"], v["anchor"], v["anchor_score"]) == (True, True, True, 100, "a", 0)
    assert providers.read_pick('{"anchor": "<b>x</b>  y"}', "s") == {"anchor": "x y", "sentence": "s", "rewrite": False, "confidence": 0}
    seen = []

    class Model:
        def embed_batch(self, texts):
            seen.append(len(texts))
            return [[float(len(t))] if t else None for t in texts]

        def pick(self, sentence, title):
            if title == "down":
                raise RuntimeError("no answer")
            return json.dumps({"anchor": "Car Loans", "sentence": sentence, "confidence": 40})

        def judge(self, context):
            assert len(context["passage"]) <= 800 and len(context["target_excerpt"]) <= 600
            return "no" if context["target_title"] == "bad" else json.dumps({"topic_match": True, "pair_score": 80, "anchor": "CAR loans"})

    texts = spark.createDataFrame([(k, "y" * k) for k in (0, 5, 9000)], "id long, text string")
    assert sorted((r.id, r.vector) for r in providers.embed(texts, Model()).collect()) == [(0, None), (5, [5.0]), (9000, [8000.0])]
    ask = spark.createDataFrame([(1, "See car loans now.", "Loans"), (2, "None here.", "Loans"), (3, "See car loans.", "down")], "id long, passage string, target_title string")
    assert {(r.id, r.anchor, r.ai_confidence, r.error) for r in providers.pick_anchors(ask, Model()).collect()} == {(1, "Car Loans", 40, None), (2, None, None, None), (3, None, None, "no answer")}
    pairs = spark.createDataFrame([(1, "S", "Good car loans " + "x" * 900, "car", "Car Loans", "e" * 700, ""), (2, "S", "p", None, "bad", None, None)], "id long, source_title string, passage string, anchor string, target_title string, target_excerpt string, target_content string")
    got = {r.id: r for r in providers.judge_pairs(pairs, Model()).collect()}
    assert got[1].grounded == "car loans" and got[1].pair_score == 80 and got[2].error and got[2].pair_score is None
    words = providers.HashedEmbeddings().embed_batch(["alpha beta", ""])
    own = registry.V.hashed_embedding(spark.createDataFrame([(1, ["alpha", "beta"])], "id long, tok array<string>"), ["id"], "tok").first().vector
    assert words[0] == pytest.approx(own) and words[1] == [0.0] * 64


def test_jobs(spark):
    q = spark.createDataFrame([(1, 7, "a", "pending", 0, False), (2, 7, "a", "done", 1, False), (3, None, "a", "pending", 2, False), (4, 8, "b", "processing", 3, True)], "id long, post_id long, job_type string, status string, attempts int, auto boolean")
    now = F.lit("2024-01-20").cast("timestamp")
    new = spark.createDataFrame([(10, 7, "a", True), (11, 9, "a", False), (12, 9, "a", True), (13, None, "a", False), (14, None, "a", False)], "id long, post_id long, job_type string, auto boolean")
    got = {(r.id, r.auto) for r in jobs.enqueue(q.withColumn("created_at", now), new.withColumn("created_at", now)).collect()}
    assert got == {(1, True), (2, False), (3, False), (4, True), (11, True), (13, False), (14, False)}
    assert [(r.id, r.status, r.attempts) for r in jobs.claim(q, 1).collect()] == [(1, "processing", 1)]
    ran = spark.createDataFrame([(1, None), (3, "x"), (4, "y")], "id long, error string")
    assert {r.id: (r.status, r.last_error) for r in jobs.finish(q, ran).collect()} == {1: ("done", None), 2: ("done", None), 3: ("pending", "x"), 4: ("failed", "y")}
    done = spark.createDataFrame([(1, "index_post", True, False), (2, "index_post", False, True), (3, "generate_matches", True, False), (4, "generate_matches", False, False), (5, "finalize_post", True, False)], "post_id long, job_type string, auto boolean, skipped boolean")
    assert {tuple(r) for r in jobs.next_jobs(done, True).collect()} == {(1, "generate_matches", True), (3, "finalize_post", False)}
    assert jobs.next_jobs(done, False).count() == 1


def test_index_state(spark, tmp_path):
    index = spark.createDataFrame([(1, 1, 1), (2, 0, 5), (3, 2, 0)], "post_id long, incoming_links int, outgoing_links int")
    links = spark.createDataFrame([(1, 1, 3, "active"), (2, 2, 3, "active"), (3, 3, 1, "removed")], "id long, s long, t long, status string")
    after = I.delete_posts({"index": index, "links": links, "opportunities": links}, spark.createDataFrame([(2,)], "post_id long"))
    assert {tuple(r) for r in after["index"].collect()} == {(1, 1, 1), (3, 1, 0)} and [r.id for r in after["links"].orderBy("id").collect()] == [1, 3]
    posts = spark.createDataFrame([(1, "publish"), (3, "draft")], "post_id long, status string")
    checked, counted = I.health(links, posts, index)
    assert {r.id: r.status for r in checked.collect()} == {1: "broken", 2: "broken", 3: "removed"} and {tuple(r) for r in counted.collect()} == {(1, 1, 0), (2, 0, 4), (3, 0, 0)}
    with pytest.raises(ValueError, match="lacks"):
        schema.check(index, "posts")
    analytics.export_json(index.withColumn("x", F.lit(None).cast("string")), str(tmp_path / "out"))
    assert "null" in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    o = spark.createDataFrame([(1, 1, 2, "ready"), (2, 2, 3, "verified"), (3, 3, 4, "pending"), (4, None, 1, "ready")], "id long, s long, t long, status string")
    assert sorted(r.id for r in resolve.on_trash(o, spark.createDataFrame([(2,), (4,), (4,)], "id long")).collect()) == [2, 4]


def test_resolve_addresses(spark):
    posts = spark.createDataFrame([(k, "publish", "post", p) for k, p in ((1, "/p1/"), (7, "/x"), (8, "/a b"))] + [(9, "draft", "post", "/d")], "post_id long, status string, type string, permalink string")
    hrefs = ["mailto:x", "#t", "slug/", "//www.site/p1/", "/P1", "?p=7", "https://other/p1", "/a%20b", "/d", "https://SITE/x?y=1", ""]
    links = spark.createDataFrame([(100 + k, 0, h, "a") for k, h in enumerate(hrefs)], "post_id long, pos int, href string, anchor string")
    assert {(hrefs[r.source - 100], r.target) for r in linkscan.resolve(links, posts, "www.site").collect()} == {("//www.site/p1/", 1), ("/P1", 1), ("?p=7", 7), ("/a%20b", 8), ("https://SITE/x?y=1", 7)}


def test_streaming_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert registry.stream_ingest(spark, str(tmp_path)).count() == 0
