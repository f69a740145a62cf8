"""Queries on the engine's state: index, work lists, jobs, judgements, insertion, graph, exports.

Their state is derived from the corpus tables by ids, so that SQL can hold them
to account; see `catalog_sql`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom import registry as R, schema
from linkloom.functions import providers, text as T, vectors as V
from linkloom.operators import analytics, graph, index as I, insertion, jobs, linkscan, matching, placement, prepare, resolve, worklists as W
from linkloom.session import Workspace
from linkloom.settings import Settings
from linkloom.sources.adapters import table

S = R.S


def _as_of():
    return F.lit(R.AS_OF).cast("timestamp")


# State ------------------------------------------------------------------------


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Inserted links with anchors and times derived from their ids."""
    return R._links(spark, d).select("id", "s", "t", F.concat(F.lit("anchor "), (F.col("id") % 7).cast("string")).alias("anchor"), F.timestamp_seconds(F.col("id") * 60 % 1000003).alias("inserted_at"), "status")


def _index(spark: SparkSession, d: str) -> DataFrame:
    """post_id, content_hash, passage_count, counters of active links, own limits, indexed_at (null for every eleventh)."""
    from linkloom.streaming.ingest import index_rows

    rows = index_rows(R._posts(spark, d)).select("post_id", "content_hash", "passage_count")
    counted = linkscan.counters(R._links(spark, d), rows.select("post_id"))
    at = F.when(F.col("post_id") % 11 != 0, F.timestamp_seconds(F.col("post_id") * 60))
    return rows.join(counted, "post_id").select("post_id", "content_hash", "passage_count", F.col("incoming_links").cast("int").alias("incoming_links"), F.col("outgoing_links").cast("int").alias("outgoing_links"), (1 + F.col("post_id") % 3).cast("int").alias("max_outgoing_links"), at.alias("indexed_at"))


def _site(spark: SparkSession, d: str) -> DataFrame:
    return R.resolved_links(spark, d).select(F.col("source").alias("s"), F.col("target").alias("t"), "anchor")


def _queue(spark: SparkSession, d: str) -> DataFrame:
    return R._queue(spark, d).withColumn("auto", F.col("id") % 5 == 0)


def _log(spark: SparkSession, d: str) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, ("debug", "info", "warning", "error"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), level.alias("level"), F.col("event_type").alias("message"), F.col("ts").alias("created_at"))


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    return R._posts(spark, d).select("post_id")


# Index --------------------------------------------------------------------------


def source_eligible(spark, d):
    """Posts that may get another outgoing link by their own limit."""
    return I.source_eligible(_index(spark, d))


def match_own_limits(spark, d):
    """Matches whose source is below its own limit and whose target is published; strong ones both ways."""
    live = R._posts(spark, d).where("status = 'publish'").select(F.col("post_id").alias("id"))
    return matching.eligible(R.match_topk(spark, d), I.source_eligible(_index(spark, d)), live, S)


def index_upsert(spark, d):
    """The index after every third post was indexed anew: new hash and count, old counters."""
    index = _index(spark, d)
    new = index.where("post_id % 3 = 0").select("post_id", F.md5("content_hash").alias("content_hash"), (F.col("passage_count") + 1).alias("passage_count"), F.lit(0).alias("incoming_links"), F.lit(0).alias("outgoing_links"), F.lit(S.max_outgoing_links).alias("max_outgoing_links"), F.timestamp_seconds(F.lit(0)).alias("indexed_at"))
    return I.upsert(index.where("post_id % 2 = 0"), new).select("post_id", "content_hash", "passage_count", "incoming_links", "outgoing_links", "max_outgoing_links")


def index_stubs(spark, d):
    """Index rows with stubs for link ends that have none."""
    links = _links(spark, d)
    ends = links.select(F.col("s").alias("post_id")).union(links.select("t"))
    return I.with_stubs(_index(spark, d).where("post_id % 4 <> 1"), ends, S.max_outgoing_links).select("post_id", "passage_count", "max_outgoing_links")


def replace_passages(spark, d):
    """Passages after every fifth post was split anew into its even passages."""
    p = R._passages(spark, d).select("post_id", "idx", "text", F.array(F.lit(1.0)).alias("vector"))
    new = p.where("post_id % 5 = 0").withColumn("vector", F.when(F.col("idx") % 2 == 0, F.col("vector")).otherwise(F.array().cast("array<double>")))
    return I.replace_passages(p, new, _numbers(spark, d).where("post_id % 5 = 0")).select("post_id", "idx", "text")


def delete_index(spark, d):
    return I.without(_index(spark, d), _numbers(spark, d).where("post_id % 6 = 5"), "post_id").select("post_id", "content_hash")


def delete_cascade(spark, d):
    """Rows of each table after every tenth post was deleted, and the counters of the rest."""
    tables = {"index": _index(spark, d), "links": _links(spark, d), "opportunities": R._opps(spark, d), "site_links": _site(spark, d), "queue": _queue(spark, d), "passages": R._passages(spark, d)}
    after = I.delete_posts(tables, _numbers(spark, d).where("post_id % 10 = 7"))
    out = after["index"].agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("incoming_links") * 1000 + F.col("outgoing_links")).alias("counters")).select(F.lit("index").alias("table"), "n", "counters")
    for name in ("links", "opportunities", "site_links", "queue", "passages"):
        out = out.union(after[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name), "n", F.lit(None).cast("long")))
    return out


def trash_jobs(spark, d):
    """Jobs after every tenth post was trashed: its unfinished ones go."""
    q = _queue(spark, d)
    gone = q.where(F.col("status").isin(*jobs.UNFINISHED) & (F.col("post_id") % 10 == 3)).select("id")
    return q.join(gone, "id", "left_anti").groupBy("job_type", "status").agg(F.count(F.lit(1)).alias("n"))


def reset_data(spark, d):
    """All tables after a reset: their columns, and no rows."""
    out = None
    for name in schema.TABLES:
        df = schema.check(schema.empty(spark, name), name)
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), F.lit(len(df.columns)).alias("columns"), "n")
        out = one if out is None else out.union(one)
    return out


def doc_vectors_with_title(spark, d):
    """Checksums of document vectors: means of title and passages."""
    posts = R._posts(spark, d)
    _, means = I.document_vectors(posts, R._passages(spark, d))
    return means.select("id", F.posexplode("vector").alias("pos", "x")).groupBy("id").agg(F.round(F.sum(F.col("x").cast("decimal(28,18)") * (F.col("pos") + 1)).cast("double"), 6).alias("weighed"))


def decoded_vectors(spark, d):
    """Vectors after a way through JSON; every seventh is an empty list, every ninth no list at all."""
    text = F.when(F.col("vec_id") % 9 == 0, "none").when(F.col("vec_id") % 7 == 0, "[]").otherwise(F.to_json(F.transform("embedding", lambda x: x.cast("double"))))
    return table(spark, d, "embeddings").select("vec_id", I.decode_vector(text).alias("v")).select("vec_id", F.coalesce(F.size("v"), F.lit(0)).alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# Lists ----------------------------------------------------------------------------


def prepare_batch(spark, d):
    return W.prepare_batch(R._opps(spark, d), S).select("id", "sim")


def verify_batch(spark, d):
    return W.verify_batch(R._opps(spark, d)).select("id", "confidence")


def insert_batch(spark, d):
    return W.insert_batch(R._opps(spark, d), S).select("id", "confidence")


def auto_insert_batch(spark, d):
    return W.auto_insert_batch(R._opps(spark, d), S).select("id", "confidence")


def latest_links(spark, d):
    return W.latest_links(_links(spark, d), R._posts(spark, d)).select("id", "anchor", "status", "source_title", "target_title")


def recent_index(spark, d):
    return W.recent_index(_index(spark, d), R._posts(spark, d), page=2).select("post_id", "title", "passage_count", "incoming_links")


def _page_index(spark, d):
    """An index of the pages, for orphans by scan."""
    return R._pages(spark, d).where("post_id % 3 > 0").select("post_id", (F.col("post_id") % 9).cast("int").alias("passage_count"), (F.col("post_id") % 2).cast("int").alias("incoming_links"), F.timestamp_seconds("post_id").alias("indexed_at"))


def orphan_page_scan(spark, d):
    return W.orphan_page(R._pages(spark, d), _page_index(spark, d), _site(spark, d), 50, 10)


def orphan_page_counters(spark, d):
    return W.orphan_page(R._pages(spark, d), _page_index(spark, d), None, 50, 10)


def orphan_counts(spark, d):
    args = R._pages(spark, d), _page_index(spark, d)
    by_scan, by_counters = W.orphan_count(*args, _site(spark, d)), W.orphan_count(*args, None)
    return by_scan.select(F.lit("scan").alias("mode"), "n").union(by_counters.select(F.lit("counters"), "n"))


def excerpts(spark, d):
    return W.excerpts(R._posts(spark, d), R._passages(spark, d))


def actions(spark, d):
    return W.actions(R._opps(spark, d), rerank=True)


def _signals(spark, d):
    """Signals of rows: judged ones, ones of the older form, none."""
    o = R._opps(spark, d)
    judged = F.to_json(F.struct((F.col("sim")).alias("passage_score"), F.struct((F.col("id") % 101).cast("int").alias("pair_score"), (F.col("id") % 7).cast("int").alias("anchor_score"), F.concat(F.lit("a"), F.col("s").cast("string")).alias("grounded"), F.lit("fits").alias("reason")).alias("rerank")))
    return o.select("id", F.when(F.col("id") % 3 == 0, judged).when(F.col("id") % 3 == 1, '{"rerank_reason":"old form"}').alias("signals"))


def review_fields(spark, d):
    return W.review_fields(_signals(spark, d))


def steps_done(spark, d):
    posts, index, queue, opps = R._posts(spark, d), _index(spark, d), _queue(spark, d), R._opps(spark, d)
    done = [(False, queue, opps), (True, queue.where("status = 'done'"), opps.where("status <> 'ready'")), (False, queue.where("status = 'failed'"), opps.where("status <> 'pending'"))]
    out = None
    for k, (rerank, q, o) in enumerate(done):
        one = W.steps_done(posts, index.withColumn("indexed_at", F.timestamp_seconds("post_id")) if k else index, q, o, rerank).select(F.lit(k).alias("case"), "indexed_done", "prepared_done", "verified_done")
        out = one if out is None else out.union(one)
    return out


def statuses_of_buckets(spark, d):
    """Statuses of each bucket, with and without verification."""
    one, two = (schema.status_table(spark, r).groupBy("bucket").agg(F.array_join(F.array_sort(F.collect_list("status")), ",").alias("statuses")).select(F.lit(r).alias("rerank"), "bucket", "statuses") for r in (False, True))
    return one.union(two)


def touching_posts(spark, d):
    return W.touching(R._opps(spark, d), R._vectors(spark, d).select("id").where("id % 10 = 4")).select("id", "status")


def title_contains(spark, d):
    posts = R._posts(spark, d)
    return posts.where(W.contains_fragment(F.col("title"), "The") | W.contains_fragment(F.col("title"), "100%_")).select("post_id")


def finalize_post(spark, d):
    """What an edited post's open rows become: all that touch it, finalised."""
    o = W.touching(R._opps(spark, d), R._vectors(spark, d).select("id").where("id % 10 = 4"))
    return resolve.finalize(o, R._outgoing(spark, d), S).select("id", "status", "confidence")


def reject(spark, d):
    o = R._opps(spark, d)
    return resolve.reject(o, o.where("id % 13 = 0").select("id")).select("id", "status")


def reapply_and_resolve(spark, d):
    o = R._opps(spark, d)
    return resolve.reapply_and_resolve(o, R._verdicts(o.where("id % 2 = 1")), R._outgoing(spark, d), S).select("id", "status", "confidence")


def reapply_protected(spark, d):
    o = R._opps(spark, d)
    return resolve.reapply_and_resolve(o, R._verdicts(o.where("id % 2 = 1")), R._outgoing(spark, d), S, protect_decided=True).select("id", "status", "confidence")


# Jobs -------------------------------------------------------------------------------


def enqueue(spark, d):
    """The queue after jobs for every post of the corpus came twice, once for an edit."""
    q, posts = _queue(spark, d), _numbers(spark, d)
    new = posts.select((F.col("post_id") * 2 + 10000000).alias("id"), "post_id", F.lit("click").alias("job_type"), F.lit(False).alias("auto"), _as_of().alias("created_at"))
    new = new.union(posts.where("post_id % 2 = 0").select(F.col("post_id") * 2 + 10000001, "post_id", F.lit("click"), F.lit(True), _as_of()))
    return jobs.enqueue(q.select("id", "post_id", "job_type", "status", "attempts", "auto", "created_at"), new).select("id", "post_id", "job_type", "status", "auto")


def queue_retry(spark, d):
    """The queue after the claimed jobs ran; every third failed."""
    q = _queue(spark, d)
    ran = q.where("status = 'processing'").select("id", F.when(F.col("id") % 3 == 0, "no answer").alias("error"))
    return jobs.finish(q, ran).groupBy("status", "attempts", "last_error").agg(F.count(F.lit(1)).alias("n"))


def queue_release(spark, d):
    q = _queue(spark, d)
    return jobs.release(q, q.where("id % 2 = 1").select("id")).groupBy("status", "attempts").agg(F.count(F.lit(1)).alias("n"))


def job_chain(spark, d):
    """Jobs that follow the done ones; types and flags by id."""
    kind = F.element_at(F.array(*map(F.lit, ("index_post", "generate_matches", "finalize_post"))), (F.floor(F.col("id") / 4) % 3 + 1).cast("int"))
    done = _queue(spark, d).where("status = 'done'").select("post_id", kind.alias("job_type"), "auto", (F.col("id") % 8 == 2).alias("skipped"))
    return jobs.next_jobs(done, S.auto_link_new).groupBy("job_type", "auto").agg(F.count(F.lit(1)).alias("n"))


def job_payloads(spark, d):
    payload = F.when(F.col("id") % 3 == 0, '{"auto":1}').when(F.col("id") % 3 == 1, '{"auto":0}').otherwise("{broken")
    return R._queue(spark, d).groupBy(jobs.payload_flag(payload, "auto").alias("auto")).agg(F.count(F.lit(1)).alias("n"))


def log_append(spark, d):
    log = _log(spark, d)
    return jobs.log_append(log.where("id % 2 = 0"), log.where("id % 2 = 1")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def log_read(spark, d):
    return jobs.log_read(_log(spark, d), 100, "warning").select("id", "level", "message")


def log_retention(spark, d):
    return analytics.retention(_log(spark, d), _as_of(), 5).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


# Judgements ---------------------------------------------------------------------------


def json_replies(spark, d):
    """Replies read as JSON objects: whole, with words around, broken; none for the last kind."""

    @F.pandas_udf("pair_score int, topic boolean, product boolean, anchor string")
    def read(s):
        import pandas as pd

        rows = []
        for reply in s:
            try:
                v = providers.read_verdict(reply)
                rows.append((v["pair_score"], v["topic_match"], v["product_match"], v["anchor"]))
            except ValueError:
                rows.append((None, None, None, None))
        return pd.DataFrame(rows, columns=["pair_score", "topic", "product", "anchor"]).astype({"pair_score": "Int32", "topic": "boolean", "product": "boolean"})

    k, score = F.col("item_id"), (F.col("item_id") * 7 - 20).cast("string")
    body = F.concat(F.lit('{"topic_match": true, "pair_score": '), score, F.lit(', "anchor": " a '), k.cast("string"), F.lit(' ", "product_match": '), F.when(k % 2 == 0, "null").otherwise("false"), F.lit("}"))
    reply = F.when(k % 4 == 0, body).when(k % 4 == 1, F.concat(F.lit("Sure: "), body, F.lit(" done"))).when(k % 4 == 2, F.lit("{broken")).otherwise(F.lit("[1]"))
    return table(spark, d, "benchmark").select("item_id", read(reply).alias("v")).select("item_id", "v.*")


def _prepared(spark, d):
    """All inputs of preparing, written once: passages, vectors, means, candidates."""
    ws = Workspace(spark, "prepare")
    posts, passages = R._posts(spark, d), ws.cut(R._passages(spark, d, T.all_passages))
    vectors, documents = map(ws.cut, I.document_vectors(posts, passages))
    mean = ws.cut(V.mean_vector(documents, [], "vector"))
    df, n = T.document_frequency(passages, ws)
    n = ws.cut(n)
    return ws, posts, passages, vectors, documents, mean, ws.cut(placement.candidate_lists(R._matchable(spark, d, posts), ws.cut(df), n)), n


def _prepare(spark, d, s: Settings = S, judge=None):
    ws, posts, passages, vectors, documents, mean, cands, n = _prepared(spark, d)
    return ws, posts, passages, ws.cut(prepare.prepare(R._opps(spark, d), posts, passages, vectors, documents, mean, cands, n, s, judge))


def prepare_opportunities(spark, d):
    """All rows prepared: status, passage, anchor, confidence."""
    return _prepare(spark, d)[3].select("id", "s", "t", "status", "anchor", "confidence", "passage_score", "idx", "spec", "reason")


def prepare_with_judge(spark, d):
    """The same where an offline judge picks anchors for rows without one."""
    return _prepare(spark, d, S.update(use_ai_anchor=True), providers.RuleJudge())[3].select("id", "status", "anchor", "confidence", "ai_anchor")


def _judged(spark, d):
    s = S.update(use_ai_rerank=True)
    ws, posts, passages, rows = _prepare(spark, d, s)
    titles = posts.select("post_id", "title", "content")
    ready = rows.where("status = 'ready' and sentence is not null").join(titles.select(F.col("post_id").alias("s"), F.col("title").alias("source_title")), "s")
    ready = ready.join(titles.select(F.col("post_id").alias("t"), F.col("title").alias("target_title"), F.col("content").alias("target_content")), "t")
    ready = ready.join(W.excerpts(posts, passages).select(F.col("post_id").alias("t"), F.col("excerpt").alias("target_excerpt")), "t")
    verdicts = ws.cut(providers.judge_pairs(ready.withColumn("passage", F.col("sentence")), providers.RuleJudge()))
    return s, ws, posts, rows, verdicts


def judge_pairs(spark, d):
    """Verdicts of the offline judge on all ready rows."""
    return _judged(spark, d)[4].select("id", "topic_match", "product_match", "jurisdiction_match", "pair_score", "anchor", "grounded", "error")


# Insertion ----------------------------------------------------------------------------


def _inserted(spark, d):
    ws, posts, _, rows = _prepare(spark, d)
    free = _links(spark, d).where("false")
    kept = ws.cut(resolve.enforce_caps(resolve.resolve_reciprocal(rows), R._outgoing(spark, d).withColumn("n_out", F.lit(0)), S))
    return ws, posts, kept, insertion.insert_links(kept.where("status = 'ready'").select("id"), kept, free, posts, S, ws, _as_of(), _index(spark, d))


def insert_links(spark, d):
    """What became of each kept row: inserted, reciprocal, not found."""
    return _inserted(spark, d)[3].results


def insert_counters(spark, d):
    """Counters after insertion."""
    return _inserted(spark, d)[3].index.select("post_id", "incoming_links", "outgoing_links")


def remove_links(spark, d):
    """Numbers of removed and missing links after all that was inserted was taken out, and of pages that are as before."""
    ws, posts, _, got = _inserted(spark, d)
    links, after = ws.cut(got.links), ws.cut(got.posts)
    summary, back = insertion.remove_links(links, got.opportunities, after, ws)
    same = back.posts.join(posts.select("post_id", F.col("content").alias("old")), "post_id").agg(F.count(F.when(~F.lower("content").eqNullSafe(F.lower("old")), 1)).alias("changed_pages"))
    return summary.crossJoin(same)


def run_pipeline(spark, d):
    """From posts to links: matched, prepared, judged, reciprocal pairs and caps resolved, sure ones inserted."""
    from linkloom.pipeline import run

    return run(R._posts(spark, d), S.update(use_ai_rerank=True), Workspace(spark, "pipeline-links"), providers.RuleJudge()).opportunities.select("id", "s", "t", "status", "anchor", "confidence")


# Graph and exports ----------------------------------------------------------------------


def _nodes(spark, d):
    return _index(spark, d).where("indexed_at is not null").select(F.col("post_id").alias("id"))


def graph_link_edges(spark, d):
    return graph.edges_of("links", R._opps(spark, d), _links(spark, d), _nodes(spark, d))


def graph_both_edges(spark, d):
    return graph.edges_of("both", R._opps(spark, d), _links(spark, d), _nodes(spark, d))


def graph_nodes(spark, d):
    return graph.nodes_of(_index(spark, d), R._posts(spark, d), graph.edges(R._opps(spark, d), _nodes(spark, d)), orphans=False)


def graph_meta(spark, d):
    e = graph.edges(R._opps(spark, d), _nodes(spark, d))
    return graph.meta(graph.nodes_of(_index(spark, d), R._posts(spark, d), e), e, 55.0, "semantic")


def export_site_links(spark, d):
    return analytics.export_site_links(_site(spark, d), R._pages(spark, d))


def export_orphans(spark, d):
    return analytics.export_orphans(_index(spark, d), R._posts(spark, d))


def export_queue(spark, d):
    return analytics.export_queue(_queue(spark, d)).select("id", "post_id", "job_type", "status", "attempts")


def export_logs(spark, d):
    return jobs.log_read(_log(spark, d), analytics.EXPORT_LOGS).select("id", "level", "message")


def export_index(spark, d):
    """Index rows with the titles of their posts, also of posts that are gone."""
    index, posts = _index(spark, d), R._posts(spark, d).where("post_id % 8 > 0")
    return index.join(posts.select("post_id", "title"), "post_id", "left").orderBy("post_id").limit(analytics.EXPORT_ROWS).select("post_id", "title", "passage_count", "incoming_links", "outgoing_links", "max_outgoing_links")


def health_check(spark, d):
    """Counters after links to unpublished posts broke."""
    _, index = I.health(_links(spark, d), R._posts(spark, d), _index(spark, d))
    return index.select("post_id", "incoming_links", "outgoing_links")


_NAMES = """source_eligible match_own_limits index_upsert index_stubs replace_passages delete_index delete_cascade trash_jobs reset_data doc_vectors_with_title decoded_vectors
prepare_batch verify_batch insert_batch auto_insert_batch latest_links recent_index orphan_page_scan orphan_page_counters orphan_counts excerpts actions review_fields steps_done
statuses_of_buckets touching_posts title_contains finalize_post reject reapply_and_resolve reapply_protected enqueue queue_retry queue_release job_chain job_payloads log_append log_read
log_retention json_replies prepare_opportunities prepare_with_judge judge_pairs insert_links insert_counters remove_links run_pipeline graph_link_edges graph_both_edges graph_nodes
graph_meta export_site_links export_orphans export_queue export_logs export_index health_check""".split()


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES}
