"""All registered queries of the engine, by name, and the SQL they are held against."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.functions import html as H, text as T, vectors as V
from linkloom.operators import analytics, graph, jobs, linkscan, matching, placement, prepare, resolve
from linkloom.session import Workspace
from linkloom.settings import Settings
from linkloom.sources import adapters
from linkloom.sources.adapters import table

S = Settings()
STATES = ("pending", "ready", "verified", "no_anchor", "inserted", "rejected", "ready", "capped")
AS_OF = "2024-01-20 00:00:00"


# Shared inputs -----------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return adapters.vectors(table(spark, d, "embeddings"))


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return adapters.posts_from_documents(table(spark, d, "documents"), table(spark, d, "labels"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return adapters.posts_from_pages(table(spark, d, "pages"))


_shared: dict[tuple[str, str], DataFrame] = {}


def _opps(spark: SparkSession, d: str) -> DataFrame:
    """Matches in both directions with states and confidences derived from their ids; kept, as most queries begin with them."""
    key = spark.sparkContext.applicationId, d
    if key not in _shared:
        # What a lost executor held is computed again.
        _shared[key] = _matched(spark, d).persist()
    return _shared[key]


def _matched(spark: SparkSession, d: str) -> DataFrame:
    pairs = matching.both_directions(matching.match_outgoing(_vectors(spark, d), S), S)
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.pmod(F.col("s") * 31 + F.col("t") * 17, F.lit(8)) + 1).cast("int"))
    conf = (20 + F.pmod(F.col("s") * 7 + F.col("t") * 13, F.lit(77))).cast("int")
    return pairs.select((F.col("s") * 1000000 + F.col("t")).alias("id"), "s", "t", "sim", state.alias("status"), conf.alias("confidence"))


def _outgoing(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select(F.col("id").alias("s"), F.pmod("id", F.lit(3)).cast("int").alias("n_out"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Inserted links: the matches whose state is inserted; every fifth is removed."""
    status = F.when(F.pmod("id", F.lit(5)) == 0, "removed").otherwise("active")
    return _opps(spark, d).where("status = 'inserted'").select("id", "s", "t", status.alias("status"))


def _passages(spark: SparkSession, d: str, split=T.passages) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("post_id"), F.posexplode(split(F.col("text"))).alias("idx", "text"))
    return docs


# Queries --------------------------------------------------------------------------


def match_topk(spark, d):
    return matching.match_outgoing(_vectors(spark, d), S)


def match_both_directions(spark, d):
    return matching.both_directions(match_topk(spark, d), S)


def match_incoming_orphans(spark, d):
    v = _vectors(spark, d).select("id")
    return matching.match_incoming(_vectors(spark, d), v.where("id % 3 <> 2"), v.where("id % 4 = 1"), S)


def match_eligible_only(spark, d):
    posts = _posts(spark, d)
    live = posts.where("status = 'publish'").select(F.col("post_id").alias("id"))
    return matching.eligible(match_topk(spark, d), _vectors(spark, d).select("id").where("id % 3 < 2"), live, S)


def match_upsert(spark, d):
    old = _opps(spark, d).where("id % 2 = 0").select("s", "t", (F.col("sim") - 1).alias("sim"), "status")
    return matching.upsert(old, match_topk(spark, d)).withColumn("sim", F.round("sim", 2))


def doc_vector_mean(spark, d):
    e = _vectors(spark, d).select((F.col("id") % 50).alias("grp"), "vector")
    return V.mean_vector(e, ["grp"], "vector").select("grp", F.posexplode("mean").alias("pos", "m")).select("grp", "pos", F.round("m", 6).alias("m"))


def passages(spark, d):
    return _passages(spark, d)


def passage_counts(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("post_id"), F.size(T.passages(F.col("text"))).alias("n"))


def content_hash(spark, d):
    from linkloom.streaming.ingest import index_rows

    return index_rows(_posts(spark, d)).select("post_id", "content_hash", "passage_count")


def passages_html(spark, d):
    """Passages of raw pages; splitting HTML needs an entity decoder, so it runs in Arrow batches."""

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(H.split_passages)

    return _pages(spark, d).select("post_id", F.posexplode(split(F.regexp_replace("content", r"(?i)<br>|</p>", "\n\n"))).alias("idx", "text"))


def _frequency(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("post_id"), T.passages(F.col("text")).alias("passages"))
    return T.document_frequency_of(texts, Workspace(spark, "frequency"))


def idf_table(spark, d):
    df, n = _frequency(spark, d)
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.round(T.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def distinctive_floor(spark, d):
    _, n = _frequency(spark, d)
    return n.select("n", F.round(T.floor(F.col("n")), 6).alias("floor"))


def ngrams_2_3(spark, d):
    t = T.phrase_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.explode(F.concat(T.ngrams(t, 2), T.ngrams(t, 3))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def first_40_ngrams(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.first_ngrams(F.col("text"))).alias("pos", "gram"))


def acronyms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.acronyms(F.col("text"))).alias("acronym"))


def stems(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.array_distinct(T.idf_tokens(F.col("text")))).alias("word")).distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


def _candidates(spark, d):
    df, n = _frequency(spark, d)
    return placement.candidate_lists(_posts(spark, d), df, n), n


def _matchable(spark, d, rows: DataFrame) -> DataFrame:
    """Rows (post_id, ...) of posts with a vector; others are no end of a match."""
    return rows.join(_vectors(spark, d).select(F.col("id").alias("post_id")), "post_id", "left_semi")


def anchor_candidates(spark, d):
    c, _ = _candidates(spark, d)
    return placement.listed(c).select("post_id", "phrase", F.round("spec", 6).alias("spec"))


def best_passage(spark, d):
    """Best passages by hashed embeddings, for all matches."""
    ws = Workspace(spark, "best-passage")
    tokens = _passages(spark, d).select("post_id", "idx", T.idf_tokens(F.col("text")).alias("tok"))
    p = ws.cut(V.hashed_embedding(tokens, ["post_id", "idx"], "tok"))
    docs = ws.cut(V.mean_of(p, "post_id").select(F.col("post_id").alias("id"), "vector"))
    return placement.best_passage(_opps(spark, d).select("s", "t"), _matchable(spark, d, p), docs, V.mean_vector(docs, [], "vector"), S.min_passage_score)


def _placed(spark, d):
    """s, t, passage: the best passage of each match that isn't of low relevance, where its anchor is placed."""
    text = _passages(spark, d).select(F.col("post_id").alias("s"), "idx", F.col("text").alias("passage"))
    return best_passage(spark, d).where("status = 'ready'").select("s", "t", "idx").join(text, ["s", "idx"]).select("s", "t", "passage")


def best_anchor(spark, d):
    """Anchors in the source's best passage, for all matches."""
    df, n = _frequency(spark, d)
    return placement.best_anchor(_placed(spark, d), placement.candidate_lists(_matchable(spark, d, _posts(spark, d)), df, n), n)


def confidence_score(spark, d):
    rows = _opps(spark, d).select("s", "t", "sim", (F.col("s") % 5).alias("words"), ((F.col("t") % 9) / 1.0).alias("spec"))
    return rows.select("s", "t", T.confidence(F.col("sim"), F.col("words"), F.col("spec"), F.lit(2.5)).alias("confidence"))


def refine_anchor(spark, d):
    """Refined anchors: the first words of a source's best passage, against the target's topic."""

    rows = _placed(spark, d).join(prepare.topics(_matchable(spark, d, _posts(spark, d))), "t")
    return rows.select("s", "t", prepare.refined(F.substring_index("passage", " ", 2), "passage", "_topics").alias("anchor"))


def ground_anchor(spark, d):
    @F.pandas_udf("string")
    def grounded(a: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([H.ground_anchor(*x) for x in zip(a, p, strict=True)], dtype=object)

    return _passages(spark, d).select("post_id", "idx", grounded(F.upper(F.substring_index("text", " ", 3)), "text").alias("anchor"))


def _rewritten(spark, d):
    """Pages with a link to the next page put in at the first words of their article's first passage."""

    @F.pandas_udf("before string, after string, anchor string, url string")
    def rewrite(content: pd.Series, ids: pd.Series) -> pd.DataFrame:
        rows = []
        for c, i in zip(content, ids, strict=True):
            m = H.re.search(r"(?s)<p>([^<]{30,})", c)
            words = m[1].split()[:2] if m else []
            anchor, url = H.html.unescape(" ".join(words)), f"/p/{i + 1}"
            rows.append((c, H.replace_anchor(c, None, anchor, url) if words else None, anchor, url))
        return pd.DataFrame(rows, columns=["before", "after", "anchor", "url"])

    return _pages(spark, d).select("post_id", rewrite("content", "post_id").alias("r")).select("post_id", "r.*")


def rewrite_html(spark, d):
    r = _rewritten(spark, d)
    return r.select("post_id", F.md5("after").alias("html_md5"), F.col("after").isNotNull().alias("linked"))


def unwrap_html(spark, d):
    @F.pandas_udf("string")
    def unwrap(c: pd.Series, u: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([H.unwrap_link(*x) if x[0] is not None else None for x in zip(c, u, a, strict=True)])

    r = _rewritten(spark, d).withColumn("back", unwrap("after", "url", "anchor"))
    return r.select("post_id", (F.col("back") == F.col("before")).alias("same"))


def link_scan(spark, d):
    return linkscan.link_scan(_pages(spark, d)).select("post_id", "pos", "href", "anchor")


def resolved_links(spark, d):
    p = _pages(spark, d)
    return linkscan.resolve(linkscan.link_scan(p), p, "site.example")


def in_degree(spark, d):
    return linkscan.in_degree(resolved_links(spark, d))


def orphans(spark, d):
    return linkscan.orphans(_pages(spark, d), resolved_links(spark, d))


def reciprocal_resolve(spark, d):
    return resolve.resolve_reciprocal(_opps(spark, d))


def source_caps(spark, d):
    return resolve.enforce_caps(_opps(spark, d), _outgoing(spark, d), S)


def finalize(spark, d):
    return resolve.finalize(_opps(spark, d), _outgoing(spark, d), S)


def _verdicts(opps: DataFrame) -> DataFrame:
    k = F.pmod(F.col("s") * 5 + F.col("t") * 3, F.lit(11))
    return opps.select("id", (k > 1).alias("topic_match"), F.when(k != 2, k != 3).alias("product_match"), F.lit(True).alias("jurisdiction_match"), (60 + 4 * k).cast("int").alias("pair_score"), F.when(k != 4, "anchor").alias("grounded"))


def reapply_thresholds(spark, d):
    o = _opps(spark, d)
    return resolve.reapply_thresholds(o, _verdicts(o.where("id % 2 = 1")), S)


def verify_greedy(spark, d):
    ws = Workspace(spark, "verify")
    o = ws.cut(_opps(spark, d))
    ok = _verdicts(o).select("id", resolve.verdict_ok(S).alias("ok"))
    return resolve.verify_greedy(o, ok, _outgoing(spark, d), S, ws)


def reevaluate(spark, d):
    return resolve.reevaluate(_opps(spark, d))


def rebuild_matches(spark, d):
    kept = resolve.drop_undecided(_opps(spark, d)).select("s", "t", "sim", "status")
    return matching.upsert(kept, match_both_directions(spark, d))


def trash_and_delete(spark, d):
    v = _vectors(spark, d).select("id")
    return resolve.on_delete(resolve.on_trash(_opps(spark, d), v.where("id % 10 = 3")), v.where("id % 10 = 7"))


def status_counts(spark, d):
    return analytics.status_counts(_opps(spark, d))


def bucket_counts(spark, d):
    return analytics.bucket_counts(_opps(spark, d))


def totals(spark, d):
    p = _pages(spark, d)
    sl = resolved_links(spark, d)
    return analytics.totals(p, p, _opps(spark, d), _links(spark, d), sl, linkscan.orphans(p, sl))


def export_meta(spark, d):
    return analytics.export_meta(totals(spark, d), S, True)


def review_list(spark, d):
    return analytics.review_list(_opps(spark, d))


FOCUS = ("verified", "ready", "inserted", "pending")


def focus_list(spark, d):
    return analytics.focus_list(_opps(spark, d), 3, FOCUS)


def index_page(spark, d):
    return _posts(spark, d).select("post_id", "title", "status").orderBy(F.desc("post_id")).offset(25).limit(25)


def graph_edges(spark, d):
    return graph.edges(_opps(spark, d), _vectors(spark, d).select("id").where("id % 7 <> 0"))


def graph_degree(spark, d):
    return graph.degrees(graph_edges(spark, d))


def graph_communities(spark, d):
    ws = Workspace(spark, "graph")
    return graph.communities(ws.cut(graph_edges(spark, d)), _vectors(spark, d).select("id").where("id % 7 <> 0"), ws)


def broken_links(spark, d):
    return linkscan.broken(_links(spark, d), _posts(spark, d))


def link_counters(spark, d):
    return linkscan.counters(_links(spark, d), _vectors(spark, d).select(F.col("id").alias("post_id")))


def suggestion_counts(spark, d):
    return analytics.suggestion_counts(_opps(spark, d))


def export_posts(spark, d):
    return _posts(spark, d).select("post_id", "title", "status", "type", "permalink").orderBy("post_id").limit(analytics.EXPORT_ROWS)


def export_opportunities(spark, d):
    return analytics.export_opportunities(_opps(spark, d), _posts(spark, d))


def export_links(spark, d):
    return analytics.export_opportunities(_links(spark, d), _posts(spark, d))


def _eval(spark, d):
    k = F.col("item_id")
    pairs = table(spark, d, "benchmark")
    word = lambda n: F.lower(F.element_at(F.split("text", " "), n))
    rows = pairs.select(F.when(k % 4 == 3, "negative").otherwise("positive").alias("kind"), word(1).alias("a_fragment"), word(2).alias("b_fragment"))
    return analytics.eval_pairs(rows, _posts(spark, d), _opps(spark, d))


def eval_report(spark, d):
    return _eval(spark, d)


def eval_summary(spark, d):
    return analytics.eval_summary(_eval(spark, d))


def _queue(spark, d):
    return adapters.queue_from_events(table(spark, d, "events"))


def queue_counts(spark, d):
    return _queue(spark, d).groupBy("job_type", "status").agg(F.count(F.lit(1)).alias("n"))


def queue_dedupe(spark, d):
    return analytics.queue_dedupe(_queue(spark, d)).select("id", "post_id", "job_type", "status")


def queue_stale(spark, d):
    return analytics.queue_stale(_queue(spark, d), F.lit(AS_OF).cast("timestamp")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def queue_batch(spark, d):
    """The next jobs in order of arrival, as claimed."""
    return jobs.claim(_queue(spark, d), S.batch_size).select("id", "job_type", "status", "attempts")


def retention_purge(spark, d):
    q = _queue(spark, d)
    return analytics.retention(q, F.lit(AS_OF).cast("timestamp"), 7, done_only=True).groupBy("job_type").agg(F.count(F.lit(1)).alias("n"))


def stream_ingest(spark, d):
    """The index after the documents' changes have streamed through."""
    from linkloom.streaming import ingest

    ws = Workspace(spark, "stream")
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("post_id"), F.when(F.col("doc_id") % 10 == 9, "delete").otherwise("upsert").alias("op"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"), F.timestamp_seconds("doc_id").alias("changed_at"))
    rows.write.parquet(f"{ws.base}/in")
    q = ingest.start(spark, f"{ws.base}/in", "post_id long, op string, title string, content string, changed_at timestamp", f"{ws.base}/index", f"{ws.base}/state")
    q.awaitTermination()
    last = max((p["batchId"] for p in q.recentProgress if p["numInputRows"]), default=None)
    if last is None:
        return spark.createDataFrame([], "post_id long, content_hash string, passage_count int")
    return spark.read.schema(ingest.INDEX).parquet(f"{ws.base}/index/v{last}").select("post_id", "content_hash", "passage_count")


_NAMES = """match_topk match_both_directions match_incoming_orphans match_eligible_only match_upsert doc_vector_mean passages passage_counts content_hash
passages_html idf_table distinctive_floor ngrams_2_3 first_40_ngrams acronyms stems anchor_candidates best_anchor best_passage confidence_score refine_anchor
ground_anchor rewrite_html unwrap_html link_scan resolved_links in_degree orphans reciprocal_resolve source_caps finalize reapply_thresholds verify_greedy reevaluate
rebuild_matches trash_and_delete status_counts bucket_counts totals export_meta review_list focus_list index_page graph_edges graph_degree graph_communities broken_links
link_counters suggestion_counts export_posts export_opportunities export_links eval_report eval_summary queue_counts queue_dedupe queue_stale queue_batch retention_purge
stream_ingest""".split()


def queries() -> dict:
    from linkloom import catalog

    return {n: globals()[n] for n in _NAMES} | catalog.queries()


def oracle_sql() -> dict:
    from linkloom import oracle

    from linkloom import catalog_sql

    return oracle.queries() | catalog_sql.queries()
