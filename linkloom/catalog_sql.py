"""DuckDB SQL of the queries in `catalog`, and of those in `registry` that need longer statements."""

from __future__ import annotations

import json

from linkloom import schema

from linkloom.oracle import ACRONYMS, IDF, LINKS, OPPS, PAGES, PASSAGES, POSTS, QUEUE, RECIP, TOKENS, _capped, _first, _grams, _phrase
from linkloom.settings import Settings

AS_OF = "TIMESTAMP '2024-01-20 00:00:00'"
S = Settings()

HASH = """hash_rows AS (SELECT posts.post_id, md5(concat_ws('|', title, coalesce(array_to_string(parts, '|'), ''))) AS content_hash, coalesce(len(parts), 0)::INTEGER AS passage_count FROM posts LEFT JOIN whole USING (post_id))"""
INDEX = f"""{LINKS}, {POSTS}, {PASSAGES}, {HASH},
outs AS (SELECT s AS post_id, count(*) AS o FROM links WHERE status = 'active' GROUP BY s), ins AS (SELECT t AS post_id, count(*) AS i FROM links WHERE status = 'active' GROUP BY t),
idx AS (SELECT post_id, content_hash, passage_count, coalesce(i, 0)::INTEGER AS incoming_links, coalesce(o, 0)::INTEGER AS outgoing_links, (1 + post_id % 3)::INTEGER AS max_outgoing_links,
  CASE WHEN post_id % 11 <> 0 THEN post_id * 60 END AS indexed_at FROM hash_rows LEFT JOIN outs USING (post_id) LEFT JOIN ins USING (post_id))"""
FULL_LINKS = f"""{LINKS}, full_links AS (SELECT id, s, t, 'anchor ' || (id % 7) AS anchor, id * 60 % 1000003 AS inserted_at, status FROM links)"""
PAGE_INDEX = f"""{PAGES}, pidx AS (SELECT post_id, (post_id % 9)::INTEGER AS passage_count, (post_id % 2)::INTEGER AS incoming_links, post_id AS indexed_at FROM pposts WHERE post_id % 3 > 0)"""
JOBS = f"{QUEUE}, jobs AS (SELECT *, id % 5 = 0 AS auto FROM q)"
LOG = "log AS (SELECT event_id AS id, ['debug', 'info', 'warning', 'error'][event_id % 4 + 1] AS level, event_type AS message, ts AS created_at FROM events)"
VERDICTS = """v0 AS (SELECT *, (s * 5 + t * 3) % 11 AS k FROM opps), v1 AS (SELECT *, CASE WHEN id % 2 = 1 THEN k > 1 AND (k = 2 OR k <> 3) AND 60 + 4 * k >= 75 AND k <> 4 END AS ok FROM v0),
judged AS (SELECT id, s, t, sim, CASE WHEN ok IS NULL THEN status WHEN ok THEN 'verified' ELSE 'rejected_relevance' END AS status, CASE WHEN ok THEN (60 + 4 * k)::INTEGER ELSE confidence END AS confidence, status AS old, confidence AS old_confidence FROM v1)"""


def _settled(src: str) -> str:
    return f"""rec AS (SELECT * REPLACE (CASE WHEN r > 1 THEN 'reciprocal' ELSE status END AS status, CASE WHEN r > 1 THEN NULL ELSE confidence END AS confidence)
FROM (SELECT *, CASE WHEN status = 'verified' THEN row_number() OVER (PARTITION BY least(s, t), greatest(s, t), status = 'verified' ORDER BY coalesce(confidence, 0) DESC, id) ELSE 1 END AS r FROM {src})),
settled AS (SELECT id, CASE WHEN status = 'verified' AND c > greatest(0, 2 - s % 3) THEN 'capped' ELSE status END AS status, confidence FROM (SELECT *, row_number() OVER (PARTITION BY s, status = 'verified' ORDER BY confidence DESC NULLS LAST, sim DESC, id) AS c FROM rec))"""


def _vectors(src: str) -> str:
    """Hashed vectors of (post_id, idx, text) in src, and means by post."""
    return f"""tok AS (SELECT post_id, idx, unnest({TOKENS}) AS tok FROM {src}), hashed AS (SELECT post_id, idx, ('0x' || substr(md5(tok), 1, 8))::BIGINT AS h FROM tok),
places AS (SELECT post_id, idx, (h % 64)::INTEGER AS d, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM hashed GROUP BY 1, 2, 3),
keys AS (SELECT DISTINCT post_id, idx FROM places), filled AS (SELECT k.post_id, k.idx, g.d::INTEGER AS d, coalesce(p.x, 0.0) AS x FROM keys k CROSS JOIN range(64) g(d) LEFT JOIN places p ON p.post_id = k.post_id AND p.idx = k.idx AND p.d = g.d),
norms AS (SELECT post_id, idx, sqrt(sum(x * x)) AS norm FROM filled GROUP BY 1, 2),
vec AS MATERIALIZED (SELECT f.post_id, f.idx, f.d, CASE WHEN norm > 0 THEN x / norm ELSE 0.0 END AS x FROM filled f JOIN norms USING (post_id, idx)),
dv AS MATERIALIZED (SELECT post_id, d, sum(x::DECIMAL(28,18))::DOUBLE / count(x) AS x FROM vec GROUP BY 1, 2)"""


BEST = f"""{_vectors('passages')}, cm AS (SELECT d, sum(x::DECIMAL(28,18))::DOUBLE / count(x) AS m FROM dv GROUP BY d),
cp AS MATERIALIZED (SELECT post_id, idx, list(x - m ORDER BY d) AS v FROM vec JOIN cm USING (d) GROUP BY 1, 2), ct AS MATERIALIZED (SELECT post_id, list(x - m ORDER BY d) AS v FROM dv JOIN cm USING (d) GROUP BY 1),
scored AS (SELECT o.s, o.t, cp.idx, CASE WHEN ct.v IS NOT NULL AND cp.v IS NOT NULL THEN round(greatest(0, least(100, (coalesce(CASE WHEN list_dot_product(cp.v, cp.v) > 0 AND list_dot_product(ct.v, ct.v) > 0 THEN list_cosine_similarity(cp.v, ct.v) END, 0) + 1) / 2 * 100)), 2) END AS sc
  FROM opps o LEFT JOIN cp ON cp.post_id = o.s LEFT JOIN ct ON ct.post_id = o.t),
bestp AS (SELECT s, t, CASE WHEN sc IS NOT NULL THEN idx END AS idx, coalesce(sc, 0.0) AS passage_score, CASE WHEN coalesce(sc, 0.0) < 55 THEN 'low_relevance' ELSE 'ready' END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY sc DESC NULLS LAST, idx) AS r FROM scored) WHERE r = 1)"""
#: Candidates with their place: title phrases by length, body phrases, acronyms, words.
PLACED = rf"""toks AS (SELECT post_id, ' ' || lower(title) || ' ' AS lt, title || ' ' || content AS both_text, {_phrase('title')} AS tt, {_phrase('content')} AS bt FROM posts),
lists AS (SELECT post_id, 1 AS kind, list_concat({_grams('tt', 2)}, list_concat({_grams('tt', 3)}, list_concat({_grams('tt', 4)}, list_concat({_grams('tt', 5)}, {_grams('tt', 6)})))) AS l FROM toks
  UNION ALL SELECT post_id, 2, {_first('bt')} FROM toks
  UNION ALL SELECT post_id, 3, {ACRONYMS.format('both_text')} FROM toks
  UNION ALL SELECT post_id, 4, list_filter(list_concat(tt, bt), lambda w: w <> '') FROM toks),
spots AS (SELECT post_id, kind, unnest(l) AS g, generate_subscripts(l, 1) AS k FROM lists),
once AS (SELECT post_id, kind, g, min(k) AS k FROM spots GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY post_id, kind ORDER BY k) AS r FROM once),
cand AS (SELECT post_id, CASE WHEN kind = 3 THEN lower(g) ELSE g END AS phrase, kind, kind * 1000000 + (CASE WHEN kind = 1 THEN k ELSE r END) - 1 AS seq FROM ranked WHERE kind <> 2 OR r <= 40),
ct2 AS (SELECT post_id, phrase, kind, seq, unnest(CASE WHEN len(list_filter({_phrase('phrase')}, lambda x: x <> '')) = 0 THEN [NULL] ELSE list_filter({_phrase('phrase')}, lambda x: x <> '') END) AS token FROM cand),
base2 AS (SELECT post_id, phrase, kind, seq, max(CASE WHEN token IS NULL THEN 0.0 ELSE ln((n.n + 1) / (coalesce(df.df, 0) + 1)) + 1 END) AS b, max(n.n) AS n FROM ct2 LEFT JOIN df USING (token) CROSS JOIN n GROUP BY ALL),
cands AS (SELECT post_id, phrase, max(b + CASE kind WHEN 3 THEN 3.0 ELSE 0.0 END + CASE WHEN kind = 1 OR contains(lt, ' ' || phrase || ' ') THEN 1.5 ELSE 0 END) AS spec, min(seq) AS seq, max(n) AS n FROM base2 JOIN toks USING (post_id)
  WHERE kind < 4 OR b >= ln((n + 1) / (n * 0.15 + 1)) + 1 GROUP BY post_id, phrase)"""


def _communities(sweeps: int = 12) -> str:
    parts = [f"""{OPPS}, nd AS (SELECT id FROM v WHERE id % 7 <> 0), e AS (SELECT least(s, t) AS a, greatest(s, t) AS b, round(max(sim), 1) AS w FROM opps WHERE sim >= 55 AND s % 7 <> 0 AND t % 7 <> 0 GROUP BY 1, 2),
both_edges AS MATERIALIZED (SELECT a AS id, b AS nb, w FROM e UNION ALL SELECT b, a, w FROM e), l0 AS MATERIALIZED (SELECT id, id AS label FROM nd)"""]
    for k in range(sweeps):
        parts.append(f"""votes{k} AS MATERIALIZED (SELECT x.id, l.label AS vote, round(sum(x.w), 6) AS w FROM both_edges x JOIN l{k} l ON x.nb = l.id GROUP BY 1, 2),
l{k + 1} AS MATERIALIZED (SELECT id, coalesce(vote, label) AS label FROM (SELECT l.id, l.label, v.vote, row_number() OVER (PARTITION BY l.id ORDER BY v.w DESC NULLS LAST, (v.vote = l.label) DESC, v.vote) AS r FROM l{k} l LEFT JOIN votes{k} v ON l.id = v.id) WHERE r = 1)""")
    parts.append(f"firsts AS (SELECT label, row_number() OVER (ORDER BY min(id)) - 1 AS community FROM l{sweeps} GROUP BY label)")
    return f"WITH {', '.join(parts)} SELECT id, community FROM l{sweeps} JOIN firsts USING (label)"


def _flag(names: tuple[str, ...]) -> str:
    return f"status IN ({', '.join(map(repr, names))})"


def queries() -> dict[str, str]:
    from linkloom.operators.worklists import APPROVABLE, PREPARABLE, REJECTABLE

    w = "WITH "
    buckets = " ".join(f"WHEN '{s}' THEN '{'working' if s == 'ready' else b}'" for s, (b, _) in schema.STATUSES.items())
    labels = " ".join(f"WHEN '{s}' THEN '{'Awaiting verification' if s == 'ready' else x}'" for s, (_, x) in schema.STATUSES.items())
    by_bucket = {(r, b): ",".join(sorted(s for s, (o, _) in schema.STATUSES.items() if ("working" if r and s == "ready" else o) == b)) for r in (False, True) for b in schema.BUCKETS}
    values = lambda rows: ", ".join(f"({', '.join(repr(x) if not isinstance(x, bool) else str(x).lower() for x in r)})" for r in rows)
    sizes = [(n, len(schema._split(ddl)), 0) for n, ddl in schema.TABLES.items()]
    settings = json.dumps(S.public(), sort_keys=True)
    out = "'rewrite_suggested', 'no_anchor', 'rejected_relevance', 'rejected', 'capped', 'reciprocal', 'low_relevance', 'invalid'"

    def steps(k: int, rerank: bool, qs: str, os: str) -> str:
        kept = "verified" if rerank else "ready"
        return f"""SELECT {k} AS "case", p > 0 AND i >= p AND b = 0 AS indexed_done, pend = 0 AND ins + nl > 0 AS prepared_done, {'wait = 0 AND ins > 0' if rerank else 'pend = 0 AND ins + nl > 0'} AS verified_done
FROM (SELECT (SELECT count(*) FROM posts WHERE status = 'publish') AS p, (SELECT count({'indexed_at' if k == 0 else '*'}) FROM idx) AS i, (SELECT count(*) FROM q WHERE status IN ('pending', 'processing') AND {qs}) AS b,
  (SELECT count(*) FROM opps WHERE status = 'pending' AND {os}) AS pend, (SELECT count(*) FROM opps WHERE status = 'ready' AND {os}) AS wait, (SELECT count(*) FROM opps WHERE status = '{kept}' AND {os}) AS ins, (SELECT count(*) FROM opps WHERE status IN ({out}) AND {os}) AS nl)"""

    edges = "e AS (SELECT least(s, t) AS a, greatest(s, t) AS b, round(max(sim), 1) AS weight, bool_or(status = 'inserted') AS inserted FROM opps WHERE sim >= 55 AND s IN (SELECT id FROM nd) AND t IN (SELECT id FROM nd) GROUP BY 1, 2)"
    nodes = f"{INDEX}, nd AS (SELECT post_id AS id FROM idx WHERE indexed_at IS NOT NULL)"
    pairs = "lk AS (SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b FROM links WHERE status = 'active' AND s IN (SELECT id FROM nd) AND t IN (SELECT id FROM nd))"
    return {
        "best_passage": f"{w}{OPPS}, {PASSAGES}, {BEST} SELECT s, t, idx, passage_score, status FROM bestp",
        "best_anchor": rf"""{w}{OPPS}, {POSTS}, {IDF}, {BEST}, {PLACED},
            forms AS (SELECT s, t, ' ' || trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[^\p{{L}}\p{{N}} ]', ' | ', 'g'), ' +', ' ', 'g')) || ' ' AS form FROM bestp JOIN passages ON passages.post_id = s AND passages.idx = bestp.idx WHERE status = 'ready'),
            hits AS (SELECT s, t, phrase, spec, row_number() OVER (PARTITION BY s, t ORDER BY round(spec, 9) DESC, length(phrase) DESC, seq) AS r FROM forms JOIN cands ON cands.post_id = t WHERE spec >= ln((n + 1) / (n * 0.15 + 1)) + 1 AND contains(form, ' ' || phrase || ' '))
            SELECT s, t, phrase, round(spec, 6) AS spec FROM hits WHERE r = 1""",
        "stream_ingest": f"{w}{POSTS.replace('substr(split_part(d.text, chr(10), 1), 1, 80)', 'substr(d.text, 1, 40)')}, {PASSAGES}, {HASH} SELECT * FROM hash_rows WHERE post_id % 10 <> 9 AND passage_count > 0",
        "export_meta": f"""{w}{LINKS}, {PAGES} SELECT (SELECT count(*) FROM pposts) AS published, (SELECT count(*) FROM pposts) AS indexed, (SELECT count(*) FROM opps) AS opportunities, (SELECT count(*) FROM links WHERE status = 'active') AS active_links, (SELECT count(*) FROM site) AS site_links,
            (SELECT count(*) FROM pposts WHERE post_id NOT IN (SELECT target FROM site)) AS orphans, '{settings}' AS settings, 'scanned_site_links' AS orphan_source, 10000::INTEGER AS row_cap""",
        "graph_communities": _communities(),
        "source_eligible": f"{w}{INDEX} SELECT post_id AS id FROM idx WHERE outgoing_links < max_outgoing_links",
        "match_own_limits": f"{w}{INDEX}, free AS (SELECT post_id AS id FROM idx WHERE outgoing_links < max_outgoing_links), live AS (SELECT post_id AS id FROM posts WHERE status = 'publish'), good AS (SELECT s, t, sim FROM top WHERE s IN (SELECT id FROM free) AND t IN (SELECT id FROM live)) SELECT DISTINCT s, t, sim FROM (SELECT * FROM good UNION ALL SELECT t, s, sim FROM good WHERE sim >= 60 AND t IN (SELECT id FROM free) AND s IN (SELECT id FROM live))",
        "index_upsert": f"{w}{INDEX} SELECT post_id, CASE WHEN post_id % 3 = 0 THEN md5(content_hash) ELSE content_hash END AS content_hash, (CASE WHEN post_id % 3 = 0 THEN passage_count + 1 ELSE passage_count END)::INTEGER AS passage_count, (CASE WHEN post_id % 2 = 0 THEN incoming_links ELSE 0 END)::INTEGER AS incoming_links, (CASE WHEN post_id % 2 = 0 THEN outgoing_links ELSE 0 END)::INTEGER AS outgoing_links, (CASE WHEN post_id % 2 = 0 THEN max_outgoing_links ELSE 2 END)::INTEGER AS max_outgoing_links FROM idx WHERE post_id % 2 = 0 OR post_id % 3 = 0",
        "index_stubs": f"{w}{INDEX}, own AS (SELECT post_id, passage_count, max_outgoing_links FROM idx WHERE post_id % 4 <> 1) SELECT * FROM own UNION ALL SELECT post_id, 0::INTEGER, 2::INTEGER FROM (SELECT s AS post_id FROM links UNION SELECT t FROM links) WHERE post_id NOT IN (SELECT post_id FROM own)",
        "replace_passages": f"{w}{PASSAGES} SELECT post_id, idx, text FROM passages WHERE post_id % 5 <> 0 OR idx % 2 = 0",
        "delete_index": f"{w}{INDEX} SELECT post_id, content_hash FROM idx WHERE post_id % 6 <> 5",
        "delete_cascade": f"""{w}{INDEX}, {PAGES}, {QUEUE}, gone AS (SELECT doc_id AS p FROM documents WHERE doc_id % 10 = 7), kept AS (SELECT * FROM links WHERE s NOT IN (SELECT p FROM gone) AND t NOT IN (SELECT p FROM gone)),
            left_idx AS (SELECT post_id, (SELECT count(*) FROM kept k WHERE k.status = 'active' AND k.t = post_id) AS i, (SELECT count(*) FROM kept k WHERE k.status = 'active' AND k.s = post_id) AS o FROM idx WHERE post_id NOT IN (SELECT p FROM gone))
            SELECT 'index' AS "table", count(*) AS n, sum(i * 1000 + o)::BIGINT AS counters FROM left_idx UNION ALL SELECT 'links', count(*), NULL FROM kept
            UNION ALL SELECT 'opportunities', count(*), NULL FROM opps WHERE s NOT IN (SELECT p FROM gone) AND t NOT IN (SELECT p FROM gone) UNION ALL SELECT 'site_links', count(*), NULL FROM site WHERE source NOT IN (SELECT p FROM gone) AND target NOT IN (SELECT p FROM gone)
            UNION ALL SELECT 'queue', count(*), NULL FROM q WHERE post_id NOT IN (SELECT p FROM gone) UNION ALL SELECT 'passages', count(*), NULL FROM passages WHERE post_id NOT IN (SELECT p FROM gone)""",
        "trash_jobs": f"{w}{QUEUE} SELECT job_type, status, count(*) AS n FROM q WHERE NOT (status IN ('pending', 'processing') AND post_id % 10 = 3) GROUP BY ALL",
        "reset_data": f'SELECT t AS "table", c::INTEGER AS columns, n::BIGINT AS n FROM (VALUES {values(sizes)}) x(t, c, n)',
        "doc_vectors_with_title": f"{w}{POSTS}, {PASSAGES}, texts AS (SELECT post_id, idx, text FROM passages UNION ALL SELECT post_id, -1, coalesce(title, '') FROM posts WHERE post_id IN (SELECT post_id FROM passages)), {_vectors('texts')} SELECT post_id AS id, round(sum(x::DECIMAL(28,18) * (d + 1))::DOUBLE, 6) AS weighed FROM dv GROUP BY post_id",
        "decoded_vectors": "SELECT vec_id, (CASE WHEN vec_id % 9 = 0 OR vec_id % 7 = 0 THEN 0 ELSE len(embedding) END)::INTEGER AS n, CASE WHEN vec_id % 9 <> 0 AND vec_id % 7 <> 0 THEN round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) END AS total FROM embeddings",
        "prepare_batch": f"{w}{OPPS} SELECT id, sim FROM opps WHERE status = 'pending' ORDER BY sim DESC, id LIMIT 25",
        "verify_batch": f"{w}{OPPS} SELECT id, confidence FROM opps WHERE status = 'ready' ORDER BY confidence DESC, id LIMIT 5",
        "insert_batch": f"{w}{OPPS} SELECT id, confidence FROM opps WHERE status = 'ready' ORDER BY confidence DESC, id LIMIT 10",
        "auto_insert_batch": f"{w}{OPPS} SELECT id, confidence FROM opps WHERE status = 'ready' AND confidence >= 75",
        "latest_links": f"{w}{FULL_LINKS}, {POSTS} SELECT l.id, anchor, l.status, a.title AS source_title, b.title AS target_title FROM (SELECT * FROM full_links ORDER BY inserted_at DESC, id DESC LIMIT 200) l LEFT JOIN posts a ON a.post_id = s LEFT JOIN posts b ON b.post_id = t",
        "recent_index": f"{w}{INDEX} SELECT post_id, title, passage_count, incoming_links FROM idx JOIN posts USING (post_id) ORDER BY indexed_at DESC NULLS LAST, post_id LIMIT 25 OFFSET 25",
        "orphan_page_scan": f"{w}{PAGE_INDEX} SELECT post_id, coalesce(passage_count, 0)::INTEGER AS passage_count FROM pposts LEFT JOIN pidx USING (post_id) WHERE post_id NOT IN (SELECT target FROM site) ORDER BY post_id DESC LIMIT 50 OFFSET 10",
        "orphan_page_counters": f"{w}{PAGE_INDEX} SELECT post_id, passage_count FROM pidx WHERE incoming_links = 0 ORDER BY indexed_at DESC, post_id LIMIT 50 OFFSET 10",
        "orphan_counts": f"{w}{PAGE_INDEX} SELECT 'scan' AS mode, count(*) AS n FROM pposts WHERE post_id NOT IN (SELECT target FROM site) UNION ALL SELECT 'counters', count(*) FROM pidx WHERE incoming_links = 0",
        "excerpts": rf"{w}{POSTS}, {PASSAGES} SELECT posts.post_id, coalesce(array_to_string(whole.parts[1:2], ' '), array_to_string(list_filter(regexp_split_to_array(coalesce(content, ''), '\s+'), lambda x: x <> '')[1:80], ' ')) AS excerpt FROM posts LEFT JOIN (SELECT * FROM whole WHERE len(parts) > 0) whole USING (post_id)",
        "actions": f"{w}{OPPS} SELECT id, status, CASE status {buckets} END AS bucket, CASE status {labels} END AS label, {_flag(PREPARABLE)} AS show_prepare, {_flag(APPROVABLE)} AS show_approve, {_flag(REJECTABLE)} AS show_reject FROM opps",
        "review_fields": f"{w}{OPPS} SELECT id, CASE id % 3 WHEN 0 THEN 'fits' WHEN 1 THEN 'old form' ELSE '' END AS reason, CASE WHEN id % 3 = 0 THEN 'a' || s ELSE '' END AS ai_anchor, CASE WHEN id % 3 = 0 THEN id % 101 END::INTEGER AS pair_score, CASE WHEN id % 3 = 0 THEN id % 7 END::INTEGER AS anchor_score FROM opps",
        "steps_done": f"{w}{INDEX}, {QUEUE} {steps(0, False, 'true', 'true')} UNION ALL {steps(1, True, chr(39).join(['status = ', 'done', '']), chr(39).join(['status <> ', 'ready', '']))} UNION ALL {steps(2, False, chr(39).join(['status = ', 'failed', '']), chr(39).join(['status <> ', 'pending', '']))}",
        "statuses_of_buckets": f"SELECT * FROM (VALUES {values([(r, b, x) for (r, b), x in by_bucket.items() if x])}) x(rerank, bucket, statuses)",
        "touching_posts": f"{w}{OPPS} SELECT id, status FROM opps WHERE s % 10 = 4 OR t % 10 = 4",
        "title_contains": f"{w}{POSTS} SELECT post_id FROM posts WHERE contains(lower(title), 'the') OR contains(lower(title), '100%_')",
        "finalize_post": f"{w}{OPPS.replace('opps AS', 'all_opps AS')}, opps AS (SELECT * FROM all_opps WHERE s % 10 = 4 OR t % 10 = 4), {RECIP}, {_capped('recip')} SELECT id, CASE WHEN status = 'ready' AND confidence >= 75 THEN 'inserted' ELSE status END AS status, confidence FROM capped",
        "reject": f"{w}{OPPS} SELECT id, CASE WHEN id % 13 = 0 THEN 'rejected' ELSE status END AS status FROM opps",
        "reapply_and_resolve": f"{w}{OPPS}, {VERDICTS}, {_settled('judged')} SELECT * FROM settled",
        "reapply_protected": f"{w}{OPPS}, {VERDICTS}, kept AS (SELECT id, s, t, sim, CASE WHEN old IN ('inserted', 'rejected', 'reciprocal') THEN old ELSE status END AS status, CASE WHEN old IN ('inserted', 'rejected', 'reciprocal') THEN old_confidence ELSE confidence END AS confidence FROM judged), {_settled('kept')} SELECT * FROM settled",
        "enqueue": f"""{w}{JOBS}, open AS (SELECT post_id FROM jobs WHERE job_type = 'click' AND status IN ('pending', 'processing'))
            SELECT id, post_id, job_type, status, auto OR (job_type = 'click' AND status IN ('pending', 'processing') AND post_id IN (SELECT doc_id FROM documents) AND post_id % 2 = 0) AS auto FROM jobs
            UNION ALL SELECT doc_id * 2 + 10000000, doc_id, 'click', 'pending', doc_id % 2 = 0 FROM documents WHERE doc_id NOT IN (SELECT post_id FROM open)""",
        "queue_retry": f"{w}{QUEUE}, z AS (SELECT *, status = 'processing' AND id % 3 = 0 AS failed FROM q) SELECT CASE WHEN status <> 'processing' THEN status WHEN NOT failed THEN 'done' WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS status, attempts, CASE WHEN failed THEN 'no answer' END AS last_error, count(*) AS n FROM z GROUP BY ALL",
        "queue_release": f"{w}{QUEUE}, z AS (SELECT *, status = 'processing' AND id % 2 = 1 AS hit FROM q) SELECT CASE WHEN hit THEN 'pending' ELSE status END AS status, (CASE WHEN hit THEN greatest(0, attempts - 1) ELSE attempts END)::INTEGER AS attempts, count(*) AS n FROM z GROUP BY ALL",
        "job_chain": f"{w}{JOBS}, done AS (SELECT *, ['index_post', 'generate_matches', 'finalize_post'][(id // 4) % 3 + 1] AS kind, id % 8 = 2 AS skipped FROM jobs WHERE status = 'done') SELECT CASE kind WHEN 'index_post' THEN 'generate_matches' ELSE 'finalize_post' END AS job_type, kind = 'index_post' AND auto AS auto, count(*) AS n FROM done WHERE (kind = 'index_post' AND NOT skipped) OR (kind = 'generate_matches' AND auto) GROUP BY ALL",
        "job_payloads": f"{w}{QUEUE} SELECT id % 3 = 0 AS auto, count(*) AS n FROM q GROUP BY ALL",
        "log_append": f"{w}{LOG} SELECT level, count(*) AS n FROM log WHERE id % 2 = 0 OR level <> 'debug' GROUP BY level",
        "log_read": f"{w}{LOG} SELECT id, level, message FROM log WHERE level = 'warning' ORDER BY id DESC LIMIT 100",
        "log_retention": f"{w}{LOG} SELECT level, count(*) AS n FROM log WHERE created_at >= {AS_OF} - INTERVAL 5 DAYS GROUP BY level",
        "json_replies": "SELECT item_id, CASE WHEN item_id % 4 < 2 THEN greatest(0, least(100, item_id * 7 - 20)) END::INTEGER AS pair_score, CASE WHEN item_id % 4 < 2 THEN true END AS topic, CASE WHEN item_id % 4 < 2 THEN item_id % 2 = 0 END AS product, CASE WHEN item_id % 4 < 2 THEN 'a ' || item_id END AS anchor FROM benchmark",
        "graph_link_edges": f"{w}{nodes}, {pairs} SELECT a, b, 100.0::DOUBLE AS weight, true AS inserted FROM lk",
        "graph_both_edges": f"{w}{nodes}, {pairs}, {edges} SELECT e.a, e.b, weight, inserted OR lk.a IS NOT NULL AS inserted FROM e LEFT JOIN lk ON e.a = lk.a AND e.b = lk.b",
        "graph_nodes": f"{w}{nodes}, {edges}, deg AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id) SELECT post_id AS id, title, incoming_links AS incoming, outgoing_links AS outgoing, passage_count AS passages, degree FROM idx JOIN posts USING (post_id) JOIN deg ON deg.id = post_id WHERE indexed_at IS NOT NULL",
        "graph_meta": f"{w}{nodes}, {edges} SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM e) AS edges, 55.0::DOUBLE AS min_sim, 'semantic' AS edge_type",
        "export_site_links": f"{w}{PAGES}, titled AS (SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages) SELECT source AS s, target AS t, anchor, a.title AS source_title, b.title AS target_title FROM (SELECT * FROM site ORDER BY source, target LIMIT 10000) LEFT JOIN titled a ON a.page_id = source LEFT JOIN titled b ON b.page_id = target",
        "export_orphans": f"{w}{INDEX} SELECT post_id, passage_count, outgoing_links, title FROM (SELECT * FROM idx WHERE incoming_links = 0 ORDER BY post_id LIMIT 10000) LEFT JOIN posts USING (post_id)",
        "export_queue": f"{w}{QUEUE} SELECT id, post_id, job_type, status, attempts FROM q ORDER BY id DESC LIMIT 10000",
        "export_logs": f"{w}{LOG} SELECT id, level, message FROM log ORDER BY id DESC LIMIT 1000",
        "export_index": f"{w}{INDEX} SELECT idx.post_id, title, passage_count, incoming_links, outgoing_links, max_outgoing_links FROM idx LEFT JOIN (SELECT * FROM posts WHERE post_id % 8 > 0) p USING (post_id) ORDER BY idx.post_id LIMIT 10000",
        "health_check": f"{w}{INDEX}, dead AS (SELECT * FROM links WHERE status = 'active' AND t NOT IN (SELECT post_id FROM posts WHERE status = 'publish')) SELECT post_id, greatest(0, incoming_links - (SELECT count(*) FROM dead d WHERE d.t = post_id))::INTEGER AS incoming_links, greatest(0, outgoing_links - (SELECT count(*) FROM dead d WHERE d.s = post_id))::INTEGER AS outgoing_links FROM idx",
    }
