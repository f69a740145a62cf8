"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from linkloom.functions.text import STOP_WORDS
from linkloom.operators.analytics import EVAL_RANK
from linkloom.schema import STATUSES

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_STATES = "['pending', 'ready', 'verified', 'no_anchor', 'inserted', 'rejected', 'ready', 'capped']"

V = """v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
pos AS (SELECT id, unnest(e) AS x, generate_subscripts(e, 1) AS k FROM v),
mean AS (SELECT k, sum(x::DECIMAL(28,18))::DOUBLE / count(x) AS m FROM pos GROUP BY k),
c AS (SELECT pos.id, list(x - m ORDER BY pos.k) AS e FROM pos JOIN mean USING (k) GROUP BY pos.id),
sims AS (SELECT a.id AS s, b.id AS t, round(greatest(0, least(100, (list_cosine_similarity(a.e, b.e) + 1) / 2 * 100)), 2) AS sim FROM c a JOIN c b ON a.id <> b.id)"""
TOP = f"""{V}, top AS (SELECT s, t, sim FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sim DESC, t) AS r FROM sims WHERE sim >= 55) WHERE r <= 8)"""
BOTH = f"""{TOP}, both_ways AS (SELECT s, t, max(sim) AS sim FROM (SELECT s, t, sim FROM top UNION ALL SELECT t, s, sim FROM top WHERE sim >= 60) GROUP BY s, t)"""
OPPS = f"""{BOTH}, opps AS (SELECT s * 1000000 + t AS id, s, t, sim, {_STATES}[(s * 31 + t * 17) % 8 + 1] AS status, (20 + (s * 7 + t * 13) % 77)::INTEGER AS confidence FROM both_ways)"""
LINKS = f"""{OPPS}, links AS (SELECT id, s, t, CASE WHEN id % 5 = 0 THEN 'removed' ELSE 'active' END AS status FROM opps WHERE status = 'inserted')"""
POSTS = r"""posts AS (SELECT d.doc_id AS post_id, substr(split_part(d.text, chr(10), 1), 1, 80) AS title, d.text AS content,
CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'draft' ELSE 'publish' END AS status, 'post' AS type, '/d/' || d.doc_id AS permalink FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
PASSAGES = r"""paras AS (SELECT doc_id AS post_id, generate_subscripts(p, 1) AS k, unnest(p) AS para FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(text, '[ \t]+', ' ', 'g')), '\n\s*\n'),
lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 25) AS p FROM documents)),
folded AS (SELECT post_id, k, CASE WHEN length(para) <= 500 THEN [para] ELSE list_transform(string_split(list_reduce(
string_split(regexp_replace(para, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
lambda acc, x: CASE WHEN length(split_part(acc, chr(2), -1)) + length(x) > 500 AND split_part(acc, chr(2), -1) <> '' THEN acc || chr(2) || ' ' || x ELSE acc || ' ' || x END, ''), chr(2)), lambda x: trim(x)) END AS parts FROM paras),
whole AS (SELECT post_id, list_filter(flatten(list(parts ORDER BY k)), lambda x: x <> '')[1:60] AS parts FROM folded GROUP BY post_id),
passages AS (SELECT post_id, generate_subscripts(parts, 1)::INTEGER - 1 AS idx, unnest(parts) AS text FROM whole)"""
TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 3)"
IDF = rf"""{PASSAGES}, df AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT post_id, unnest({TOKENS}) AS token FROM passages) GROUP BY token),
n AS (SELECT count(DISTINCT post_id) AS n FROM passages)"""


def _phrase(col: str) -> str:
    return rf"list_transform(regexp_split_to_array(lower({col}), '[^\p{{L}}\p{{N}}]+'), lambda x: CASE WHEN length(x) < 3 OR x IN ({_STOP}) THEN '' ELSE x END)"


def _grams(tok: str, n: int) -> str:
    return f"list_transform(list_filter(list_transform(range(1, len({tok}) - {n} + 2), lambda k: {tok}[k:k + {n - 1}]), lambda g: NOT list_contains(g, '')), lambda g: array_to_string(g, ' '))"


def _first(col: str) -> str:
    return f"list_concat({_grams(col, 2)}, {_grams(col, 3)})"


def _distinct(src: str, key: str, lst: str) -> str:
    """Distinct list entries in order of their first place."""
    return f"(SELECT {key}, g, min(k) AS k FROM (SELECT {key}, unnest({lst}) AS g, generate_subscripts({lst}, 1) AS k FROM {src}) GROUP BY {key}, g)"


ACRONYMS = r"regexp_extract_all(regexp_replace({0}, '([^\p{{L}}\p{{N}}_])', ' \1 ', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])(\p{{Lu}}[\p{{Lu}}\p{{Nd}}]{{1,5}})(?:$|[^\p{{L}}\p{{N}}_])', 1)"

CANDS = rf"""{POSTS}, {IDF},
toks AS (SELECT post_id, ' ' || lower(title) || ' ' AS lt, title || ' ' || content AS both_text, {_phrase('title')} AS tt, {_phrase('content')} AS bt FROM posts),
body AS (SELECT post_id, g, row_number() OVER (PARTITION BY post_id ORDER BY k) AS r FROM {_distinct("(SELECT post_id, " + _first('bt') + " AS l FROM toks)", 'post_id', 'l')}),
cand AS (
  {' UNION ALL '.join(f"SELECT post_id, unnest({_grams('tt', n)}) AS phrase, true AS ft, 0.0 AS bonus, 1 AS kind FROM toks" for n in range(2, 7))}
  UNION ALL SELECT post_id, g, false, 0.0, 2 FROM body WHERE r <= 40
  UNION ALL SELECT post_id, lower(unnest({ACRONYMS.format('both_text')})), false, 3.0, 3 FROM toks
  UNION ALL SELECT DISTINCT post_id, w, false, 0.0, 4 FROM (SELECT post_id, unnest(list_concat(tt, bt)) AS w FROM toks) WHERE w <> ''
),
dc AS (SELECT DISTINCT * FROM cand),
ct AS (SELECT post_id, phrase, ft, bonus, kind, unnest(CASE WHEN len(list_filter({_phrase('phrase')}, lambda x: x <> '')) = 0 THEN [NULL] ELSE list_filter({_phrase('phrase')}, lambda x: x <> '') END) AS token FROM dc),
base AS (SELECT post_id, phrase, ft, bonus, kind, max(CASE WHEN token IS NULL THEN 0.0 ELSE ln((n.n + 1) / (coalesce(df.df, 0) + 1)) + 1 END) AS b, max(n.n) AS n
  FROM ct LEFT JOIN df USING (token) CROSS JOIN n GROUP BY post_id, phrase, ft, bonus, kind),
cands AS (SELECT base.post_id, phrase, max(b + bonus + CASE WHEN ft OR contains(lt, ' ' || phrase || ' ') THEN 1.5 ELSE 0 END) AS spec, min(kind) AS kind FROM base JOIN toks USING (post_id)
  WHERE kind < 4 OR b >= ln((n + 1) / (n * 0.15 + 1)) + 1 GROUP BY base.post_id, phrase)"""

PAGES = r"""pposts AS (SELECT page_id AS post_id, lower('/' || split_part(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), ' ', 1)) AS permalink, html FROM pages),
scan AS (SELECT post_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS inner_html,
  generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1), 1)::INTEGER - 1 AS pos FROM pposts),
found AS (SELECT post_id, pos, href, trim(regexp_replace(inner_html, '(?s)<[^>]*>', '', 'g')) AS anchor FROM scan),
paths AS (SELECT lower('/' || trim(url_decode(replace(permalink, '+', '%2B')), '/')) AS path, max(post_id) AS target FROM pposts GROUP BY 1),
site AS (SELECT f.post_id AS source, p.target, min_by(anchor, pos) AS anchor FROM found f JOIN paths p
  ON lower('/' || trim(url_decode(replace(regexp_extract(replace(trim(f.href), '&amp;', '&'), '^([^?#]*)', 1), '+', '%2B')), '/')) = p.path
  WHERE f.href LIKE '/%' AND f.href NOT LIKE '//%' AND f.post_id <> p.target GROUP BY ALL)"""

RECIP = """recip AS (SELECT id, s, t, sim, CASE WHEN r > 1 THEN 'reciprocal' ELSE status END AS status, CASE WHEN r > 1 THEN NULL ELSE confidence END AS confidence
FROM (SELECT *, CASE WHEN status = 'ready' THEN row_number() OVER (PARTITION BY least(s, t), greatest(s, t), status = 'ready' ORDER BY coalesce(confidence, 0) DESC, id) ELSE 1 END AS r FROM opps))"""


def _capped(src: str) -> str:
    return f"""capped AS (SELECT id, s, t, sim, CASE WHEN status = 'ready' AND r > greatest(0, 2 - s % 3) THEN 'capped' ELSE status END AS status, confidence
FROM (SELECT *, row_number() OVER (PARTITION BY s, status = 'ready' ORDER BY confidence DESC NULLS LAST, sim DESC, id) AS r FROM {src}))"""


QUEUE = """q AS (SELECT event_id AS id, user_id AS post_id, event_type AS job_type, ['pending', 'processing', 'done', 'failed'][event_id % 4 + 1] AS status, (floor(value)::BIGINT % 4)::INTEGER AS attempts, ts AS created_at FROM events)"""
_BUCKET = " ".join(f"WHEN '{s}' THEN '{b}'" for s, (b, _) in STATUSES.items())
_RANK = " ".join(f"WHEN '{s}' THEN {r}" for s, r in EVAL_RANK.items())
EVAL = f"""{OPPS}, {POSTS}, pairs AS (SELECT CASE WHEN item_id % 4 = 3 THEN 'negative' ELSE 'positive' END AS kind, lower(split_part(text, ' ', 1)) AS a_fragment, lower(split_part(text, ' ', 2)) AS b_fragment FROM benchmark),
frags AS (SELECT a_fragment AS f FROM pairs UNION SELECT b_fragment FROM pairs),
hit AS (SELECT f, min(post_id) AS p FROM frags JOIN posts ON contains(lower(title), f) WHERE status = 'publish' GROUP BY f),
best AS (SELECT least(s, t) AS lo, greatest(s, t) AS hi, max_by(status, (CASE status {_RANK} ELSE 0 END) * 1000000000000 + id) AS best FROM opps GROUP BY 1, 2),
res AS (SELECT kind, a_fragment, b_fragment, CASE WHEN ha.p IS NULL OR hb.p IS NULL THEN 'unresolved' ELSE coalesce(best, 'absent') END AS status FROM pairs
  LEFT JOIN hit ha ON ha.f = a_fragment LEFT JOIN hit hb ON hb.f = b_fragment LEFT JOIN best ON lo = least(ha.p, hb.p) AND hi = greatest(ha.p, hb.p))"""
AS_OF = "TIMESTAMP '2024-01-20 00:00:00'"


def queries() -> dict[str, str]:
    w = "WITH "
    out = {
        "match_topk": f"{w}{TOP} SELECT s, t, sim FROM top",
        "match_both_directions": f"{w}{BOTH} SELECT s, t, sim FROM both_ways",
        "match_incoming_orphans": f"{w}{V} SELECT s, t, sim FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY sim DESC, s) AS r FROM sims WHERE sim >= 55 AND s % 3 <> 2 AND t % 4 = 1) WHERE r <= 8",
        "match_eligible_only": f"{w}{TOP}, {POSTS}, live AS (SELECT post_id AS id FROM posts WHERE status = 'publish'), good AS (SELECT s, t, sim FROM top WHERE s % 3 < 2 AND t IN (SELECT id FROM live)) SELECT DISTINCT s, t, sim FROM (SELECT * FROM good UNION ALL SELECT t, s, sim FROM good WHERE sim >= 60 AND t % 3 < 2 AND s IN (SELECT id FROM live))",
        "match_upsert": f"{w}{OPPS}, old AS (SELECT s, t, sim - 1 AS sim, status FROM opps WHERE id % 2 = 0) SELECT coalesce(o.s, n.s) AS s, coalesce(o.t, n.t) AS t, round(coalesce(n.sim, o.sim), 2) AS sim, coalesce(o.status, 'pending') AS status FROM old o FULL JOIN top n ON o.s = n.s AND o.t = n.t",
        "doc_vector_mean": f"{w}{V} SELECT id % 50 AS grp, k::INTEGER - 1 AS pos, round(sum(x::DECIMAL(28,18))::DOUBLE / count(x), 6) AS m FROM pos GROUP BY ALL",
        "passages": f"{w}{PASSAGES} SELECT post_id, idx, text FROM passages",
        "passage_counts": f"{w}{PASSAGES} SELECT doc_id AS post_id, coalesce(len(parts), 0)::INTEGER AS n FROM documents LEFT JOIN whole ON doc_id = post_id",
        "content_hash": f"{w}{POSTS}, {PASSAGES} SELECT posts.post_id, md5(concat_ws('|', title, coalesce(array_to_string(parts, '|'), ''))) AS content_hash, coalesce(len(parts), 0)::INTEGER AS passage_count FROM posts LEFT JOIN whole USING (post_id)",
        "idf_table": f"{w}{IDF} SELECT token, df, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf FROM df CROSS JOIN n",
        "distinctive_floor": f"{w}{IDF} SELECT n, round(ln((n + 1) / (n * 0.15 + 1)) + 1, 6) AS floor FROM n",
        "ngrams_2_3": f"{w}t AS (SELECT {_phrase('text')} AS tok FROM documents) SELECT gram, count(*) AS n FROM (SELECT unnest({_first('tok')}) AS gram FROM t) GROUP BY gram",
        "first_40_ngrams": f"{w}t AS (SELECT doc_id, {_phrase('text')} AS tok FROM documents), l AS (SELECT doc_id, {_first('tok')} AS l FROM t) SELECT doc_id, (r - 1)::INTEGER AS pos, g AS gram FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM {_distinct('l', 'doc_id', 'l')}) WHERE r <= 40",
        "acronyms": f"SELECT DISTINCT doc_id, unnest({ACRONYMS.format('text')}) AS acronym FROM documents",
        "stems": f"{w}t AS (SELECT DISTINCT unnest({TOKENS}) AS word FROM documents) SELECT word, CASE " + " ".join(f"WHEN word LIKE '%{e}' AND length(word) > {len(e) + 2} THEN left(word, length(word) - {len(e)})" for e in ("ings", "ing", "ies", "es", "s")) + " ELSE word END AS stem FROM t",
        "anchor_candidates": f"{w}{CANDS} SELECT post_id, phrase, round(spec, 6) AS spec FROM cands",
        "confidence_score": f"{w}{OPPS} SELECT s, t, greatest(20, least(96, round(0.6 * sim + 3 * greatest(s % 5, 1) + greatest(0, least(15, 4 * (t % 9 - 2.5))) + 10)))::INTEGER AS confidence FROM opps",
        "link_scan": f"{w}{PAGES} SELECT post_id, pos, href, anchor FROM found",
        "resolved_links": f"{w}{PAGES} SELECT source, target, anchor FROM site",
        "in_degree": f"{w}{PAGES} SELECT target, count(*) AS in_links FROM site GROUP BY target",
        "orphans": f"{w}{PAGES} SELECT post_id FROM pposts WHERE post_id NOT IN (SELECT target FROM site)",
        "reciprocal_resolve": f"{w}{OPPS}, {RECIP} SELECT * FROM recip",
        "source_caps": f"{w}{OPPS}, {_capped('opps')} SELECT * FROM capped",
        "finalize": f"{w}{OPPS}, {RECIP}, {_capped('recip')} SELECT id, s, t, sim, CASE WHEN status = 'ready' AND confidence >= 75 THEN 'inserted' ELSE status END AS status, confidence FROM capped",
        "reapply_thresholds": f"{w}{OPPS}, k AS (SELECT *, (s * 5 + t * 3) % 11 AS k FROM opps), o AS (SELECT *, CASE WHEN id % 2 = 1 THEN k > 1 AND (k = 2 OR k <> 3) AND 60 + 4 * k >= 75 AND k <> 4 END AS ok FROM k) SELECT id, s, t, sim, CASE WHEN ok IS NULL THEN status WHEN ok THEN 'verified' ELSE 'rejected_relevance' END AS status, CASE WHEN ok THEN (60 + 4 * k)::INTEGER ELSE confidence END AS confidence FROM o",
        "reevaluate": f"{w}{OPPS}, o AS (SELECT *, status IN ('ready', 'verified', 'no_anchor', 'capped') AS again FROM opps) SELECT id, s, t, sim, CASE WHEN again THEN 'pending' ELSE status END AS status, CASE WHEN NOT again THEN confidence END AS confidence FROM o",
        "rebuild_matches": f"{w}{OPPS} SELECT s, t, sim, CASE WHEN status IN ('pending', 'ready', 'no_anchor') THEN 'pending' ELSE status END AS status FROM opps",
        "trash_and_delete": f"{w}{OPPS} SELECT * FROM opps WHERE NOT (status IN ('pending', 'ready') AND (s % 10 = 3 OR t % 10 = 3)) AND s % 10 <> 7 AND t % 10 <> 7",
        "status_counts": f"{w}{OPPS} SELECT x.status, count(opps.id) AS n FROM (SELECT unnest([{', '.join(repr(s) for s in STATUSES)}]) AS status) x LEFT JOIN opps ON x.status = opps.status GROUP BY x.status",
        "bucket_counts": f"{w}{OPPS} SELECT CASE status {_BUCKET} ELSE 'working' END AS bucket, count(*) AS n FROM opps GROUP BY 1",
        "totals": f"{w}{LINKS}, {PAGES} SELECT (SELECT count(*) FROM pposts) AS published, (SELECT count(*) FROM pposts) AS indexed, (SELECT count(*) FROM opps) AS opportunities, (SELECT count(*) FROM links WHERE status = 'active') AS active_links, (SELECT count(*) FROM site) AS site_links, (SELECT count(*) FROM pposts WHERE post_id NOT IN (SELECT target FROM site)) AS orphans",
        "review_list": f"{w}{OPPS} SELECT * FROM opps WHERE status IN ('ready', 'verified') ORDER BY confidence DESC, sim DESC, id DESC LIMIT 200",
        "focus_list": f"{w}{OPPS} SELECT * FROM opps WHERE s = 3 OR t = 3 ORDER BY coalesce(list_position(['verified', 'ready', 'inserted', 'pending'], status), 0), confidence DESC, id DESC LIMIT 200",
        "index_page": f"{w}{POSTS} SELECT post_id, title, status FROM posts ORDER BY post_id DESC LIMIT 25 OFFSET 25",
        "graph_edges": f"{w}{OPPS} SELECT least(s, t) AS a, greatest(s, t) AS b, round(max(sim), 1) AS weight, bool_or(status = 'inserted') AS inserted FROM opps WHERE sim >= 55 AND s % 7 <> 0 AND t % 7 <> 0 GROUP BY 1, 2",
        "graph_degree": f"{w}{OPPS}, e AS (SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b FROM opps WHERE s % 7 <> 0 AND t % 7 <> 0) SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id",
        "broken_links": f"{w}{LINKS}, {POSTS} SELECT id, s, t, CASE WHEN status = 'active' AND t NOT IN (SELECT post_id FROM posts WHERE status = 'publish') THEN 'broken' ELSE status END AS status FROM links",
        "link_counters": f"{w}{LINKS} SELECT id AS post_id, (SELECT count(*) FROM links l WHERE l.status = 'active' AND l.s = v.id) AS outgoing_links, (SELECT count(*) FROM links l WHERE l.status = 'active' AND l.t = v.id) AS incoming_links FROM v",
        "suggestion_counts": f"{w}{OPPS}, l AS (SELECT * FROM opps WHERE status IN ('pending', 'ready', 'verified', 'inserted')) SELECT id, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT s AS id, 1 AS o, 0 AS i FROM l UNION ALL SELECT t, 0, 1 FROM l) GROUP BY id",
        "export_posts": f"{w}{POSTS} SELECT post_id, title, status, type, permalink FROM posts ORDER BY post_id LIMIT 10000",
        "export_opportunities": f"{w}{OPPS}, {POSTS} SELECT o.*, a.title AS source_title, b.title AS target_title FROM (SELECT * FROM opps ORDER BY id LIMIT 10000) o LEFT JOIN posts a ON o.s = a.post_id LEFT JOIN posts b ON o.t = b.post_id",
        "export_links": f"{w}{LINKS}, {POSTS} SELECT o.*, a.title AS source_title, b.title AS target_title FROM (SELECT * FROM links ORDER BY id LIMIT 10000) o LEFT JOIN posts a ON o.s = a.post_id LEFT JOIN posts b ON o.t = b.post_id",
        "eval_report": f"{w}{EVAL} SELECT * FROM res",
        "eval_summary": f"""{w}{EVAL}, cc AS (SELECT kind = 'positive' AS p, status <> 'unresolved' AS k, status IN ('ready', 'verified', 'rewrite_suggested', 'inserted') AS r, status FROM res)
            SELECT count(*) FILTER (p AND k) AS positives_resolved, round(100 * count(*) FILTER (p AND k AND status <> 'absent') / nullif(count(*) FILTER (p AND k), 0), 1) AS candidate_recall, round(100 * count(*) FILTER (p AND r) / nullif(count(*) FILTER (p AND k), 0), 1) AS ready_recall,
            count(*) FILTER (NOT p AND k) AS negatives_resolved, round(100 * count(*) FILTER (NOT p AND k AND NOT r) / nullif(count(*) FILTER (NOT p AND k), 0), 1) AS precision_suppression FROM cc""",
        "queue_counts": f"{w}{QUEUE} SELECT job_type, status, count(*) AS n FROM q GROUP BY ALL",
        "queue_dedupe": f"{w}{QUEUE} SELECT id, post_id, job_type, status FROM (SELECT *, row_number() OVER (PARTITION BY job_type, post_id ORDER BY id) AS r FROM q WHERE status IN ('pending', 'processing')) WHERE r = 1",
        "queue_stale": f"{w}{QUEUE}, z AS (SELECT *, status = 'processing' AND created_at < {AS_OF} - INTERVAL 5 MINUTES AS stale FROM q) SELECT CASE WHEN stale AND attempts >= 3 THEN 'failed' WHEN stale THEN 'pending' ELSE status END AS status, count(*) AS n FROM z GROUP BY 1",
        "queue_batch": f"{w}{QUEUE} SELECT id, job_type, 'processing' AS status, (attempts + 1)::INTEGER AS attempts FROM q WHERE status = 'pending' ORDER BY id LIMIT 20",
        "retention_purge": f"{w}{QUEUE} SELECT job_type, count(*) AS n FROM q WHERE NOT (status = 'done' AND created_at < {AS_OF} - INTERVAL 7 DAYS) GROUP BY job_type",
    }
    return out
