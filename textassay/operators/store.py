"""The score store: one row per scored document with time and URL; history, trends, reputation."""

from __future__ import annotations

from textassay.operators.rules import status


def store(d) -> str:
    """Documents have neither time nor URL of their own: both follow from doc_id."""
    return f"""
SELECT s.doc_id, {d.sha('s.t')} AS content_hash, s.overall, s.worst, s.confident, s.matched, s.scam, s.emo, s.adv, s.ai, s.lang, s.source, s.t, {d.day('s.doc_id % 28')} AS scored_on, p.url, {d.host('p.url')} AS host, s.doc_id % 7 AS user_id
FROM (SELECT x.*, x.doc_id % c.np AS pid FROM scored x CROSS JOIN (SELECT greatest(count(*), 1) AS np FROM pages) c) s LEFT JOIN pages p ON p.page_id = s.pid"""


def sites(d) -> str:
    return f"SELECT host, {mean(d, 'overall')} AS mean_score, count(*) AS n, sum(100 - worst) AS quality FROM store WHERE host IS NOT NULL GROUP BY host"


def feedback(d) -> str:
    return "SELECT doc_id, quality, toxic, CASE WHEN quality = 0 THEN 'junk' ELSE 'ok' END AS verdict FROM labels WHERE quality IS NOT NULL"


def latest(d) -> str:
    """Newest row of each content hash; its first owner stays."""
    return "SELECT content_hash, doc_id, overall, scored_on, user_id FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY scored_on DESC, doc_id DESC) AS rn FROM store) WHERE rn = 1"


def verdicts(d) -> str:
    return f"SELECT *, {status('100 - worst')} AS status FROM store"


def mean(d, x: str, places: int = 1) -> str:
    """Mean of scores of one decimal, rounded half up: whole numbers throughout, so no order of rows changes it; null without rows."""
    scale = 10 ** (places - 1)
    whole = f"(2 * {scale} * sum(CAST(round({x} * 10) AS BIGINT)) + count({x}))"
    return f"CAST({d.div(whole, f'nullif(2 * count({x}), 0)')} AS DOUBLE) / {10 * scale}.0"


BASES = {"store": store, "sites": sites, "feedback": feedback, "latest": latest, "verdicts": verdicts}


def _days(d) -> str:
    """(user, day) with activity."""
    return "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events"


def _streak(d) -> str:
    island = d.day_minus("day", "rn")
    return f"SELECT user_id, max(day) AS last_day, CAST(max(len) AS BIGINT) AS longest, CAST({d.max_by('len', 'day')} AS BIGINT) AS streak FROM (SELECT user_id, max(day) AS day, count(*) AS len FROM (SELECT user_id, day, {island} AS island FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn FROM ({_days(d)}))) GROUP BY user_id, island) GROUP BY user_id"


def _upsert(d) -> str:
    """A stored row is replaced by a batch row of the same hash if it has no other owner; the owner stays."""
    old = "SELECT content_hash, overall, scored_on, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE user_id END AS owner FROM latest WHERE doc_id % 2 = 0"
    new = "SELECT content_hash, overall + 1 AS overall, scored_on, user_id FROM latest"
    return f"SELECT coalesce(o.content_hash, n.content_hash) AS content_hash, CAST(CASE WHEN n.content_hash IS NULL OR (o.content_hash IS NOT NULL AND o.owner IS NOT NULL AND o.owner <> n.user_id) THEN o.overall ELSE n.overall END AS DOUBLE) AS overall, CASE WHEN o.content_hash IS NULL THEN n.user_id ELSE o.owner END AS owner FROM ({old}) o FULL OUTER JOIN ({new}) n ON o.content_hash = n.content_hash"


# Articles that a site needs, and the mean score up to which it is blacklisted.
AUTO_BLACKLIST = "n >= 5 AND mean_score <= 30"

QUERIES = {
    "score_report": lambda d: f"SELECT lang, source, count(*) AS n, {mean(d, 'overall')} AS mean_score, count(CASE WHEN worst >= 70 THEN 1 END) AS junk FROM scored GROUP BY lang, source",
    "score_store_upsert": _upsert,
    "distinct_exact_dups": lambda d: "SELECT content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM store GROUP BY content_hash",
    "daily_trends": lambda d: f"SELECT scored_on, {mean(d, 'overall')} AS mean_score, count(*) AS n, count(CASE WHEN overall < 40 THEN 1 END) AS junk FROM store WHERE scored_on > {d.day_minus(chr(68) + 'ATE ' + repr('2024-01-28'), 14)} GROUP BY scored_on",
    "summary_stats": lambda d: f"SELECT count(*) AS total, coalesce({mean(d, 'overall')}, 0.0) AS mean_score, count(CASE WHEN overall < 40 THEN 1 END) AS junk, count(CASE WHEN overall > 75 THEN 1 END) AS high FROM store",
    "batch_summary": lambda d: f"SELECT count(CASE WHEN overall > 60 THEN 1 END) AS ok, count(CASE WHEN overall >= 40 AND overall <= 60 THEN 1 END) AS caution, count(CASE WHEN overall < 40 THEN 1 END) AS junk, {mean(d, 'overall', 2)} AS mean_score FROM store WHERE t <> ''",
    "daily_tier_counts": lambda d: "SELECT scored_on, count(CASE WHEN confident THEN 1 END) AS rules_only, count(CASE WHEN NOT confident THEN 1 END) AS escalated FROM store GROUP BY scored_on",
    "domain_reputation": lambda d: "SELECT host, mean_score, n FROM sites",
    "auto_blacklist": lambda d: f"SELECT host, mean_score, n FROM sites WHERE {AUTO_BLACKLIST}",
    "top_sites": lambda d: "SELECT host, n, CAST(quality AS DOUBLE) AS quality FROM sites ORDER BY n DESC, host LIMIT 50",
    "top_site": lambda d: "SELECT host, n, CAST(round(quality / n, 2) AS DOUBLE) AS mean_quality FROM sites ORDER BY n DESC, host LIMIT 1",
    "verdict_daily": lambda d: "SELECT scored_on, count(*) AS total, count(CASE WHEN status IN ('quality', 'normal') THEN 1 END) AS quality, count(CASE WHEN status = 'suspicious' THEN 1 END) AS suspicious, count(CASE WHEN status = 'junk' THEN 1 END) AS junk FROM verdicts GROUP BY scored_on",
    "reading_time_saved": lambda d: f"SELECT {d.month('scored_on')} AS month, 3 * count(CASE WHEN status IN ('suspicious', 'junk') THEN 1 END) AS minutes FROM verdicts GROUP BY {d.month('scored_on')}",
    "store_counts": lambda d: "SELECT 'scores' AS name, count(*) AS n FROM latest UNION ALL SELECT 'feedback', count(*) FROM feedback",
    "latency_percentiles": lambda d: f"SELECT event_type, CAST({d.percentile('value', 0.5)} AS DOUBLE) AS p50, CAST({d.percentile('value', 0.95)} AS DOUBLE) AS p95, CAST({d.percentile('value', 0.99)} AS DOUBLE) AS p99 FROM events GROUP BY event_type",
    "latest_per_hash": lambda d: "SELECT content_hash, doc_id, overall, scored_on FROM latest",
    "activity_streak": _streak,
    "recent_n_per_group": lambda d: "SELECT user_id, event_id, CAST(rn AS INT) AS rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5",
    "rescore_delta": lambda d: "SELECT url, doc_id, overall, CAST(round(overall - lag(overall) OVER (PARTITION BY url ORDER BY scored_on, doc_id), 1) AS DOUBLE) AS delta FROM store WHERE url IS NOT NULL",
    "history_query": lambda d: "SELECT doc_id, overall, scored_on FROM store WHERE overall BETWEEN 40 AND 73 AND matched LIKE '%emotional%' AND scored_on BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' ORDER BY scored_on DESC, content_hash, doc_id LIMIT 50 OFFSET 5",
    "history_count": lambda d: "SELECT count(*) AS n FROM store WHERE overall BETWEEN 40 AND 73 AND matched LIKE '%emotional%' AND scored_on BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'",
    "history_page": lambda d: "SELECT doc_id, overall FROM store ORDER BY scored_on DESC, content_hash, doc_id LIMIT 20 OFFSET 40",
    "review_queue": lambda d: "SELECT doc_id, overall, worst FROM store WHERE overall < 40 OR worst >= 95",
    "hash_prefix_lookup": lambda d: "SELECT q.prefix, min(l.doc_id) AS doc_id FROM (SELECT DISTINCT substring(content_hash, 1, 4) AS prefix FROM latest WHERE doc_id % 100 = 0) q JOIN (SELECT content_hash, doc_id, substring(content_hash, 1, 4) AS prefix FROM latest) l ON l.prefix = q.prefix GROUP BY q.prefix HAVING count(DISTINCT l.content_hash) = 1",
    "feedback_join": lambda d: "SELECT s.content_hash, f.verdict, s.overall FROM feedback f JOIN store s ON s.doc_id = f.doc_id",
    "feedback_append": lambda d: "SELECT doc_id, verdict, CASE WHEN verdict IN ('junk', 'ok', 'excellent') AND toxic = 0 THEN 'accepted' ELSE 'rejected' END AS outcome FROM feedback",
    "parse_labels": lambda d: f"SELECT event_id, coalesce({d.json('props', 'device')}, {d.json('props', 'page')}, 'none') AS label FROM events",
    "read_content": lambda d: f"SELECT doc_id, CAST(length(t) AS BIGINT) AS chars, {d.sha('t')} AS content_hash FROM docs WHERE {d.rxreplace('t', '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$')} <> ''",
    "read_url_list": lambda d: f"SELECT page_id, url FROM pages WHERE {d.rx('url', '^https?://')} AND NOT {d.rx('url', '^#')}",
    "export_verdicts": lambda d: f"SELECT concat_ws('\t', CAST(doc_id AS STRING), {status('overall')}) AS line FROM store",
}
