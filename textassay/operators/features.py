"""Per-document features, heuristic classes, genre and reference value."""

from __future__ import annotations

from textassay.functions.packs import LATIN, NEGATIVE, POSITIVE
from textassay.operators.rules import overall_of, status, total

#: White space of lines and sentences, the ideographic and the no-break space included.
SPACE = " \t\n\r\f\u3000\u00a0"
# Sentence ends.
ENDS = "[。！？.!?]+"


# Most characters of a stored text and the mark of a cut one.
STORED_CHARS, CUT = 120_000, "[truncated]"


def trim(d, x: str) -> str:
    return d.trim(x, SPACE)


def _stats(d) -> str:
    sentences = d.only(d.each(d.split("t", "[。！？.!?\\n]+"), "s", trim(d, "s")), "s", "length(s) > 2")
    lines = d.only(d.each(d.split("t", "\\n"), "s", trim(d, "s")), "s", "length(s) > 0")
    lengths = d.each("sents", "s", "length(s)")
    mean = f"aggregate({lengths}, 0L, (a, b) -> a + b)" if d.name == "spark" else f"list_sum({lengths})"
    return f"""
SELECT doc_id, CAST(length(t) AS BIGINT) AS char_count, CAST({d.size('lines')} AS BIGINT) AS paragraph_count, CAST(links AS BIGINT) AS link_count, links > 0 AS has_links, CAST(images AS BIGINT) AS image_count,
  CASE WHEN {d.size('sents')} = 0 THEN 0.0 ELSE CAST(round(CAST({mean} AS DOUBLE) / {d.size('sents')}, 1) AS DOUBLE) END AS avg_sentence_length
FROM (SELECT doc_id, t, {sentences} AS sents, {lines} AS lines, {d.rxcount('t', 'https?://[^ \\t\\n\\)\\]]+')} AS links, {d.rxcount('t', '!\\[[^\\n]*?\\]\\([^\\n]*?\\)')} + {d.rxcount('t', '(?i)<img[ \\t\\n]')} AS images FROM docs)"""


def feats(d) -> str:
    """Numeric features of a text."""
    sentences = d.only(d.split("t", "[。.!！?？]"), "s", f"length({trim(d, 's')}) > 2")
    lengths = d.each("sents", "s", "length(s)")
    chars = f"aggregate({lengths}, 0L, (a, b) -> a + b)" if d.name == "spark" else f"coalesce(list_sum({lengths}), 0)"
    return f"""
SELECT *, CAST(char_count AS DOUBLE) / greatest(line_count, 1) AS avg_line_length, CAST(numbers AS DOUBLE) / greatest(word_count, 1) AS number_ratio,
  CAST({d.size('sents')} AS BIGINT) AS sentence_count, CAST({chars} AS DOUBLE) / greatest({d.size('sents')}, 1) AS avg_sentence_length
FROM (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS char_count, CAST({d.rxcount('t', '[^ \\t\\n\\r\\f]+')} AS BIGINT) AS word_count,
  CAST(CASE WHEN t = '' THEN 0 ELSE {d.rxcount('t', '\\n')} + CASE WHEN {d.rx('t', '\\n$')} THEN 0 ELSE 1 END END AS BIGINT) AS line_count,
  CAST({d.rxcount('t', '[!！]')} AS BIGINT) AS exclamations, CAST({d.rxcount('t', '[?？]')} AS BIGINT) AS questions, CAST({d.rxcount('t', '[.][.][.]|…')} AS BIGINT) AS ellipses,
  {total([d.contains('t', w) for w in LATIN.scam])} AS scam_keywords, {total([d.rx('t', p) for p in LATIN.anxiety])} AS emotional_patterns, {total([d.contains('t', w) for w in LATIN.promo])} AS ad_keywords, {total([d.contains('t', w) for w in LATIN.hedging])} AS ai_patterns,
  {d.rx('t', '(?m)^#')} AS has_title, CAST({d.rxcount('t', '(?m)^.*[^ \\t\\n\\r\\f].*$')} AS BIGINT) AS paragraphs_n, CAST({d.rxcount('t', 'https?://')} AS BIGINT) AS link_n, {d.rxcount('t', '[0-9]+')} AS numbers,
  CAST({d.size(d.distinct(d.chars('t')))} AS DOUBLE) / greatest(length(t), 1) AS char_diversity, {sentences} AS sents FROM docs)"""


def classes(d) -> str:
    ladder = [
        ("scam_keywords >= 3", 15, 0.9),
        ("scam_keywords >= 2", 25, 0.8),
        ("ad_keywords >= 3", 30, 0.8),
        ("emotional_patterns >= 3", 35, 0.75),
        ("char_count < 50", 20, 0.85),
        ("char_count > 2000 AND paragraphs_n > 5 AND scam_keywords = 0 AND ad_keywords = 0", 70, 0.6),
        ("ai_patterns >= 3", 45, 0.6),
    ]
    pick = lambda k, other: "CAST(CASE " + " ".join(f"WHEN {r[0]} THEN {r[k]}" for r in ladder) + f" ELSE {other} END AS DOUBLE)"
    return f"SELECT doc_id, {pick(1, 50)} AS score, {pick(2, 0.5)} AS conf FROM feats"


def genres(d) -> str:
    signals = total([f"{d.rxcount('t', '(?m)^[0-9]+[.)] ')} >= 4", f"{d.rxcount('t', 'github[.]com/')} >= 2", d.rx("t", "(?i)pip install|npm install|brew install"), d.rx("t", "(?i)comparison table"), d.rx("t", "(?i)complete guide|best [0-9]+|top [0-9]+|roundup of")])
    numbered, repos, installs = d.rxcount("t", "(?m)^[0-9]+[.)] "), d.rxcount("t", "github[.]com/"), total([d.contains("lower(t)", w) for w in ("pip install", "npm install", "brew install")])
    return f"""
SELECT doc_id, t, CASE WHEN length(t) < 200 THEN 'default' WHEN scam_n >= 2 OR promo_n >= 3 THEN 'advertorial' WHEN {d.rx('t', '(?i)reported|according to|announced|spokes(man|woman|person)')} AND {d.rx('t', '(?i)yesterday|today|this morning|on (mon|tues|wednes|thurs|fri|satur|sun)day')} THEN 'news'
  WHEN {d.rx('t', '(?i)i think|in my (view|opinion)|i believe|i would argue')} THEN 'opinion' WHEN {signals} >= 2 THEN 'roundup' WHEN {signals} >= 1 THEN 'roundup_profile' ELSE 'default' END AS genre,
  CASE WHEN t = '' THEN 0.0 ELSE CAST(round(CAST(greatest(0.0, least(100.0, 28.0 + least(28.0, {repos} * 2.5) + least(18.0, {numbered} * 1.8) + least(14.0, {installs} * 5.0) + CASE WHEN {d.rx('t', '(?i)comparison table')} THEN 12.0 ELSE 0.0 END + CASE WHEN {d.rx('t', '(?i)install|stars|plugin|changelog')} THEN 6.0 ELSE 0.0 END)) AS DECIMAL(18, 6)), 1) AS DOUBLE) END AS reference_value
FROM hits"""


# Floors, caps, blend and weights of round-ups.
FLOORS = {"info_density": 45.0, "reasoning_quality": 32.0, "readability": 55.0, "timeliness": 48.0}
CAPS = {"ai": 68.0, "adv": 58.0, "scam": 30.0}
BLEND = 0.55
ROUNDUP_WEIGHTS = {"originality": 0.85, "info_density": 1.15, "reasoning_quality": 0.35, "readability": 0.75, "timeliness": 0.65, "ai": 0.55, "emo": 1.0, "adv": 0.75, "scam": 1.15}


def _calibrated(d) -> str:
    """Overall score; round-ups have floors, caps and weights of their own.

    Dimensions that only a judge gives stand at 50.
    """
    positive = {n: f"greatest(50.0, {FLOORS.get(n, 0.0)})" for n, _ in POSITIVE}
    positive["info_density"] = f"least(100.0, greatest(50.0, {FLOORS['info_density']}, reference_value * {BLEND} + 50.0 * {round(1 - BLEND, 2)}))"
    negative = {n: f"least(coalesce(s.{n}, 0.0), {CAPS.get(n, 100.0)})" for n, _ in NEGATIVE}
    return f"SELECT s.doc_id, g.genre, CASE WHEN g.genre LIKE 'roundup%' THEN {overall_of(positive, negative, {n: str(w) for n, w in ROUNDUP_WEIGHTS.items()})} ELSE s.overall END AS overall FROM scored s JOIN genres g ON s.doc_id = g.doc_id"


def _action(d) -> str:
    return f"""
SELECT doc_id, CASE WHEN overall >= 80 THEN 4 WHEN overall >= 60 THEN 3 WHEN overall >= 40 THEN 2 ELSE 1 END AS tier,
  CASE WHEN coalesce(scam, 0) >= 60 THEN 'avoid' WHEN coalesce(emo, 0) >= 70 AND overall < 70 THEN 'verify' WHEN overall >= 73.8 THEN 'read' WHEN overall >= 60 THEN 'skim' ELSE 'skip' END AS action, {status('overall')} AS status FROM scored"""


def dims(d) -> str:
    """Unpivoted dimensions: doc_id, dim, kind, pos, score."""
    parts = [f"SELECT doc_id, '{n}' AS dim, 'risk' AS kind, {k} AS pos, coalesce({n}, 0.0) AS score FROM scored" for k, n in enumerate(("ai", "emo", "adv", "scam"))]
    parts += [f"SELECT doc_id, '{n}' AS dim, 'good' AS kind, {k} AS pos, CAST({x} AS DOUBLE) AS score FROM classes_and_genre" for k, (n, x) in enumerate((("info_density", "reference_value"), ("readability", "class_score")))]
    return " UNION ALL ".join(parts)


BASES = {
    "feats": feats,
    "classes": classes,
    "genres": genres,
    "dims": dims,
    "classes_and_genre": lambda d: "SELECT g.doc_id, g.reference_value, c.score AS class_score FROM genres g JOIN classes c ON g.doc_id = c.doc_id",
}

QUERIES = {
    "article_stats": _stats,
    "text_features": lambda d: "SELECT doc_id, char_count, word_count, line_count, avg_line_length, exclamations, questions, ellipses, scam_keywords, emotional_patterns, ad_keywords, ai_patterns, has_title, paragraphs_n, link_n, number_ratio, char_diversity, sentence_count, avg_sentence_length FROM feats",
    "heuristic_class": lambda d: "SELECT doc_id, score, conf, CASE WHEN score < 30 THEN 'junk' WHEN score < 50 THEN 'low' WHEN score < 70 THEN 'medium' ELSE 'good' END AS category, conf >= 0.85 AS skip FROM classes",
    "genre": lambda d: "SELECT doc_id, genre FROM genres",
    "reference_value": lambda d: "SELECT doc_id, reference_value FROM genres",
    "genre_calibrate": _calibrated,
    "score_tier": lambda d: "SELECT doc_id, CASE WHEN overall >= 80 THEN 'excellent' WHEN overall >= 60 THEN 'good' WHEN overall >= 40 THEN 'fair' ELSE 'poor' END AS tier FROM scored",
    "reading_action": _action,
    "dimension_highlights": lambda d: "SELECT doc_id, kind, dim, score, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY score DESC, pos) AS rn FROM dims) WHERE kind = 'good' AND rn <= 1 OR kind = 'risk' AND rn <= 2",
    "long_text_select": lambda d: "SELECT doc_id, length(t) < 100 AS short, CASE WHEN length(t) <= 5000 THEN t WHEN length(t) > 10000 THEN concat(substring(t, 1, 5000), ' [...] ', right(t, 2000)) ELSE substring(t, 1, 5000) END AS selected FROM docs",
    "storage_truncate": lambda d: f"SELECT doc_id, length(t) > {STORED_CHARS} AS truncated, CASE WHEN length(t) > {STORED_CHARS} THEN concat(substring(t, 1, {STORED_CHARS - len(CUT)}), '{CUT}') ELSE t END AS stored FROM docs",
}
