"""Evaluation against labels, calibration, rule mining and weight learning."""

from __future__ import annotations

from textassay.operators.rules import total

# Keywords of the candidate rule set, and parts of keywords that point to a dimension.
CANDIDATE = ("***", "&&&", "worthless")
INDICATORS = {"scam": ("trash", "worthless", "scum"), "adv": ("license", "apache", "***", "&&&"), "emo": ("!!",)}
MIN_COUNT = 3
MISSED = "verdict = 'junk' AND scale <> 'junk'"
#: Judgements of a document that stand beside its grams as counts, since a document may be judged more than once.
COUNTED = {"missed_n": MISSED, "removed_n": "verdict <> 'junk' AND scale = 'junk'", "passed_n": "verdict = scale AND verdict <> 'junk'"}


def judged(d) -> str:
    """Scores with labels: y, prediction scales, texts."""
    any_high = " OR ".join(f"coalesce({x} >= 60 AND {x}_conf >= 0.7, FALSE)" for x in ("scam", "emo", "adv", "ai"))
    border = " OR ".join(f"coalesce({x} >= 50 AND {x} < 70, FALSE)" for x in ("scam", "emo", "adv"))
    return f"""
SELECT s.doc_id, s.lang, s.source, s.t, s.overall, s.worst, f.quality, f.toxic, f.verdict, ({any_high}) AS junk,
  CASE WHEN s.reason LIKE 'high%' AND s.worst >= 70 THEN 'junk' WHEN {border} THEN 'borderline' WHEN s.worst >= 70 THEN 'junk' ELSE 'quality' END AS pred3,
  CASE WHEN f.quality = 0 THEN 'junk' WHEN f.toxic = 1 THEN 'borderline' ELSE 'quality' END AS true3,
  CASE WHEN s.overall < 40 THEN 'junk' WHEN s.overall <= 70 THEN 'ok' ELSE 'excellent' END AS scale,
  least(100.0, s.worst + 20.0 * {total([d.contains('s.t', w) for w in CANDIDATE])}) AS worst_b, s.scam, s.emo, s.adv, s.ai FROM scored s JOIN feedback f ON s.doc_id = f.doc_id"""


def grams(d) -> str:
    """Distinct word 1- and 2-grams of each judged document."""
    words = d.rxall("t", "[^ \\t\\n\\r\\f]+")
    if d.name == "spark":
        both = "concat(w, zip_with(slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, size(w)), (a, b) -> concat(a, ' ', b)))"
    else:
        both = f"list_concat(w, {d.each(d.seq('1', 'len(w) - 1'), 'k', 'concat(list_extract(w, k), chr(32), list_extract(w, k + 1))')})"
    if d.name != "spark":
        return f"SELECT doc_id, quality, miss, x AS gram FROM {d.explode('doc_id, quality, miss', d.distinct(both), f'(SELECT doc_id, quality, {MISSED} AS miss, {words} AS w FROM judged)')}"
    kept = f"doc_id, quality, miss, {', '.join(COUNTED)}"
    return f"SELECT {kept}, x AS gram FROM {d.explode(kept, d.distinct(both), f'(SELECT {kept}, {words} AS w FROM judged_parts)')}"


def judged_parts(d) -> str:
    """The texts that grams come from; Spark stores them and reads them in parts of bounded size."""
    counts = ", ".join(f"count(CASE WHEN {test} THEN 1 END) OVER (PARTITION BY doc_id) AS {name}" for name, test in COUNTED.items())
    return f"SELECT doc_id, quality, {MISSED} AS miss, {counts}, t FROM judged"


def missed(d) -> str:
    """Junk by the user's word that the score let pass."""
    return f"SELECT doc_id FROM judged WHERE {MISSED}"


def terms(d) -> str:
    """TF-IDF of grams of missed documents: share of missed documents times log of inverse document frequency."""
    return f"""
SELECT gram, fn_df, df, CAST(round(CAST(fn_df AS DOUBLE) / nf * ln(CAST(n AS DOUBLE) / df), 9) AS DOUBLE) AS tfidf
FROM (SELECT gram, count(*) AS df, count(CASE WHEN miss THEN 1 END) AS fn_df FROM grams GROUP BY gram) a
CROSS JOIN (SELECT count(*) AS n FROM judged) b CROSS JOIN (SELECT greatest(count(*), 1) AS nf FROM missed) c WHERE fn_df >= {MIN_COUNT}"""


def top_terms(d) -> str:
    return "SELECT gram, fn_df, df, tfidf, row_number() OVER (ORDER BY tfidf DESC, gram) AS rn FROM (SELECT * FROM terms ORDER BY tfidf DESC, gram LIMIT 30)"


def deltas(d) -> str:
    wrong = "(quality = 0 AND overall > 60 OR quality = 1 AND overall < 40)"
    parts = [f"SELECT doc_id, '{x}' AS dim, CASE WHEN overall > 60 AND coalesce({x}, 0) < 50 THEN -0.05 WHEN overall < 40 AND coalesce({x}, 0) > 50 THEN 0.05 END AS delta FROM judged WHERE {wrong}" for x in ("ai", "emo", "adv", "scam")]
    return "SELECT doc_id, dim, CAST(delta AS DOUBLE) AS delta FROM (" + " UNION ALL ".join(parts) + ") WHERE delta IS NOT NULL"


BASES = {"judged": judged, "judged_parts": judged_parts, "grams": grams, "missed": missed, "terms": terms, "top_terms": top_terms, "deltas": deltas}


def _rates(tp: str, fp: str, fn: str) -> str:
    p = f"CASE WHEN {tp} + {fp} = 0 THEN 0.0 ELSE CAST({tp} AS DOUBLE) / ({tp} + {fp}) END"
    r = f"CASE WHEN {tp} + {fn} = 0 THEN 0.0 ELSE CAST({tp} AS DOUBLE) / ({tp} + {fn}) END"
    return f"{p} AS precision_, {r} AS recall_, CASE WHEN 2 * {tp} + {fp} + {fn} = 0 THEN 0.0 ELSE CAST(2 * {tp} AS DOUBLE) / (2 * {tp} + {fp} + {fn}) END AS f1"


def _binary(d) -> str:
    return f"SELECT tp, fp, tn, fn, {_rates('tp', 'fp', 'fn')}, CASE WHEN tp + fp + tn + fn = 0 THEN 0.0 ELSE CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) END AS accuracy FROM (SELECT count(CASE WHEN junk AND quality = 0 THEN 1 END) AS tp, count(CASE WHEN junk AND quality = 1 THEN 1 END) AS fp, count(CASE WHEN NOT junk AND quality = 1 THEN 1 END) AS tn, count(CASE WHEN NOT junk AND quality = 0 THEN 1 END) AS fn FROM judged)"


def _three(d) -> str:
    classes = d.rows("class", [["'junk'"], ["'borderline'"], ["'quality'"]])
    return f"SELECT class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {_rates('tp', 'fp', 'fn')} FROM (SELECT k.class, sum(CASE WHEN c.t3 = k.class AND c.p3 = k.class THEN c.n ELSE 0 END) AS tp, sum(CASE WHEN c.t3 <> k.class AND c.p3 = k.class THEN c.n ELSE 0 END) AS fp, sum(CASE WHEN c.t3 = k.class AND c.p3 <> k.class THEN c.n ELSE 0 END) AS fn FROM (SELECT true3 AS t3, pred3 AS p3, count(*) AS n FROM judged GROUP BY true3, pred3) c CROSS JOIN {classes} k GROUP BY k.class)"


def _accumulate(d) -> str:
    """Sum of deltas clamped to [-1, 1] after every step.

    A clamped addition is x -> least(hi, greatest(lo, x + a)); these compose, so each day is
    folded by itself and a user's days are folded after.
    """
    step = "SELECT user_id, event_type AS dim, ts, event_id, (CAST(event_id % 7 AS DOUBLE) - 3) * 0.3 AS delta FROM events"
    if d.name != "spark":
        return f"SELECT user_id, dim, CAST(round(list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list(delta ORDER BY ts, event_id)), lambda x, y: greatest(-1.0, least(1.0, x + y))), 6) AS DOUBLE) AS weight, count(*) AS n FROM ({step}) GROUP BY user_id, dim"
    then = "named_struct('a', f.a + g.a, 'lo', least(g.hi, greatest(g.lo, f.lo + g.a)), 'hi', least(g.hi, greatest(g.lo, f.hi + g.a)))"
    start = "named_struct('a', 0.0D, 'lo', -1e9D, 'hi', 1e9D)"
    own = "named_struct('a', delta, 'lo', -1.0D, 'hi', 1.0D)"
    day = f"SELECT user_id, dim, CAST(ts AS DATE) AS day, count(*) AS n, aggregate(transform(array_sort(collect_list(named_struct('ts', ts, 'id', event_id, 'f', {own}))), x -> x.f), {start}, (f, g) -> {then}) AS f FROM ({step}) GROUP BY user_id, dim, CAST(ts AS DATE)"
    return f"SELECT user_id, dim, round(least(f.hi, greatest(f.lo, f.a)), 6) AS weight, n FROM (SELECT user_id, dim, sum(n) AS n, aggregate(transform(array_sort(collect_list(named_struct('day', day, 'f', f))), x -> x.f), {start}, (f, g) -> {then}) AS f FROM ({day}) GROUP BY user_id, dim)"


def _distinctive(d, target: str) -> str:
    """Grams of the target's documents that no rightly passed document holds."""
    if d.name == "spark":
        hits = next(name for name, test in COUNTED.items() if test == target)
        return f"SELECT gram, n FROM (SELECT gram, sum({hits}) AS n, sum(passed_n) AS others FROM grams GROUP BY gram) WHERE others = 0 AND n >= 2 ORDER BY n DESC, gram LIMIT 10"
    return f"SELECT gram, n FROM (SELECT g.gram, count(*) AS n FROM grams g JOIN (SELECT doc_id FROM judged WHERE {target}) m ON g.doc_id = m.doc_id LEFT JOIN (SELECT DISTINCT g.gram FROM grams g JOIN (SELECT doc_id FROM judged WHERE verdict = scale AND verdict <> 'junk') b ON g.doc_id = b.doc_id) x ON g.gram = x.gram WHERE x.gram IS NULL GROUP BY g.gram) WHERE n >= 2 ORDER BY n DESC, gram LIMIT 10"


def _vocab(d, where: str, operation: str) -> str:
    """Grams by the quality of their documents: one aggregation here, a set operation in the oracle."""
    if d.name == "spark":
        return f"SELECT gram FROM (SELECT gram, count(CASE WHEN quality = 0 THEN 1 END) AS low, count(CASE WHEN quality = 1 THEN 1 END) AS high FROM grams GROUP BY gram) WHERE {where}"
    return f"SELECT gram FROM grams g JOIN judged j ON g.doc_id = j.doc_id WHERE j.quality = 0 {operation} SELECT gram FROM grams g JOIN judged j ON g.doc_id = j.doc_id WHERE j.quality = 1"


def near_terms(d) -> str:
    """Each top term with each of its partners."""
    return f"SELECT term1 AS gram, term2 AS near, n FROM ({_cooccurrence(d)}) UNION ALL SELECT term2 AS gram, term1 AS near, n FROM ({_cooccurrence(d)})"


def term_list(d) -> str:
    """One row: the top terms (30 at most) in order, each with its partners."""
    near = f"SELECT gram, {d.collect('near', 'near')} AS nears FROM near_terms GROUP BY gram"
    item = "named_struct('gram', t.gram, 'nears', coalesce(b.nears, slice(array(t.gram), 1, 0)))"
    if d.name != "spark":  # a fold's elements and its state are of one type there
        item = "{'gram': t.gram, 'nears': coalesce(b.nears, CAST([] AS VARCHAR[])), 'used': CAST([] AS VARCHAR[]), 'groups': CAST([] AS VARCHAR[][])}"
    return f"SELECT {d.collect(item, 't.rn')} AS items FROM top_terms t LEFT JOIN ({near}) b ON t.gram = b.gram"


def term_groups(d) -> str:
    """Terms taken greedily in order: an unused one with unused partners leads a group of them, four partners at most by name.

    A first term without partners is a group by itself; later ones without are left out.
    """
    if d.name == "spark":
        free = "array_sort(array_except(x.nears, s.used))"
        group = f"concat(array(x.gram), slice({free}, 1, 4))"
        none = "CAST(array() AS ARRAY<STRING>)"
        add = f"CASE WHEN array_contains(s.used, x.gram) OR size({free}) = 0 AND size(s.used) > 0 THEN s ELSE named_struct('used', concat(s.used, {group}), 'groups', concat(s.groups, array({group}))) END"
        fold = f"aggregate(items, named_struct('used', {none}, 'groups', CAST(array() AS ARRAY<ARRAY<STRING>>)), (s, x) -> {add}, s -> s.groups)"
        each = f"SELECT g + 1 AS g, k + 1 AS k, gram FROM (SELECT {fold} AS groups FROM term_list) LATERAL VIEW posexplode(groups) AS g, members LATERAL VIEW posexplode(members) AS k, gram"
    else:
        free = "list_sort(list_filter(x.nears, lambda n: NOT list_contains(s.used, n)))"
        group = f"list_concat([x.gram], list_slice({free}, 1, 4))"
        add = f"CASE WHEN list_contains(s.used, x.gram) OR len({free}) = 0 AND len(s.used) > 0 THEN s ELSE {{'gram': x.gram, 'nears': x.nears, 'used': list_concat(s.used, {group}), 'groups': list_append(s.groups, {group})}} END"
        start = "{'gram': '', 'nears': CAST([] AS VARCHAR[]), 'used': CAST([] AS VARCHAR[]), 'groups': CAST([] AS VARCHAR[][])}"
        each = f"SELECT g, k, list_extract(members, k) AS gram FROM (SELECT g, members, unnest(range(1, len(members) + 1)) AS k FROM (SELECT g, list_extract(groups, g) AS members FROM (SELECT groups, unnest(range(1, len(groups) + 1)) AS g FROM (SELECT list_reduce(list_prepend({start}, items), lambda s, x: {add}).groups AS groups FROM term_list))))"
    return f"SELECT e.gram, t.tfidf, e.k, e.g FROM ({each}) e JOIN top_terms t ON e.gram = t.gram"


def _candidates(d) -> str:
    """Five rules at most, of five keywords at most; confidence is the share of missed documents that hold a keyword."""
    hints = ", ".join("sum(CASE WHEN " + " OR ".join(d.contains("lower(gram)", w) for w in words) + f" THEN 1 ELSE 0 END) AS {x}" for x, words in INDICATORS.items())
    best = f"greatest({', '.join(INDICATORS)})"
    named = " ".join(f"WHEN {x} = {best} THEN '{x}'" for x in INDICATORS)
    rules = f"SELECT g, {d.collect('gram', 'k')} AS words, max(tfidf) AS top, {hints} FROM term_groups WHERE g <= 5 GROUP BY g"
    held = "SELECT t.g, CAST(count(DISTINCT h.doc_id) AS DOUBLE) / max(c.nf) AS share FROM term_groups t JOIN hits_top h ON t.gram = h.gram CROSS JOIN (SELECT greatest(count(*), 1) AS nf FROM missed) c GROUP BY t.g"
    return f"SELECT concat('mined_', CAST(r.g AS VARCHAR(9))) AS name, CASE WHEN {best} = 0 THEN 'scam' {named} END AS dimension, {d.join('r.words', ', ')} AS keywords, CAST(round(least(50.0, greatest(15.0, 100 * r.top)), 1) AS DOUBLE) AS contribution, CAST(round(CASE WHEN {best} = 0 THEN least(h.share, 0.5) ELSE h.share END, 2) AS DOUBLE) AS confidence FROM ({rules}) r JOIN ({held}) h ON r.g = h.g"


def _cooccurrence(d) -> str:
    return f"SELECT a.gram AS term1, b.gram AS term2, count(*) AS n FROM hits_top a JOIN hits_top b ON a.doc_id = b.doc_id AND a.gram < b.gram GROUP BY a.gram, b.gram HAVING count(*) >= {MIN_COUNT}"


BASES |= {"near_terms": near_terms, "term_list": term_list, "term_groups": term_groups}
QUERIES = {
    "calibration_stats": lambda d: "SELECT total, CASE WHEN total = 0 THEN 0.0 ELSE 100.0 * agreed / total END AS agreement, fp, fn FROM (SELECT CAST(count(*) AS DOUBLE) AS total, count(CASE WHEN scale = verdict THEN 1 END) AS agreed, count(CASE WHEN scale = 'junk' AND verdict <> 'junk' THEN 1 END) AS fp, count(CASE WHEN scale <> 'junk' AND verdict = 'junk' THEN 1 END) AS fn FROM judged)",
    "confusion_binary": _binary,
    "category_recall": lambda d: "SELECT lang, count(*) AS n, CAST(count(CASE WHEN junk THEN 1 END) AS DOUBLE) / count(*) AS recall_ FROM judged WHERE quality = 0 GROUP BY lang",
    "category_fpr": lambda d: "SELECT lang, count(*) AS n, CAST(count(CASE WHEN junk THEN 1 END) AS DOUBLE) / count(*) AS fpr FROM judged WHERE quality = 1 GROUP BY lang",
    "confusion_3class": _three,
    "rules_ab_join": lambda d: "SELECT doc_id, quality, CASE WHEN worst >= 70 THEN 'junk' WHEN worst >= 40 THEN 'suspicious' ELSE 'quality' END AS pred_a, CASE WHEN worst_b >= 70 THEN 'junk' WHEN worst_b >= 40 THEN 'suspicious' ELSE 'quality' END AS pred_b FROM judged",
    "rules_ab_test": lambda d: "SELECT tp_a, tp_b, tp_b - tp_a AS tp_delta, fp_a, fp_b, fp_b - fp_a AS fp_delta, CASE WHEN junk = 0 THEN 0.0 ELSE CAST(tp_a AS DOUBLE) / junk END AS recall_a, CASE WHEN junk = 0 THEN 0.0 ELSE CAST(tp_b AS DOUBLE) / junk END AS recall_b FROM (SELECT count(CASE WHEN quality = 0 AND worst >= 70 THEN 1 END) AS tp_a, count(CASE WHEN quality = 0 AND worst_b >= 70 THEN 1 END) AS tp_b, count(CASE WHEN quality = 1 AND worst >= 70 THEN 1 END) AS fp_a, count(CASE WHEN quality = 1 AND worst_b >= 70 THEN 1 END) AS fp_b, count(CASE WHEN quality = 0 THEN 1 END) AS junk FROM judged)",
    "ngram_df": lambda d: "SELECT gram, count(*) AS df FROM grams GROUP BY gram HAVING count(*) >= 5",
    "suggest_keywords": lambda d: _distinctive(d, "verdict = 'junk' AND scale <> 'junk'"),
    "suggest_removals": lambda d: _distinctive(d, "verdict <> 'junk' AND scale = 'junk'"),
    "distinctive_anti": lambda d: "SELECT gram, fn_df FROM terms WHERE fn_df = df",
    "mine_rules_tfidf": lambda d: "SELECT gram, fn_df, df, tfidf FROM top_terms",
    "term_cooccurrence": _cooccurrence,
    "rule_candidates": _candidates,
    "feedback_deltas": lambda d: "SELECT doc_id, dim, delta FROM deltas",
    "weight_accumulate": _accumulate,
    # the last event that moved the sensitivity decides
    "client_calibration": lambda d: f"SELECT user_id, {d.max_by('step', 'moved')} AS adjustment FROM (SELECT user_id, CASE WHEN event_type = 'error' AND k > 5 THEN 5 WHEN event_type = 'signup' AND k > 3 THEN -5 END AS step, CASE WHEN event_type = 'error' AND k > 5 OR event_type = 'signup' AND k > 3 THEN n END AS moved FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)) WHERE moved IS NOT NULL GROUP BY user_id",
    "consistent_median": lambda d: f"SELECT user_id, CAST({d.percentile('value', 0.5)} AS DOUBLE) AS median FROM events GROUP BY user_id",
    "explanation_similarity": lambda d: f"SELECT doc_id, CAST(round(CASE WHEN n = 0 THEN 0.0 ELSE CAST(k AS DOUBLE) / n END, 4) AS DOUBLE) AS similarity FROM (SELECT doc_id, {d.size(d.intersect('a', 'b'))} AS k, {d.size(d.union('a', 'b'))} AS n FROM (SELECT doc_id, {d.distinct(d.each(d.seq('1', 'length(x) - 1'), 'k', 'substring(x, k, 2)'))} AS a, {d.distinct(d.each(d.seq('1', 'length(y) - 1'), 'k', 'substring(y, k, 2)'))} AS b FROM (SELECT doc_id, concat(matched, ' ', lang) AS x, concat(source, ' emotional_excessive_punctuation en') AS y FROM scored)))",
    "vocab_intersect": lambda d: _vocab(d, "low > 0 AND high > 0", "INTERSECT"),
    "vocab_except": lambda d: _vocab(d, "low > 0 AND high = 0", "EXCEPT"),
}
BASES["hits_top"] = lambda d: "SELECT g.doc_id, g.gram FROM grams g JOIN top_terms t ON g.gram = t.gram WHERE g.miss"
