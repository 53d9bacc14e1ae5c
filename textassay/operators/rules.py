"""The rule engine as projections over a document table (doc_id, t).

Order of application is fixed: scam, emotional, promotional, machine-written,
credibility, combinations, platform patterns, custom rules, citing cap.  An unset
dimension is NULL.  Everything is one narrow plan without a shuffle; the counts of
keyword hits are computed once in `hits` and all rules derive from them.
"""

from __future__ import annotations

import re

from textassay.functions import phrases
from textassay.functions.dialect import SCANNED
from textassay.functions.packs import DIMENSIONS, LABELS, LATIN, NEGATIVE, POSITIVE, Pack

# White space and punctuation that do not count as characters of a text.
IGNORED = " \t\n\r\f，。！？、；：“”‘’（）《》"
LINK = "https?://[^ \\t\\n\\r\\f]+"


def keyword(d, x: str, w: str) -> str:
    """Literal containment; ASCII keywords under four characters are matched as words, ignoring case."""
    return d.short_word(x, w) if w.isascii() and len(w) < 4 else d.contains(x, w)


def literal(p: str) -> str:
    """The longest run of letters and blanks that every match of a pattern holds; empty where none is sure."""
    if "\\" in p or "(?" in p.removeprefix("(?i)"):
        return ""
    bare, before = re.sub(r"\[[^\]]*\]", "\0", p.removeprefix("(?i)")), None
    while bare != before:
        bare, before = re.sub(r"\([^()]*\)", "\0", bare), bare
    if "|" in bare:
        return ""
    runs = re.findall("[A-Za-z ]+", re.sub(r".(?:[?*]|\{[^}]*\})", "\0", bare))
    return max(runs, key=len, default="")


def pattern(d, x: str, p: str) -> str:
    """Whether a pattern occurs; on Spark's scanned texts only those that hold its literal are searched, which costs a fraction."""
    word = literal(p) if d.scans else ""
    if len(word) < 3:
        return d.rx(x, p)
    # lower() turns all that (?i) takes for the word into it, and some characters more
    held = f"contains(lower({x}), {d.lit(word.lower())})" if p.startswith("(?i)") else f"contains({x}, {d.lit(word)})"
    return f"({held} AND {d.rx(x, p)})"


def total(terms) -> str:
    return "(" + " + ".join(f"CAST({t} AS INT)" for t in terms) + ")" if terms else "0"


def all_of(terms) -> str:
    return "(" + " AND ".join(terms) + ")" if terms else "FALSE"


def documents(d) -> str:
    return "SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents"


def marked(docs, pack: Pack = LATIN):
    """The document table (doc_id, t) with its phrases, all found in one scan."""
    return phrases.mark(docs, pack, IGNORED)


def _found(pack: Pack, category: str) -> str:
    """Entries of a category in the array that marked() gives."""
    first, last = phrases.numbers(pack).get(category, (0, 0))
    return f"filter(found, f -> f.id >= {first} AND f.id < {last})"


def _hits_found(pack: Pack) -> list[str]:
    """Counts of keyword hits from what one scan found; their number does not grow with the phrases."""
    n = lambda category: f"size({_found(pack, category)})"
    parts = [
        f"{n('scam')} AS scam_n",
        f"{n('promo')} AS promo_n",
        f"aggregate({_found(pack, 'hedging')}, 0, (s, f) -> s + f.n) AS hedge_n",
        "CASE WHEN bare_n = 0 THEN 1.0 ELSE CAST(kinds AS DOUBLE) / bare_n END AS diversity",
        f"{n('credibility')} AS cred_n",
        f"{n('citing')} > 0 AS cited",
    ]
    parts += [f"{n(f'combo_{k}')} = {len(c[1])}" + (" AND FALSE" if not c[1] else "") + f" AS combo_{k}" for k, c in enumerate(pack.combos)]
    parts += [f"{n(f'platform_{k}')} AS platform_{k}" for k in range(len(pack.platforms))]
    return parts + [f"{n(f'custom_{k}')} + {total([pattern(SCANNED, 't', p) for p in r.patterns])} AS custom_{k}" for k, r in enumerate(pack.custom)]


def _hits_sought(d, pack: Pack) -> list[str]:
    """The same counts phrase by phrase."""
    parts = [
        f"{total(keyword(d, 't', w) for w in pack.scam) if pack.scam else 0} AS scam_n",
        f"{total([keyword(d, 't', w) for w in pack.promo])} AS promo_n",
        "CAST(" + (" + ".join(f"((length(t) - length(replace(t, {d.lit(w)}, ''))) / {len(w)}.0)" for w in pack.hedging) or "0") + " AS INT) AS hedge_n",
        f"CASE WHEN length(bare) = 0 THEN 1.0 ELSE CAST({d.size(d.distinct(d.chars('bare')))} AS DOUBLE) / length(bare) END AS diversity",
        f"{total([keyword(d, 't', w) for group in pack.credibility for w in group])} AS cred_n",
        f"({' OR '.join(d.contains('t', w) for w in pack.citing) or 'FALSE'}) AS cited",
    ]
    parts += [f"{all_of([keyword(d, 't', w) for w in words])} AS combo_{k}" for k, (_, words, _, _) in enumerate(pack.combos)]
    parts += [f"{total([keyword(d, 't', w) for w in words])} AS platform_{k}" for k, (_, words) in enumerate(pack.platforms)]
    return parts + [f"{total([d.contains('t', w) for w in r.keywords] + [d.rx('t', p) for p in r.patterns])} AS custom_{k}" for k, r in enumerate(pack.custom)]


def hits(d, pack: Pack = LATIN) -> str:
    common = [
        "CAST(length(t) - length(replace(t, '!', '')) + length(t) - length(replace(t, '！', '')) AS BIGINT) AS bangs",
        f"{total([pattern(d, 't', p) for p in pack.anxiety])} AS anx_n",
        f"CASE WHEN contains(t, '://') THEN {d.rxcount('t', LINK)} ELSE 0 END AS links" if d.scans else f"{d.rxcount('t', LINK)} AS links",
    ]
    if d.scans:
        return f"SELECT *, {', '.join([*common, *_hits_found(pack)])} FROM marked"
    return f"SELECT *, {', '.join([*common, *_hits_sought(d, pack)])} FROM (SELECT *, {d.without('t', IGNORED)} AS bare FROM docs)"


def base_rules(d) -> str:
    """Keyword, punctuation, link and wording rules, each by itself."""
    return """
SELECT *,
  CASE WHEN scam_n >= 3 THEN 95.0 WHEN scam_n >= 1 THEN 75.0 END AS scam_1,
  CASE WHEN scam_n >= 3 THEN 0.95 WHEN scam_n >= 1 THEN 0.8 END AS scam_c1,
  CASE WHEN punct AND anx_n >= 1 THEN 85.0 WHEN punct OR anx_n >= 2 THEN 70.0 END AS emo_1,
  CASE WHEN punct AND anx_n >= 1 THEN 0.9 WHEN punct OR anx_n >= 2 THEN 0.75 END AS emo_c1,
  CASE WHEN punct AND anx_n >= 1 THEN 'emotional_anxiety_and_punctuation' WHEN punct THEN 'emotional_excessive_punctuation' WHEN anx_n >= 2 THEN 'emotional_anxiety_phrases' END AS emo_rule,
  CASE WHEN promo_n >= 1 AND links >= 3 OR promo_n >= 2 THEN 80.0 WHEN promo_n = 1 THEN 60.0 WHEN links >= 3 THEN 55.0 END AS adv_1,
  CASE WHEN promo_n >= 1 AND links >= 3 OR promo_n >= 2 THEN 0.85 WHEN promo_n = 1 THEN 0.7 WHEN links >= 3 THEN 0.6 END AS adv_c1,
  CASE WHEN hedge_n >= 3 OR low_div AND hedge_n >= 1 THEN 65.0 WHEN low_div THEN 55.0 END AS ai,
  CASE WHEN hedge_n >= 3 OR low_div AND hedge_n >= 1 THEN 0.6 WHEN low_div THEN 0.5 END AS ai_conf,
  CASE WHEN cred_n >= 3 THEN 85.0 WHEN cred_n = 2 THEN 70.0 WHEN cred_n = 1 THEN 55.0 END AS cred,
  CASE WHEN cred_n >= 3 THEN 0.85 WHEN cred_n = 2 THEN 0.75 WHEN cred_n = 1 THEN 0.6 END AS cred_c
FROM (SELECT *, 1000.0 * bangs / greatest(length(t), 1) > 5 AS punct, diversity < 0.4 AND length(t) > 200 AS low_div FROM hits)"""


def merged(d, pack: Pack = LATIN) -> str:
    """All steps for each dimension in one expression, then the citing cap.

    Contributions are never negative, so capping at 100 after each step is capping their
    sum.  Expressions stay flat: nested steps would double in size when a filter on a
    score is pushed below them.
    """
    name = lambda when, n: f"CASE WHEN {when} THEN {d.lit(n)} END"
    combos = [(dim, f"combo_{k}", boost, n) for k, (n, _, dim, boost) in enumerate(pack.combos)]
    later = [("adv", f"platform_{k} >= 2", 15.0, 0.7, f"platform_{n}_patterns") for k, (n, _) in enumerate(pack.platforms)]
    later += [(r.dimension, f"custom_{k} >= {r.min_hits}" + (f" AND coalesce(source = {d.lit(r.platform)}, FALSE)" if r.platform else ""), r.contribution, r.confidence, r.name) for k, r in enumerate(pack.custom)]
    base = {"scam": ("scam_1", "scam_c1"), "emo": ("emo_1", "emo_c1"), "adv": ("adv_1", "adv_c1"), "ai": ("ai", "ai_conf")}
    out = []
    for dim, (score, conf) in base.items():
        fired = [f"{score} IS NOT NULL"] + ["cred IS NOT NULL"] * (dim == "scam")
        added = [f"coalesce({score}, 0.0)"] + ["coalesce(cred, 0.0)"] * (dim == "scam")
        sure = f"greatest(coalesce({conf}, 0.0), coalesce(cred_c, 0.0))" if dim == "scam" else f"coalesce({conf}, 0.0)"
        if own := [c for c in combos if c[0] == dim]:
            sure = f"least({sure} + 0.1 * {total([c[1] for c in own])}, 1.0)"
        steps = [(c[1], c[2]) for c in own] + [(x[1], x[2]) for x in later if x[0] == dim]
        fired += [when for when, _ in steps]
        added += [f"CASE WHEN {when} THEN {add} ELSE 0.0 END" for when, add in steps]
        floors = [f"CASE WHEN {x[1]} THEN {x[3]} ELSE 0.0 END" for x in later if x[0] == dim]
        sure = f"greatest({', '.join([sure, *floors])})" if floors else sure
        any_ = " OR ".join(fired)
        cap = "cited AND " if dim == "scam" else "FALSE AND "
        out.append(f"CAST(CASE WHEN {any_} THEN least({' + '.join(added)}, CASE WHEN {cap}TRUE THEN 35.0 ELSE 100.0 END) END AS DOUBLE) AS {dim}_x")
        out.append(f"CAST(CASE WHEN {any_} THEN least({sure}, CASE WHEN {cap}TRUE THEN 0.75 ELSE 1.0 END) END AS DOUBLE) AS {dim}_cx")
        if dim == "scam":
            capped = f"cited AND ({any_})"
    names = [name("scam_1 IS NOT NULL", "scam_keywords"), "emo_rule", name("adv_1 IS NOT NULL", "advertorial_promo"), name("ai IS NOT NULL", "ai_generated_signals"), name("cred IS NOT NULL", "credibility_unverifiable")]
    names += [name(c[1], c[3]) for c in combos] + [name(x[1], x[4]) for x in later] + [name(capped, "scam_educational_context_cap")]
    out += [f"concat_ws('|', {', '.join(names)}) AS matched", total([f"({n}) IS NOT NULL" for n in names if "combo_" not in n]) + " AS plain_n"]
    final = ", ".join(f"{x}_x AS {x}, {x}_cx AS {x}_conf" for x in base)
    return f"SELECT doc_id, lang, source, t, {final}, matched, plain_n FROM (SELECT doc_id, lang, source, t, {', '.join(out)} FROM base_rules)"


def overall_of(positive: dict[str, str], negative: dict[str, str], weights: dict[str, str] | None = None) -> str:
    """Weighted score 0..100 with one decimal: good dimensions count as they are, risks inversely."""
    w = weights or {n: str(x) for n, x in (*POSITIVE, *NEGATIVE)}
    terms = [f"({positive[n]}) * {w[n]}" for n, _ in POSITIVE] + [f"(100 - ({negative[n]})) * {w[n]}" for n, _ in NEGATIVE]
    whole = " + ".join(w[n] for n, _ in (*POSITIVE, *NEGATIVE))
    # half up on a decimal that is exact for scores and weights of one place
    return f"CAST(round(CAST(greatest(0.0, least(100.0, ({' + '.join(terms)}) / ({whole}))) AS DECIMAL(18, 9)), 1) AS DOUBLE)"


def scored(d) -> str:
    """Rules with the overall score, decisions and verdict of each document."""
    overall = overall_of({n: "50.0" for n, _ in POSITIVE}, {n: f"coalesce({n}, 0.0)" for n, _ in NEGATIVE})
    confs = ", ".join(f"CASE WHEN {x}_conf > 0 THEN {x}_conf END" for x in DIMENSIONS)
    good = [f"CASE WHEN {x}_conf >= 0.7 THEN {x}_conf END" for x in DIMENSIONS]
    mean = f"({' + '.join(f'coalesce({g}, 0.0)' for g in good)}) / nullif({total([f'({g}) IS NOT NULL' for g in good])}, 0)"
    return f"""
SELECT *,
  {overall} AS overall,
  CAST(greatest(coalesce(scam, 0.0), coalesce(emo, 0.0), coalesce(adv, 0.0)) AS DOUBLE) AS worst,
  (coalesce(scam >= 90 AND scam_conf >= 0.9, FALSE) OR coalesce(emo >= 80 AND emo_conf >= 0.85, FALSE) OR coalesce(adv >= 75 AND adv_conf >= 0.8, FALSE) OR plain_n >= 2) AS confident,
  coalesce(least({confs}), 0.8) AS least_conf,
  CASE WHEN plain_n = 0 AND length(t) > 1000 THEN 'clean_prose_needs_review' WHEN plain_n = 0 THEN 'insufficient_confidence'
       WHEN {' OR '.join(f'coalesce({x} >= 90 AND {x}_conf >= 0.9, FALSE)' for x in DIMENSIONS)} THEN 'high_confidence_single_dimension'
       WHEN plain_n >= 3 AND coalesce({mean} >= 0.85 - 1e-9, FALSE) THEN 'high_confidence_rules' ELSE 'insufficient_confidence' END AS reason
FROM rules"""


def status(x: str) -> str:
    return f"CASE WHEN {x} < 40 THEN 'junk' WHEN {x} <= 60 THEN 'suspicious' WHEN {x} <= 80 THEN 'normal' ELSE 'quality' END"


BASES = {"docs": documents, "hits": hits, "base_rules": base_rules, "rules": merged, "scored": scored}


def _long_form(d) -> str:
    if d.scans:
        kinds = ("scam", "promo", "hedging", "citing")
        cases = " ".join(f"WHEN f.id >= {a} AND f.id < {b} THEN '{c}'" for c, (a, b) in phrases.numbers(LATIN).items() if c in kinds)
        return f"SELECT * FROM (SELECT doc_id, CASE {cases} END AS rule, f.phrase AS keyword FROM marked LATERAL VIEW explode(found) AS f) WHERE rule IS NOT NULL"
    table = d.rows("rule, keyword", [[d.lit(rule), d.lit(w)] for rule, words in (("scam", LATIN.scam), ("promo", LATIN.promo), ("hedging", LATIN.hedging), ("citing", LATIN.citing)) for w in words])
    return f"SELECT docs.doc_id, k.rule, k.keyword FROM docs JOIN {table} k ON contains(docs.t, k.keyword)"


def _verdict(x: str) -> str:
    return f"CASE WHEN {x} < 40 THEN 'junk' WHEN {x} <= 70 THEN 'ok' ELSE 'excellent' END"


# Violation classes in order, with the hits each needs.
VIOLATIONS = (
    ("violence", ("disgusting", "scum", "beat you up", "you deserve to die"), 2),
    ("drugs", ("buy cocaine", "sell meth", "overdose", "no prescription needed"), 1),
    ("porn", ("explicit video", "adult webcam"), 1),
    ("gambling", ("jackpot", "casino", "place your bets", "betting odds"), 2),
    ("phishing", ("confirm your password", "account suspended", "verify your identity"), 1),
)


def _prefilter(d) -> str:
    cases = " ".join(f"WHEN {total([d.contains('t', w) for w in words])} >= {n}{' AND ' + d.rx('t', LINK) if name == 'phishing' else ''} THEN '{name}'" for name, words, n in VIOLATIONS)
    return f"SELECT doc_id, violation, violation IS NULL AS passed, CASE WHEN violation IS NULL THEN NULL ELSE 0.0 END AS fixed_score FROM (SELECT doc_id, CASE {cases} END AS violation FROM docs)"


def _evidence(d) -> str:
    if d.scans:
        groups = [("scam", "scam"), ("promo", "promo"), ("wording", "hedging"), ("credibility", "credibility"), *((r.name, f"custom_{k}") for k, r in enumerate(LATIN.custom))]
        lists = ", ".join(f"transform(slice({_found(LATIN, own)}, 1, 4), f -> named_struct('category', {d.lit(name)}, 'keyword', f.phrase, 'line', f.line))" for name, own in groups)
        return f"SELECT doc_id, e.category, e.keyword, e.line FROM marked LATERAL VIEW explode(concat({lists})) AS e"
    lines = d.explode("doc_id", d.split("t", "\n"), "docs")
    groups = [("scam", LATIN.scam), ("promo", LATIN.promo), ("wording", LATIN.hedging), ("credibility", sum(LATIN.credibility, ())), *((r.name, r.keywords) for r in LATIN.custom)]
    words = [(name, k, w) for name, group in groups for k, w in enumerate(group)]
    table = d.rows("category, pos, keyword", [[d.lit(c), str(k), d.lit(w)] for c, k, w in words])
    return f"""
SELECT doc_id, category, keyword, line FROM (
  SELECT doc_id, category, keyword, line, row_number() OVER (PARTITION BY doc_id, category ORDER BY pos) AS rn
  FROM (SELECT l.doc_id, k.category, k.pos, k.keyword, CAST(min(l.i) AS BIGINT) AS line FROM {lines} l JOIN {table} k ON contains(l.x, k.keyword) GROUP BY l.doc_id, k.category, k.pos, k.keyword)) WHERE rn <= 4"""


def _explanation(d) -> str:
    signals = "concat_ws(', ', CASE WHEN scam >= 60 THEN 'possible scam wording' END, CASE WHEN emo >= 60 THEN 'pressure on emotions' END, CASE WHEN adv >= 60 THEN 'promotional wording' END, CASE WHEN ai >= 60 THEN 'formulaic wording' END)"
    n = total([f"coalesce({x} >= 60, FALSE)" for x in DIMENSIONS])
    return f"""
SELECT doc_id, concat_ws(' ', CASE WHEN overall >= 70 THEN 'Good read.' WHEN overall >= 40 AND NOT (overall <= 55 AND n <= 1) THEN 'Read with care.' WHEN overall >= 40 THEN 'Unclear.' ELSE 'Best skipped.' END,
  CASE WHEN signals <> '' THEN concat('Signs: ', signals, '.') END, CASE WHEN least_conf >= 0.8 THEN 'Quite certain.' ELSE 'Not certain.' END) AS explanation
FROM (SELECT *, {signals} AS signals, {n} AS n FROM scored)"""


def _additive(d) -> str:
    score = "least(100, least(15 * scam_n, 60) + least(10 * anx_n, 30) + least(8 * promo_n, 30))"
    return f"""
SELECT doc_id, score, CASE WHEN score >= 60 THEN 'junk' WHEN score >= 30 OR score >= 25 AND score < 45 THEN 'suspicious' ELSE 'ok' END AS normal,
  CASE WHEN score >= 50 THEN 'junk' WHEN score >= 20 THEN 'suspicious' ELSE 'ok' END AS strict,
  CASE WHEN score >= 75 THEN 'junk' WHEN score >= 40 OR score >= 25 AND score < 45 THEN 'suspicious' ELSE 'ok' END AS relaxed
FROM (SELECT doc_id, {score} AS score FROM hits)"""


def _category(d) -> str:
    rules = d.explode("doc_id", d.split("matched", "[|]"), "(SELECT * FROM scored WHERE matched <> '')")
    label = "CASE WHEN contains(x, 'scam') OR contains(x, 'credib') THEN 'risk' WHEN contains(x, 'emotional') THEN 'tone' WHEN contains(x, 'adv') OR contains(x, 'platform') THEN 'promotion' WHEN contains(x, 'ai_') THEN 'style' WHEN contains(x, 'combo') THEN 'combination' ELSE 'custom' END"
    first = f"(SELECT doc_id, category, min(i) AS first_seen, count(*) AS n FROM (SELECT doc_id, i, {label} AS category FROM {rules}) GROUP BY doc_id, category)"
    return f"SELECT doc_id, category, CAST(first_seen AS BIGINT) AS first_seen, n FROM {first}"


def _labels(d) -> str:
    cases = ", ".join(f"CASE WHEN {dim if dim in DIMENSIONS else '50.0'} >= {least} THEN '{name}' END" for name, dim, least in LABELS)
    return f"SELECT doc_id, concat_ws(',', {cases}) AS labels FROM scored"


def _scales(d) -> str:
    risk = "100 - worst"
    return f"""
SELECT doc_id, {status('overall')} AS status, CASE WHEN overall >= 80 THEN 'A' WHEN overall >= 60 THEN 'B' WHEN overall >= 40 THEN 'C' ELSE 'D' END AS tier,
  CASE WHEN overall > 60 THEN 'OK' WHEN overall >= 40 THEN 'CAUTION' ELSE 'JUNK' END AS batch, {_verdict('overall')} AS calibration,
  CASE WHEN worst >= 70 THEN 'junk' WHEN worst >= 40 THEN 'suspicious' ELSE 'ok' END AS risk,
  CASE WHEN overall < 30 THEN 1 WHEN overall < 50 THEN 2 WHEN overall < 70 THEN 3 ELSE 4 END AS class,
  CASE WHEN confident THEN {status(risk)} ELSE 'inconclusive' END AS rules_only, (CASE WHEN confident THEN {risk} ELSE 50.0 END) < 60 AS is_junk FROM scored"""


QUERIES = {
    "keyword_match": lambda d: f"SELECT doc_id, {keyword(d, 't', 'MIT')} AS has_mit, {keyword(d, 't', 'License')} AS has_license FROM docs",
    "rule_hits_long": _long_form,
    "rule_scam": lambda d: "SELECT doc_id, scam_n, CAST(scam_1 AS DOUBLE) AS score, CAST(scam_c1 AS DOUBLE) AS conf FROM base_rules",
    "rule_punctuation": lambda d: "SELECT doc_id, bangs, punct FROM base_rules",
    "rule_anxiety": lambda d: "SELECT doc_id, anx_n FROM hits",
    "rule_emotional": lambda d: "SELECT doc_id, CAST(emo_1 AS DOUBLE) AS score, CAST(emo_c1 AS DOUBLE) AS conf, emo_rule FROM base_rules",
    "rule_advertorial": lambda d: "SELECT doc_id, promo_n, CAST(links AS BIGINT) AS links, CAST(adv_1 AS DOUBLE) AS score, CAST(adv_c1 AS DOUBLE) AS conf FROM base_rules",
    "lexical_diversity": lambda d: "SELECT doc_id, CAST(diversity AS DOUBLE) AS diversity FROM hits",
    "rule_ai": lambda d: "SELECT doc_id, hedge_n, low_div, ai, ai_conf FROM (SELECT doc_id, hedge_n, low_div, CAST(ai AS DOUBLE) AS ai, CAST(ai_conf AS DOUBLE) AS ai_conf FROM base_rules)",
    "rule_credibility": lambda d: "SELECT doc_id, cred_n, CAST(cred AS DOUBLE) AS cred, CAST(least(coalesce(scam_1, 0.0) + cred, 100.0) AS DOUBLE) AS scam_with_cred FROM base_rules",
    "rule_combo": lambda d: "SELECT doc_id, combo_0, combo_1 FROM hits",
    "rule_platform_patterns": lambda d: "SELECT doc_id, platform_0, platform_1, platform_0 >= 2 AS forum, platform_1 >= 2 AS shop FROM hits",
    "rule_custom": lambda d: "SELECT doc_id, custom_0, custom_1, custom_2, custom_0 >= 2 AS abuse_fired, custom_1 >= 2 AS symbols_fired, custom_2 >= 1 AS shout_fired FROM hits",
    "rule_educational_cap": lambda d: "SELECT doc_id, contains(matched, 'educational') AS capped, scam, scam_conf FROM rules",
    "rule_score_all": lambda d: "SELECT doc_id, matched, scam, scam_conf, emo, emo_conf, adv, adv_conf, ai, ai_conf FROM rules",
    "rule_escalation": lambda d: "SELECT doc_id, reason, reason LIKE 'high%' AS skip FROM scored",
    "overall_score": lambda d: f"SELECT doc_id, overall, {status('overall')} AS status FROM scored",
    "rule_only_score": lambda d: "SELECT doc_id, overall AS rule_score, matched <> '' AS rules_fired FROM scored",
    "fast_verdict": lambda d: "SELECT doc_id, confident, CAST(CASE WHEN confident THEN 100 - worst ELSE 50 END AS DOUBLE) AS verdict, CAST(CASE WHEN confident THEN least_conf ELSE 0.1 END AS DOUBLE) AS conf FROM scored",
    "labels": _labels,
    "content_prefilter": _prefilter,
    "severity": lambda d: "SELECT doc_id, CASE WHEN scam >= 60 THEN 'danger' WHEN adv >= 60 OR emo >= 60 THEN 'warning' WHEN worst > 0 THEN 'info' ELSE 'safe' END AS severity FROM scored",
    "recommendation": lambda d: "SELECT doc_id, CASE WHEN scam >= 60 THEN 'avoid' WHEN adv >= 60 THEN 'check_interest' WHEN overall > 80 THEN 'read' ELSE 'browse' END AS recommendation FROM scored",
    "evidence_locate": _evidence,
    "explanation": _explanation,
    "rule_hit_category": _category,
    "additive_score": _additive,
    "cost_tiering": lambda d: "SELECT reason, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM scored GROUP BY reason",
    "verdict_scales": _scales,
    "rule_hit_ranking": lambda d: f"SELECT x AS rule, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS INT) AS rank FROM {d.explode('doc_id', d.split('matched', '[|]'), chr(40) + 'SELECT * FROM scored WHERE matched <> ' + quote_empty() + chr(41))} GROUP BY x",
    "rules_union": lambda d: "SELECT rule, count(*) AS n FROM (SELECT 'built_in' AS rule FROM rules WHERE scam IS NOT NULL UNION ALL SELECT 'custom' FROM rules WHERE contains(matched, 'custom_')) GROUP BY rule",
    "is_primarily_ascii": lambda d: f"SELECT doc_id, CAST(length({d.rxreplace('t', '[^A-Za-z0-9 ]')}) AS DOUBLE) / greatest(length(t), 1) > 0.5 AS ascii FROM docs",
}


def quote_empty() -> str:
    return "''"
