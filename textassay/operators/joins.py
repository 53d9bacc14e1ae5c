"""Look-ups and joins around the score store."""

from __future__ import annotations

from textassay.functions.packs import NEGATIVE, POSITIVE
from textassay.operators.rules import overall_of
from textassay.operators.store import AUTO_BLACKLIST

# Platform domains and their weights; presets of weights.
PLATFORMS = (("example.com", "com", 1.5), ("example.net", "net", 0.5), ("example.org", "org", 1.0))
MODES = (("balanced", 1.0, 1.0), ("strict", 0.8, 1.6), ("lenient", 1.2, 0.6))


def _platforms(d) -> str:
    table = d.rows("domain, platform, adv_weight", [[d.lit(a), d.lit(b), str(w)] for a, b, w in PLATFORMS])
    positive = {n: "50.0" for n, _ in POSITIVE}
    negative = {n: f"coalesce(s.{n}, 0.0)" for n in ("ai", "emo", "scam")} | {"adv": "least(100.0, coalesce(s.adv, 0.0) + CASE WHEN k.platform = 'com' THEN 15.0 ELSE 0.0 END)"}
    weights = {"originality": "1.0", "info_density": "1.0", "reasoning_quality": "1.0", "readability": "0.8", "timeliness": "0.6", "ai": "0.8", "emo": "1.0", "adv": "coalesce(k.adv_weight, 1.0)", "scam": "1.2"}
    return f"SELECT s.doc_id, k.platform, {overall_of(positive, negative, weights)} AS overall FROM store s LEFT JOIN {table} k ON s.host = k.domain OR s.host LIKE concat('%.', k.domain)"


def _modes(d) -> str:
    table = d.rows("mode, good, bad", [[d.lit(m), str(g), str(b)] for m, g, b in MODES])
    return f"SELECT s.doc_id, m.mode, CAST(round((50.0 * 4.4 * m.good + m.bad * ((100 - coalesce(s.ai, 0)) * 0.8 + (100 - coalesce(s.emo, 0)) + (100 - coalesce(s.adv, 0)) + (100 - coalesce(s.scam, 0)) * 1.2)) / (4.4 * m.good + 4.0 * m.bad), 3) AS DOUBLE) AS overall FROM (SELECT s.*, CASE WHEN doc_id % 3 = 0 THEN 'strict' WHEN doc_id % 3 = 1 THEN 'lenient' ELSE 'balanced' END AS wanted FROM scored s) s JOIN {table} m ON s.wanted = m.mode"


def _cache(d) -> str:
    age = d.days_between("DATE '2024-01-28'", "l.scored_on")
    return f"SELECT s.doc_id, l.content_hash IS NOT NULL AS hit, l.overall AS cached FROM (SELECT doc_id, content_hash FROM store) s LEFT JOIN latest l ON s.content_hash = l.content_hash AND {age} < 7"


def _adjust(d) -> str:
    black = d.rows("host", [[d.lit("ththth.example.net")], [d.lit("m.ththth.example.net")]])
    white = d.rows("host", [[d.lit("tionsh.example.net")], [d.lit("ththre.example.com")]])
    delta = "CASE WHEN b.host IS NOT NULL THEN -30 WHEN a.host IS NOT NULL THEN -20 WHEN w.host IS NOT NULL THEN 5 ELSE 0 END"
    return f"""
SELECT s.doc_id, {delta} AS delta, CAST(greatest(0.0, least(100.0, s.overall + {delta})) AS DOUBLE) AS adjusted, CASE WHEN b.host IS NOT NULL THEN 'blacklist' WHEN a.host IS NOT NULL THEN 'auto_blacklist' WHEN w.host IS NOT NULL THEN 'whitelist' END AS reason
FROM store s LEFT JOIN {black} b ON s.host = b.host LEFT JOIN (SELECT host FROM sites WHERE {AUTO_BLACKLIST}) a ON s.host = a.host LEFT JOIN {white} w ON s.host = w.host"""


def weights(d) -> str:
    """Learned weight deltas: users with a row override the default of each dimension."""
    return "SELECT user_id % 7 AS uid, CAST(round(greatest(-1.0, least(1.0, avg(value) / 100 - 0.5)), 3) AS DOUBLE) AS adv_delta FROM events WHERE user_id % 7 < 5 GROUP BY user_id % 7"


def _user_weights(d) -> str:
    return "SELECT s.doc_id, s.user_id, CAST(round((220.0 + (100 - coalesce(s.ai, 0)) * 0.8 + (100 - coalesce(s.emo, 0)) + (100 - coalesce(s.adv, 0)) * (1.0 + coalesce(w.adv_delta, 0.0)) + (100 - coalesce(s.scam, 0)) * 1.2) / (8.4 + coalesce(w.adv_delta, 0.0)), 3) AS DOUBLE) AS overall FROM store s LEFT JOIN weights w ON s.user_id = w.uid"


GOODS, RISKS = [n for n, _ in POSITIVE], [n for n, _ in NEGATIVE]
#: A first reply of less confidence is asked for again, of a dearer judge.
ASK_AGAIN = 0.7
COSTS = ("0.001", "0.01")


# Wording of a reply that repeats an injected instruction.
INJECTED = (
    "ignore previous",
    "ignore all",
    "override instructions",
    "disregard above",
    "ignore above",
    "new instructions",
    "system prompt",
    "forget everything",
    "忽略上述",
    "忽略以上",
    "忽略之前",
    "忽略所有",
    "无视上述",
    "无视以上",
    "新的指令",
    "重新定义",
    "系统提示",
    "覆盖指令",
)


def outer_object(d, x: str) -> str:
    """The first balanced {...} of a reply, null without one: braces inside texts do not count, an open object is none.

    A fold over the characters from the first brace on; replies are short.  The oracle takes
    everything from the first brace to the last, which is the same where a reply holds one object.
    """
    if d.name != "spark":
        return f"nullif(regexp_extract({x}, '(?s)[{{].*[}}]'), '')"
    start = "named_struct('n', 0, 'deep', 0, 'quoted', false, 'escaped', false, 'end', 0)"
    deep = "CASE WHEN s.quoted THEN s.deep WHEN c = '{' THEN s.deep + 1 WHEN c = '}' THEN s.deep - 1 ELSE s.deep END"
    quoted = "CASE WHEN s.escaped THEN s.quoted WHEN c = '\"' THEN NOT s.quoted ELSE s.quoted END"
    step = f"CASE WHEN s.end > 0 THEN s ELSE named_struct('n', s.n + 1, 'deep', {deep}, 'quoted', {quoted}, 'escaped', s.quoted AND NOT s.escaped AND c = r'\\', 'end', CASE WHEN c = '}}' AND NOT s.quoted AND s.deep = 1 THEN s.n + 1 ELSE 0 END) END"
    rest = f"substring({x}, locate('{{', {x}))"
    return f"CASE WHEN contains({x}, '{{') THEN nullif(left({rest}, aggregate(split({rest}, ''), {start}, (s, c) -> {step}, s -> s.end)), '') END"


def replies(d) -> str:
    """Judge replies as they come: fenced, bare, broken, a few out of bounds in all dimensions; made from the documents' scores."""

    def body(conf: str, shift: int) -> str:
        parts = []
        for k, n in enumerate([*GOODS, *RISKS]):
            good = n in GOODS
            value = f"(doc_id * 7 + {13 * k + shift}) % 101" if good else f"CAST(floor({'worst * 1.5' if n == 'scam' else f'coalesce({n}, 0.0)'}) AS INT)"
            value = f"CASE doc_id % 13 WHEN 0 THEN 100 WHEN 1 THEN {99 if good else 1} WHEN 2 THEN {1 if good else 99} ELSE {value} END"
            parts.append(f"'\"{n}\": ', CAST({value} AS STRING), ', '")
        more = "CASE WHEN doc_id % 3 = 0 THEN ', \"meta\": {\"model\": {\"name\": \"m\"}}' ELSE '' END, ', \"summary\": \"a {plain} summary\", \"labels\": [\"x\"]'"
        return "concat('{', " + ", ".join(parts) + f", '\"conf\": 0.', CAST({conf} AS STRING), {more}, ', \"note\": \"n', CAST(doc_id AS STRING), '\"}}')"

    first, second = body("doc_id % 10", 0), body("(doc_id * 3 + 4) % 10", 29)
    return f"""
SELECT doc_id, overall, scam, scam_conf, worst, {second} AS second_reply,
  CASE WHEN doc_id % 5 = 0 THEN concat('```json\n', {first}, '\n```') WHEN doc_id % 5 = 1 THEN 'no json here' WHEN doc_id % 5 = 2 THEN concat('Sure: ', {first}, ' done') ELSE {first} END AS reply FROM scored"""


def parsed(d) -> str:
    """Both replies as numbers; what is missing is neutral, of little confidence."""

    def field(j: str, n: str, high: str, none: str) -> str:
        return f"CASE WHEN {j} IS NULL THEN {none} ELSE greatest(0.0, least({high}, coalesce({d.to_double(d.json(j, n))}, {none}))) END"

    dims = ", ".join(f"{field('j', n, '100.0', '50.0')} AS judge_{n}" for n in [*GOODS, *RISKS])
    return f"""
SELECT doc_id, overall, scam, scam_conf, j IS NOT NULL AS ok, {dims}, {field('j', 'conf', '1.0', '0.1')} AS judge_conf,
  {field('j2', 'scam', '100.0', '50.0')} AS second_scam, {field('j2', 'conf', '1.0', '0.1')} AS second_conf
  , lower(concat(coalesce({d.json('j', 'summary')}, ''), ' ', coalesce({d.json('j', 'labels')}, ''))) AS said
FROM (SELECT *, {outer_object(d, 'reply')} AS j, {outer_object(d, 'second_reply')} AS j2 FROM replies)"""


def _validate(d) -> str:
    """A reply with every dimension at one end, or that repeats an injected instruction, is taken for a forged one and becomes neutral."""
    all_ = lambda names, test: " AND ".join(f"judge_{n} {test}" for n in names)
    # The patterns of a forged reply.
    forged = [(GOODS, "= 100", RISKS, "= 100"), (GOODS, "= 0", RISKS, "= 0"), (GOODS, ">= 98", RISKS, "<= 2"), (GOODS, "<= 2", RISKS, ">= 98")]
    test = " OR ".join(f"({all_(a, x)} AND {all_(b, y)})" for a, x, b, y in forged)
    injected = " OR ".join(d.contains("said", phrase) for phrase in INJECTED)
    dims = ", ".join(f"CAST(CASE WHEN rejected THEN 50.0 ELSE judge_{n} END AS DOUBLE) AS {n}" for n in [*GOODS, *RISKS])
    return f"SELECT doc_id, rejected, {dims}, CAST(CASE WHEN rejected THEN 0.1 ELSE judge_conf END AS DOUBLE) AS conf FROM (SELECT *, ok AND ({test} OR {injected}) AS rejected FROM parsed)"


def _merge(d) -> str:
    """Sure rules first; an unsure first reply gives way to a second of more confidence, and costs add up."""
    again = f"judge_conf < {ASK_AGAIN} AND second_conf > judge_conf"
    pick = lambda rules, second, first: f"CASE WHEN scam_conf >= 0.9 THEN {rules} WHEN {again} THEN {second} ELSE {first} END"
    return f"""
SELECT doc_id, CAST({pick('scam', 'second_scam', 'judge_scam')} AS DOUBLE) AS scam, {pick(d.lit('rules'), d.lit('fallback'), d.lit('judge'))} AS scam_source,
  CAST({pick('0.0', f'{COSTS[0]} + {COSTS[1]}', COSTS[0])} AS DOUBLE) AS cost FROM parsed"""


BASES = {"weights": weights, "replies": replies, "parsed": parsed}

QUERIES = {
    "cache_lookup": _cache,
    "new_items": lambda d: "SELECT p.page_id, p.url FROM pages p LEFT ANTI JOIN (SELECT url FROM pages WHERE page_id % 3 = 0) s ON p.url = s.url" if d.name == "spark" else "SELECT p.page_id, p.url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM (SELECT url FROM pages WHERE page_id % 3 = 0) s WHERE s.url = p.url)",
    "source_reputation": lambda d: "SELECT s.doc_id, s.host, r.mean_score, r.n FROM store s LEFT JOIN sites r ON s.host = r.host",
    "source_adjust": _adjust,
    "platform_weights": _platforms,
    "scoring_mode": _modes,
    "profile_threshold": lambda d: "SELECT uid, CAST(greatest(20, 40 + CAST(adv_delta * 5 AS INT)) AS INT) AS threshold FROM weights",
    "user_weights": _user_weights,
    "judge_parse": lambda d: "SELECT doc_id, ok, CAST(judge_scam AS DOUBLE) AS judge_scam, CAST(judge_conf AS DOUBLE) AS judge_conf FROM parsed",
    "judge_validate": _validate,
    "judge_merge": _merge,
    "compare_pair": lambda d: "SELECT a.doc_id AS left_id, b.doc_id AS right_id, a.overall - b.overall AS overall_delta, coalesce(a.scam, 0.0) - coalesce(b.scam, 0.0) AS scam_delta, coalesce(a.adv, 0.0) - coalesce(b.adv, 0.0) AS adv_delta FROM scored a JOIN scored b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0",
}
