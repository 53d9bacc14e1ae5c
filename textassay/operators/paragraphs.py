"""Paragraph and sentence tables, writing rhythm, information density and the reading guide."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from textassay.operators.features import ENDS, SPACE, trim
from textassay.operators.rules import total

# Fixed values of the Latin pack: filler, transition and judgement wording.
FILLERS = ("needless to say", "it goes without saying", "as we all know", "at the end of the day", "in today's world", "to be honest", "more or less", "it is worth noting")
TRANSITIONS = ("however", "moreover", "furthermore", "in addition", "on the other hand", "as a result", "in conclusion", "first of all")
#: A paragraph of numbers with wording of a data sheet and none of judgement is thin.
JUDGEMENTS = (" but ", "however", "drawback", "disappoint", "problem", "expected", "in practice")
SPECIFICATIONS = ("GB", "Pro ", "megapixel", "inch", "starting at", "Version", "mAh")
NAMES = "[A-Z][a-z]+( [A-Z][a-z]+)+"
#: What every text with NAMES holds and no other; Java's matcher takes a stack frame for every turn of a group, so long names end in an error.
TWO_NAMES = "[A-Z][a-z]+ [A-Z][a-z]"
#: Characters of an anchor, and the paragraphs up to which each is searched for by itself.
LONGEST, SHORTEST, SEARCHED = 22, 10, 1000
QUOTES = "[“”「」『』]"


def paras(d) -> str:
    """doc_id, i (1-based), p, n (paragraphs of the document)."""
    kept = d.only(d.each(d.split("t", "\\n"), "s", trim(d, "s")), "s", "length(s) > 0")
    return f"SELECT doc_id, CAST(i AS BIGINT) AS i, x AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM {d.explode('doc_id', kept, 'docs')}"


def sents(d) -> str:
    """doc_id, i, j, s: sentences of each paragraph."""
    kept = d.only(d.each(d.split("p", ENDS), "s", trim(d, "s")), "s", "length(s) > 0")
    return f"SELECT doc_id, pi AS i, CAST(i AS BIGINT) AS j, x AS s FROM {d.explode('doc_id, pi', kept, '(SELECT doc_id, i AS pi, p FROM paras)')}"


def named(d, x: str) -> str:
    return d.rx(x, TWO_NAMES if d.name == "spark" else NAMES)


def _score(digits: str, quoted: str, named: str, sheet: str) -> str:
    return f"CASE WHEN {digits} THEN 0.3 ELSE 0.0 END + CASE WHEN {quoted} THEN 0.2 ELSE 0.0 END + CASE WHEN {named} THEN 0.2 ELSE 0.0 END - 0.2 * fillers - CASE WHEN length(p) < 20 THEN 0.2 ELSE 0.0 END + CASE WHEN length(p) > 100 AND specific THEN 0.2 ELSE 0.0 END - CASE WHEN {sheet} THEN 0.15 ELSE 0.0 END"


def valued(d) -> str:
    """paras with what their density is made of, each worked out once and before the rows part, where no filter is pushed below it.

    Spark only; the oracle has the expressions in `density`.
    """
    kept = d.only(d.each(d.split("t", "\\n"), "s", trim(d, "s")), "s", "length(s) > 0")
    any_of = lambda words: "(" + " OR ".join(d.contains("p", w) for w in words) + ")"
    fillers = " + ".join(f"CASE WHEN {d.contains('p', f)} THEN (length(p) - length(replace(p, {d.lit(f)}, ''))) / {len(f)} ELSE 0 END" for f in FILLERS)
    sheet = f"{any_of(SPECIFICATIONS)} AND NOT {any_of(JUDGEMENTS)} AND {d.rxcount('p', '[0-9]+')} >= 3"
    values = f"named_struct('p', p, 'fillers', CAST({fillers} AS INT), 'digits', {d.rx('p', '[0-9]+')}, 'quoted', {any_of(QUOTES.strip('[]'))}, 'named', {named(d, 'p')}, 'sheet', {sheet})"
    return f"SELECT doc_id, CAST(i AS BIGINT) AS i, x.p AS p, count(*) OVER (PARTITION BY doc_id) AS n, x.fillers AS fillers, x.digits AS digits, x.quoted AS quoted, x.named AS named, x.sheet AS sheet, x.digits OR x.quoted OR x.named AS specific FROM {d.explode('doc_id', d.each(kept, 'p', values), 'docs')}"


def density(d) -> str:
    """Information density 0..1 of each paragraph, with the signals it is made of."""
    transitions = f"{total([d.contains('lower(p)', t) for t in TRANSITIONS])} AS transitions"
    if d.name == "spark":
        score = _score("digits", "quoted", "named", "sheet")
        return f"SELECT doc_id, i, p, n, fillers, specific, transitions, CAST(round(greatest(0.0, least(1.0, {score})), 6) AS DOUBLE) AS density FROM (SELECT *, {transitions} FROM valued)"
    fillers = "(" + " + ".join(f"(length(p) - length(replace(p, {d.lit(f)}, ''))) / {len(f)}" for f in FILLERS) + ")"
    fillers = f"CAST({fillers} AS INT)"
    any_of = lambda words: "(" + " OR ".join(d.contains("p", w) for w in words) + ")"
    specific = f"({d.rx('p', '[0-9]+')} OR {d.rx('p', QUOTES)} OR {named(d, 'p')})"
    score = _score(d.rx("p", "[0-9]+"), d.rx("p", QUOTES), named(d, "p"), f"{d.rxcount('p', '[0-9]+')} >= 3 AND NOT {any_of(JUDGEMENTS)} AND {any_of(SPECIFICATIONS)}")
    return f"SELECT doc_id, i, p, n, fillers, specific, transitions, CAST(round(greatest(0.0, least(1.0, {score})), 6) AS DOUBLE) AS density FROM (SELECT *, {fillers} AS fillers, {specific} AS specific, {transitions} FROM paras)"


def kinds(d) -> str:
    """Paragraph classes: suspicious, empty, nugget."""
    return "SELECT *, density < 0.2 AND length(p) > 20 AS is_empty, density >= 0.3 AND specific AS is_nugget, CAST(fillers >= 2 AS INT) + CAST(transitions >= 3 AS INT) + CAST(NOT specific AND length(p) > 200 AS INT) AS reasons FROM density"


def _bigrams(d, x: str) -> str:
    return d.distinct(d.each(d.seq("1", f"length({x}) - 1"), "k", f"substring({x}, k, 2)"))


def shapes(d) -> str:
    """One row a document, without a shuffle: paragraphs, their lengths, sentence lengths, distances of neighbours.

    Spark only; the oracle has its own relational form of each value.
    """
    lines = d.only(d.each(d.split("t", "\\n"), "s", trim(d, "s")), "s", "length(s) > 0")
    pairs = "zip_with(split(left(p, length(p) - 1), ''), split(substring(p, 2), ''), (a, b) -> concat(a, b))"
    bigrams = f"transform(ps, p -> CASE WHEN length(p) > 1 THEN array_distinct({pairs}) ELSE slice(array(''), 1, 0) END)"
    sentences = f"flatten(transform(ps, p -> {d.only(d.each(d.split('p', ENDS), 's', f'length({trim(d, chr(115))})'), 'n', 'n > 0')}))"
    both, sizes = "size(array_intersect(x, y))", "size(x) + size(y)"
    gap = f"CASE WHEN y IS NULL OR {sizes} = 0 THEN NULL ELSE 1.0D - CAST({both} AS DOUBLE) / ({sizes} - {both}) END"
    return f"""
SELECT doc_id, ps, transform(ps, p -> length(p)) AS lens, {sentences} AS sent_lens, zip_with(bs, slice(bs, 2, size(bs)), (x, y) -> {gap}) AS gaps
FROM (SELECT *, {bigrams} AS bs FROM (SELECT doc_id, {lines} AS ps FROM docs))"""


def drift(d) -> str:
    """Jaccard distance of the bigram sets of each paragraph and the next; NULL if both are empty."""
    if d.name == "spark":
        return "SELECT doc_id, CAST(pos + 1 AS BIGINT) AS i, distance FROM shapes LATERAL VIEW OUTER posexplode(gaps) AS pos, distance WHERE pos IS NOT NULL"
    both = f"{d.size(d.intersect('b', 'c'))}"
    return f"""
SELECT doc_id, i, CASE WHEN c IS NULL OR {d.size('b')} + {d.size('c')} = 0 THEN NULL ELSE 1.0 - CAST({both} AS DOUBLE) / ({d.size('b')} + {d.size('c')} - {both}) END AS distance
FROM (SELECT doc_id, i, b, lead(b) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM (SELECT doc_id, i, {_bigrams(d, 'p')} AS b FROM paras))"""


def _moments(a: str) -> str:
    """Count and mean of an array of numbers."""
    return f"named_struct('n', CAST(size({a}) AS BIGINT), 'mean', aggregate({a}, 0.0D, (s, x) -> s + x) / nullif(size({a}), 0))"


def _deviation(a: str, m: str) -> str:
    """Sample standard deviation of an array with moments m, 0 if undefined."""
    return f"CASE WHEN {m}.n > 1 THEN sqrt(aggregate({a}, 0.0D, (s, x) -> s + (x - {m}.mean) * (x - {m}.mean)) / ({m}.n - 1)) ELSE 0.0D END"


def rhythms(d) -> str:
    # The piecewise lines of both scores.
    pl = "CASE WHEN pn < 2 THEN 50.0 WHEN pcv < 0.1 THEN 95.0 WHEN pcv < 0.2 THEN 95.0 - (pcv - 0.1) * 200.0 WHEN pcv < 0.35 THEN 75.0 - (pcv - 0.2) * (25.0 / 0.15) WHEN pcv < 0.5 THEN 50.0 - (pcv - 0.35) * (30.0 / 0.15) ELSE greatest(5.0, 20.0 - (pcv - 0.5) * 30.0) END"
    sl = "CASE WHEN coalesce(sn, 0) < 3 THEN 50.0 WHEN scv >= 0.6 THEN least(95.0, 85.0 + (scv - 0.6) * 25.0) WHEN scv >= 0.3 THEN 50.0 + (scv - 0.3) * (35.0 / 0.3) WHEN scv >= 0.15 THEN 25.0 + (scv - 0.15) * (25.0 / 0.15) ELSE greatest(5.0, 25.0 - (0.15 - scv) * 133.0) END"
    r = lambda x: f"CAST(round(CAST(round(CAST({x} AS DOUBLE), 7) AS DECIMAL(18, 7)), 1) AS DOUBLE)"
    if d.name == "spark":
        return f"""
SELECT doc_id, pn AS paragraph_count, {r('pmean')} AS avg_paragraph_length, {r('psd')} AS length_std_dev, {r(pl)} AS uniformity, {r(sl)} AS diversity, {r('coalesce(dist * 100.0, 50.0)')} AS topic_drift
FROM (SELECT doc_id, pm.n AS pn, pm.mean AS pmean, psd, psd / pm.mean AS pcv, sm.n AS sn, ssd / sm.mean AS scv, aggregate(known, 0.0D, (s, x) -> s + x) / nullif(size(known), 0) AS dist
FROM (SELECT *, {_deviation('lens', 'pm')} AS psd, {_deviation('sent_lens', 'sm')} AS ssd
FROM (SELECT doc_id, lens, sent_lens, filter(gaps, x -> x IS NOT NULL) AS known, {_moments('lens')} AS pm, {_moments('sent_lens')} AS sm FROM shapes WHERE size(ps) > 0)))"""
    return f"""
SELECT p.doc_id, p.pn AS paragraph_count, {r('p.pmean')} AS avg_paragraph_length, {r('p.psd')} AS length_std_dev, {r(pl)} AS uniformity, {r(sl)} AS diversity, {r('coalesce(dist * 100.0, 50.0)')} AS topic_drift
FROM (SELECT doc_id, count(*) AS pn, avg(length(p)) AS pmean, coalesce(stddev_samp(length(p)), 0.0) AS psd, coalesce(stddev_samp(length(p)), 0.0) / avg(length(p)) AS pcv FROM paras GROUP BY doc_id) p
LEFT JOIN (SELECT doc_id AS sd, count(*) AS sn, coalesce(stddev_samp(length(s)), 0.0) / avg(length(s)) AS scv FROM sents GROUP BY doc_id) s ON p.doc_id = s.sd
LEFT JOIN (SELECT doc_id AS dd, avg(distance) AS dist FROM drift GROUP BY doc_id) x ON p.doc_id = x.dd"""


def _ai_patterns(d) -> str:
    starters = "(SELECT doc_id, max(k) AS most, sum(k) AS total FROM (SELECT doc_id, substring(s, 1, 4) AS st, count(*) AS k FROM sents WHERE length(s) >= 4 GROUP BY doc_id, substring(s, 1, 4)) GROUP BY doc_id)"
    return f"""
SELECT r.doc_id, r.paragraph_count >= 3 AND r.length_std_dev < 0.2 * r.avg_paragraph_length AS uniform, g.with_transition >= greatest(2, 0.3 * r.paragraph_count) AS formulaic,
  coalesce(st.total >= 5 AND st.most >= 3 AND st.most >= 0.3 * st.total, FALSE) AS repetitive, g.fillers >= 2 AS filler, g.vague * 2 > r.paragraph_count AS vague, r.uniformity > 65 AS steady
FROM rhythms r JOIN (SELECT doc_id AS gd, sum(CASE WHEN transitions >= 1 THEN 1 ELSE 0 END) AS with_transition, sum(fillers) AS fillers, sum(CASE WHEN NOT specific AND length(p) > 50 THEN 1 ELSE 0 END) AS vague FROM density GROUP BY doc_id) g ON r.doc_id = g.gd
LEFT JOIN (SELECT doc_id AS td, most, total FROM {starters}) st ON r.doc_id = st.td"""


def statuses(d) -> str:
    return "SELECT *, CASE WHEN is_nugget THEN 'gold' WHEN is_empty THEN 'skip' ELSE 'neutral' END AS state, reasons >= 1 AS caution FROM kinds"


def runs(d) -> str:
    """Run-length encoding of paragraph states."""
    return """
SELECT doc_id, state, min(i) AS first_i, max(i) AS last_i, count(*) AS len, max(n) AS n, sum(density) AS density_sum, sum(fillers) AS fillers, sum(transitions) AS transitions
FROM (SELECT *, sum(changed) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
      FROM (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS changed FROM statuses)) GROUP BY doc_id, run, state"""


def guide(d) -> str:
    return "SELECT doc_id, count(*) AS n, sum(CAST(is_nugget AS INT)) AS nuggets, sum(CAST(is_empty AS INT)) AS empties, sum(CASE WHEN reasons >= 1 THEN 1 ELSE 0 END) AS suspicious FROM kinds GROUP BY doc_id"


def sent_density(d) -> str:
    fillers = total([d.contains("s", f) for f in FILLERS])
    return f"SELECT doc_id, i, j, s, CAST(round(greatest(0.0, least(1.0, CASE WHEN {d.rx('s', '[0-9]+')} THEN 0.3 ELSE 0.0 END + CASE WHEN {named(d, 's')} THEN 0.2 ELSE 0.0 END - 0.2 * {fillers} - CASE WHEN length(s) < 20 THEN 0.2 ELSE 0.0 END)), 6) AS DOUBLE) AS density FROM sents"


def _tldr(d) -> str:
    """The three densest sentences of ten characters or more, the densest first; without any, the first sentence."""
    order = "CASE WHEN length(s) >= 10 THEN 0 ELSE 1 END, CASE WHEN length(s) >= 10 THEN -density ELSE 0 END, i, j"
    picked = f"(SELECT doc_id, s, rn FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS rn FROM sent_density) WHERE rn <= 3 AND (length(s) >= 10 OR rn = 1))"
    latin = f"CAST(length({d.rxreplace('t', '[^A-Za-z0-9 ]')}) AS DOUBLE) / greatest(length(t), 1) > 0.5"
    best = d.collect("s", "rn")
    return f"SELECT p.doc_id, CASE WHEN k.latin THEN {d.join('p.best', '. ')} ELSE {d.join('p.best', '。')} END AS tldr, p.n FROM (SELECT doc_id, {best} AS best, count(*) AS n FROM {picked} GROUP BY doc_id) p JOIN (SELECT doc_id, {latin} AS latin FROM docs) k ON p.doc_id = k.doc_id"


def _once(text: str, tops: list[str]) -> list[bool]:
    """Whether each of these parts of a text stands there once, those that overlap the last one not counted."""
    if len(tops) <= SEARCHED:
        return [text.find(top, text.find(top) + len(top)) < 0 for top in tops]
    counts, free = dict.fromkeys(tops, 0), dict.fromkeys(tops, 0)
    for size in {len(top) for top in tops}:  # 13 sizes at most, so the time is linear in the text
        for i in range(len(text) - size + 1):
            own = text[i : i + size]
            if free.get(own, i + 1) <= i:
                counts[own] += 1
                free[own] = i + size
    return [counts[top] == 1 for top in tops]


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, i, anchor of the paragraphs of docs(doc_id, t), each text read in its own row.

    If a start of a paragraph comes again, so does every shorter one; so only the longest is looked for.
    """

    def run(batches):
        for batch in batches:
            rows, places, found = [], [], []
            for k in range(batch.num_rows):
                text = batch.column("t")[k].as_py()
                tops = [p[:LONGEST] for p in (line.strip(SPACE) for line in text.split("\n")) if p]
                long = [t for t in tops if len(t) >= SHORTEST]
                once = dict(zip(long, _once(text, long), strict=True))
                rows += [k] * len(tops)
                places += range(1, len(tops) + 1)
                found += [t if once.get(t) else t[:SHORTEST] for t in tops]
                if len(rows) >= 1 << 16 or k + 1 == batch.num_rows:
                    ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(places, pa.int64()), pa.array(found, pa.string())], ["doc_id", "i", "anchor"])
                    rows, places, found = [], [], []

    return docs.select("doc_id", "t").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, i bigint, anchor string")


def _anchor(d) -> str:
    """The longest start of 22 to 10 characters that stands once in the text, else the first ten; `anchors` gives the same in one pass."""
    sizes = d.only(d.each(d.seq("1", "13"), "k", "23 - k"), "m", "m <= length(p) AND length(t) - length(replace(t, substring(p, 1, m), '')) = m")
    return f"SELECT doc_id, i, substring(p, 1, coalesce({d.at('sizes', 1)}, least(10, length(p)))) AS anchor FROM (SELECT a.doc_id, a.i, a.p, {sizes} AS sizes FROM paras a JOIN docs b ON a.doc_id = b.doc_id)"


def _evidence(d) -> str:
    return f"""
SELECT x.doc_id, x.dim, {d.join(d.collect('CAST(k.i AS STRING)', 'k.i'), ',')} AS paragraphs FROM (SELECT doc_id, dim, CASE WHEN kind = 'risk' THEN 'skip' ELSE 'gold' END AS state FROM dims WHERE kind = 'risk' AND score > 35 OR kind = 'good' AND score > 55) x
JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, state ORDER BY i) AS rn FROM statuses) k ON x.doc_id = k.doc_id AND x.state = k.state WHERE k.rn <= 6 GROUP BY x.doc_id, x.dim"""


BASES = {"paras": paras, "sents": sents, "valued": valued, "density": density, "kinds": kinds, "shapes": shapes, "drift": drift, "rhythms": rhythms, "statuses": statuses, "runs": runs, "guide": guide, "sent_density": sent_density}

QUERIES = {
    "paragraphs": lambda d: "SELECT doc_id, i, p FROM paras",
    "sentences": lambda d: "SELECT doc_id, i, j, s FROM sents",
    "rhythm": lambda d: "SELECT * FROM rhythms",
    "info_density": lambda d: "SELECT doc_id, i, density, specific FROM density",
    "ai_patterns": _ai_patterns,
    "paragraph_classes": lambda d: "SELECT doc_id, i, is_empty, is_nugget, reasons >= 1 AS suspicious, CASE WHEN reasons >= 2 THEN 'high' WHEN reasons = 1 THEN 'medium' END AS severity FROM kinds",
    "skip_blocks": lambda d: "SELECT doc_id, first_i, last_i, CASE WHEN fillers >= 1 THEN 'filler' WHEN transitions >= 1 THEN 'transition' WHEN density_sum = 0 THEN 'vague' ELSE 'low_density' END AS kind FROM runs WHERE state = 'skip'",
    "reading_map": lambda d: "SELECT doc_id, i, state, caution FROM statuses",
    "run_segments": lambda d: "SELECT doc_id, state, first_i, last_i, len, CAST(round(100.0 * len / n, 2) AS DOUBLE) AS width FROM (SELECT doc_id, state, first_i, last_i, len, CAST(n AS DOUBLE) AS n FROM runs)",
    "top_nuggets": lambda d: "SELECT doc_id, i, density, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY density DESC, i) AS rn FROM kinds WHERE is_nugget) WHERE rn <= 3",
    "tldr": _tldr,
    "reading_advice": lambda d: "SELECT g.doc_id, CASE WHEN coalesce(s.ai, 0) >= 65 AND g.nuggets = 0 THEN 'skip' WHEN g.nuggets * 4 >= g.n AND s.overall >= 60 THEN 'read_carefully' ELSE 'skim' END AS advice, CAST(floor(100.0 * g.empties / g.n) AS INT) AS saved_percent FROM guide g JOIN scored s ON g.doc_id = s.doc_id",
    "caution_pick": lambda d: "SELECT s.doc_id, CASE WHEN coalesce(s.scam, 0) >= 60 THEN 'check_claims' WHEN coalesce(s.adv, 0) >= 60 THEN 'promotion' WHEN coalesce(s.emo, 0) >= 60 THEN 'pressure' WHEN g.suspicious * 2 > g.n THEN 'thin' END AS caution FROM scored s JOIN guide g ON s.doc_id = g.doc_id",
    "search_anchor": _anchor,
    "position_label": lambda d: "SELECT doc_id, i, CASE WHEN n <= 1 THEN 'whole' WHEN r <= 0.12 THEN 'opening' WHEN r <= 0.35 THEN 'early' WHEN r <= 0.65 THEN 'middle' WHEN r <= 0.88 THEN 'late' ELSE 'end' END AS label, CAST(CASE WHEN n <= 1 THEN 50 ELSE floor(100.0 * (2 * i - 1) / (2 * n) + 0.5) END AS INT) AS percent FROM (SELECT doc_id, i, n, CAST(i - 1 AS DOUBLE) / greatest(n - 1, 1) AS r FROM paras)",
    "dimension_evidence": _evidence,
    # no table stores guides, so every document lacks one
    "guide_backfill": lambda d: f"SELECT d.doc_id, g.nuggets, g.empties FROM docs d LEFT JOIN guide g ON d.doc_id = g.doc_id AND length({trim(d, 'd.t')}) >= 50",
    "paragraph_lag_jaccard": lambda d: "SELECT doc_id, i, CAST(round(distance, 6) AS DOUBLE) AS distance FROM drift WHERE distance IS NOT NULL",
}
