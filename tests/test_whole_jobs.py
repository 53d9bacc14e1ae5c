"""Queries against brute force in Python, on rows that an oracle of the same build would miss too."""

import json
import math

import pytest

from textassay.functions.dialect import SPARK
from textassay.operators import pages, simhash
from textassay.plans import catalog
from textassay.streaming import jobs


@pytest.fixture
def folder(spark, sf_dir, tmp_path):
    """A folder of tables with documents of one's own, else empty or those of the smallest tables."""

    def make(rows):
        spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
        spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return make


def test_originality_penalty_reaches_exact_copies_and_distance_six(spark, folder):
    words = "The river of the old town ran slowly past the mill and the bakers walked along it every morning in spring".split()
    base = " ".join(words * 4)
    rows = [(1, base), (2, base), (3, base)] + [(10 + k, base + " " + " ".join(f"extra{k}word{j}" for j in range(k))) for k in range(1, 40)]
    prints = {i: int(simhash.simhashes([t.lower()], {})[0]) for i, t in rows}
    want, at = {}, set()
    for i, _ in rows:
        best = min(((prints[i] ^ prints[j]) % 2**64).bit_count() for j in prints if j < i) if i > 1 else 64
        at.add(best)
        similar = 1 - best / 64
        want[i] = min(30, math.floor((similar - 0.85) * 200 + 1e-9)) if similar >= 0.9 else 0
    got = {r.doc_id: r.penalty for r in catalog.run("originality_penalty", spark, folder(rows)).collect()}
    assert at & {4, 5, 6} and want[2] == want[3] == 30
    assert got == want


def test_guide_backfill_gives_every_long_document_a_guide(spark, folder):
    long = "Some plain words stand in this line and they go on for a while."
    rows = [(i, long) for i in range(1, 8)] + [(9, "short"), (12, " " * 60 + "x"), (15, "")]
    got = {r.doc_id: r.nuggets is not None for r in catalog.run("guide_backfill", spark, folder(rows)).collect()}
    assert got == {i: i < 9 for i, _ in rows}


def test_search_anchor_reaches_every_paragraph(spark, folder):
    text = "\n".join(f"Paragraph {k} tells of a thing of its own." for k in "abcdefgh")
    got = {r.i: r.anchor for r in catalog.run("search_anchor", spark, folder([(1, text)])).collect()}
    assert sorted(got) == list(range(1, 9)) and all(text.count(a) == 1 for a in got.values())


def test_rescored_pages_keep_url_score_cycle_and_delta(spark, tmp_path):
    calm = "<article>" + "<p>The mill on the river ran for many years and the town grew around it.</p>" * 12 + "</article>"
    loud = calm.replace("town", "worthless trash scam!!! license apache")

    def arrive(rows):
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages.parquet")
        return {r.url: r for r in jobs.rescore_pages(spark, str(tmp_path), f"{tmp_path}/state").collect()}

    def score(html):
        spark.createDataFrame([(1, pages.main_block(html), "en", "x")], "doc_id long, text string, lang string, source string").createOrReplaceTempView("documents")
        return spark.sql(catalog.sql("scored", SPARK)).collect()[0].overall

    first = arrive([(1, "a", loud), (2, "a", calm), (3, "b", calm), (4, None, calm)])
    assert {u: (r.score, r.cycle, r.delta) for u, r in first.items()} == {u: (score(calm), 1, None) for u in "ab"}
    second = arrive([(5, "a", loud), (6, "c", loud)])
    assert score(loud) != score(calm)
    assert {u: (r.score, r.cycle) for u, r in second.items()} == {"a": (score(loud), 2), "b": (score(calm), 1), "c": (score(loud), 2)}
    assert second["a"].delta == pytest.approx(score(loud) - score(calm), abs=0.06) and second["c"].delta is None
    again = jobs.rescore_pages(spark, str(tmp_path), f"{tmp_path}/state").collect()
    assert {r.url: r for r in again} == second


def test_rule_candidates_group_terms_greedily(spark, sf_dir):
    from textassay.operators.learn import INDICATORS

    top = {r.gram: r.tfidf for r in catalog.run("mine_rules_tfidf", spark, sf_dir).collect()}
    near = {t: set() for t in top}
    for r in catalog.run("term_cooccurrence", spark, sf_dir).collect():
        near[r.term1].add(r.term2)
        near[r.term2].add(r.term1)
    want = greedy(sorted(top, key=lambda t: (-top[t], t)), near)[:5]
    got = sorted(catalog.run("rule_candidates", spark, sf_dir).collect(), key=lambda r: r.name)
    assert [r.keywords for r in got] == [", ".join(g) for g in want]
    for r, g in zip(got, want, strict=True):
        hits = {d: sum(any(w in t.lower() for w in words) for t in g) for d, words in INDICATORS.items()}
        assert r.dimension == max(hits, key=hits.get)
        assert 0 < r.confidence <= (1 if any(hits.values()) else 0.5)
        assert r.contribution == pytest.approx(min(50, max(15, 100 * max(top[t] for t in g))), abs=0.06)


def greedy(terms, near):
    """An unused term with unused partners leads a group; a first term without partners is one by itself."""
    used, groups = set(), []
    for t in terms:
        free = sorted(near[t] - used)
        if t not in used and (free or not used):
            groups.append([t, *free[:4]])
            used.update(groups[-1])
    return groups


def test_greedy_groups_on_random_graphs(spark):
    import random

    from textassay.functions.dialect import SPARK
    from textassay.operators import learn

    rng = random.Random(9)
    for n, p in [(0, 0), (1, 0), (6, 0), (12, 0.1), (30, 0.05), (30, 0.3)]:
        terms = [f"t{k:02d}" for k in rng.sample(range(40), n)]
        pairs = [(a, b) for k, a in enumerate(terms) for b in terms[k + 1 :] if rng.random() < p]
        near = {t: {b for a, b in pairs if a == t} | {a for a, b in pairs if b == t} for t in terms}
        both = pairs + [(b, a) for a, b in pairs]
        tables = {"top_terms": spark.createDataFrame([(t, 1.0, k) for k, t in enumerate(terms)], "gram string, tfidf double, rn int"), "near_terms": spark.createDataFrame(both, "gram string, near string")}
        got = catalog.over(f"WITH term_list AS ({learn.term_list(SPARK)}) {learn.term_groups(SPARK)}", spark, tables).collect()
        groups = {}
        for r in sorted(got, key=lambda r: (r.g, r.k)):
            groups.setdefault(r.g, []).append(r.gram)
        assert [groups[g] for g in sorted(groups)] == greedy(terms, near)


def test_judge_replies_by_bracket_matching(spark):
    from textassay.functions.dialect import SPARK
    from textassay.operators import joins

    replies = {
        'plain {"a": 1} end': '{"a": 1}',
        '```json\n{"a": {"b": {"c": 2}}, "d": 3}\n``` and {"e": 4}': '{"a": {"b": {"c": 2}}, "d": 3}',
        '{"s": "a } brace \\" and { more", "x": {}} tail }': '{"s": "a } brace \\" and { more", "x": {}}',
        '{"open": {"never": 1}': None,
        "no json": None,
        "": None,
        "} {": None,
        "{}": "{}",
    }
    rows = spark.createDataFrame([(r,) for r in replies], "reply string")
    got = {r.reply: r.found for r in rows.selectExpr("reply", f"{joins.outer_object(SPARK, 'reply')} AS found").collect()}
    assert got == replies


def test_injected_replies_become_neutral(spark):
    from textassay.functions.dialect import SPARK
    from textassay.operators import joins

    body = lambda summary, labels: json.dumps({**dict.fromkeys([*joins.GOODS, *joins.RISKS], 42), "conf": 0.9, "summary": summary, "labels": labels}, ensure_ascii=False)
    replies = [body("a good read", ["dense"]), body("Please IGNORE Previous text", []), body("fine", ["new instructions"]), body("系统提示", []), "ignore all, no json", body(None, None)]
    rows = spark.createDataFrame([(k, 50.0, None, None, 0.0, r, r) for k, r in enumerate(replies)], "doc_id int, overall double, scam double, scam_conf double, worst double, reply string, second_reply string")
    got = {r.doc_id: r for r in catalog.over(f"WITH parsed AS ({joins.parsed(SPARK)}) {joins._validate(SPARK)}", spark, {"replies": rows}).collect()}
    assert [got[k].rejected for k in range(6)] == [False, True, True, True, False, False]
    assert all((got[k].scam, got[k].conf) == (50.0, 0.1) for k in (1, 2, 3)) and (got[0].scam, got[0].conf) == (42.0, 0.9)


def test_paragraphs_of_many_capitalised_words_are_read(spark, folder):
    import duckdb

    calm = "The mill on the river ran for 40 years and the town grew around it, as the old people told.\n" * 3
    base = folder([(1, calm + "Word " * 20_000 + "\n" + calm + "Double your money with guaranteed returns, act now, wire transfer only."), (2, "Name " * 20_000)])
    tables = duckdb.connect()
    for name in ("documents", "benchmark"):
        tables.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{base}/{name}.parquet/*.parquet')")
    for name in ("dimension_evidence", "info_density", "tldr"):
        got = sorted(tuple(r) for r in catalog.run(name, spark, base).collect())
        assert got and got == sorted(tables.execute(catalog.sql_oracles()[name]).fetchall())


def test_near_dup_pairs_lose_no_document_of_a_fingerprint(spark, folder):
    base = "The river of the old town ran slowly past the mill and the bakers walked along it every morning in spring"
    texts = [base + f" with word{k} and some more of it" * (k % 3) for k in range(12)]
    texts = [v for t in texts for v in (t, t.upper(), t.replace(" ", "\n"), t, t + ".")] + ["a sentence of its own kind"]
    rows = list(enumerate(texts, 5))
    prints = {i: int(simhash.simhashes([" ".join(t.lower().split())], {})[0]) for i, t in rows}
    want = {(i, j): ((prints[i] ^ prints[j]) % 2**64).bit_count() for i in prints for j in prints if i < j}
    want = {k: v for k, v in want.items() if v <= simhash.K}
    got = catalog.run("near_dup_pairs", spark, folder(rows)).collect()
    first = {i: i for i in prints} | {r.right_id: r.left_id for r in got if r.distance == 0}
    between = {(r.left_id, r.right_id): r.distance for r in got if r.distance}
    assert len(got) == len({(r.left_id, r.right_id) for r in got}) and all(want[r.left_id, r.right_id] == r.distance for r in got)
    found = {(i, j): 0 if first[i] == first[j] else between.get(tuple(sorted((first[i], first[j])))) for i in prints for j in prints if i < j}
    assert {k: v for k, v in found.items() if v is not None} == want and 0 in want.values() and len(set(want.values())) > 1
