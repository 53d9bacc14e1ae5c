"""The rule engine against a plain-Python version, on inline texts of two languages."""

import random
import re
import time

import pytest

from textassay.functions import phrases
from textassay.functions.dialect import DUCK, SCANNED, SPARK
from textassay.functions.packs import LATIN, ZH
from textassay.operators import rules
from textassay.plans import catalog, native

TEXTS = [
    "Double your money! You have been selected: wire transfer the upfront fee. LAST CHANCE, before it's too late!",
    "buy now, limited time offer, free shipping, add to cart, studies show it works instantly. In conclusion, in conclusion, needless to say.",
    "fact check: sources say guaranteed returns; you are scum, trash, an idiot. HELLO WORLD! ### $$$",
    "",
    "Plain words about nothing in particular.",
    "trash and scum and worthless clown!!!!!!",
    "Licensed under the Apache License, Version 2.0. mit MIT permit it is that is it is ",
    "### $$$ *** SHOUTING! with the is that 100% " * 3,
    "a" * 300 + " it is ",
    "thread cart is the and the for the on the https://a.b/c https://a.b/d http://x.y ",
    "稳赚不赔 内部名额 先交押金！再不行动就晚了 限时优惠 扫码领取",
    "反诈提示：稳赚不赔 专家称 百分百有效",
    "!" * 50,
]


def keyword(text, w):
    if w.isascii() and len(w) < 4:
        return bool(re.search(rf"(?i)(?<![A-Za-z]){w}(?![A-Za-z])", text))
    return w in text


def plain(text, pack):
    score, conf, names = {}, {}, []
    if not text:
        return names, score, conf
    n = sum(keyword(text, w) for w in pack.scam)
    if n:
        names.append("scam_keywords")
        score["scam"], conf["scam"] = (95, 0.95) if n >= 3 else (75, 0.8)
    bangs = text.count("!") + text.count("！")
    punct, anx = 1000 * bangs / len(text) > 5, sum(bool(re.search(p, text)) for p in pack.anxiety)
    if punct and anx:
        names.append("emotional_anxiety_and_punctuation")
        score["emo"], conf["emo"] = 85, 0.9
    elif punct or anx >= 2:
        names.append("emotional_excessive_punctuation" if punct else "emotional_anxiety_phrases")
        score["emo"], conf["emo"] = 70, 0.75
    promo, links = sum(keyword(text, w) for w in pack.promo), len(re.findall(r"https?://\S+", text))
    if promo >= 2 or (promo and links >= 3):
        score["adv"], conf["adv"] = 80, 0.85
    elif promo:
        score["adv"], conf["adv"] = 60, 0.7
    elif links >= 3:
        score["adv"], conf["adv"] = 55, 0.6
    if "adv" in score:
        names.append("advertorial_promo")
    hedge = sum(text.count(w) for w in pack.hedging)
    bare = re.sub("[ \t\n\r\f，。！？、；：“”‘’（）《》]", "", text)
    low = len(text) > 200 and bool(bare) and len(set(bare)) / len(bare) < 0.4
    if hedge >= 3 or (low and hedge):
        score["ai"], conf["ai"] = 65, 0.6
    elif low:
        score["ai"], conf["ai"] = 55, 0.5
    if "ai" in score:
        names.append("ai_generated_signals")
    cred = sum(keyword(text, w) for group in pack.credibility for w in group)
    if cred:
        s, c = (85, 0.85) if cred >= 3 else (70, 0.75) if cred == 2 else (55, 0.6)
        names.append("credibility_unverifiable")
        score["scam"], conf["scam"] = min(100, score.get("scam", 0) + s), max(conf.get("scam", 0), c)
    for name, words, dim, boost in pack.combos:
        if all(keyword(text, w) for w in words):
            names.append(name)
            score[dim], conf[dim] = min(100, score.get(dim, 0) + boost), min(1, conf.get(dim, 0) + 0.1)
    for name, words in pack.platforms:
        if sum(keyword(text, w) for w in words) >= 2:
            names.append(f"platform_{name}_patterns")
            score["adv"], conf["adv"] = min(100, score.get("adv", 0) + 15), max(conf.get("adv", 0), 0.7)
    for r in pack.custom:
        if sum(w in text for w in r.keywords) + sum(bool(re.search(p, text)) for p in r.patterns) >= r.min_hits:
            names.append(r.name)
            score[r.dimension], conf[r.dimension] = min(100, score.get(r.dimension, 0) + r.contribution), max(conf.get(r.dimension, 0), r.confidence)
    if "scam" in score and any(m in text for m in pack.citing):
        score["scam"], conf["scam"] = min(score["scam"], 35), min(conf["scam"], 0.75)
        names.append("scam_educational_context_cap")
    return names, score, conf


@pytest.mark.parametrize("pack", [LATIN, ZH], ids=["latin", "zh"])
def test_engine_equals_plain_python(spark, pack):
    spark.createDataFrame([(i, "en", "s", t) for i, t in enumerate(TEXTS)], "doc_id int, lang string, source string, t string").createOrReplaceTempView("docs")
    sql = f"WITH hits AS ({rules.hits(SPARK, pack)}), base_rules AS ({rules.base_rules(SPARK)}), rules AS ({rules.merged(SPARK, pack)}) SELECT * FROM rules"
    df = spark.sql(sql)
    assert "Python" not in df._jdf.queryExecution().toString()
    for r in df.collect():
        names, score, conf = plain(TEXTS[r.doc_id], pack)
        assert r.matched == "|".join(names), TEXTS[r.doc_id][:40]
        for dim in ("scam", "emo", "adv", "ai"):
            assert r[dim] == score.get(dim), (dim, TEXTS[r.doc_id][:40])
            assert r[f"{dim}_conf"] == pytest.approx(conf.get(dim)) if dim in conf else r[f"{dim}_conf"] is None
    spark.catalog.dropTempView("docs")


def test_clean_text_scores_as_documented(spark):
    value = spark.sql(f"SELECT {rules.overall_of({n: '50.0' for n, _ in rules.POSITIVE}, {n: '0.0' for n, _ in rules.NEGATIVE})} AS x").first().x
    assert value == 73.8


@pytest.mark.parametrize("pack", [LATIN, ZH], ids=["latin", "zh"])
def test_one_scan_equals_one_expression_a_phrase(spark, pack):
    """Every phrase alone, in pairs, overlapping and repeated."""
    words = [e.phrase for e in phrases.entries(pack)]
    texts = [*TEXTS, *words, *(f"x{a}{b}\n{a} {a}" for a, b in zip(words, words[1:], strict=False)), "", "one MIT and mit, not emit"]
    docs = spark.createDataFrame([(i, "en", "s", t) for i, t in enumerate(texts)], "doc_id int, lang string, source string, t string")
    chain = lambda d: f"WITH hits AS ({rules.hits(d, pack)}), base_rules AS ({rules.base_rules(d)}), rules AS ({rules.merged(d, pack)}) SELECT * FROM rules"
    found = catalog.over(chain(SCANNED), spark, {"marked": rules.marked(docs, pack)}).drop("t").orderBy("doc_id").collect()
    assert found == catalog.over(chain(SPARK), spark, {"docs": docs}).drop("t").orderBy("doc_id").collect()
    fired = {n for r in found for n in r.matched.split("|")}
    assert fired >= {"scam_keywords", "advertorial_promo", "credibility_unverifiable"}


def test_scan_does_not_grow_with_the_phrases():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(30_000))
    seconds = []
    for n in (100, 1000, 20_000):
        scanner = phrases.Scanner([phrases.Entry("scam", f"{rng.randrange(10**9)} phrase {k}", False) for k in range(n)])
        began = time.perf_counter()
        for _ in range(5):
            assert scanner.found(text) == []
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 3 * seconds[0] and seconds[2] < 6 * seconds[0], seconds


def test_scanner_without_automaton_gives_the_same():
    listed = phrases.entries(LATIN) + [phrases.Entry("x", "aba", False), phrases.Entry("y", "MIT", True), phrases.Entry("z", "", False)]
    fast, slow = phrases.Scanner(listed), phrases.Scanner(listed)
    slow.automaton = None
    for text in [*TEXTS, "ababa aba\nabab", "mit emit MIT.", ""]:
        assert fast.found(text) == slow.found(text)
    assert [h[2:] for h in slow.found("x\nababa aba") if h[1] == "aba"] == [(2, 2)]


def test_every_latin_rule_fires_on_the_planted_documents(spark, sf_dir):
    fired = {n for r in native.QUERIES["rule_score_planted"](spark, sf_dir).select("matched").distinct().collect() for n in r.matched.split("|")}
    want = {"scam_keywords", "emotional_anxiety_and_punctuation", "emotional_anxiety_phrases", "advertorial_promo", "credibility_unverifiable", "scam_educational_context_cap"}
    assert fired >= want | {c[0] for c in LATIN.combos if c[0] in fired}


def test_characters_are_counted_in_one_cheap_pass():
    import random
    import time

    import numpy as np

    from textassay.functions import phrases
    from textassay.operators.rules import IGNORED

    rng, apart = random.Random(6), np.array(sorted(map(ord, IGNORED)), np.uint32)
    pools = ["ab \n\t!", "aé，。 “日本", "a😀，𝒳 \f", IGNORED, "\0\uffff"]
    for pool in pools:
        for n in (0, 1, 5, 200):
            text = "".join(rng.choices(pool, k=n))
            bare = [c for c in text if c not in IGNORED]
            assert phrases.characters(text, apart) == (len(set(bare)), len(bare))
    text = "Das Wetter war schön, und der Fluß lief langsam. " * 20_000
    start = time.perf_counter()
    phrases.characters(text, apart)
    ours, start = time.perf_counter() - start, time.perf_counter()
    text.translate(dict.fromkeys(map(ord, IGNORED)))  # what a text beyond ASCII took before
    assert ours < (time.perf_counter() - start) / 2


def test_patterns_are_searched_only_where_their_literal_stands(spark):
    known = {"(?i)you(x|y)?(ll| will) regret": " regret", "(a(b|c))?longer x+yz": "longer x", "a{0,3}bcd|x": "", "(?i)ab?cde": "cde", "[abc]{2}defg*": "def", "foo(?=bar)": "", "\\bfoo": ""}
    assert {p: rules.literal(p) for p in known} == known
    texts = ["", "LAST CHANCE", "la\u017ft chance", "Last \u212ahance \u0130", "\u0130 If You STILL don\u2019t act NOW", "if you dont", "Most People never", "longer xxyz", "Longer xyz", "You'll ReGret \u03a3"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = [*rules.LATIN.anxiety, *known]
    sought = [rules.pattern(SCANNED, "t", p) for p in patterns]
    assert sum("contains(" in s for s in sought) == len(rules.LATIN.anxiety) + 4
    plain = docs.selectExpr(*[SCANNED.rx("t", p) + f" AS p{k}" for k, p in enumerate(patterns)]).collect()
    assert docs.selectExpr(*[s + f" AS p{k}" for k, s in enumerate(sought)]).collect() == plain
    assert sum(map(sum, plain)) >= 6 and rules.pattern(DUCK, "t", patterns[0]) == DUCK.rx("t", patterns[0])
