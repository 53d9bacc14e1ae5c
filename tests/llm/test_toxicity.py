"""The channel against all readings of small lattices, the counts against a plain form, and held-out accuracy."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest

from textassay.llm import queries, toxicity

BAD = ["blorgat", "snivert", "krumpel", "dastig", "moffrin"]
PLAIN = "the cat sat on a mat and was seen by many of them near old town hall while rain fell over green hills".split()
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def channel():
    rng = random.Random(1)
    table = np.zeros(1 << toxicity.TABLE_BITS, np.int64)
    words = collections.Counter(rng.choice(PLAIN + BAD) for _ in range(20_000))
    toxicity.count_grams(words, table)
    return toxicity.Channel(table, sum(len(w) * n for w, n in words.items()))


@pytest.mark.parametrize(
    "span, said",
    [("bl0rg4t", "blorgat"), ("5n1v3rt", "snivert"), ("k.r.u.m.p.e.l", "krumpel"), ("d a s t i g", "dastig"), ("mooooffrin", "moffrin"), ("kr*mpel", "krumpel"), ("sn!v3r+", "snivert"), ("d@$tig", "dastig"), ("blоrgаt", "blorgat"), ("b-l-0-r-g-4-t", "blorgat")],
)
def test_channel_restores(channel, span, said):
    assert channel.restore(toxicity.clean(span)) == said


def test_plain_tokens_are_not_suspect(channel):
    for token in ["town", "hall.", "that***", "a.", "2024", "été", "日本", "(rain)", "fell!!!", "wasn't"]:
        if token != "wasn't":
            assert toxicity.reading(token, channel)[0] is None
    assert toxicity.clean("ＢＬ​orgat") == "blorgat"


def price(channel, parts):
    total, own = 0.0, " "
    for text, cost in parts:
        total += cost
        for c in text:
            total += channel.cost(own, c) if c != " " or own != " " else 0.0
            own = " " if c == " " else (own + c)[1 - toxicity.ORDER :]
    return total


@pytest.mark.parametrize("span", ["b10rg4t", "s n 1 v", "m0ff.r!n", "aaa5*t", "d@$t--g"])
def test_viterbi_equals_all_readings(channel, span):
    nodes = [*toxicity.lattice(span), [(" ", 0.0)]]
    readings = list(itertools.product(*nodes))
    best = min(price(channel, r) for r in readings)
    fits = {" ".join("".join(t for t, _ in r).split()) for r in readings if price(channel, r) < best + 1e-9}
    assert channel.restore(span) in fits


def test_counts_equal_a_plain_form(spark, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abé Z.9\n", k=rng.randint(0, 40))) for _ in range(50)] + [None, "", "日本 ok"]
    monkeypatch.setattr(toxicity, "FAN_IN", 2)
    monkeypatch.setattr(toxicity, "COUNTED_AT_ONCE", 60)
    table, total = toxicity.character_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7))
    want = collections.Counter()
    for t in texts:
        for w in "".join(c if c in toxicity._CODE else " " for c in toxicity.clean(t or "")).split():
            for n in range(1, toxicity.ORDER + 1):
                want.update(f" {w} "[k : k + n] for k in range(len(w) + 3 - n))
    channel = toxicity.Channel(table, total)
    for gram, n in want.items():
        if gram.strip() == gram:  # boundaries are shared by neighbouring words
            assert channel._count(gram) >= n  # equal but for grams of one bucket
    assert abs(sum(channel._count(g) - n for g, n in want.items() if g.strip() == g)) <= 3
    assert toxicity.character_counts(spark.createDataFrame([], "text string"))[1] == 0


def disguised(word, rng):
    swaps = {"o": "0", "i": "1", "e": "3", "a": "@", "s": "$", "t": "7"}
    kind = rng.randrange(4)
    if kind == 0:
        return "".join(swaps.get(c, c) for c in word)
    return (".".join(word), " ".join(word), word.replace(word[2], word[2] * 4, 1))[kind - 1]


def made(rng, n):
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(PLAIN) for _ in range(rng.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                word = rng.choice(BAD)
                words[rng.randrange(len(words))] = disguised(word, rng) if rng.random() < 0.5 else word
        rows.append((i, " ".join(words), "en", "s"))
        if i % 10:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_op13_query_catches_held_out_disguised_texts(spark, tmp_path):
    rng = random.Random(3)
    rows, labels = made(rng, 1200)
    rows += [(5000, None, "en", "s"), (5001, "", None, None), (5002, " \n", "en", "s"), (None, "blorgat", "en", "s"), (1, rows[1][1], "en", "s"), (5003, "the cat " * 20_000 + "kr.um.pel d@$t1g", "en", "s")]
    labels += [(1, 1, 0), (None, 1, 1), (7, 1, None), (99_999, 1, 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op13_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    held = [r for r in got if r.held_out and r.doc_id < 1200]
    assert {r.doc_id for r in held} == {i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    toxic = [r for r in held if r.doc_id % 6 == 0]
    clean = [r for r in held if r.doc_id % 6]
    assert np.mean([r.predicted for r in toxic]) > 0.97 and np.mean([r.predicted for r in clean]) < 0.01
    by = {r.doc_id: r for r in got}
    assert by[5003].predicted == by[None].predicted == 1
    assert by[5000].score == by[5001].score == by[5002].score < 0.3


def test_op13_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, labels)
    got = toxicity.score(odd_docs.withColumnRenamed("kept", "Score"), model)
    assert got.columns[-3:] == ["score_", "predicted", "restored"] and got.count() == 10
    none = toxicity.train(odd_docs, labels.where("toxic = 0"))
    assert all(r.score < 1e-9 for r in toxicity.score(odd_docs, none).collect())
    every = toxicity.train(odd_docs, labels.where("toxic = 1"))
    assert all(r.score > 1 - 1e-9 for r in toxicity.score(odd_docs, every).collect())
    empty = toxicity.train(no_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(no_docs, empty).count() == 0
    said = toxicity.score(spark.createDataFrame([(1, "bl0rg4t here")], "doc_id long, text string"), toxicity.Model(np.zeros(1 << 18, np.int64), 0, {"here ": (3.0, 30.0)}, (-1.0, 1.0, 0.0, 0.0, 0.0))).first()
    assert said.restored == [] and said.predicted == 1
