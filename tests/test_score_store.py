"""The store against a dictionary, and what an upsert writes."""

import datetime
import hashlib
import os
import random

from textassay.sources.score_store import ScoreStore, keyed

DAY = datetime.date(2024, 1, 1)


def digest(i):
    return hashlib.sha256(str(i).encode()).hexdigest()


def batch(spark, rows):
    return spark.createDataFrame(rows, ScoreStore.SCHEMA)


def row(i, score, day=0, owner=None, matched="", url=None):
    return (digest(i), float(score), DAY + datetime.timedelta(days=day), owner, matched, url)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_store_equals_a_dictionary(spark, tmp_path):
    store, want, rng = ScoreStore(spark, f"{tmp_path}/s", 1), {}, random.Random(3)
    for n in range(4):
        rows = [row(rng.randrange(25), rng.randrange(100), n, rng.choice([None, 1, 2])) for _ in range(12)]
        newest = {}
        for r in rows:
            newest[r[0]] = max(r, newest.get(r[0], r), key=lambda x: (x[2], x[1], x[3] is not None, x[3] or 0))
        for h, r in newest.items():
            old = want.get(h)
            if old is None:
                want[h] = r
            elif old[3] is None or old[3] == r[3]:
                want[h] = (*r[:3], old[3], *r[4:])
        for _ in range(1 + n % 2):  # a batch that runs again changes nothing
            store.upsert(batch(spark, rows))
        assert {r.content_hash: tuple(r)[:6] for r in store.rows().collect()} == want


def test_upsert_writes_the_buckets_of_its_batch_only(spark, tmp_path):
    path = f"{tmp_path}/s"
    store = ScoreStore(spark, path)
    assert store.rows().count() == 0 and store.upsert(batch(spark, [])) == []
    store.upsert(batch(spark, [row(i, 50) for i in range(400)]))
    before = files(path)
    assert store.upsert(batch(spark, [row(7, 60, 1), row(8, 61, 1), (None, 1.0, DAY, None, "", None)])) == sorted({digest(7)[:2], digest(8)[:2]})
    after = files(path)
    touched = {digest(7)[:2], digest(8)[:2]}
    assert {f for f in before if f.split("bucket=")[1][:2] not in touched} == {f for f in after if f.split("bucket=")[1][:2] not in touched}
    assert all(before[f] == after[f] for f in before.keys() & after.keys())
    assert len(after) == len(before) and store.rows().count() == 400


def test_queries(spark, tmp_path):
    store = ScoreStore(spark, f"{tmp_path}/s")
    store.upsert(batch(spark, [row(i, i, i % 7, i % 3 or None, "scam_keywords|x" if i % 5 == 0 else "x") for i in range(40)]))
    assert [r.overall for r in store.by_hash(digest(3)).collect()] == [3.0]
    assert {r.content_hash for r in store.by_hash(digest(3)[:1]).collect()} == {digest(i) for i in range(40) if digest(i)[0] == digest(3)[0]}
    got = store.query(least=10, most=30, since=DAY + datetime.timedelta(days=2), rule="scam_keywords", limit=50).collect()
    assert sorted(r.overall for r in got) == [float(i) for i in range(10, 31) if i % 5 == 0 and i % 7 >= 2]
    assert [r.scored_on for r in got] == sorted((r.scored_on for r in got), reverse=True)
    assert {r.owner for r in store.history(5, owner=2).collect()} == {2} and store.history(5, owner=2).count() == 5


def test_keyed_store(spark, tmp_path):
    store = keyed(spark, f"{tmp_path}/k", "k long, v string, t int", "k", "t", buckets=4)
    store.upsert(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "z", 1)], "k long, v string, t int"))
    store.upsert(spark.createDataFrame([(2, "d", 2)], "k long, v string, t int"))
    assert {r.k: r.v for r in store.rows().collect()} == {1: "b", 2: "d"}
