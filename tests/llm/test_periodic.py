"""Periodic runs against brute force, and the query's digests against a plain second form."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from textassay.llm import periodic, queries

SPACE = r"[^\x20\x09-\x0D]+"


def brute_runs(w, min_length=24, min_exponent=3):
    """Each period's maximal stretches; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(w) // min_exponent + 1):
        k = 0
        while k < len(w) - q:
            s = k
            while k < len(w) - q and w[k] == w[k + q]:
                k += 1
            if k > s and k + q - s >= max(min_length, min_exponent * q):
                found.setdefault((s, k + q), q)
            k += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def numbered(words):
    known = {}
    return np.array([known.setdefault(x, len(known)) for x in words], np.int64)


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(40):
        least, exponent = rng.choice([(24, 3), (24, 3), (6, 2), (10, 3), (10, 2)])
        docs = []
        for _ in range(rng.randint(1, 6)):
            w = [rng.randrange(rng.choice([1, 2, 3, 10, 100])) for _ in range(rng.choice([0, 5, 24, 40, 100, 200]))]
            for _ in range(rng.randint(0, 3) if len(w) > 23 else 0):
                s, p = rng.randrange(len(w) - 10), rng.randint(1, len(w) // 8)
                for i in range(s + p, min(len(w), s + rng.randint(2 * p, len(w)))):
                    w[i] = w[i - p]
            docs.append(numbered(w))
        assert periodic.find(docs, least, exponent) == [brute_runs(d.tolist(), least, exponent) for d in docs]


def test_long_repetitive_documents():
    assert periodic.find([np.zeros(100_000, np.int64)]) == [[(0, 100_000, 1)]]
    assert periodic.find([np.tile(np.arange(20_000), 4)]) == [[(0, 80_000, 20_000)]]
    assert periodic.find([np.arange(100_000)]) == [[]] and periodic.find([]) == []


def expected(doc_id, text):
    w = re.findall(SPACE, text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-(r[1] * 10**12 // r[2]), r[0], r[2]), default=None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *head, digest(listed), digest(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_op11_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices("abcdef", k=rng.choice([0, 1, 30, 90])))) for i in range(300)]
    rows += [(1000 + i, "\x0b x\ty " * 20 + "z " * 40) for i in range(30)]
    rows += [(7, None), (None, "no id " * 20), (8, ""), (9, " \n\t"), (9, " \n\t"), (10, "a b\x1cc " * 30), (10, "a b\x1cc " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 20


def test_op11_odd_rows(spark, odd_docs, no_docs):
    got = periodic.runs(odd_docs.withColumnRenamed("kept", "runs")).collect()
    assert len(got) == 10 and got[0].asDict().keys() >= {"runs", "runs_", "best", "collapsed"}
    long = next(r for r in got if r.doc_id == 7)
    assert long.best.period == 13 and long.best.length == 39_000 and len(long.collapsed.split()) == 13
    assert all(r.collapsed == "" and r.runs_ == [] and r.best is None for r in got if not (r.text or "").split())
    assert periodic.runs(no_docs).count() == 0
