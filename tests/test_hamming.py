"""The Hamming index against all pairs, its covering property, and skewed tables."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textassay.operators import hamming

FULL = (1 << 64) - 1


@given(st.integers(0, FULL), st.integers(0, 6), st.integers(1, 10**6), st.randoms(use_true_random=False))
@settings(deadline=None, max_examples=150)
def test_masks_cover_every_pair(x, distance, n, rng):
    y = x
    for b in rng.sample(range(64), distance):
        y ^= 1 << b
    assert any((x ^ y) & m == 0 for m in hamming.masks(distance, n))


def test_keys_grow_with_the_table():
    bits = lambda d, n: min(m.bit_count() for m in hamming.masks(d, n))
    assert bits(3, 1000) == 16 and bits(3, 10**9) >= 31 and bits(5, 10**8) >= 28 and bits(6, 10**9) >= 30
    assert all(len(hamming.masks(d, 10**12)) <= hamming.MOST_TABLES for d in range(7))
    whole = hamming.parts(FULL, 7)
    assert sum(whole) == FULL and len(whole) == 7 and max(p.bit_count() for p in whole) - min(p.bit_count() for p in whole) <= 1


def table(spark, rows, query=()):
    return spark.createDataFrame([(hamming.signed(x), x in query) for x in rows], "fingerprint long, query boolean").repartition(3)


def brute(rows, distance, query=()):
    rows = sorted(map(hamming.signed, rows))
    query = set(map(hamming.signed, query))
    both = [(a, b) for a in rows for b in rows if (a in query and b not in query if query else a < b)]
    return {(a, b, n) for a, b in both if 0 < (n := ((a ^ b) & FULL).bit_count()) <= distance}


@pytest.mark.parametrize("distance, hot", [(3, 512), (6, 512), (3, 4), (6, 3), (0, 1)])
def test_pairs_equal_brute_force_on_skewed_tables(spark, distance, hot):
    rng = random.Random(distance * 10 + hot)
    rows = {0, FULL, 1 << 63}
    for _ in range(40):  # families within a few bits of each other, and one half of the bits shared by many
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 4)):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 7)):
                y ^= 1 << b
            rows.add(y)
    rows |= {0xABCD1234 << 32 | rng.getrandbits(12) for _ in range(60)}
    got = hamming.near(table(spark, rows), distance, hot).collect()
    assert {tuple(r) for r in got} == brute(rows, distance) and len(got) == len(brute(rows, distance))


def test_query_side_and_empty_tables(spark):
    rng = random.Random(4)
    rows = {rng.getrandbits(8) | rng.getrandbits(3) << 40 for _ in range(80)}
    query = set(rng.sample(sorted(rows), 10))
    assert {tuple(r) for r in hamming.near(table(spark, rows, query), 5, 7).collect()} == brute(rows, 5, query)
    assert hamming.near(table(spark, []), 5).count() == 0
    null = spark.createDataFrame([(None, False), (None, False), (3, False)], "fingerprint long, query boolean")
    assert hamming.near(null, 3).count() == 0


def test_buckets_stay_bounded(spark):
    """4096 fingerprints that agree on 52 bits: no bucket holds more than HOT or 4 ** (distance + 1)."""
    rows = spark.range(4096).select((F.lit(0x5A5A << 40) + F.col("id")).alias("fingerprint"), F.lit(False).alias("query"))
    found, _ = hamming.index(rows, 3, 32)
    assert found.groupBy("mask", "key").count().agg(F.max("count")).first()[0] <= 4 ** (3 + 1)


@pytest.mark.parametrize("distance, hot", [(6, 512), (6, 3), (3, 4)])
def test_nearest_before_equals_brute_force_with_a_row_a_fingerprint(spark, distance, hot):
    rng = random.Random(distance + hot)
    centres = [rng.getrandbits(64) for _ in range(6)]
    rows = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(40)})
    rng.shuffle(rows)  # doc_id is the place; every third is no query
    rows += [0x5A5A << 40 | k for k in range(150)]  # more than a bucket's SMALL
    table = spark.createDataFrame([(hamming.signed(x), k % 3 != 0, k) for k, x in enumerate(rows)], "fingerprint long, query boolean, doc_id long").repartition(3)
    want = {}
    for k, x in enumerate(rows):
        best = min(((x ^ y).bit_count() for y in rows[:k]), default=64)
        if k % 3 and best <= distance:
            want[hamming.signed(x)] = best
    got = hamming.nearest_before(table, distance, hot).collect()
    assert {tuple(r) for r in got} == set(want.items()) and len(got) == len(want)


def test_a_pair_comes_from_one_bucket_without_a_shuffle(spark):
    """Of a dense family every pair agrees in many tables; it comes once, and no aggregation is needed for that."""
    rows = spark.range(1024).select(F.expr("CAST(conv(concat(repeat('10', 8), lpad(bin(id), 10, '0')), 2, 10) AS BIGINT)").alias("fingerprint"), F.lit(False).alias("query"))
    for hot in (hamming.HOT, 100):
        found = hamming.near(rows, 3, hot)
        assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 1024 * (10 + 45 + 120) // 2
