"""Percentiles by refinement against the built-in that holds all values."""

import random

import pytest
from pyspark.sql import functions as F

from textassay.operators import quantiles

WANTED = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("buckets", [128, 1024])
def test_equal_to_the_built_in(spark, monkeypatch, buckets):
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    rng = random.Random(buckets)
    rows = [("ties", float(rng.choice([1, 1, 1, 2, 7]))) for _ in range(300)] + [("one", 5.0), (None, 3.0), (None, 4.0), ("gone", None), ("gone", float("nan"))]
    rows += [("wide", rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300)) for _ in range(200)] + [("close", 1 + k * 2.0**-52) for k in range(40)] + [("same", 2.5)] * 50
    rows += [("far", -1.7e308), ("far", 1.7e308), ("far", 0.0), ("hot", 1.0)] + [("hot", rng.random()) for _ in range(1500)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r for r in quantiles.percentiles(df, "k", "v", WANTED).collect()}
    fine = df.where("v IS NOT NULL AND NOT isnan(v)")
    want = fine.groupBy("k").agg(*(F.percentile("v", F.lit(p)).alias(n) for n, p in WANTED.items())).collect()
    assert got.keys() == {r.k for r in want}
    for r in want:
        for n in WANTED:
            assert got[r.k][n] == pytest.approx(r[n], rel=1e-12, abs=0), (r.k, n)


def test_empty_table(spark):
    assert quantiles.percentiles(spark.createDataFrame([], "k string, v double"), "k", "v", WANTED).collect() == []
