"""Whitening against numpy's dense eigensolver, exact integers, and the defined odd cases."""

import math

import numpy as np
import pytest

from textassay.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, n string"


def reference(rows):
    """Usable ids, integers, and eigenpairs of the dense covariance of equally long vectors."""
    fine = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in fine], object)
    centred = (x - sum(x) / len(x)).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / len(x))
    return [i for i, _ in fine], x, centred, e[::-1], u[:, ::-1]


def held_against(rows, got, count=8):
    ids, x, centred, e, u = reference(rows)
    n, trace = len(x), e.sum()
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, min(count, x.shape[1]) + 1)) and all(len(v) == n for v in by.values())
    deviation = ((n * x - sum(x)) ** 2).sum(1)
    for k, own in by.items():
        expect = centred @ u[:, k - 1] / math.sqrt(e[k - 1])
        order = np.argsort(ids, kind="stable")
        own.sort(key=lambda r: r.vec_id)
        w = np.array([r.whitened for r in own])
        sign = np.sign(w @ expect[order])
        assert np.abs(sign * w - expect[order]).max() < 1e-8
        assert [r.deviation for r in own] == deviation[order].tolist() and {r.n for r in own} == {n}
        assert own[0].explained == pytest.approx(e[k - 1] / trace, rel=1e-9)
        assert own[0].identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def test_op12_query_equals_dense_solver(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    held_against(rows, queries.op12_embedding_whitening(spark, sf_dir).collect())


@pytest.mark.parametrize("gap", [1.0, 1e-2, 1e-4])
def test_jacobi_davidson_on_spectra(gap):
    rng = np.random.default_rng(3)
    dim = 200
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    e = np.sort(np.concatenate([1 + gap * np.arange(8), rng.uniform(0, 0.9, dim - 8)]))[::-1]
    a = (q * e) @ q.T
    passes = []

    def apply(v):
        passes.append(v.shape[1])
        return a @ v

    values, vectors = whitening.jacobi_davidson(apply, dim, 8)
    assert np.abs(values - e[:8]).max() < 1e-13 * dim
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-13
    assert len(passes) < 250


def test_jacobi_davidson_equal_values_and_small_spaces():
    for e in ([3, 3, 3, 1, 1, 0, 0], [2.0], [1, 1, 1, 1, 1, 1, 1, 1, 1, 1], [5, 0, 0]):
        q = np.linalg.qr(np.random.default_rng(1).standard_normal((len(e), len(e))))[0]
        a = (q * np.array(e, float)) @ q.T
        values, vectors = whitening.jacobi_davidson(lambda v, a=a: a @ v, len(e), 8)
        assert np.allclose(values, sorted(e, reverse=True)[:8], atol=1e-13) and np.abs(a @ vectors - vectors * values).max() < 1e-12


def test_op12_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(60)]
    rows += [(1, rows[1][1]), (7, rows[3][1]), (200, [40.0] * 5)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0, 3.0, 4.0]), (93, [float("nan")] * 5), (94, [float("inf")] + [0.0] * 4), (95, [1e300] * 5), (96, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], SCHEMA)
    held_against(rows, whitening.whiten(df).collect())
    null_id = whitening.whiten(spark.createDataFrame([(None, v, "x") for _, v in rows], SCHEMA)).collect()
    assert len(null_id) == 5 * len(rows) and all(r.vec_id is None for r in null_id)
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(*r, "x") for r in bad[:6]], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "x")] * 4, SCHEMA)).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0, 2.0 * i], "x") for i in range(9)], SCHEMA)).collect()
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1, rel=1e-9)
    huge = whitening.whiten(spark.createDataFrame([(i, [i * 1e12, -i * 1e12], "x") for i in range(3)], SCHEMA)).collect()
    assert {r.vec_id: r.deviation for r in huge} == {0: None, 1: 0, 2: None}


def test_op12_partial_sums_meet_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(200)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(13)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 4)
    held_against(rows, whitening.whiten(df).collect())
